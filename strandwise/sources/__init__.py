"""Readers and writers of sequence collections and suffix arrays."""
