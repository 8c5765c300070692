"""Token ids of whole texts by a public tokenizer file, word by word through a cache.

Where a vocabulary's rules never join characters across white space, a text's ids are
the ids of its white-space-separated words, one after another. That is so for rules
that are known here; a file with any other rules is asked for whole texts instead.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._common import release

#: Words are cut as bytes: only white space of one byte splits, other spaces are left to the tokenizer. So many are kept, in two generations.
_CACHE_WORDS = 300_000
#: Characters of text that are encoded together.
_LOT = 1_000_000
#: Marks that the splitting rule cuts off a word's last letter, all together.
_MARKS = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Letters up to this one are old enough to be letters in every Unicode version; the one letter whose lower case ends in a mark.
_OLD_LETTERS, _DOTTED = "\u0530", "\u0130"
#: What begins a special token in these files.
_SPECIAL = b"<|"
#: The rules, as tokenizer files write them, under which words can be encoded one by one (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Letters that these rules leave as they are: small ones, composed, and old enough; and words of nothing else, which are one piece each.
_KEPT = "".join(c for c in map(chr, range(0x61, ord(_OLD_LETTERS))) if c.isalpha() and c.lower() == c and unicodedata.is_normalized("NFC", c))
_one_piece = re.compile(f"[{_KEPT}]+").fullmatch
#: The characters that stand for bytes in these files; they differ from Latin-1 in bytes that print nothing.
_BYTES = "".join(chr(290 + b - 0x80 if 0x80 <= b <= 0xA0 else 323 if b == 0xAD else b) for b in range(256))
_state: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_at_spaces(rules: dict) -> bool:
    """Whether a tokenizer file's rules are those under which each word has its own ids: known normalizer and splitting rule, and special tokens that hold no white space and begin alike."""
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model, added = rules.get("model") or {}, rules.get("added_tokens") or []
    bytes_only = [x for x in steps[1:] if x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")]
    return (
        rules.get("normalizer") == _NORMALIZER
        and steps[0] == _SPLIT
        and len(bytes_only) == len(steps) - 1 == 1
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout")
        and not rules.get("truncation")
        and not rules.get("padding")
        and all(x["content"].encode().startswith(_SPECIAL) and not any(c.isspace() for c in x["content"]) and not x.get("normalized") and not x.get("single_word") for x in added)
    )


class Encoder:
    """Encodes texts as the tokenizers library does; ids of words seen before come from a bounded cache.

    The cache has two generations. A full one becomes the older, whose words come back
    when they are met again; so words that are met in every generation are learned once.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_word = splits_at_spaces(rules)
        # the same pieces and merges without the rules that change nothing in words of one piece
        self.merges = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []})) if self.by_word else None
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.words: int | None = None

    def encode(self, text: str | None, end: int) -> np.ndarray:
        """The text's ids, then ``end``; null counts as empty."""
        return self.encode_all([text], end)[0]

    def encode_all(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The same for several texts; what is new in them is learned at once."""
        if not self.by_word:
            return [np.array([*ids, end], dtype="<u4") for ids in self._ids([t or "" for t in texts])]
        words: list[bytes] = []
        ends = []
        for text in texts:
            if text:
                data = text.encode("utf-8", "replace")
                # the vocabulary is lower-case, but a special token and what composes with a mark keep their case
                words += (data.lower() if data.isascii() and _SPECIAL not in data else data).split()
            ends.append(len(words))
        if len(self.cache) > (self.words or _CACHE_WORDS) // 2:
            self.older, self.cache = self.cache, {}
        if new := set(words).difference(self.cache):
            lost = new.difference(self.older)
            met = new - lost
            self.cache.update(zip(met, map(self.older.get, met)))
            self._learn(lost)
        found = list(map(self.cache.get, words))
        out, start, last = [], 0, int(end).to_bytes(4, "little")
        for stop in ends:
            out.append(np.frombuffer(b"".join(found[start:stop]) + last, dtype="<u4"))
            start = stop
        return out

    def encode_rows(self, batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[object, np.ndarray]]:
        """(first column, ids) of rows of two columns, the second the text; lots of about _LOT characters are encoded together."""
        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= _LOT:
                    yield from zip(keys, self.encode_all(texts, end))
                    keys, texts, size = [], [], 0
        yield from zip(keys, self.encode_all(texts, end))
        release()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[bytes]) -> list[int]:
        """The ids of words of one piece each, one after another; their bytes go to the merges as the characters that stand for them."""
        text = codecs.charmap_decode(b" ".join(words), "strict", _BYTES)[0]
        return self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: set[bytes]) -> None:
        """Adds words to the cache. A word that ends in marks is a stem and its marks, which many words share."""
        cache, older, plain, letters, other, split, same = self.cache, self.older, set(), set(), set(), [], []
        for word in words:
            w = word
            if w.isalpha() and w.islower():
                plain.add(w)
                continue
            if w.isascii() and _SPECIAL not in w and (low := w.lower()) != w:
                same.append((word, low))
                if low in cache or low in words:
                    continue
                if low in older:
                    cache[low] = older[low]
                    continue
                w = low
            if w.isalpha():
                plain.add(w)
                continue
            stem = w.rstrip(_MARKS)
            n = len(stem)
            if 0 < n < len(w) and _SPECIAL not in w and _ends_in_letter(stem):
                tail = w[n:]
                split.append((w, stem, tail))
                if tail not in cache:
                    other.add(tail)
                if stem in cache:
                    continue
                if stem in older:
                    cache[stem] = older[stem]
                    continue
                w = stem
            if w.isalpha():
                plain.add(w)
            elif w.isascii():
                other.add(w)
            else:
                letter = w.decode("utf-8")
                (plain if _one_piece(letter) else letters if letter.isalpha() else other).add(w)
        # words of letters alone are encoded together: each ends with the only token that ends a word
        other = list(other)
        for together, encode in ((list(plain), self._pieces), (list(letters), lambda part: self._ids([b" ".join(part).decode("utf-8")])[0])):
            for at in range(0, len(together), 256):
                part = together[at : at + 256]
                ids = np.array(encode(part), dtype="<u4")
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != len(part):
                    other += part
                    continue
                data, start = ids.tobytes(), 0
                for w, end in zip(part, (4 * ends).tolist()):
                    cache[w] = data[start:end]
                    start = end
        for at in range(0, len(other), 256):
            part = other[at : at + 256]
            for w, ids in zip(part, self._ids([w.decode("utf-8") for w in part])):
                cache[w] = np.array(ids, dtype="<u4").tobytes()
        for w, stem, tail in split:
            cache[w] = cache[stem] + cache[tail]
        for w, low in same:
            cache[w] = cache[low]


def _ends_in_letter(stem: bytes) -> bool:
    """Whether a stem's normalised form is certain to end in a letter, so that marks behind it are a piece of their own."""
    last = stem[-1]
    if last < 128:
        return 97 <= last <= 122
    letter = unicodedata.normalize("NFC", stem.decode("utf-8"))[-1]
    return letter < _OLD_LETTERS and letter != _DOTTED and letter.isalpha()


def encoder(vocabulary: str, words: int | None = None) -> Encoder:
    """One encoder a worker process; ``words`` replaces _CACHE_WORDS."""
    if vocabulary not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state[vocabulary] = Encoder(vocabulary)
        release()  # reading a vocabulary takes several times what is kept
    _state[vocabulary].words = words
    return _state[vocabulary]


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
