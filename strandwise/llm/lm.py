"""Language-model scores from an n-gram trie with Elias-Fano levels.

The model is an interpolated trigram model over whole words, without pruning. It is cut
into bins by context, and a bin is a trie by itself: the words of its n-grams, for each
word the words seen after it, for each word the words seen before it (the contexts of
trigrams), and for each such pair the words seen after it. All four levels are
Elias-Fano coded: the first by the high bits of its word ids, the others by their
parents, whose unary part is at once the list of monotone pointers into the level, with
numbers of the bin's words, of as few bits as it needs, as low parts. A query searches
only among the successors of its context. A word's id is its place in the vocabulary,
which is an Elias-Fano level of 64-bit hashes. Discounted probabilities and back-off weights are quantised
to one byte, and tasks map a bin's levels into memory.

No task and no executor holds more of the model than the bin it works on: tokens go to
the bin of their context, with the number of their document, and what comes back is one
sum for each document and bin. Training and scoring take the same way, and where the
scored table holds the training documents they take it once. A context too frequent for
one task is dealt to several bins by the word before it; what they need to know of its
successors is counted beforehand.
"""

from __future__ import annotations

import itertools
import json
import mmap
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ._common import read_table, release, save
from .langid import fold

#: Discount of every count; bytes of text a bin; tokens that a task sends together; tokens of one context beyond which it is dealt to several bins.
DISCOUNT, BIN_TEXT, LOT_TOKENS, HOT_TOKENS = 0.75, 6 << 20, 2_000_000, 1_000_000
#: Bytes of the coded vocabulary up to which all tasks hold it; beyond, words meet their counts in a join.
VOCABULARY_BYTES = 64 << 20
#: White space cannot be a word, so these two stand apart from all words.
END, BEGIN = b" ", b"\n"
TOKENS, TRIE, SUCCESSORS, DOCS = range(4)
SENT = "bin int, kind int, lot long, data binary"
_CHUNK = 1 << 16
#: Bits of a level for each key asked up to which the level is read as a whole.
_MANY = 16
#: Steps of a log10 in which a bin's sums for a document are sent.
_STEPS = 10_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _hashes(words) -> np.ndarray:
    return np.fromiter(map(_hash, words), np.uint64, len(words))


# ---- numbers as bytes


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits each, one after another, and eight bytes that reads may run into."""
    parts = []
    for at in range(0, len(values) if width else 0, _CHUNK):
        part = values[at : at + _CHUNK].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits.ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def read_bits(data: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    """The numbers at ``index``; ``width`` is at most 56."""
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.int64) * width
    window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at >> 3]).view("<u8").ravel()
    return window >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers, or of doubles: as many bytes a number as the largest needs, byte by byte, compressed."""
    import zstandard

    head, parts = [], []
    for x in arrays:
        if x.dtype == np.float64:
            width = -8
        else:
            width = max(1, -(-int(x.max() if len(x) else 0).bit_length() // 8))
        planes = np.ascontiguousarray(x.astype("<f8" if width < 0 else "<u8")).view(np.uint8).reshape(-1, 8)
        head.append((len(x), width))
        parts.append(np.ascontiguousarray(planes[:, : abs(width)].T).tobytes())
    header = np.array(head, "<i8").tobytes()
    return len(head).to_bytes(2, "little") + zstandard.ZstdCompressor(level=1).compress(header + b"".join(parts))


def _unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    n, raw = int.from_bytes(data[:2], "little"), zstandard.ZstdDecompressor().decompress(data[2:])
    out, at = [], 16 * n
    for length, width in np.frombuffer(raw, "<i8", 2 * n).reshape(-1, 2).tolist():
        planes = np.zeros((length, 8), np.uint8)
        planes[:, : abs(width)] = np.frombuffer(raw, np.uint8, length * abs(width), at).reshape(abs(width), length).T
        out.append(planes.view("<f8" if width < 0 else "<u8").ravel())
        at += length * abs(width)
    return out


# ---- Elias-Fano


class EliasFano:
    """Rising keys (bucket, low part): the buckets in unary, the low parts in ``width`` bits each."""

    @staticmethod
    def build(bucket: np.ndarray, low: np.ndarray, buckets: int, width: int) -> dict[str, np.ndarray]:
        flags = np.zeros(-(-(len(bucket) + buckets) // 64) * 64, np.uint8)
        flags[bucket.astype(np.int64) + np.arange(len(bucket))] = 1
        zeros = 64 - flags.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        return {"bits": np.packbits(flags, bitorder="little"), "zeros": np.concatenate(([0], np.cumsum(zeros)[:-1])).astype(np.uint32) if len(zeros) else np.zeros(0, np.uint32), "low": pack_bits(low, width)}

    def __init__(self, bits: np.ndarray, zeros: np.ndarray, low: np.ndarray, width: int):
        self.bits, self.zeros, self.low, self.width = bits.reshape(-1, 8), zeros, low, width

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero, from 0."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        inside = 1 - np.unpackbits(self.bits[word], axis=1, bitorder="little")
        ranks = np.cumsum(inside, axis=1, dtype=np.uint8)
        return word * 64 + np.argmax(ranks == (k - self.zeros[word] + 1).astype(np.uint8)[:, None], axis=1)

    @cached_property
    def keys(self) -> np.ndarray:
        """All keys in order, bucket and low part as one number of 64 bits at most."""
        ones = np.flatnonzero(np.unpackbits(self.bits.ravel(), bitorder="little"))
        place = np.arange(len(ones))
        ones -= place
        return ones.astype(np.uint64) << np.uint64(self.width) | read_bits(self.low, self.width, place)

    def find(self, bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of each key; -1: not there. A bucket's keys end at its zero. Many keys are looked up in the level read once as a whole, few by its bits."""
        if _MANY * len(bucket) >= 64 * len(self.bits):
            asked = bucket.astype(np.uint64) << np.uint64(self.width) | low.astype(np.uint64)
            at = np.searchsorted(self.keys, asked)
            there = at < len(self.keys)
            there[there] = self.keys[at[there]] == asked[there]
            return np.where(there, at, -1)
        found = np.full(len(bucket), -1, np.int64)
        for at in range(0, len(bucket), _CHUNK):
            found[at : at + _CHUNK] = self._find(bucket[at : at + _CHUNK].astype(np.int64), low[at : at + _CHUNK].astype(np.uint64))
        return found

    def _find(self, bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
        hi = self._zero(bucket) - bucket
        lo = np.zeros_like(hi)
        later = bucket > 0
        lo[later] = self._zero(bucket[later] - 1) - (bucket[later] - 1)
        end, open_ = hi.copy(), np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = read_bits(self.low, self.width, mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        there = np.flatnonzero(lo < end)
        there = there[read_bits(self.low, self.width, lo[there]) == low[there]]
        found = np.full(len(bucket), -1, np.int64)
        found[there] = lo[there]
        return found


def _high_bits(n: int) -> int:
    """High bits of n hashes: a bucket holds about one, and low parts have 56 bits at most."""
    return max(8, int(n).bit_length() - 1)


def hash_level(hashes: np.ndarray) -> dict[str, np.ndarray]:
    """A level of rising 64-bit hashes."""
    high = _high_bits(len(hashes))
    return EliasFano.build(hashes >> np.uint64(64 - high), hashes & np.uint64((1 << 64 - high) - 1), 1 << high, 64 - high)


class HashLevel(EliasFano):
    def __init__(self, n: int, bits: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.high = _high_bits(n)
        super().__init__(bits, zeros, low, 64 - self.high)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        found = self.find(hashes >> np.uint64(64 - self.high), hashes & np.uint64((1 << 64 - self.high) - 1))
        vars(self).pop("keys", None)  # tasks hold all levels of a vocabulary
        return found


# ---- a bin's trie


def _quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a value and the 256 values that the bytes stand for: the values themselves if they are so few, else the means of equal ranges."""
    if not len(values):
        return np.array([], np.uint8), np.zeros(256)
    distinct, codes = np.unique(values, return_inverse=True)
    if len(distinct) > 256:
        edges = np.linspace(distinct[0], distinct[-1], 257)[1:-1]
        codes = np.searchsorted(edges, values, side="right")
    sums, n = np.bincount(codes, values, 256), np.bincount(codes, minlength=256)
    return codes.astype(np.uint8), np.where(n > 0, sums / np.maximum(n, 1), 0.0)


def _level(parent: np.ndarray, word: np.ndarray, counts: np.ndarray, parents: int, width: int, discount: float, name: str) -> dict[str, np.ndarray]:
    """A level of successors with their quantised shares and their parents' weights; keys (parent, word) rise."""
    total, kinds = np.bincount(parent, counts, parents), np.bincount(parent, minlength=parents)
    share = np.log10(np.maximum(counts - discount, 1e-9) / total[parent]) if len(parent) else np.array([])
    left = np.log10(np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0))
    out = EliasFano.build(parent, word, parents, width)
    out["share"], out["share_book"] = _quantise(share)
    out["left"], out["left_book"] = _quantise(left)
    return {f"{name}_{k}": v for k, v in out.items()}


def build_trie(words: np.ndarray, bigrams: tuple, contexts: np.ndarray, trigrams: tuple, discount: float = DISCOUNT) -> bytes:
    """A trie as bytes. ``words``: rising ids. ``bigrams``: rising v << 32 | t of word indexes, and counts. ``contexts``: rising
    v << 32 | u. ``trigrams``: rising context << 32 | t, contexts by index, and counts."""
    n, width = len(words), max(1, int(max(len(words) - 1, 1)).bit_length())
    rest = max(0, int(words[-1] if n else 0).bit_length() - width)
    sections = {f"words_{k}": v for k, v in EliasFano.build((words >> np.uint64(rest)).astype(np.int64), words & np.uint64((1 << rest) - 1), (int(words[-1]) >> rest) + 1 if n else 1, rest).items()}
    sections |= _level(*_halves(bigrams[0]), bigrams[1], n, width, discount, "after")
    sections |= {f"before_{k}": v for k, v in EliasFano.build(*_halves(contexts), n, width).items()}
    sections |= _level(*_halves(trigrams[0]), trigrams[1], len(contexts), width, discount, "third")
    head, at = {"n": n, "width": width, "rest": rest, "last": int(words[-1]) if n else -1, "parts": {}}, 0
    for name, x in sections.items():
        head["parts"][name] = [at, len(x), x.dtype.str]
        at += -(-x.nbytes // 64) * 64
    header = json.dumps(head).encode()
    start = -(-(8 + len(header)) // 64) * 64
    out = bytearray(start + at)
    out[:8] = start.to_bytes(8, "little")
    out[8 : 8 + len(header)] = header
    for name, x in sections.items():
        a = start + head["parts"][name][0]
        out[a : a + x.nbytes] = np.ascontiguousarray(x).tobytes()
    return bytes(out)


class Trie:
    """A bin's trie over any buffer, a memory map in tasks."""

    def __init__(self, data):
        start = int.from_bytes(bytes(data[:8]), "little")
        head = json.loads(bytes(data[8:start]).rstrip(b"\0"))
        part = {name: np.frombuffer(data, dtype, n, start + at) for name, (at, n, dtype) in head["parts"].items()}
        level = lambda name: (part[f"{name}_bits"], part[f"{name}_zeros"], part[f"{name}_low"])
        self.part, self.last, self.rest = part, head["last"], head["rest"]
        self.words = EliasFano(*level("words"), self.rest)
        self.after, self.before, self.third = (EliasFano(*level(x), head["width"]) for x in ("after", "before", "third"))

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Number of each word id among this trie's words; -1: not there."""
        found, within = np.full(len(ids), -1, np.int64), np.flatnonzero(ids <= self.last) if self.last >= 0 else np.zeros(0, np.int64)
        one = ids[within].astype(np.uint64)
        found[within] = self.words.find((one >> np.uint64(self.rest)).astype(np.int64), one & np.uint64((1 << self.rest) - 1))
        return found

    def _values(self, name: str, index: np.ndarray, otherwise: float) -> np.ndarray:
        codes, book = self.part[name], 10.0 ** self.part[f"{name}_book"]
        return np.where(index >= 0, book[codes[np.maximum(index, 0)]] if len(codes) else otherwise, otherwise)

    def context(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Index of each context of trigrams, v after u; -1: not there."""
        found = np.full(len(v), -1, np.int64)
        pair = np.flatnonzero((v >= 0) & (u >= 0))
        found[pair] = self.before.find(v[pair], u[pair])
        return found

    def probability(self, v: np.ndarray, u: np.ndarray, t: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Of words t after u and v, all as indexes of this trie's words (-1: unknown); ``single``: the words' own probabilities."""
        return self.in_context(v, self.context(v, u), t, single)

    def in_context(self, v: np.ndarray, context: np.ndarray, t: np.ndarray, single: np.ndarray) -> np.ndarray:
        """The same with the contexts' indexes."""
        both = np.flatnonzero((v >= 0) & (t >= 0))
        share = np.zeros(len(v))
        share[both] = self._values("after_share", self.after.find(v[both], t[both]), 0.0)
        prob = share + self._values("after_left", v, 1.0) * single
        both, share = np.flatnonzero((context >= 0) & (t >= 0)), np.zeros(len(v))
        share[both] = self._values("third_share", self.third.find(context[both], t[both]), 0.0)
        return share + self._values("third_left", context, 1.0) * prob


# ---- words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of a task's words, summed a million distinct words at a time; a document has one beginning and one end."""
    counts: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(_hashes(counts).view(np.int64)), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["hash", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            counts[END] += 1
            counts[BEGIN] += 1
            if len(counts) > 1_000_000:
                yield rows()
                counts = Counter()
    if counts:
        yield rows()
    release()


def _code_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (first, start, n, data): rising hashes with counts as coded levels of a million words; start is the first word's id."""
    held: list = []

    def row(h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        level = hash_level(h)
        data = _packed(level["bits"], level["zeros"], level["low"], n)
        return pa.RecordBatch.from_arrays([pa.array(h[:1].view(np.int64)), pa.array(ids[:1]), pa.array([len(h)], pa.int64()), pa.array([data], pa.binary())], names=["first", "start", "n", "data"])

    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append((batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
        if held and (batch is None or sum(len(h) for h, *_ in held) >= 1_000_000):
            yield row(*(np.concatenate(x) for x in zip(*held)))
            held = []
    release()


class Words:
    """The vocabulary's coded levels, in the order of their hashes."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        rows = sorted((first & (1 << 64) - 1, start, n, data) for first, start, n, data in rows)
        self.first = np.array([r[0] for r in rows], np.uint64)
        self.levels = []
        for _, start, n, data in rows:
            bits, zeros, low, counts = _unpacked(data)
            self.levels.append((start, HashLevel(n, bits.astype(np.uint8), zeros.astype(np.uint32), low.astype(np.uint8)), counts.astype(np.int64)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of each hash."""
        ids, out, level = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.searchsorted(self.first, hashes, side="right") - 1
        for k, (start, words, counts) in enumerate(self.levels):
            mine = np.flatnonzero(level == k)
            if len(mine):
                index = words.index(hashes[mine])
                there = index >= 0
                ids[mine[there]], out[mine[there]] = start + index[there], counts[index[there]]
        return ids, out


@dataclass
class Vocabulary:
    """Words of a corpus: (h, id, n) in the order of their hashes and the coded levels as tables, the totals, and how contexts are dealt to bins.

    ids run up to n_words; n_words itself is a document's beginning, and one more an unknown word.
    """

    ranked: DataFrame
    levels: DataFrame
    n_words: int
    n_tokens: int
    bins: int
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]  # rising ids, first bins and numbers of bins of frequent contexts
    coded_bytes: int

    @property
    def all_bins(self) -> int:
        return self.bins + int(self.hot[2].sum())


def vocabulary(docs: DataFrame, text_col: str = "text", bin_text: int = BIN_TEXT, hot_tokens: int = HOT_TOKENS) -> Vocabulary:
    """Counts the words of all rows. Frequent contexts are at most as many as the tokens by ``hot_tokens``."""
    texts = docs.select(F.col(text_col).alias("text"))
    counts = save(texts.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    own = F.col("hash") == F.lit(np.array([_hash(BEGIN)], np.uint64).view(np.int64)[0].item())
    # the order of unsigned numbers
    flipped = counts.filter(~own).select(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))).alias("h"), "n")
    ranked = save(global_rank(flipped, ["h"], row="id").select("h", "id", "n"), "ranked-words")
    levels = save(ranked.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(_code_words, "first long, start long, n long, data binary"), "vocabulary")
    total = ranked.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_words, size = total[0] or 0, levels.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0
    text = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    frequent = ranked.filter(F.col("n") > hot_tokens).select("id", "n").union(counts.filter(own & (F.col("n") > hot_tokens)).select(F.lit(n_words).cast("long"), "n"))
    rows = sorted((r["id"], -(-r["n"] // hot_tokens)) for r in frequent.collect())
    parts, bins = np.array([k for _, k in rows], np.int64), max(1, -(-text // bin_text))
    return Vocabulary(ranked, levels, n_words, total[1] or 0, bins, (np.array([i for i, _ in rows], np.int64), bins + np.cumsum(parts) - parts, parts), size)


# ---- tokens on their way


class Lot:
    """Documents of one task whose tokens go together; words are numbers of the lot."""

    def __init__(self):
        self.place = defaultdict(itertools.count().__next__)
        self.begin = self.place[BEGIN]
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        words = words_of(text)
        words.append(END)
        self.tokens.append(np.fromiter(map(self.place.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def close(self) -> None:
        self.hashes = _hashes(self.place)
        del self.place
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.t = np.concatenate(self.tokens)
        self.tokens = []
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.v = np.concatenate(([self.begin], self.t[:-1])).astype(np.int32)
        self.v[self.starts] = self.begin
        # the first word has no word but the beginning before it: its context is a pair of beginnings
        self.u = np.concatenate(([self.begin], self.v[:-1])).astype(np.int32)
        self.u[self.starts] = self.begin
        self.number = self.t

    def name(self, ids: np.ndarray, n_words: int) -> None:
        """Turns the lot's numbers of words into ids of the vocabulary, of 32 bits as in pairs; ``number`` keeps the words' numbers."""
        ids = np.where(ids < 0, n_words + 1, ids).astype(np.uint32)
        ids[self.begin] = n_words
        self.t, self.v, self.u = (ids[x] for x in (self.t, self.v, self.u))


def _mixed(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.asarray(n).astype(np.uint64)).astype(np.int64)


def _bins(lot: Lot, vocab_bins: int, hot: tuple, n_words: int) -> np.ndarray:
    """Of each token, by its context; a frequent one's tokens by the word before it, a beginning's by the token."""
    out = _mixed(lot.v, vocab_bins).astype(np.int32)
    ids, first, parts = hot
    if len(ids):
        at = np.minimum(np.searchsorted(ids, lot.v), len(ids) - 1)
        rows = np.flatnonzero(ids[at] == lot.v)
        k = at[rows]
        out[rows] = first[k] + _mixed(np.where(lot.v[rows] == n_words, lot.t[rows], lot.u[rows]), parts[k])
    return out


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lot, list, list]]:
    """(lot, its rows' batches of other columns, their word counts if any); the text is the last column but the counts."""
    lot, rows, known = Lot(), [], []
    for batch in batches:
        at = 0
        for k, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
            lot.add(text.as_py())
            if lot.size >= LOT_TOKENS:
                rows.append(batch.slice(at, k + 1 - at))
                yield lot, rows, known
                lot, rows, at = Lot(), [], k + 1
        rows.append(batch.slice(at))
    if lot.size:
        yield lot, rows, known


def _message(lot: Lot, at: np.ndarray, counts: np.ndarray, trains: np.ndarray) -> bytes:
    """Tokens ``at`` (sorted by context, then document) of one bin: contexts in runs, words before, words, counts of the distinct words, documents, times, and which documents train. ``counts``: of the lot's words."""
    v, u, t, doc = lot.v[at], lot.u[at], lot.t[at], lot.doc[at]
    first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (t[1:] != t[:-1]) | (doc[1:] != doc[:-1]))))
    times = np.diff(np.append(first, len(at)))
    v, u, t, doc = v[first], u[first], t[first], doc[first]
    runs = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    seen = np.zeros(len(lot.lengths), bool)
    seen[doc] = True
    docs, own = np.flatnonzero(seen), (np.cumsum(seen) - 1)[doc]
    step = np.diff(own, prepend=0)
    step[runs] = own[runs]  # documents rise within a context
    once = np.unique(t, return_index=True)[1]
    return _packed(np.diff(v[runs], prepend=0), np.diff(np.append(runs, len(v))), u, t, counts[lot.number[at[first[once]]]], step, times, docs, trains[docs])


def _tokens_of(data: bytes) -> tuple[np.ndarray, ...]:
    """(v, u, t, distinct words, their counts, document numbers, times, documents, trains)"""
    runs, sizes, u, t, counts, step, times, docs, trains = _unpacked(data)
    sizes, step = sizes.astype(np.int64), step.astype(np.int64)
    starts, own = np.cumsum(sizes) - sizes, np.cumsum(step)
    own -= np.repeat(own[starts] - step[starts], sizes)
    v = np.repeat(np.cumsum(runs), sizes).astype(np.uint32)
    u, t = u.astype(np.uint32), t.astype(np.uint32)
    return v, u, t, np.unique(t), counts.astype(np.int64), own.astype(np.int32), times.astype(np.float32), docs, trains.astype(bool)


def _send(vocab: Vocabulary, words: list | None, carried: list[str]):
    """Messages of a task's documents: their tokens by bin, and what is known of the documents by themselves."""
    bins, hot, all_bins, n_words, n_tokens = vocab.bins, vocab.hot, vocab.all_bins, vocab.n_words, vocab.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = Words(words.value) if words is not None else None

        def row(b: int, kind: int, lot: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([kind], pa.int32()), pa.array([lot], pa.int64()), pa.array([data], pa.binary())], names=["bin", "kind", "lot", "data"])

        for k, (lot, rows, _) in enumerate(_lots(batches)):
            lot.close()
            number = (TaskContext.get().partitionId() << 24) + k
            table = pa.Table.from_batches(rows)
            ids, counts = held.find(lot.hashes) if held is not None else _given_words(table, lot.hashes)
            lot.name(ids, n_words)
            single = np.log10((counts + 1.0) / (n_tokens + n_words + 1.0))
            # what follows an unknown word is not seen after it
            alone = lot.v == n_words + 1
            sums = [np.add.reduceat((counts > 0).astype(np.int64)[lot.number], lot.starts)]
            own = single[lot.number]
            sums.append(np.add.reduceat(own, lot.starts))
            own[~alone] = 0.0
            sums.append(np.add.reduceat(own, lot.starts))
            del own
            about = table.select(carried).combine_chunks()
            for name, x in zip(("n_tokens", "n_known", "base_score", "alone"), (lot.lengths, *sums)):
                about = about.append_column(name, pa.array(x))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(about)
            yield row(number % all_bins, DOCS, number, sink.getvalue().to_pybytes())
            trains = table.column("_trains").to_numpy().astype(np.uint8)
            of, sent = _bins(lot, bins, hot, n_words), np.flatnonzero(~alone)
            order = of[sent].astype(np.int64) << 40
            order |= lot.v[sent]
            order = sent[np.argsort(order, kind="stable")]
            ends, start = np.flatnonzero(np.diff(of[order], append=-1)) + 1, 0
            for end in ends.tolist():
                at = order[start:end]
                yield row(int(of[at[0]]), TOKENS, number, _message(lot, at, counts, trains))
                start = end
            del lot, rows, table, of, sent, order, single, alone, ids, counts
            release()
        release()

    return run


def _given_words(table: pa.Table, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts that came with the rows (``_known``: lists of hash, id and n)."""
    values = table.column("_known").combine_chunks().flatten()
    h, ids, n = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("hash", "id", "n"))
    h, first = np.unique(h.view(np.uint64), return_index=True)
    if not len(h):
        return np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
    return np.where(h[at] == hashes, ids[first][at], -1), np.where(h[at] == hashes, n[first][at], 0)


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = _hashes(dict.fromkeys([*words_of(text.as_py()), END]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(own.view(np.int64))], names=["_row", "hash"])


def _named(rows: DataFrame, vocab: Vocabulary):
    """(rows, words): a vocabulary within VOCABULARY_BYTES goes to all tasks; of a larger one the rows get their own words by a join."""
    if vocab.coded_bytes <= VOCABULARY_BYTES:
        return rows, rows.sparkSession.sparkContext.broadcast([tuple(r) for r in vocab.levels.select("first", "start", "n", "data").collect()])
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()), "lm-rows")
    asked = rows.select("_row", "text").mapInArrow(_own_words, "_row long, hash long")
    words = vocab.ranked.select(F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("hash"), "id", "n")
    known = asked.join(words, "hash").groupBy("_row").agg(F.collect_list(F.struct("hash", "id", "n")).alias("_known"))  # a document's own words
    return rows.join(known, "_row", "left").drop("_row"), None


def _messages(rows: DataFrame, vocab: Vocabulary, carried: list[str]) -> DataFrame:
    """Messages of ``rows`` (carried columns, _trains, text), and what those that train tell of frequent contexts."""
    given, words = _named(rows, vocab)
    sent = given.mapInArrow(_send(vocab, words, carried), SENT)
    return sent.unionByName(_successors(given.filter("_trains"), vocab, words)) if len(vocab.hot[0]) else sent


def _hot_pairs(vocab: Vocabulary, words):
    hot, n_words = vocab.hot[0], vocab.n_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words(words.value) if words is not None else None
        for lot, rows, _ in _lots(batches):
            lot.close()
            lot.name((held.find(lot.hashes) if held is not None else _given_words(pa.Table.from_batches(rows), lot.hashes))[0], n_words)
            rows = np.flatnonzero(np.isin(lot.v, hot))
            pairs, n = np.unique(_pair(lot.v[rows], lot.t[rows]), return_counts=True)
            v, t = _halves(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(t), pa.array(n)], names=["v", "t", "n"])

    return run


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, t, n = (batch.column(i).to_numpy() for i in range(3))
        for one in np.unique(v):
            mine = v == one
            yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([_packed(np.array([one]), t[mine], n[mine])], pa.binary())], names=["v", "data"])


def _successors(given: DataFrame, vocab: Vocabulary, words) -> DataFrame:
    """Messages to all bins of each frequent context: the words seen after it, with counts. ``given``: training rows, as ``_named`` gives them."""
    ids, first, parts = vocab.hot
    pairs = given.mapInArrow(_hot_pairs(vocab, words), "v long, t long, n long").groupBy("v", "t").agg(F.sum("n").alias("n"))
    packed = save(pairs.repartition("v", F.pmod("t", F.lit(64))).sortWithinPartitions("v").mapInArrow(_pack_pairs, "v long, data binary"), "hot-successors")
    table = given.sparkSession.createDataFrame([(int(i), int(a), int(k)) for i, a, k in zip(ids, first, parts)], "v long, a int, k int")
    bins = packed.join(F.broadcast(table), "v").select(F.explode(F.sequence("a", F.expr("a + k - 1"))).alias("bin"), "data")  # a row a frequent context
    return bins.select("bin", F.lit(SUCCESSORS).alias("kind"), F.lit(0).cast("long").alias("lot"), "data")


# ---- a bin


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys of those that weigh anything, and their summed weights."""
    kept = weights > 0
    found, at = np.unique(keys[kept], return_inverse=True)
    return found, np.bincount(at, weights[kept], len(found))


def _learn(v: np.ndarray, u: np.ndarray, t: np.ndarray, times: np.ndarray, successors: list, begin: int, discount: float) -> bytes:
    """The trie of a bin's training tokens; words as ids. A frequent context's successors are given."""
    if successors:
        given = [_unpacked(x) for x in successors]
        bigrams = _sums(np.concatenate([_pair(np.repeat(h, len(x)), x) for h, x, _ in given]), np.concatenate([n.astype(np.float64) for *_, n in given]))
    else:
        bigrams = _sums(_pair(v, t), times)
    # two beginnings tell no more than one
    trained = times * (v != begin)
    contexts, _ = _sums(_pair(v, u), trained)
    trigrams = _sums(_pair(np.searchsorted(contexts, _pair(v, u)), t), trained)
    words = np.unique(np.concatenate([*_halves(bigrams[0]), *_halves(contexts), _halves(trigrams[0])[1]]))
    local = lambda x: np.searchsorted(words, x)
    own = lambda keys: _pair(*map(local, _halves(keys)))
    context, third = _halves(trigrams[0])
    return build_trie(words.astype(np.uint64), (own(bigrams[0]), bigrams[1]), own(contexts), (_pair(context, local(third)), trigrams[1]), discount)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _answer(vocab: Vocabulary, discount: float, tries: bool, sums: bool):
    """A bin's messages to its trie and to the sums of its documents."""
    total, begin = vocab.n_tokens + vocab.n_words + 1, vocab.n_words

    def run(group: pa.Table) -> pa.Table:
        kinds, lots, data = group.column("kind").to_pylist(), group.column("lot").to_pylist(), group.column("data")
        number, out = group.column("bin")[0].as_py(), []
        of_kind = lambda kind: sorted((lots[i], i) for i in range(len(kinds)) if kinds[i] == kind)
        out += [(number, DOCS, lot, data[i].as_py()) for lot, i in of_kind(DOCS)] if sums else []
        sent, given = of_kind(TOKENS), [data[i].as_py() for _, i in of_kind(TRIE)]
        if sent:
            held = [_tokens_of(data[i].as_py()) for _, i in sent]
            v, u, t = (np.concatenate([h[k] for h in held]) for k in range(3))
            words, first = np.unique(np.concatenate([h[3] for h in held]), return_index=True)
            single = (np.concatenate([h[4] for h in held])[first] + 1.0) / total
            docs = [h[5:] for h in held]
            del held
            if not given:
                weights = np.concatenate([times * trains[own] for own, times, _, trains in docs])
                given = [_learn(v, u, t, weights, [data[i].as_py() for _, i in of_kind(SUCCESSORS)], begin, discount)]
        if tries and given:
            out.append((number, TRIE, 0, given[0]))
        if sums and sent:
            trie = Trie.mapped(given[0])
            pairs, of = np.unique(_pair(v, u), return_inverse=True)
            del v, u
            keys, of = np.unique(_pair(of.ravel(), t), return_inverse=True)
            del t
            after, before = (trie.index(x).astype(np.int32) for x in _halves(pairs))
            context, known = trie.context(after, before).astype(np.int32), trie.index(words)
            del pairs, before
            prob = np.zeros(len(keys), np.float32)
            for a in range(0, len(keys), 500_000):
                pair, word = _halves(keys[a : a + 500_000])
                word = np.searchsorted(words, word.astype(words.dtype))
                prob[a : a + 500_000] = np.log10(trie.in_context(after[pair], context[pair], known[word], single[word]))
            of, start = of.ravel(), 0
            for (lot, _), (own, times, names, _) in zip(sent, docs):
                score = np.bincount(own, prob[of[start : start + len(own)]] * times, len(names))
                start += len(own)
                out.append((number, TOKENS, lot, _packed(names, np.rint(-score * _STEPS).astype(np.int64))))
        columns = list(zip(*out)) if out else [(), (), (), ()]
        release()
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bin", "kind", "lot", "data"])

    return run


def _assemble(n_tokens: int):
    """A lot's documents with the sums that the bins sent, in the order of the bins."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("kind").to_pylist(), group.column("bin").to_pylist(), group.column("data").to_pylist()), key=lambda r: r[:2])
        docs = pa.ipc.open_stream(rows[-1][2]).read_all()
        steps = np.zeros(docs.num_rows, np.int64)
        for kind, _, data in rows[:-1]:
            names, sums = _unpacked(data)
            steps[names.astype(np.int64)] += sums.astype(np.int64)
        out = docs.drop_columns(["alone"]).append_column("score", pa.array(docs.column("alone").to_numpy() - steps / _STEPS))
        at = out.schema.get_field_index("base_score")
        return out.add_column(at, "train_tokens", pa.array(np.full(docs.num_rows, n_tokens)))

    return run


# ---- models


@dataclass
class Model:
    """The tries of all bins, a table in the shared folder, and the vocabulary."""

    words: Vocabulary
    tries: DataFrame


def _carried(docs: DataFrame, keep: tuple, trains: Column, text_col: str) -> tuple[DataFrame, list[str]]:
    names = [f"_c{i}" for i in range(len(keep))]
    return docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], F.coalesce(trains, F.lit(False)).alias("_trains"), F.col(text_col).alias("text")), names


def _scored(messages: DataFrame, vocab: Vocabulary, discount: float, docs: DataFrame, names: list[str], keep: tuple) -> DataFrame:
    answers = save(messages.groupBy("bin").applyInArrow(_answer(vocab, discount, False, True), SENT), "lm-sums")
    fields = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{fields}{', ' if fields else ''}n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = answers.groupBy("lot").applyInArrow(_assemble(vocab.n_tokens), schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "n_tokens", "n_known", "train_tokens", "base_score", "score")


def train(docs: DataFrame, text_col: str = "text", discount: float = DISCOUNT, bin_text: int = BIN_TEXT, hot_tokens: int = HOT_TOKENS) -> Model:
    """The model of all rows of ``docs``. Null texts count as empty: they teach an end after a beginning. Other columns are not read."""
    vocab = vocabulary(docs, text_col, bin_text, hot_tokens)
    rows, names = _carried(docs, (), F.lit(True), text_col)
    sent = _messages(rows, vocab, names)
    return Model(vocab, save(sent.groupBy("bin").applyInArrow(_answer(vocab, discount, True, False), SENT), "tries"))


def score(docs: DataFrame, model: Model, keep: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` with n_tokens, n_known, train_tokens, base_score and score (both log10) of every row.

    Null texts count as empty and have their end alone. Nothing is joined by id: ids
    may repeat or be null, and kept columns may have any names but those of the
    results. Without training text every token is unknown. An empty table gives no rows.
    Texts of any length are scored whole, their tokens in the bins of their contexts.
    """
    rows, names = _carried(docs, keep, F.lit(False), text_col)
    return _scored(_messages(rows, model.words, names).unionByName(model.tries), model.words, DISCOUNT, rows, names, keep)


def train_and_score(docs: DataFrame, trains: Column, keep: tuple = ("doc_id",), text_col: str = "text", discount: float = DISCOUNT, bin_text: int = BIN_TEXT, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """All rows as ``score`` gives them, by the model that ``train`` makes of the rows where ``trains`` is true; every token goes to its bin once, to teach and to be scored."""
    taught = docs.filter(trains)
    vocab = vocabulary(taught, text_col, bin_text, hot_tokens)
    rows, names = _carried(docs, keep, trains, text_col)
    return _scored(_messages(rows, vocab, names), vocab, discount, rows, names, keep)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(7) == 2
    return train_and_score(docs.select("doc_id", held_out.alias("held_out"), "text"), ~F.col("held_out"), ("doc_id", "held_out"))
