import collections
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import lm
from strandwise.llm.langid import fold


def plain_scores(train, texts):
    """The model by its definition, in dictionaries."""
    token = lambda t: (t or "").encode().lower().split() + [lm.END]
    c, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = token(t)
        c.update(w)
        two.update(zip([lm.BEGIN, *w], w))
        three.update(zip([lm.BEGIN, *w], w, w[1:]))
    n, v = sum(c.values()), len(c)
    total2, kinds2, total3, kinds3 = (collections.Counter() for _ in range(4))
    for (a, _), k in two.items():
        total2[a] += k
        kinds2[a] += 1
    for (a, b, _), k in three.items():
        total3[a, b] += k
        kinds3[a, b] += 1
    out = []
    for t in texts:
        w, base, score = token(t), 0.0, 0.0
        for i, x in enumerate(w):
            p = (c[x] + 1) / (n + v + 1)
            base += math.log10(p)
            b = w[i - 1] if i else lm.BEGIN
            if total2[b]:
                p = max(two[b, x] - lm.DISCOUNT, 0) / total2[b] + lm.DISCOUNT * kinds2[b] / total2[b] * p
            a = (w[i - 2] if i > 1 else lm.BEGIN) if i else None
            if total3[a, b]:
                p = max(three[a, b, x] - lm.DISCOUNT, 0) / total3[a, b] + lm.DISCOUNT * kinds3[a, b] / total3[a, b] * p
            score += math.log10(p)
        out.append((len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("bin_text,lot,hot,vocabulary", [(lm.BIN_TEXT, lm.LOT_TOKENS, lm.HOT_TOKENS, lm.VOCABULARY_BYTES), (8_000, 500, 60, lm.VOCABULARY_BYTES), (20_000, 3_000, lm.HOT_TOKENS, 0)])
def test_scores(spark, corpus, monkeypatch, bin_text, lot, hot, vocabulary):
    """In one way or two, in one bin or many, with frequent contexts dealt or not, with the vocabulary in tasks or joined."""
    monkeypatch.setattr(lm, "LOT_TOKENS", lot)
    monkeypatch.setattr(lm, "VOCABULARY_BYTES", vocabulary)
    rows, df = corpus
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    trains = fold(7) != 2
    model = lm.train(df.filter(trains), bin_text=bin_text, hot_tokens=hot)
    assert (model.words.bins > 2) == (bin_text < lm.BIN_TEXT) and bool(len(model.words.hot[0])) == (hot == 60)
    expected = plain_scores([r[1] for r in rows if not held(r[0])], [r[1] for r in rows])
    key = lambda i: -1 if i is None else i
    wanted = sorted((key(r[0]), *e) for r, e in zip(rows, expected))
    asked = df.withColumnRenamed("score", "own")
    for out in (lm.score(asked, model, ("doc_id", "own")), lm.train_and_score(asked, trains, ("doc_id", "own"), bin_text=bin_text, hot_tokens=hot)):
        got = sorted((key(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect())
        for a, b in zip(got, wanted, strict=True):
            assert a[:4] == b[:4]
            assert math.isclose(a[4], b[4], rel_tol=1e-9)
            assert math.isclose(a[5], b[5], rel_tol=0.02, abs_tol=0.02)  # probabilities are quantised


def test_nothing_to_learn_from(spark, empty):
    model = lm.train(empty)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in lm.score(df, model).collect()}
    assert out[1]["n_known"] == 0 and out[1]["train_tokens"] == 0 and out[1]["score"] == 0.0 and out[2]["n_tokens"] == 1
    assert lm.score(empty, model).count() == 0


def test_names_of_kept_columns(spark):
    df = spark.createDataFrame([("a b", True, 3), ("b c", False, 4)], "text string, _trains boolean, _known int")
    out = lm.train_and_score(df, df["_trains"], ("text", "_trains", "_known")).collect()
    assert sorted((r["text"], r["_trains"], r["_known"], r["n_tokens"], r["n_known"]) for r in out) == [("a b", True, 3, 3, 3), ("b c", False, 4, 3, 2)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 56).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(0, 2**w - 1), max_size=80))))
def test_bits(case):
    width, values = case
    data = lm.pack_bits(np.array(values, np.uint64), width)
    assert len(data) <= len(values) * width // 8 + 9
    assert lm.read_bits(data, width, np.arange(len(values))).tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=80))
def test_level_of_hashes(hashes):
    words = np.array(sorted(hashes), np.uint64)
    level = lm.HashLevel(len(words), **lm.hash_level(words))
    asked = np.concatenate((words, np.array([0, 5, 2**64 - 1], np.uint64)))
    place = {int(w): i for i, w in enumerate(words)}
    assert level.index(asked).tolist() == [place.get(int(a), -1) for a in asked]


def test_levels_are_smaller_than_sorted_arrays():
    r = np.random.default_rng(3)
    words = np.unique(r.integers(0, 2**64, 100_000, dtype=np.uint64))
    assert sum(x.nbytes for x in lm.hash_level(words).values()) < 0.85 * words.nbytes
    pairs = np.unique(r.integers(0, 100_000, 400_000) << 32 | r.integers(0, 100_000, 400_000)).astype(np.uint64)
    level = lm.EliasFano.build((pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF), 100_000, 17)
    assert sum(x.nbytes for x in level.values()) < 0.35 * pairs.nbytes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**40), max_size=30), max_size=4), st.lists(st.floats(-1e6, 1e6), max_size=5))
def test_packing(arrays, doubles):
    given_ = [np.array(x, np.int64) for x in arrays] + [np.array(doubles, np.float64)]
    assert [x.tolist() for x in lm._unpacked(lm._packed(*given_))] == [x.tolist() for x in given_]


def test_successors_are_searched_within_their_context():
    words = np.array([1 << 40, 1 << 50, 1 << 60], np.uint64)
    key = lambda a, b: a << 32 | b
    bigrams = (np.array([key(0, 1), key(0, 2), key(2, 0)], np.uint64), np.array([3.0, 1.0, 2.0]))
    contexts, trigrams = np.array([key(0, 2), key(2, 2)], np.uint64), (np.array([key(0, 1), key(1, 0)], np.uint64), np.array([2.0, 2.0]))
    trie = lm.Trie.mapped(lm.build_trie(words, bigrams, contexts, trigrams))
    assert trie.index(np.concatenate((words, np.array([5, (1 << 60) + 1], np.uint64)))).tolist() == [0, 1, 2, -1, -1]
    v, u, t = np.array([0, 0, 2, 1, -1]), np.array([2, 1, 0, 0, 0]), np.array([1, 1, 0, 0, 1])
    single, d = np.full(5, 0.1), lm.DISCOUNT
    two = [(3 - d) / 4 + d * 2 / 4 * 0.1] * 2 + [(2 - d) / 2 + d / 2 * 0.1, 0.1, 0.1]
    wanted = [(2 - d) / 2 + d / 2 * two[0], two[1], two[2], 0.1, 0.1]
    assert np.allclose(trie.probability(v, u, t, single), wanted, rtol=1e-6)


def test_many_keys_are_found_without_selecting_each_bucket(monkeypatch):
    r = np.random.default_rng(4)
    keys = np.unique(r.integers(0, 500, 3_000) << 32 | r.integers(0, 100, 3_000)).astype(np.uint64)
    bucket, low = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
    asked, other = r.integers(0, 500, 4_000), r.integers(0, 128, 4_000)
    place = {int(k): i for i, k in enumerate(keys)}
    wanted = [place.get(int(a) << 32 | int(b), -1) for a, b in zip(asked, other)]
    level = lm.EliasFano(**lm.EliasFano.build(bucket, low, 500, 7), width=7)
    assert np.concatenate([level.find(asked[i : i + 9], other[i : i + 9]) for i in range(0, 4_000, 9)]).tolist() == wanted
    monkeypatch.setattr(lm.EliasFano, "_zero", None)
    assert level.find(asked, other).tolist() == wanted
