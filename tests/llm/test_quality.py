import collections
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.llm import quality
from strandwise.llm._common import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    times, covered, seen, dup = collections.Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def scored(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("w", F.lit(0))
    return quality.score_quality(df, df.select("doc_id").filter("doc_id < 3"), buckets=64)


def test_counts(spark, corpus):
    rows = [(r[0], r[1]) for r in corpus[0]] + [(1, "a b c " * 30), (1, "a\n\na\n b\na#*$"), (None, "x y z x y z q")]
    found = collections.Counter((r["text"], *(r[f] for f in FIELDS)) for r in scored(spark, rows).collect())
    assert found == collections.Counter((t, *brute(t)) for _, t in rows)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\x0b\u00a0#", max_size=60), min_size=20, max_size=30))
def test_counts_of_any_text(spark, texts):
    rows = list(enumerate(texts))
    found = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in scored(spark, rows).collect()}
    assert found == {i: brute(t) for i, t in rows}


def test_windows_whose_short_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(quality, "_POSITION_BITS", 3)  # positions no longer fit: pairs are sorted
    text = "a b c d " * 10 + "e f g h i j"
    row = spark.createDataFrame([(text,)], "text string").select(quality._repeated_words(words_of("text")).alias("n")).first()
    assert row["n"] == brute(text)[4]


def test_ratio_follows_its_definition(spark):
    import math

    import xxhash

    rows = [(0, "good text here"), (1, "bad ### text"), (2, "more good text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = quality.bucket_log_ratios(df, df.filter("doc_id <> 1"), 16)
    grams = {r["doc_id"]: r["g"] for r in df.select("doc_id", quality.gram_buckets("text", 16).alias("g")).collect()}
    raw, target = [0] * 16, [0] * 16
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += i != 1
    prior = 16 * quality.SMOOTHING
    for x, t, n in zip(ratios, target, raw):
        share = n / sum(raw)
        assert abs(x - (math.log((t + prior * share) / (sum(target) + prior)) - math.log(share) if n else 0.0)) < 1e-9
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert grams[1][0] == signed(xxhash.xxh64_intdigest(b"bad", 42)) % 16
    out = {r["doc_id"]: r["llr"] for r in quality.score_quality(df, df.filter("doc_id <> 1"), 16).collect()}
    assert all(abs(out[i] - sum(ratios[b] for b in g) / len(g)) < 1e-9 for i, g in grams.items())


def test_verdicts_separate(spark):
    r = random.Random(2)
    clean = ["the", "and", "of", "for", "with", "this", "from"]
    rows = [(i, " ".join(r.choice(clean) + r.choice("abcdef") for _ in range(80))) for i in range(60)]
    rows += [(100 + i, " ".join(r.choice("#$%&") * 3 + r.choice("qwxz") for _ in range(80))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0, None) for i, _ in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(df, quality.trusted_ids(labels), buckets=64).collect()
    assert all(r["kept"] == (r["doc_id"] < 100) for r in out if not r["base_failed"])


def test_empty(spark, empty):
    assert quality.score_quality(empty, empty.select("doc_id")).count() == 0


def test_columns_by_the_names_of_its_own(spark):
    df = spark.createDataFrame([(1, "some words here", 5, "x")], "doc_id long, text string, _ratios long, kept string")
    out = quality.score_quality(df, df.select("doc_id"))
    assert out.first()["_ratios"] == 5 and out.first()["kept"] is False
