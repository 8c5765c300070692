import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandwise.llm import divergence


def brute(documents, top=10, least=10):
    """The definition in plain loops over (text, lang, source)."""
    docs = [(l or "", s or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))) for t, l, s in documents]
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, c in docs:
        groups.add((lang, source))
        for t, n in c.items():
            df[lang, t] += 1
            counts[lang, source][t] += n
            counts[lang, None][t] += n
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)

    def share(lang, source):
        terms = kept[lang]
        total = sum(counts[lang, source][t] for t in terms)
        return {t: 1 + (10**9 * (counts[lang, source][t] + 2)) // (total + 2 * len(terms)) for t in terms}

    out = []
    for lang, source in groups:
        p, whole = share(lang, source), share(lang, None)
        pairs = [(-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in p), other) for la, other in groups if la == lang and other != source for q in [share(lang, other)]]
        terms = [(-((p[t] - whole[t]) ** 2 // (p[t] + whole[t])), t) for t in p if counts[lang, source][t] > 0 and p[t] > whole[t]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -v, r + 1) for r, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [divergence.SHARD_ROWS, 40])
def test_audit(spark, corpus, shard_rows):
    rows, docs = corpus
    docs = docs.withColumn("term", F.lit(1)).withColumn("shard", F.lit("s")).withColumn("part", F.lit(None).cast("string")).withColumn("n", F.lit(0))
    found = divergence.audit(docs, shard_rows=shard_rows)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute([(r[1], r[2], r[3]) for r in rows])


def test_groups_without_kept_terms(spark):
    rows = [("alpha beta", "en", "a")] * 12 + [("", "en", "b"), (None, "en", "c"), ("only here", "xx", "a"), ("rare", "xx", "b"), (None, None, None), ("Γειά \x00 sou", "", "z\x00y"), ("ÄÖ äö", "en", "'; drop")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == brute(rows)


def test_counts_beyond_64_bits():
    """Shares of counts that fit no 64 bits when scaled are exact in a shard."""
    import pyarrow as pa

    n = {"a": 10**12, "b": 3}
    kept = pa.table({"lang": ["l"] * 2, "source": list(n), "term": ["t"] * 2, "n": pa.array(list(n.values()), pa.int64())})
    whole = sum(n.values()) + 5
    groups = pa.table({"lang": ["l"] * 2, "source": list(n), "total": pa.array([10**12 + 5, 3], pa.int64()), "whole": pa.array([whole] * 2, pa.int64()), "kinds": pa.array([2, 2], pa.int64()), "own": [True, True]})
    p = {s: 1 + 10**9 * (x + 2) // (t + 4) for s, x, t in (("a", 10**12, 10**12 + 5), ("b", 3, 3))}
    z = {s: 1 + 10**9 * 2 // (t + 4) for s, t in (("a", 10**12 + 5), ("b", 3))}
    q = 1 + 10**9 * (sum(n.values()) + 2) // (whole + 4)
    f = lambda x, y: (x - y) ** 2 // (x + y)
    got = divergence._parts(10)(kept, groups).to_pylist()
    assert sum(r["value"] for r in got if r["part"] == "pair") == f(p["a"], p["b"]) + f(z["a"], z["b"])  # one term both hold, one that neither does
    assert {r["source"]: r["value"] for r in got if r["part"] == "term"} == {s: f(p[s], q) for s in n if p[s] > q}


def test_nothing(empty):
    assert divergence.audit(empty).count() == 0


def test_partial_counts_of_a_task(spark, corpus, monkeypatch):
    docs = corpus[1]
    once = sorted(map(tuple, divergence.term_counts(docs).collect()))
    assert sum(r[3] for r in once) > 0
    import pyarrow as pa

    rows = [(r["lang"] or "", r["source"] or "", (r["text"] or "").encode()) for r in docs.collect()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "source", "text"])
    monkeypatch.setattr(divergence, "HELD_COUNTS", 5)
    monkeypatch.setattr(divergence, "_SLICE", 10)
    parts, total = list(divergence._count(iter([batch]))), defaultdict(lambda: [0, 0])
    assert len(parts) > 10
    for p in parts:
        for r in p.to_pylist():
            total[r["lang"], r["source"], r["term"]][0] += r["n"]
            total[r["lang"], r["source"], r["term"]][1] += r["df"]
    assert sorted((*k, *v) for k, v in total.items()) == once
