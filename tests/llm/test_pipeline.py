import collections

from pyspark.sql import functions as F

import corpus_pipeline as p
from strandwise.llm import langid, packing, tokens

from .test_pii import base


def stage(name):
    return dict(p.STAGES)[name]


def test_order_of_stages():
    assert [name for name, _ in p.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]


def test_stages_against_plain_versions(spark, corpus, empty):
    rows, df = corpus
    columns = df.columns

    kept = stage("language_id")(spark, df, "").cache()
    assert kept.columns == columns
    model = tuple(sorted(langid.train(df.filter(langid.fold(5) != 0)).items()))
    wanted = collections.Counter((r[0], r[1], langid.classify(r[1], model)[0]) for r in rows if langid.classify(r[1], model)[2])
    assert collections.Counter((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()) == wanted

    single = stage("near_dedup")(spark, kept, "").cache()
    assert single.columns == columns
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert len(set(left)) == len(left) and set(left) <= {(r["doc_id"], r["text"]) for r in kept.collect()}

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1))

    sets = [shingles(t) for _, t in left]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert not any(alike(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :])
    # what is gone is like something that stayed
    gone = [shingles(r["text"]) for r in kept.collect() if (r["doc_id"], r["text"]) not in set(left)]
    assert all(any(alike(g, x) for x in sets) for g in gone)

    mail = single.withColumn("text", F.when(F.col("doc_id") == 30, F.concat("text", F.lit(" write to a.b@c.org"))).otherwise(F.col("text")))
    masked = stage("pii")(spark, mail, "").cache()
    assert masked.columns == columns and masked.count() == single.count()
    assert not any(base(r["text"]) for r in masked.collect())
    assert masked.filter("n_chars <> length(text)").count() == 0

    mixed = stage("mixing")(spark, masked, "").cache()
    assert mixed.columns == columns
    times = collections.Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= {(r["doc_id"], r["text"]) for r in masked.collect()}

    packed = stage("packing")(spark, mixed, "").collect()
    e = tokens.encoder(tokens.default_vocabulary())
    assert sum(r["length"] for r in packed) == sum(len(e.encode(r["text"], 2)) for r in mixed.collect())
    assert packing.WINDOW == 4096
    for name, f in p.STAGES:
        assert f(spark, empty, "").count() == 0, name
