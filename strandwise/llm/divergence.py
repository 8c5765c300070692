"""Divergence of sources: how far the term distributions of a language's sources are apart, and by which terms.

Term counts are dealt to shards by the hash of language and term. In a shard DuckDB runs
vectorised SQL over the shard's rows: first counts and the terms that are kept, then
partial sums over pairs of sources and the shard's own leading terms. Spark merges the
sums and the rankings of all shards.

A term that a group lacks still has a small share there, the same for all of them. So a
pair's sum over all kept terms is that of two groups that hold nothing, once for every
kept term, and corrections for the terms that one or both of them hold: no shard makes
a row for a term and a group that lacks it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import read_table, release, save, term_table

#: Documents in which a kept term is found at least, leading terms of a group, rows of a shard, and distinct counts that a task holds at once.
MIN_DOCUMENTS, TOP_TERMS, SHARD_ROWS, HELD_COUNTS = 10, 10, 200_000, 300_000
_SLICE = 128
_PARTIAL = "lang string, source string, term string, n long, df long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts: occurrences and documents by language, source and term."""
    table, held, size = term_table(digits=False), {}, 0

    def flush():
        for (lang, source), (n, df) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            same = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "df"])
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                found = Counter(text.as_py().translate(table).split())
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                df.update(found.keys())
                size += len(n)
            if size > HELD_COUNTS:
                yield from flush()
                size = 0
    yield from flush()
    release()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of every term in every group, and its documents there. Texts are counted where they are read."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*names, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(_count, _PARTIAL)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _duckdb(**tables: pa.Table):
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
    for name, table in tables.items():
        con.register(name, table)
    return con


def _rows(con, sql: str, schema: pa.Schema) -> pa.Table:
    found = con.sql(sql).to_arrow_table().cast(schema)
    con.close()
    return found


_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
#: A kept term's rows; ``first`` is 1 in one of them, so that terms can be counted.
KEPT_SQL = """
SELECT lang, source, term, n, CASE WHEN row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 THEN 1 ELSE 0 END AS first
FROM (SELECT *, sum(df) OVER (PARTITION BY lang, term) AS documents FROM counts) WHERE documents >= {least}
"""

_PARTS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
#: Shares p are of terms held, z of a term that a group lacks. A pair is summed once, the smaller source first.
PARTS_SQL = """
WITH g AS (SELECT *, 1 + (1000000000::HUGEINT * 2) // (total + 2 * kinds) AS z FROM groups WHERE kinds > 0),
r AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (g.total + 2 * kinds) AS p, z, kinds,
         1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (whole + 2 * kinds) AS q
  FROM kept JOIN g USING (lang, source)
), h AS (SELECT lang, source, p, z, count(*) AS times FROM r GROUP BY ALL
), one AS (
  SELECT h.lang, h.source AS a, g.source AS b, sum(times * (((p - g.z) * (p - g.z)) // (p + g.z) - ((h.z - g.z) * (h.z - g.z)) // (h.z + g.z))) AS value
  FROM h JOIN g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL
), both_hold AS (
  SELECT a.lang, a.source AS a, b.source AS b,
         sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) - ((a.p - b.z) * (a.p - b.z)) // (a.p + b.z)
             - ((a.z - b.p) * (a.z - b.p)) // (a.z + b.p) + ((a.z - b.z) * (a.z - b.z)) // (a.z + b.z)) AS value
  FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
), lead AS (
  SELECT lang, source, term, ((p - q) * (p - q)) // (p + q) AS value FROM r WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}
)
SELECT 'pair' AS part, lang, least(a, b) AS source, greatest(a, b) AS item, sum(value) AS value FROM (FROM one UNION ALL FROM both_hold) GROUP BY ALL
UNION ALL SELECT 'term', lang, source, term, value FROM lead
"""
#: What all kept terms give a pair if neither held any, from the group's own row and all groups of its language.
BASE_SQL = """
WITH g AS (SELECT *, CASE WHEN kinds > 0 THEN 1 + (1000000000::HUGEINT * 2) // (total + 2 * kinds) END AS z FROM groups)
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CASE WHEN a.kinds > 0 THEN a.kinds * (((a.z - b.z) * (a.z - b.z)) // (a.z + b.z)) ELSE 0 END AS value
FROM g a JOIN g b ON a.lang = b.lang AND a.source < b.source WHERE a.own
"""


def _keep(counts: pa.Table) -> pa.Table:
    return _rows(_duckdb(counts=counts), KEPT_SQL.format(least=MIN_DOCUMENTS), _KEPT)


def _parts(top: int):
    def run(kept: pa.Table, groups: pa.Table) -> pa.Table:
        shard = _rows(_duckdb(kept=kept, groups=groups), PARTS_SQL.format(top=top), _PARTS)
        return pa.concat_tables([shard, _rows(_duckdb(groups=groups), BASE_SQL, _PARTS)])

    return run


def audit(docs: DataFrame, top: int = TOP_TERMS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources within a language, and the terms that set a source apart from its language.

    ``docs``: (text, lang, source); other columns are not read, and null is the empty
    string in each. A group without terms is compared like any other; a language in
    which no term is kept gives distances of 0. Every row is a document, repeated ones
    too; equal values rank by item. No row gives none.
    """
    groups_seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counts = save(term_counts(docs), "term-counts")
    shards = max(1, -(-counts.count() // shard_rows))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard")
    kept = save(counts.select("lang", "source", "term", "n", "df", shard).groupBy("shard").applyInArrow(_keep, "lang string, source string, term string, n long, first long"), "kept-terms")
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("kinds"))
    whole = held.groupBy("lang").agg(F.sum("total").alias("whole"), F.sum("kinds").alias("kinds"))
    groups = groups_seen.join(held.drop("kinds"), ["lang", "source"], "left").join(whole, "lang", "left")
    groups = save(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "whole", "kinds")]), "term-groups")
    # every shard gets all groups, and starts the sums of its own share of them
    given = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("own", F.col("shard") == F.pmod(F.xxhash64("lang", "source"), F.lit(shards)))
    rows = kept.select("lang", "source", "term", "n", shard)
    parts = save(rows.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(_parts(top), "part string, lang string, source string, item string, value long"), "divergence")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", sides.alias("side"), "value").select("lang", "side.*", "value", F.lit("pair").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    both = pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank")
    return both.unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and leading terms of all documents; nulls, ties, repeats and empty tables as ``audit`` states."""
    return audit(read_table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
gs AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(t.row) AS n FROM (SELECT gs.lang, gs.source, k.term FROM gs JOIN k USING (lang)) LEFT JOIN t USING (lang, source, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM c JOIN s USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 10
"""
