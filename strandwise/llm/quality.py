"""Quality rules: log-likelihood ratio of hashed n-grams, trusted texts against the raw corpus.

Words and pairs of neighbouring words are hashed to buckets. Two multinomials over
the buckets are counted: one from trusted documents, one from all. A document's
verdict is the mean log ratio of its n-grams under the two, held against a fixed
threshold; a few plain counts of the text drop what is too short or repeats itself.
Everything is computed inside the row: no text is shuffled, only bucket counts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, let, read_table, save, words_of

BUCKETS = 1 << 14
#: Trusted documents that the target is learned from, first in hash order; the raw corpus is counted whole.
TRUSTED_DOCUMENTS = 20_000
#: Mean log ratio (natural logarithm) from which a document is kept.
THRESHOLD = -0.05
#: Weight of the corpus's own shares in the target's, in mean occurrences a bucket: few trusted texts make mild ratios, not noisy ones.
SMOOTHING = 20.0
#: Names of columns that are there only while a table is scored.
_OWN = ("_quality_facts", "_quality_ratios")
_POSITION_BITS = 20
_SYMBOLS = r"[#*$%&|<>]"


def _hashes(words: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours; the last word pairs with the end."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    double = F.transform(words, lambda w, i: F.pmod(F.xxhash64(F.lit(2), w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, double)


def gram_buckets(text: str, buckets: int = BUCKETS) -> Column:
    """The hash buckets of a text's lower-cased words and word pairs."""
    return let(words_of(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda w: _hashes(w, buckets))


def bucket_log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, text_col: str = "text", id_col: str = "doc_id") -> list[float]:
    """log(target / raw) of each bucket. ``trusted`` holds at most TRUSTED_DOCUMENTS ids and is broadcast for that bound."""
    ids = F.broadcast(trusted.select(F.col(id_col).alias("_trusted")).distinct())
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, F.col("_id") == F.col("_trusted"), "left")
    grams = marked.select(F.col("_trusted").isNotNull().alias("t"), F.explode(gram_buckets("_text", buckets)).alias("b"))
    rows = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count_if("t").alias("target")).collect()  # one row a bucket
    import math

    total_raw, total_target = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    prior = SMOOTHING * buckets
    ratios = [0.0] * buckets  # a bucket that the corpus never meets says nothing
    for r in rows:
        share = r["raw"] / total_raw
        ratios[r["b"]] = math.log((r["target"] + prior * share) / (total_target + prior) / share)
    return ratios


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_DOCUMENTS) -> DataFrame:
    """Ids of documents labelled good: the first ``limit`` in hash order, so the set is the same in every run."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return save(good.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(limit), "trusted")


def _repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows which occur twice or more.

    Windows are sorted by hash with their position in the low bits of one long. The
    44 bits of hash kept there are checked against the 64-bit hashes of the same
    text; where they don't tell windows apart, or positions don't fit, the hashes
    and positions are sorted as pairs instead.
    """
    low = F.lit((1 << _POSITION_BITS) - 1)

    def hashes(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(positions):
        steps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions), F.lit(1))), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def packed(h):
        keys = F.array_sort(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~((1 << _POSITION_BITS) - 1))).bitwiseOR(i.cast("long"))))
        return let(keys, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, i: _same(s, x, i)), lambda x: x.bitwiseAND(low))), covered))

    def _same(s, x, i):
        mine = F.shiftright(x, _POSITION_BITS)
        return (F.shiftright(F.coalesce(F.get(s, i - 1), F.lit(0).cast("long")), _POSITION_BITS).eqNullSafe(mine) & (i > 0)) | F.shiftright(F.get(s, i + 1), _POSITION_BITS).eqNullSafe(mine)

    def paired(h):
        keys = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return let(keys, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, i: ((i > 0) & F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])), lambda x: x["i"])), covered))

    def count(h):
        distinct = F.size(F.array_distinct(h))
        short = F.size(F.array_distinct(F.transform(h, lambda x: F.shiftright(x, _POSITION_BITS))))
        fits = (short == distinct) & (F.size(h) < (1 << _POSITION_BITS))
        return F.when(distinct == F.size(h), F.lit(0).cast("long")).when(fits, packed(h)).otherwise(paired(h))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashes(words), count))


def text_counts(text: str) -> dict[str, Column]:
    """Plain counts of a text; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    symbols = F.when(t.rlike(_SYMBOLS), F.length(t) - F.length(F.regexp_replace(t, _SYMBOLS, ""))).otherwise(F.lit(0))
    return {
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def score_quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Null text has no words and fails the plain rules. Ties with the threshold are
    kept. Ids may repeat or be null: nothing is joined by them but the trusted
    set. Input columns named like a result, or like _OWN, are replaced. An empty table gives no rows.
    Texts of any length count whole: the ratio is a mean over all their n-grams.
    """
    ratios = bucket_log_ratios(docs, trusted, buckets, text_col, id_col)
    given = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", *_OWN)
    weights = docs.sparkSession.createDataFrame([(ratios,)], f"{_OWN[1]} array<double>")  # one row of `buckets` numbers
    given = given.crossJoin(F.broadcast(weights))
    counts = text_counts(text_col)

    def facts(w):
        total = F.aggregate(gram_buckets(text_col, buckets), F.lit(0.0), lambda s, b: s + F.get(F.col(_OWN[1]), b))
        chars = F.length(F.array_join(w, "")).cast("long")
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), _repeated_words(w).alias("n_repeat_words"), (total / F.greatest(F.lit(1), 2 * F.size(w))).alias("llr"))

    out = given.withColumn(_OWN[0], let(words_of(text_col), facts)).withColumns(counts | {k: F.col(_OWN[0])[k] for k in ("n_words", "word_chars", "n_repeat_words", "llr")})
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))).drop(*_OWN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, trusted_ids(read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plain rules count in every document, without the method's verdict."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, trusted_ids(read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text FROM d),
p AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM w, unnest(range(1, len(words) - 1)) u(i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, unnest(range(3)) u(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""
