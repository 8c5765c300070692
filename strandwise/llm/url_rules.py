"""URL filter by association rules: FP-growth over the tokens of labelled URLs.

A labelled page is a basket of tokens of its URL. FP-growth finds the token
combinations of bad pages; those that are found often enough, and seldom in other
pages, become rules, unless fewer of their tokens are a rule. A URL is matched through
an inverted index, a table from a rule's rarest token to the rule: it fires when the
URL has all its tokens.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ascii_lower, read_table, save, sized

#: Bad pages that a rule's tokens must be found in together, however many pages are labelled, and least confidence of a rule.
MIN_PAGES, MIN_CONFIDENCE = 8, 0.8
#: (rule, verdict) that hold before any mined rule; the longest that fits wins.
BASE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

_WORD = re.compile(r"[^0-9A-Za-z]+")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://" or for null."""
    at = F.locate("://", url)
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> Column:
    """The longest rule whose host is the URL's or a parent of it, and whose path begins the URL's; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: len(x[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens(host: str | None, path: str | None) -> list[str]:
    """Distinct tokens of a URL: its host, the words of the host's labels, the words of its path; numbers are one token."""
    found = {f"host={host}"} if host else set()
    found |= {"name=" + w for w in _WORD.split(host or "") if w}
    found |= {"path=" + ("#" if w.isdigit() else w.lower()) for w in _WORD.split(path or "") if w}
    return sorted(found)


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _tokens(host, path):
    return tokens(host, path)


@dataclass(frozen=True)
class Rules:
    """Mined rules: the tokens of each, and its confidence."""

    combinations: tuple[tuple[str, ...], ...]
    confidence: tuple[float, ...]

    def index(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, c in enumerate(self.combinations):
            for t in c:
                out.setdefault(t, []).append(i)
        return out


def mined_rules(pages: DataFrame, labels: DataFrame, bad: Column | None = None, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, url_col: str = "url", id_col: str = "page_id", label_id: str = "doc_id") -> DataFrame:
    """(rule, confidence): every rule of the labelled pages that no rule of fewer of its tokens covers. ``bad``: condition over ``labels`` (default: low quality or toxic).

    A rule's tokens are found together in at least ``min_pages`` bad pages, and at
    least ``min_confidence`` of the pages that have them are bad. Pages without a label
    teach nothing; no labelled page, or none that is bad: no rule. Repeated pages count
    each; of labels that share an id any bad one makes the page bad.
    """
    from pyspark.ml.fpm import FPGrowth

    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)) if bad is None else bad
    marked = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("_bad"))
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_page"), host.alias("host"), path.alias("path")).join(marked, F.col("_page") == F.col("_id"))
    baskets = save(rows.select(_tokens("host", "path").alias("t"), F.col("_bad").cast("long").alias("b")).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).withColumn("basket", F.monotonically_increasing_id()), "baskets")
    each = baskets.select(F.explode("t").alias("token"), "n", "b")
    often = save(each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).filter(F.col("b") >= min_pages).withColumn("confidence", F.col("b") / F.col("n")), "tokens")
    single = often.filter(F.col("confidence") >= min_confidence).select(F.array("token").alias("rule"), "confidence")
    # a combination with a token that is a rule is covered, and one with a rare token is rare
    open_tokens = often.filter(F.col("confidence") < min_confidence).select("token", F.col("n").alias("pages"))
    shorter = baskets.select("basket", "n", "b", F.explode("t").alias("token")).join(sized(open_tokens), "token").groupBy("basket", "n", "b").agg(F.array_sort(F.collect_list("token")).alias("t"))
    shorter = save(shorter.filter(F.size("t") > 1), "open-baskets")
    # only what bad pages hold together can be a rule; the other pages are counted afterwards
    items = shorter.select(F.explode(F.array_repeat("t", F.col("b").cast("int"))).alias("items"))
    items = save(items.repartition(items.sparkSession.sparkContext.defaultParallelism), "bad-baskets")
    n = items.count()
    if n < min_pages:
        return save(single, "rules")
    found = FPGrowth(itemsCol="items", minSupport=(min_pages - 0.5) / n).fit(items).freqItemsets
    found = save(found.filter(F.size("items") > 1).select(F.array_sort("items").alias("rule"), F.col("freq").alias("b")), "combinations")
    total = _fired(shorter, save(_led(found.select("rule"), open_tokens), "led-combinations")).groupBy("rule").agg(F.sum("n").alias("n"))
    rules = save(found.join(total, "rule").withColumn("confidence", F.col("b") / F.col("n")).filter(F.col("confidence") >= min_confidence).select("rule", "confidence"), "uncovered-rules")
    parts = rules.select("rule", F.explode(_parts("rule")).alias("part"))
    covered = parts.join(rules.select(F.col("rule").alias("part")), "part", "left_semi").select("rule")
    return save(single.unionByName(rules.join(covered, "rule", "left_anti")), "rules")


@F.udf(T.ArrayType(T.ArrayType(T.StringType())), useArrow=True)
def _parts(rule):
    return [list(x) for k in range(2, len(rule)) for x in itertools.combinations(rule, k)]


def _led(rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``rules`` with the token that they are indexed by: the one found least by ``counts`` (token, pages), else in the rules."""
    each = rules.select("rule", F.explode("rule").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("pages")) if counts is None else counts
    return rules.join(each.join(counts, "token").groupBy("rule").agg(F.min_by("token", F.struct("pages", "token")).alias("lead")), "rule")


def _fired(rows: DataFrame, led: DataFrame) -> DataFrame:
    """``rows`` (with tokens t), once for each rule of ``led`` (saved) whose tokens they all have: an inverted index from one token to its rules, as a join."""
    return rows.withColumn("lead", F.explode("t")).join(sized(led), "lead").filter(F.size(F.array_except("rule", "t")) == 0)


def mine(pages: DataFrame, labels: DataFrame, bad: Column | None = None, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, url_col: str = "url", id_col: str = "page_id", label_id: str = "doc_id") -> Rules:
    """The rules of ``mined_rules``, brought to the driver."""
    rows = sorted((tuple(r["rule"]), r["confidence"]) for r in mined_rules(pages, labels, bad, min_pages, min_confidence, url_col, id_col, label_id).collect())
    return Rules(tuple(r for r, _ in rows), tuple(c for _, c in rows))


def filter_urls(pages: DataFrame, rules: Rules | DataFrame, url_col: str = "url", id_col: str = "page_id", base=BASE_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of every page, by rules as ``mined_rules`` or ``mine`` gives, however many.

    A base rule decides where one fits; else a page is blocked if a mined rule fires
    and allowed if none does; mined_rule is the surest that fires. Null URLs have an
    empty host and path and are allowed; empty tables give no rows; rows with one id
    are judged each.
    """
    if isinstance(rules, Rules):
        rules = pages.sparkSession.createDataFrame([(list(r), c) for r, c in zip(rules.combinations, rules.confidence)], "rule array<string>, confidence double")
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = save(rows.select("host", "path").distinct().withColumn("t", _tokens("host", "path")), "urls")
    counts = urls.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("pages"))
    led = save(_led(rules, counts), "led-rules")  # a rule with a token that no page has cannot fire
    surest = F.max_by(F.array_join("rule", "&"), F.struct("confidence", -F.size("rule"), "rule"))
    best = save(_fired(urls, led).groupBy("host", "path").agg(surest.alias("mined_rule")), "fired")
    judged = rows.join(sized(best), ["host", "path"], "left")
    verdicts = F.create_map(*[F.lit(x) for pair in base for x in pair])
    return judged.withColumn("rule", base_rule(F.col("host"), F.col("path"), base)).withColumn("verdict", F.coalesce(F.element_at(verdicts, F.col("rule")), F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, with rules mined from all labelled pages."""
    pages = read_table(spark, sf_dir, "pages")
    return filter_urls(pages, mined_rules(pages, read_table(spark, sf_dir, "labels")))


def url_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path and base rule."""
    host, path = host_path(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", base_rule(F.col("host"), F.col("path")))


BASE_RULES_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS given FROM a),
p AS (SELECT page_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(given) + 1), '^[^?#]*') AS path FROM b),
r AS (SELECT unnest(['com/', 'example.com/en/', 'www.example.com/en/', 'net/es/', 'net/fr/']) AS rule),
f AS (SELECT rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS t FROM r)
SELECT page_id, host, path, (SELECT rule FROM f WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) ORDER BY length(rule) DESC LIMIT 1) AS rule FROM p
"""
