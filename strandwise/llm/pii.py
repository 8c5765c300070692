"""Personal data: identifiers of fixed forms, and more of them by bootstrapped contextual extraction.

Seeds are what the fixed forms find: e-mail addresses, IP addresses, card and phone
numbers, and secrets of hexadecimal digits. The word and the two words before and
after an identifier are lexical patterns. Patterns and instances make a bipartite
graph: a pattern is worth the share of all occurrences of its words in the corpus that
stand beside an instance that is believed, less what chance may have added to it; an
instance is believed as far as its patterns are worth. Scores are passed to and fro a
few times, and tokens that look like identifiers become spans if they come to be
believed. Only DataFrame functions are used; what travels are spans and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import BROADCAST_ROWS, let, read_table, save, sized, words_of

#: Kinds whose spans are the base ones, in the order of results, and all kinds that seeds can have.
KINDS = ("email", "ip", "card", "phone")
SEEDS = (*KINDS, "secret")
#: Rounds of scoring, least distinct believed instances of a pattern, least worth of a pattern and belief in an instance.
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE = 3, 3, 0.5
#: Standard deviations by which a pattern's share is lowered: a share of few occurrences may be chance.
CHANCE = 1.64
SIDES = ("left", "right", "left2", "right2")

#: The fixed forms. Possessive quantifiers and the conditions on where a match may
#: start change no match; they keep the time linear on long runs of one class.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_TOKEN = "A-Za-z0-9@._%+/-"
#: A token that may be an identifier: five characters or more with a digit among them.
CANDIDATE = rf"(?<![{_TOKEN}])(?=[A-Za-z@._%+/-]*+[0-9])[{_TOKEN}]{{5,}}+"
_NOT_DIGITS = r"[^0-9]+"
_CHUNK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, _NOT_DIGITS, "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit counts double, less 9 if above 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.filter(worth, lambda d: d.isNotNull()), F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sums of all elements before each element; in chunks, so that the time stays near linear."""

    def sums(chunk):
        return F.aggregate(chunk, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    last = (F.ceil(F.size(lengths) / F.lit(float(_CHUNK))) - 1).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: sums(F.slice(lengths, k * _CHUNK + 1, F.lit(_CHUNK))))

    def joined(c):
        bases = F.aggregate(c, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.element_at(x, -1))))
        return F.flatten(F.zip_with(c, F.slice(bases, F.lit(1), F.size(c)), lambda x, b: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + b)))

    return let(chunks, joined)


_SPAN = "struct<start:bigint,end:bigint,value:string,left:string,right:string,left2:string,right2:string>"
#: Up to two words behind an identifier, or before it in the reversed text; what touches it is no word of its context.
_BESIDE = r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++([^\x20\x09-\x0D]++))?"


def _matches(text: Column, pattern: str, possible: Column, keep) -> Column:
    """Spans (start, end, value, and the words beside them) of all matches that ``keep`` accepts; offsets count code points.

    left2 and right2 are two words with a space between them, empty where there is one
    word or none. Words are sought up to the next match of the same pattern.
    """
    none = F.array().cast(f"array<{_SPAN}>")

    def spans(found):
        def placed(pieces):
            lengths = F.zip_with(pieces, found, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))

            def one(starts):
                def row(m, i):
                    start = F.get(starts, i) + F.length(F.get(pieces, i))
                    word = lambda x, k: F.regexp_extract(x, _BESIDE, k)
                    before, after = F.reverse(F.get(pieces, i)), F.get(pieces, i + 1)
                    far, near, next_, then = (F.lower(x) for x in (F.reverse(word(before, 2)), F.reverse(word(before, 1)), word(after, 1), word(after, 2)))
                    two = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(" "), b)).otherwise(F.lit(""))
                    return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), near.alias("left"), next_.alias("right"), two(far, near).alias("left2"), two(next_, then).alias("right2"))

                # what is no identifier needs no context
                kept = F.filter(F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: keep(x["m"]))
                return F.transform(kept, lambda x: row(x["m"], x["i"]))

            return let(_running(lengths), one)

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), placed))

    return F.when(possible, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind of seed by the fixed forms. A null text has none."""
    text = F.coalesce(text, F.lit(""))
    possible = {"email": text.contains("@"), "phone": text.contains("+"), "secret": text.rlike("[0-9a-f]{32}")}
    return {k: _matches(text, FORMS[k], possible.get(k, text.rlike("[0-9]")), lambda x, k=k: _valid(k, x)) for k in SEEDS}


def _candidates(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return _matches(text, CANDIDATE, text.rlike("[0-9]"), lambda x: F.length(_digits(x)) >= 3)


def _key(id_col: str, text_col: str) -> list[Column]:
    """What names a row: rows that agree in it have the same text and so the same spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.length(text).alias("n")]


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Saved table of (doc_id, h, n, email, ip, card, phone, secret, candidate): one row a document, without its text."""
    spans = base_spans(F.col(text_col))
    return save(docs.select(*_key(id_col, text_col), *[c.alias(k) for k, c in spans.items()], _candidates(F.col(text_col)).alias("candidate")), "pii-scan")


def _each(kind: str, body) -> Column:
    return F.transform(F.col(kind), lambda s: body(s))


def _base(kinds: tuple = KINDS) -> Column:
    """The spans of these kinds in one array."""
    return F.concat(*[_each(k, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))) for k in kinds])


def _occurrences(scanned: DataFrame) -> DataFrame:
    """One row a span of documents that have any: key, kind, span, normalised value; candidates that touch a seed are left out."""
    tagged = [_each(k, lambda s: s.withField("kind", F.lit(k))) for k in (*SEEDS, "candidate")]
    rows = scanned.select("doc_id", "h", "n", F.explode(F.concat(*tagged)).alias("s")).select("doc_id", "h", "n", "s.*").distinct()
    base = F.col("kind") != "candidate"
    near = Window.partitionBy("doc_id", "h", "n").orderBy("start", "end", "kind")
    before = F.max(F.when(base, F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    value = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("value"))).otherwise(F.lower("value"))
    return rows.withColumn("free", free).filter(base | F.col("free")).select("doc_id", "h", "n", "kind", "start", "end", value.alias("value"), *SIDES)


def _word_counts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(words, total): how often each of the wanted words, and pairs of neighbouring words, occurs in all texts."""
    single = words_of(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    both = let(single, lambda w: F.concat(w, F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))))
    words = docs.select(F.explode(both).alias("words"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        words = words.join(F.broadcast(wanted), "words", "left_semi")
        return words.groupBy("words").agg(F.count(F.lit(1)).alias("total"))
    return words.groupBy("words").agg(F.count(F.lit(1)).alias("total")).join(wanted, "words", "left_semi")


def lower_share(mass: Column, total: Column) -> Column:
    """The lower bound of a share by Wilson's interval: what remains of mass / total if CHANCE standard deviations of it are luck."""
    n, z = F.greatest(total.cast("double"), F.lit(1.0)), CHANCE
    share = F.least(mass / n, F.lit(1.0))
    middle, spread = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n)


def discover(docs: DataFrame, scanned: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, text_col: str = "text") -> DataFrame:
    """Spans beyond the seeds: (doc_id, h, n, kind, start, end), saved. Without rounds, or where no pattern is worth it, there are none."""
    seen = save(_occurrences(scanned), "pii-occurrences")
    none = seen.limit(0).select("doc_id", "h", "n", "kind", "start", "end")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("words")) for s in SIDES]))
    edges = seen.withColumn("p", sides).filter(F.length("p.words") > 0).groupBy("p.side", "p.words", "value", "kind").agg(F.count(F.lit(1)).alias("times"))
    edges = save(edges, "pii-edges")
    seeds = F.col("kind") != "candidate"
    # a pattern that stands beside no candidate finds nothing
    supported = edges.groupBy("side", "words").agg(F.count_if(seeds).alias("instances"), F.count_if(~seeds).alias("open")).filter((F.col("instances") >= min_support) & (F.col("open") > 0)).select("side", "words")
    supported = save(supported, "pii-patterns")
    if not rounds or not supported.limit(1).count():
        return none
    totals = save(_word_counts(docs, supported.select("words").distinct(), text_col), "pii-totals")
    graph = save(edges.join(sized(save(supported.join(sized(totals), "words"), "pii-counted")), ["side", "words"]), "pii-graph")

    belief = first = graph.filter(seeds).select("value", "kind", F.lit(1.0).alias("belief")).distinct()
    for _ in range(rounds):
        # a pattern's worth, and the kind that most of it stands for
        weighed = graph.join(belief, ["value", "kind"])
        mass = F.col("times") * F.col("belief")
        shares = [F.sum(F.when(F.col("kind") == k, mass)).alias(f"m_{k}") for k in SEEDS]
        worth = weighed.groupBy("side", "words").agg(F.sum(mass).alias("mass"), F.max("total").alias("total"), F.count_if(F.col("belief") >= min_confidence).alias("instances"), *shares)
        leading = F.array_max(F.array(*[F.struct(F.coalesce(F.col(f"m_{k}"), F.lit(0.0)).alias("m"), F.lit(-i).alias("i")) for i, k in enumerate(SEEDS)]))
        worth = worth.filter(F.col("instances") >= min_support).select("side", "words", lower_share(F.col("mass"), F.col("total")).alias("worth"), (-leading["i"]).alias("lead"))
        worth = save(worth.filter(F.col("worth") >= min_confidence), "pii-worth")
        if not worth.limit(1).count():
            return none
        # an instance's belief: that not all of its patterns mislead
        doubt = F.sum(F.log(F.greatest(F.lit(1.0) - F.col("worth"), F.lit(1e-9))))
        raised = graph.filter(~seeds).join(sized(worth), ["side", "words"]).groupBy("value", "kind").agg((F.lit(1.0) - F.exp(doubt)).alias("belief"), F.max_by("lead", F.struct("worth", -F.col("lead"))).alias("lead"))
        raised = save(raised.filter(F.col("belief") >= min_confidence), "pii-belief")
        belief = first.union(raised.select("value", "kind", "belief"))
    named = F.element_at(F.array(*map(F.lit, SEEDS)), F.col("lead") + 1)
    found = seen.filter(~seeds).join(sized(raised.select("value", "lead")), "value").select("doc_id", "h", "n", named.alias("kind"), "start", "end")
    return save(found, "pii-found")


def _spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``spans``: seeds and the spans in ``found`` of the same document, by kind as in SEEDS, then start."""
    more = found.groupBy("doc_id", "h", "n").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))  # within one document
    more = save(more, "pii-more").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("n").alias("_n"), "more")
    joined = rows.join(sized(more), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")), "left")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(SEEDS) for x in (k, i)])
    base = _base(SEEDS)
    every = F.concat(base, F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(F.element_at(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return joined.withColumn("spans", F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).drop("_d", "_h", "_n", "more")


def find_personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, h, n, email, ip, card, phone, secret, candidate, spans) of every document; ``spans`` holds all kinds, seeds and discovered.

    Null and empty texts have no spans. Rows that share id and text get the same
    spans each; ids may be null. No seed in the corpus: nothing is discovered. An empty
    table gives no rows. Columns besides the two named are not read.
    """
    scanned = scan(docs, text_col, id_col)
    return _spans(scanned, discover(docs, scanned, text_col=text_col, **options))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in brackets; touching spans of several kinds keep the first's name.

    Null texts stay null, and empty ones empty. Repeated rows and rows that share an id
    are masked each. All other columns stay, whatever their names. Texts of any length
    are masked whole; no row gives none.
    """
    found = discover(docs, scan(docs, text_col, id_col), text_col=text_col, **options)
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *_key(id_col, text_col), *[c.alias(k) for k, c in base_spans(F.col(text_col)).items()])
    marked = _spans(held, found)
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))

    def masked(spans):
        apart = F.aggregate(
            F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
            F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<from:bigint,start:bigint,kind:string>>").alias("kept")),
            lambda a, s: F.when(s["start"] < a["end"], F.struct(F.greatest(a["end"], s["end"]).alias("end"), a["kept"].alias("kept"))).otherwise(F.struct(s["end"].alias("end"), F.concat(a["kept"], F.array(F.struct(a["end"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))).alias("kept"))),
        )
        part = lambda k: F.concat(F.substring(text, (k["from"] + 1).cast("int"), (k["start"] - k["from"]).cast("int")), F.lit("["), F.upper(k["kind"]), F.lit("]"))
        return let(apart, lambda a: F.concat(F.array_join(F.transform(a["kept"], part), ""), F.substring(text, (a["end"] + 1).cast("int"), F.length(text))))

    new = F.when(F.size("spans") == 0, F.col("_row")[text_col]).otherwise(masked(F.col("spans")))
    return marked.select(*[new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts of base spans, their digest, all spans, and the number of these."""
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    base = _base()
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
