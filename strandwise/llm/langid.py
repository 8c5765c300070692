"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is made of labelled texts. A
text, and its distinct words once more, are encoded with every dictionary and the
smallest sum names its language: words that a text repeats cost nothing after their
first time, so the second encoding has the finer say. The margin to the runner-up is
the score; narrow margins are rejected.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import read_table, release

#: Whole labelled texts a language, first in hash order, and the bytes of dictionary made of them: the bounds of the training sample.
SAMPLE_TEXTS, DICTIONARY_BYTES = 300, 128 << 10
LEVEL = 3
#: Bytes of letters that are encoded together: what a dictionary saves does not grow beyond, so longer texts are encoded block by block.
BLOCK_BYTES = 32 << 10
#: Score (relative margin) under which a document is rejected.
MIN_SCORE = 0.002
UNDETERMINED = "und"
#: Texts after which a worker gives memory back that it no longer uses.
RELEASED = 1000


@lru_cache(1)
def _patterns():
    import regex

    return regex.compile(r"\p{L}"), regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    """What is encoded of a text, and what dictionaries are made of: its letters in lower case, anything between them one space."""
    return _patterns()[1].sub(" ", text.lower()).encode("utf-8", "replace")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", texts: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries of all languages, each from texts in hash order until ``size`` bytes are full.

    Rows with a null text or language are left out. Which rows come first depends on
    their text alone, so reruns agree. No labelled row: no language.
    """
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a first cut by hash leaves a few times the texts needed, so that no language is sorted whole
    share = F.least(F.lit(1.0), F.lit(8.0 * texts) / F.col("n"))
    order = F.xxhash64(F.lit(5), "text")
    # one row a language
    drawn = rows.join(F.broadcast(counts), "lang").withColumn("order", order).filter(F.pmod("order", F.lit(1 << 30)) < share * F.lit(1 << 30)).drop("n")
    first = drawn.dropDuplicates(["lang", "order"]).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("k") <= texts)
    held: dict[str, list[bytes]] = {}
    # no dictionary takes more of a text than its own size
    for r in first.select("lang", "k", F.substring("text", F.lit(1), F.lit(size)).alias("text")).orderBy("lang", "k").toLocalIterator():
        parts, data = held.setdefault(r["lang"], []), letters(r["text"])
        if sum(map(len, parts)) < size:
            parts.append(data[: size - sum(map(len, parts))])
    return {lang: b"\n".join(parts) for lang, parts in held.items() if any(parts)}


@lru_cache(2)
def _compressors(model: tuple[tuple[str, bytes], ...]):
    import zstandard as zstd

    out = []
    for lang, data in model:
        d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def _sizes(data: bytes, model: tuple[tuple[str, bytes], ...]) -> list[tuple[int, str]]:
    blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
    return sorted((sum(len(c.compress(x)) for x in blocks), lang) for lang, c in _compressors(model))


def classify(text: str | None, model: tuple[tuple[str, bytes], ...], min_score: float = MIN_SCORE) -> tuple[str, float, bool]:
    """(language, score, accepted): score is the share of bytes that the best dictionary saves against the second, over all blocks of the text and of its distinct words."""
    if text is None or not model or not _patterns()[0].search(text):
        return UNDETERMINED, 0.0, False
    data = letters(text)
    whole, once = (dict((lang, n) for n, lang in _sizes(x, model)) for x in (data, b" ".join(dict.fromkeys(data.split()))))
    sizes = sorted((n + once[lang], lang) for lang, n in whole.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0, True
    score = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], score, score >= min_score


@lru_cache(1)
def _seen() -> list[int]:
    return [0]


def _count_and_release() -> None:
    seen = _seen()
    seen[0] += 1
    if seen[0] % RELEASED == 0:
        release()


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with lang_pred, score and accepted (score of at least ``min_score``).

    Null texts and texts without a letter are "und", score 0, and not accepted; so is
    everything if there is no model. Equal sizes go to the language first by name,
    with score 0. Columns that are already there by these names are replaced, all others
    stay. Rows are judged each, whatever their ids, and texts of any length whole.
    """
    fixed = tuple(sorted(model.items()))
    if any(len(d) > DICTIONARY_BYTES + SAMPLE_TEXTS for _, d in fixed):
        raise ValueError("a dictionary is larger than the documented bound")
    sent = docs.sparkSession.sparkContext.broadcast(fixed)

    @F.udf("struct<lang_pred:string, score:double, accepted:boolean>", useArrow=True)
    def predict(text):
        _count_and_release()
        return classify(text, sent.value, min_score)

    # else a filter on the result would be moved before it, and every text be judged twice, by two workers a task
    predict = predict.asNondeterministic()
    given = docs.drop("lang_pred", "score", "accepted")
    held = "_l" + "_" * max(len(c) for c in docs.columns)  # longer than any name that is there
    return given.withColumn(held, predict(F.col(text_col))).withColumns({k: F.col(held)[k] for k in ("lang_pred", "score", "accepted")}).drop(held)


def fold(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out. Nulls, ties, repeats and empty tables as ``train`` and ``identify`` state."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(fold(5) != 0))
    return identify(docs.select("doc_id", (fold(5) == 0).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
