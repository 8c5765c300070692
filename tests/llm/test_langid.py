import random

import pytest
from pyspark.sql import functions as F

from strandwise.llm import langid

from .conftest import LANGS, prose


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang, 60), lang) for i, lang in enumerate(list(LANGS) * 40)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark, model):
    r = random.Random(2)
    rows = [(i, prose(r, lang, r.randint(8, 80)), lang) for i, lang in enumerate(list(LANGS) * 30)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert sum(x["lang"] == x["lang_pred"] for x in out) >= 0.97 * len(out)
    assert all(0 <= x["score"] <= 1 for x in out)
    shouting = langid.identify(spark.createDataFrame([(1, rows[0][1].upper() + "!!!")], "doc_id long, text string"), model).first()
    assert shouting["lang_pred"] == "en"


def test_each_text_goes_to_its_smallest_encoding(model):
    fixed = tuple(sorted(model.items()))
    text = "the and of to that with for was this from have not they which and so on"
    once = b" ".join(dict.fromkeys(langid.letters(text).split()))
    sums = sorted((dict((l, n) for n, l in langid._sizes(langid.letters(text), fixed))[lang] + n, lang) for n, lang in langid._sizes(once, fixed))
    assert langid.classify(text, fixed)[:2] == (sums[0][1], (sums[1][0] - sums[0][0]) / sums[1][0])


@pytest.mark.parametrize("text", ["12 ½", "² Ⅷ ٣", "…"])
def test_numbers_are_no_letters(model, text):
    assert langid.classify(text, tuple(sorted(model.items()))) == ("und", 0.0, False)


def test_awkward_rows(corpus, model, empty):
    rows, df = corpus
    out = langid.identify(df.withColumn("lang_pred", F.lit("clash")), model).collect()
    assert len(out) == len(rows)
    for x in out:
        if x["text"] is None or not any(c.isalpha() for c in x["text"]):
            assert (x["lang_pred"], x["score"], x["accepted"]) == ("und", 0.0, False)
        else:
            assert x["lang_pred"] in LANGS
    assert langid.identify(empty, model).count() == 0


def test_narrow_margins_are_rejected(spark):
    same = {"a": b"x" * 1000, "b": b"x" * 1000}
    out = langid.identify(spark.createDataFrame([("quite a long text without any hint of where it may come from, " * 3,), ("ab",)], "text string"), same).collect()
    assert [x["accepted"] for x in out] == [False, False]


def test_training_is_bounded_and_repeatable(spark, corpus, empty):
    df = corpus[1]
    a, b = langid.train(df, texts=5, size=500), langid.train(df.repartition(7), texts=5, size=500)
    assert a == b and set(a) == set(LANGS)
    assert all(len(x) <= 500 + 5 for x in a.values())
    assert langid.train(empty) == {}
    assert langid.classify("some text", ()) == ("und", 0.0, False)


def test_length_does_not_erase_the_margin(model):
    fixed = tuple(sorted(model.items()))
    text = prose(random.Random(4), "en", 1_000_000)
    lang, score, accepted = langid.classify(text, fixed)
    assert (lang, accepted) == ("en", True)
    # about the score of a block
    assert score > 0.5 * langid.classify(text[: langid.BLOCK_BYTES], fixed)[1]


def test_every_language_has_a_dictionary(spark):
    r = random.Random(6)
    words = {f"l{i:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(70)}
    rows = [(i, " ".join(r.choice(w) for _ in range(40)), lang) for i, (lang, w) in enumerate(list(words.items()) * 2)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model) == set(words)
    assert all(langid.classify(" ".join(w), tuple(sorted(model.items())))[0] == lang for lang, w in words.items())


def test_a_filter_on_the_result_judges_each_text_once(model, spark):
    text = prose(random.Random(3), "en", 60)
    rows = spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")
    kept = langid.identify(rows, model).filter("accepted").select("lang_pred", "text")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert kept.collect() == [("en", text)]
