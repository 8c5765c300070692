import random

import pytest

LANGS = {
    "en": "the and of to that with for was this from have not they which".split(),
    "de": "der die und nicht auf sich mit eine auch wird über für sind wenn".split(),
    "fr": "les des une dans pour être avec est sur plus très cette qui où".split(),
}


def prose(r, lang, n):
    return " ".join(r.choice(LANGS[lang]) + r.choice(["", "", "en", "er", "é"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame): a table like documents with nulls in every column, ties, repeated rows, empty and long texts, and columns by names that operators use."""
    r = random.Random(11)
    rows = []
    for i in range(160):
        lang = r.choice(list(LANGS))
        text = prose(r, lang, r.randint(1, 120))
        rows.append([i, text, lang, f"s{i % 4}", None, 1.5])
    rows[3][1] = None
    rows[4][1] = ""
    rows[5][1] = " \n\t "
    rows[6][1] = "123 456 !!!"
    rows[7][1] = prose(r, "en", 20_000)
    rows[8][1] = rows[9][1] = rows[10][1]
    rows[11][2] = None
    rows[12][3] = None
    rows[13][1] = "x" * 50_000
    rows[14][1] = rows[15][1] + " tail"
    rows[16][1] = "a\u00a0b \u2028 c\x1cd <|endoftext|> İstanbul ﬁn"
    rows.append([None, "no id here at all", "en", "s0", None, None])
    rows.append(list(rows[20]))  # a repeated row
    rows.append(list(rows[21]))
    rows[-1][1] = "the same id with another text"
    rows = [tuple(x) for x in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def empty(corpus):
    return corpus[1].limit(0)
