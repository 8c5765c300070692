import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.llm import pii


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base(t):
    """The fixed forms as they are worded, found by a plain left-to-right search."""
    out = []
    forms = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, form in forms:
        for m in re.finditer(form, t or ""):
            d = "".join(re.findall("[0-9]", m[0]))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def found_in(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = df.select("doc_id", *[c.alias(k) for k, c in pii.base_spans(F.col("text")).items()]).orderBy("doc_id").collect()
    return [[(k, s["start"], s["end"]) for k in pii.KINDS for s in r[k]] for r in out]


CASES = [
    None, "", "mail a@b.co, a@b.c_d@e.f or x@y; é😀 é@x.y 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+1 (743) 555-3824 +12 +1(23)45-67.89 +1 2", "a@b..c a@-.-.- @x.y .@.z.q", "1.1.1.1@x.y 0" + "0" * 300 + ".0.0.1",
    "9" * 3000, "a." * 3000 + "@b.c", "+1" + "(" * 3000 + "2", "1 " * 4000,
]


def test_base_forms(spark):
    assert found_in(spark, CASES) == [base(t) for t in CASES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a.@-_+ 0123459é(\n", max_size=60), min_size=20, max_size=40))
def test_base_forms_of_any_text(spark, texts):
    assert found_in(spark, texts) == [base(t) for t in texts]


def test_long_text_of_one_class_is_quick(spark):
    texts = ["a" * 300_000, "1." * 150_000, "a@b." * 60_000, "+" * 100_000, "12-" * 100_000]
    assert len(found_in(spark, texts)) == 5


def test_discovery(spark):
    r = random.Random(5)
    rows = [(i, f"user ssn: 10.0.{i}.{i + 1} is known") for i in range(12)]
    rows += [(100 + i, f"person ssn: AB{i}34{i}77 is known") for i in range(5)]
    rows += [(200 + i, f"the build r{r.randint(10**6, 10**7)} was of the kind") for i in range(20)]
    rows += [(300, "again AB03 and AB034077 alone"), (301, None), (None, "ssn: AB99999x is here"), (302, "ssn: AB99999x is here"), (302, "ssn: AB99999x is here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit(1))
    out = {(x["doc_id"], x["h"]): [(s["kind"], s["start"], s["end"]) for s in x["spans"]] for x in pii.find_personal_data(df).collect()}
    by_id = {d: s for (d, _), s in out.items()}
    assert pii.find_personal_data(df).count() == len(rows)
    assert all(by_id[100 + i] == [("ip", 12, 20)] for i in range(5))
    assert all(by_id[200 + i] == [] for i in range(20))
    assert by_id[None] == by_id[302] == [("ip", 5, 13)]
    assert by_id[300] == [("ip", 15, 23)]
    # base spans stay
    assert all(set(base(t)) <= set(by_id[d]) for d, t in rows)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co and 1.2.3.4!", "kept"), (2, None, None), (2, "clean", "x")], "doc_id long, text string, kind string")
    assert {(r["text"], r["kind"]) for r in pii.redact(df).collect()} == {("é [EMAIL] and [IP]!", "kept"), (None, None), ("clean", "x")}
    both = spark.createDataFrame([(1, "+4111111111111111 x")], "doc_id long, text string")
    assert "1111" not in pii.redact(both).first()["text"]


def test_query_on_awkward_rows(spark, corpus, empty):
    rows, df = corpus
    out = pii.find_personal_data(df)
    assert out.count() == len(rows)
    assert pii.find_personal_data(empty).count() == 0
    written = hashlib.sha256(b"").hexdigest()
    assert out.select(F.sha2(pii._written(pii._base()), 256).alias("x")).filter(F.col("x") == written).count() > 100


def scored(texts, rounds=pii.ROUNDS):
    """The graph scoring in plain loops, for texts of words of which at most one is an identifier: {text number: kind} of what is discovered."""
    from math import sqrt

    seen, totals = [], {}
    for at, text in enumerate(texts):
        words = text.lower().split(" ")
        for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
            totals[g] = totals.get(g, 0) + 1
        for k, w in enumerate(text.split(" ")):
            kind = "ip" if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", w) else "secret" if re.fullmatch("[0-9a-f]{32}", w) else "candidate" if re.fullmatch(r"(?=.*\d.*\d.*\d)\w{5,}", w) else None
            if kind:
                beside = {"left": words[k - 1 : k], "right": words[k + 1 : k + 2], "left2": words[k - 2 : k] if k > 1 else [], "right2": words[k + 1 : k + 3] if k + 2 < len(words) else []}
                seen.append((at, kind, w.lower(), [(s, " ".join(x)) for s, x in beside.items() if x]))
    belief = {(v, k): 1.0 for _, k, v, _ in seen if k != "candidate"}
    lead = {}
    for _ in range(rounds):
        worth = {}
        for p in {p for *_, ps in seen for p in ps}:
            near = [(v, k) for _, k, v, ps in seen if p in ps]
            mass, n = sum(belief.get(x, 0.0) for x in near), totals[p[1]]
            if len({x for x in near if belief.get(x, 0) >= pii.MIN_CONFIDENCE}) < pii.MIN_SUPPORT or len({x for x in near if x[1] != "candidate"}) < pii.MIN_SUPPORT:
                continue
            share, z = min(mass / n, 1.0), pii.CHANCE
            low = (share + z * z / (2 * n) - z * sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if low >= pii.MIN_CONFIDENCE:
                by_kind = {k: sum(belief[x] for x in near if x[1] == k) for k in pii.SEEDS}
                worth[p] = (low, max(pii.SEEDS, key=lambda k: (by_kind[k], -pii.SEEDS.index(k))))
        if not worth:
            return {}
        belief = {x: b for x, b in belief.items() if x[1] != "candidate"}
        lead = {}
        for v in {v for _, k, v, _ in seen if k == "candidate"}:
            beside = {p for _, k, x, ps in seen if (x, k) == (v, "candidate") for p in ps if p in worth}
            doubt = 1.0
            for p in beside:
                doubt *= max(1 - worth[p][0], 1e-9)
            if 1 - doubt >= pii.MIN_CONFIDENCE:
                belief[(v, "candidate")] = 1 - doubt
                lead[v] = max((worth[p][0], -pii.SEEDS.index(worth[p][1]), worth[p][1]) for p in beside)[2]
    return {at: lead[v] for at, k, v, _ in seen if k == "candidate" and v in lead}


def test_graph_scoring_against_plain_loops(spark):
    r = random.Random(12)
    cues = {"ip": ["host", "server at"], "secret": ["token =", "key"]}
    made = {"ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "secret": lambda: "0a" + "".join(r.choice("0123456789abcdef") for _ in range(30))}
    common = "the of and was is for with".split()
    texts = []
    for _ in range(400):
        kind = r.choice(["ip", "secret"])
        what = made[kind]() if r.random() < 0.6 else f"id{r.randint(10**5, 10**5 + 60)}x"
        before = r.choice(cues[kind]) if r.random() < 0.8 else r.choice(common)
        texts.append(" ".join([r.choice(common), before, what, r.choice(common), r.choice(common)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rounds in (0, 1, 3):
        scanned = pii.scan(df)
        found = {x["doc_id"]: x["kind"] for x in pii.discover(df, scanned, rounds=rounds).collect()}
        assert found == (scored(texts, rounds) if rounds else {})
        assert bool(found) == bool(rounds)


def test_a_secret_in_another_form_is_found_by_its_pattern(spark):
    r = random.Random(1)
    rows = [(i, f'some prose here token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" and more') for i in range(9)]
    rows += [(50, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! END'), (51, "version 9233A8ECF7 of it")]
    out = {x["doc_id"]: x["spans"] for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[50]] == [("secret", 9, 49)] and out[51] == []
