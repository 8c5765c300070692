import random

import pytest
from pyspark.sql import functions as F

from strandwise.model import limit_symbols, require_rows, sequences
from strandwise.operators import anchors, bwt, lcp, matching, ranges, routed, symbols, validate
from strandwise.operators import suffix_array as sa
from strandwise.plans.ranking import global_rank, running_total

TEXTS = ["banana", "", "abc", "abc", "ab", "a" * 300, "ñaé😀", "mississippi", "x" * 40 + "y", "x" * 40 + "z", None]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def brute(texts, extra=0):
    suffixes = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t) + extra))
    return [(r, i, d) for r, (_, d, i) in enumerate(suffixes)]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("plan", ["ranges", "cover", "doubling"])
@pytest.mark.parametrize("extra", [False, True])
def test_gsa(docs_of, plan, extra):
    docs = sequences(docs_of(TEXTS))
    assert rows(sa.gsa(docs, extra, plan), "rnk", "idx", "doc") == brute([t or "" for t in TEXTS], extra)


@pytest.mark.parametrize("plan", ["ranges", "cover", "doubling"])
def test_lcp_all_plans(docs_of, plan):
    texts = [t or "" for t in TEXTS]
    suffixes = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t)))
    expected = [(r, d, i, common(s, suffixes[r - 1][0]) if r else 0) for r, (s, d, i) in enumerate(suffixes)]
    assert rows(sa.gsa_lcp(sequences(docs_of(TEXTS)), plan), "rnk", "doc", "idx", "lcp") == expected


def test_gsa_of_nothing(docs_of):
    assert sa.gsa(docs_of([]).limit(0)).count() == 0
    assert sa.gsa(docs_of([""])).count() == 0
    with pytest.raises(ValueError):
        require_rows(docs_of([""]), "collection")


def test_large_collections_take_the_other_plan(docs_of, monkeypatch):
    monkeypatch.setattr(sa, "COLLECTION_BYTES", 10)
    docs = docs_of(["banana", "bandana"])
    assert rows(sa.gsa(docs), "rnk", "idx", "doc") == brute(["banana", "bandana"])
    with pytest.raises(ValueError):
        sa.gsa(docs, plan="ranges")


def test_integer_suffix_array(spark):
    r = random.Random(3)
    seqs = {0: [r.randint(0, 2) for _ in range(60)], 1: [5] * 40, 2: [70_000, -1, 70_000], 3: [9]}
    given = spark.createDataFrame([(s, p, v) for s, vs in seqs.items() for p, v in enumerate(vs)], "seq long, pos long, value long")
    expected = sorted((s, k, p) for s, vs in seqs.items() for k, p in enumerate(sorted(range(len(vs)), key=lambda i: vs[i:])))
    assert rows(sa.integer_suffix_array(given), "seq", "rnk", "pos") == expected


def test_global_rank_with_ties_and_nulls(spark):
    values = [3, None, 1, 3, 2, None, 1, 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long")
    key = lambda v: (v is not None, v or 0)
    found = global_rank(df, ["v"], row="row", rank="rank").collect()
    assert sorted(r["row"] for r in found) == list(range(8))
    assert all(r["rank"] == sum(key(x) < key(r["v"]) for x in values) for r in found)
    total = running_total(df.fillna(0), ["i"], "v", "before").orderBy("i").collect()
    assert [r["before"] for r in total] == [sum(x or 0 for x in values[:i]) for i in range(8)]


def test_symbols(docs_of):
    docs = sequences(docs_of(["aab\nb", "", "mississippi", None]))
    assert rows(symbols.max_runs(docs), "symbol", "max_run") == [("\n", 1), ("a", 2), ("b", 1), ("i", 1), ("m", 1), ("p", 2), ("s", 2)]
    assert rows(symbols.bigrams(docs).filter("symbol = 's'"), "symbol", "next", "n") == [("s", "i", 2), ("s", "s", 2)]
    types = {r["idx"]: (r["type"], r["is_lms"]) for r in symbols.suffix_types(docs).filter("doc = 2").collect()}
    assert "".join(types[i][0] for i in range(11)) == "LSLLSLLSLLL"
    assert [i for i in range(11) if types[i][1]] == [1, 4, 7]
    assert rows(symbols.lengths(docs), "n_docs", "n_symbols", "max_length") == [(4, 16, 11)]
    assert rows(symbols.augmentation(docs_of(["ab"]), docs_of(["accab", "ddd"])), "symbol", "run") == [("c", "cc"), ("d", "ddd")]


def test_limit_cuts_inside_a_document(docs_of):
    assert rows(limit_symbols(docs_of(["abcd", "", "ef"]), 3), "doc", "text") == [(0, "abc")]
    assert rows(limit_symbols(docs_of(["ab", "cdef", "g"]), 4), "doc", "text") == [(0, "ab"), (1, "cd")]


def test_bwt_round_trips(docs_of):
    docs = sequences(docs_of(TEXTS))
    transforms = bwt.bwt(docs)
    assert rows(bwt.inverse(transforms), "doc", "text") == rows(docs, "doc", "text")
    back = bwt.join_blocks(bwt.inverse_blocks(transforms, bwt.samples(docs, 4), 4))
    assert rows(back, "doc", "text") == rows(docs.filter("text <> ''"), "doc", "text")
    with pytest.raises(ValueError):
        bwt.samples(docs, 3)


def brute_match(ref, s):
    order = sorted(ref[i:] for i in range(len(ref)))
    before = [r for r in order if r <= s]
    after = [r for r in order if r > s]
    p = common(s, before[-1]) if before else -1
    n = common(s, after[0]) if after else -1
    chosen = after[0] if n >= p else before[-1]
    return len(ref) - len(chosen), max(n, p), n >= p


@pytest.mark.parametrize("small", [False, True])
def test_matching_statistics(docs_of, monkeypatch, small):
    if small:
        for name, value in (("WIDTH", 1), ("RANGE", 2), ("PIECE", 3), ("LOAD", 2)):
            monkeypatch.setattr(routed, name, value)
    ref, texts = "abracadabra", ["cadabrac", "", "zzz", "abracadabra", "a"]
    expected = []
    for d, t in enumerate(texts):
        for i in range(len(t)):
            pos, n, smaller = brute_match(ref, t[i:])
            expected.append((d, i, pos, n, smaller, t[i + n] if i + n < len(t) else None))
    found = matching.matching_statistics(docs_of([ref]), docs_of(texts))
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    direct = matching.matching_statistics(docs_of([ref]), docs_of(texts), heads_only=True)
    key = lambda r: (r["doc"], r["idx"])
    assert sorted(direct.collect(), key=key) == sorted(matching.heads(found).collect(), key=key)


def test_a_text_matches_itself_whole(docs_of):
    found = matching.matching_statistics(docs_of(["mississippi"]), docs_of(["mississippi"])).collect()
    assert all(r["len"] == 11 - r["idx"] and r["next"] is None for r in found)
    assert matching.heads(matching.matching_statistics(docs_of(["mississippi"]), docs_of(["mississippi"]))).count() >= 1


@pytest.mark.parametrize("widths", [None, 1])
def test_patterns(spark, docs_of, monkeypatch, widths):
    if widths is not None:
        monkeypatch.setattr(anchors, "WIDTHS", widths)
    patterns = spark.createDataFrame([("ana",), ("a",), ("",), ("zz",)], "pattern string")
    docs = docs_of(["banana", "", "a"])
    assert rows(matching.locate(docs, patterns), "pattern", "doc", "idx") == [("a", 0, 1), ("a", 0, 3), ("a", 0, 5), ("a", 2, 0), ("ana", 0, 1), ("ana", 0, 3)]
    assert rows(matching.count_patterns(docs, patterns.filter("pattern <> ''")), "pattern", "n") == [("a", 4), ("ana", 2), ("zz", 0)]


def test_longest_shared(docs_of):
    found = matching.longest_shared(docs_of(["xx hello world yy hello", "none"]), docs_of(["a hello world"]), 5)
    assert rows(found, "doc", "item", "len") == [(0, 0, 12)]


@pytest.mark.parametrize("part", [4, 64])
def test_nearest_smaller(spark, part):
    r = random.Random(1)
    v = [r.randint(0, 9) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(v)), "i long, value long")
    expected = [(i, max((j for j in range(i) if v[j] < v[i]), default=-1), min((j for j in range(i, 50) if v[j] < v[i]), default=-1)) for i in range(50)]
    assert rows(ranges.nearest_smaller(df, part), "i", "psv", "nsv") == expected


def test_order_check_finds_faults(docs_of):
    docs = docs_of(["banana", "bandana"])
    good = sa.gsa(docs)
    assert rows(validate.check_order(docs, good), "n", "violations", "missing") == [(13, 0, 0)]
    swapped = good.withColumn("rnk", F.when(F.col("rnk") == 3, 9).when(F.col("rnk") == 9, 3).otherwise(F.col("rnk")))
    assert validate.check_order(docs, swapped).first()["violations"] > 0
    assert validate.check_order(docs, good.filter("rnk <> 5")).first()["missing"] == 1


def test_unique_prefix_and_repeat(docs_of):
    docs = docs_of(["banana"])
    assert rows(lcp.unique_prefix(docs), "idx", "len") == [(0, 0), (1, 3), (2, 2), (3, 3), (4, 2), (5, 1)]
    assert rows(lcp.longest_repeat(docs), "len", "substring") == [(3, "ana")]
    assert lcp.longest_repeat(docs_of(["abc"])).count() == 0
    assert rows(lcp.exact_duplicates(docs_of(["a", "b", "a", "", ""])), "doc", "dup_of") == [(2, 0)]


def _brute_below(values, at, bound, backward):
    places = [i for i, v in enumerate(values) if v < bound and (i <= at if backward else i >= at)]
    return (max if backward else min)(places, default=-1)


def test_nearest_below_over_parts_of_parts(spark):
    r = random.Random(2)
    values = [r.choice([1, 3, 5, 9]) for _ in range(90)] + list(range(40, 0, -1)) + [r.randint(0, 50) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, value long")
    asked = sorted({(r.randrange(len(values)), r.randint(0, 12)) for _ in range(150)})
    q = spark.createDataFrame(asked, "at long, bound long")
    for backward in (True, False):
        found = {(x["at"], x["bound"]): x["found"] for x in ranges.nearest_below(df, q, backward, part=4).collect()}
        assert found == {(a, b): _brute_below(values, a, b, backward) for a, b in asked}


def test_order_by_matches_is_the_order_of_texts(spark, docs_of):
    r = random.Random(6)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(8)] + ["abab" * 8, "abab" * 8, "zab"]
    docs, reference = docs_of(texts), docs_of(["abbaabababbaab"])
    ms = matching.matching_statistics(reference, docs)
    found = {(x["doc"], x["idx"]): x["rank"] for x in matching.order_by_matches(ms, sa.isa(sa.gsa(reference))).collect()}
    suffixes = {(d, i): t[i:] for d, t in enumerate(texts) for i in range(len(t))}
    order = sorted(suffixes.values())
    assert found == {k: order.index(s) for k, s in suffixes.items()}


def test_checks_find_what_is_out_of_order(spark, docs_of):
    long = "x" * 300
    docs = docs_of([long + "a", long + "b"])
    array = sa.gsa(docs)
    assert tuple(validate.check_order(docs, array).first()) == (602, 0, 0)
    swapped = array.withColumn("doc", F.when(F.col("idx") == 0, 1 - F.col("doc")).otherwise(F.col("doc")))
    assert validate.check_order(docs, swapped).first()["violations"] == 1
    heads = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 0, 300)], "rnk long, doc long, idx long")
    assert validate.check_heads_order(docs, heads).first()["violations"] == 2
    ms = spark.createDataFrame([(0, 0, 0, 300, False, "a"), (0, 1, 0, 299, True, "a"), (1, 300, 1, 1, True, None)], "doc long, idx long, pos long, len long, smaller boolean, next string")
    assert tuple(validate.check_heads(ms, docs, docs_of([long + "a"])).first()) == (3, 2)


def test_doubling_of_a_long_repeat_and_of_integers(spark, docs_of):
    docs = docs_of(["ab" * 60, "b" * 50, "ab" * 60])
    assert rows(sa.gsa(docs, plan="doubling"), "rnk", "idx", "doc") == rows(sa.gsa(docs), "rnk", "idx", "doc")
    assert rows(sa.gsa_lcp(docs, plan="doubling"), "rnk", "lcp") == rows(sa.gsa_lcp(docs), "rnk", "lcp")
    seqs = {0: [5, 5, 5, 7], 1: [5, 5], 2: [], 3: [2, 7, 2, 7]}
    df = spark.createDataFrame([(s, p, v) for s, x in seqs.items() for p, v in enumerate(x)], "seq long, pos long, value long")
    suffixes = sorted((x[p:], s, p) for s, x in seqs.items() for p in range(len(x)))
    assert rows(sa.integer_gsa(df), "rnk", "seq", "pos") == [(k, s, p) for k, (_, s, p) in enumerate(suffixes)]
    each = [(s, k, p) for s, x in seqs.items() for k, p in enumerate(sorted(range(len(x)), key=lambda p: x[p:]))]
    assert rows(sa.integer_suffix_array(df), "seq", "rnk", "pos") == sorted(each)


def test_unique_suffixes(spark, docs_of):
    texts = ["banana", "ana", "bandana", "", "ana"]
    every = [t[i:] for t in texts for i in range(len(t))]
    assert sa.unique_suffixes(docs_of(texts)).first()["n_unique"] == sum(every.count(s) == 1 for s in every)


def test_long_integer_sequences_go_through_tables(spark, monkeypatch):
    from strandwise.operators import integers

    r = random.Random(8)
    seqs = {3: [r.randint(0, 3) for _ in range(40)], 4: [7, 7, 7, 7], 9: [5]}
    df = spark.createDataFrame([(s, p, v) for s, x in seqs.items() for p, v in enumerate(x)], "seq long, pos long, value long")
    wanted = [rows(integers.lcp(df), "seq", "rnk", "pos", "lcp"), rows(integers.bwt(df), "seq", "row", "value", "primary")]
    monkeypatch.setattr(integers, "SEQUENCE_SYMBOLS", 2)
    assert [rows(integers.lcp(df), "seq", "rnk", "pos", "lcp"), rows(integers.bwt(df), "seq", "row", "value", "primary")] == wanted
    assert rows(integers.inverse_bwt(integers.bwt(df)), "seq", "pos", "value") == sorted((s, p, v) for s, x in seqs.items() for p, v in enumerate(x))


def test_rounds_of_a_long_walk_do_not_grow_with_it(spark, monkeypatch):
    from strandwise.operators import integers

    written = []
    keep = integers.materialise
    monkeypatch.setattr(integers, "materialise", lambda df, name: written.append((name, (out := keep(df, name)).count())) or out)
    monkeypatch.setattr(integers, "SEQUENCE_SYMBOLS", 300)
    r = random.Random(3)
    seqs = {1: [r.randint(0, 400) for _ in range(1000)], 2: [5, 1], 6: [r.randint(0, 9) for _ in range(700)]}
    df = spark.createDataFrame([(s, p, v) for s, x in seqs.items() for p, v in enumerate(x)], "seq long, pos long, value long")
    transform = integers.bwt(df)
    written.clear()
    assert rows(integers.inverse_bwt(transform), "seq", "pos", "value") == sorted((s, p, v) for s, x in seqs.items() for p, v in enumerate(x))
    # by doubling all of them there were ten rounds of all nodes
    assert sum(n for name, n in written if name == "int-walk") < 4 * 1702
