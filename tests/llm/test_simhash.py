import random

import pytest
import xxhash
from pyspark.sql import functions as F

from strandwise.llm import graph, simhash


def plain_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = t.encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_fingerprints(corpus):
    for row in corpus[0]:
        if len(row[1] or "") < 5_000:
            assert simhash.fingerprint(row[1]) == plain_fingerprint(row[1])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [simhash.HOT_ANCHOR, 3])
def test_links_join_what_all_pairs_join(spark, hot):
    r = random.Random(4)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for k in (0, 1, 2, 3, 3, 4, 5, 6):
            y = x
            for b in r.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    chain = r.getrandbits(64)
    for b in range(0, 64, 3):
        fps.add(chain)
        chain ^= 7 << b if b < 61 else 1 << b
    fps |= {0, 1, 6, (1 << 64) - 1, (1 << 63)}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in graph.connected_components(simhash.near_links(df, hot=hot)).collect()}
    nodes = sorted(signed(x) for x in fps)
    expected = classes(nodes, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    assert {n: roots.get(n, n) for n in nodes} == expected


def test_components_of_chains_and_stars(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (None, 3), (2, 1)]
    r.shuffle(links)
    found = {x["node"]: x["root"] for x in graph.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 1: 1, 2: 1}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_round_of_components_plans_each_star_once(spark, monkeypatch):
    from strandwise.llm import _common

    plans, save = [], _common.save

    def noted(df, name, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(df, name, **options)

    monkeypatch.setattr(_common, "save", noted)
    monkeypatch.setattr(graph, "save", noted)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    assert {r["root"] for r in graph.connected_components(links).collect()} == {0}
    assert max(p.count("Join ") for p in plans) <= 3 and max(p.count("Aggregate") for p in plans) <= 1


def test_documents(spark, corpus, empty):
    rows, df = corpus
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    keyed = {i: (r[0], simhash.fingerprint(r[1])) for i, r in enumerate(rows)}
    group = classes(list(keyed), lambda a, b: (keyed[a][1] ^ keyed[b][1]).bit_count() <= 3)
    least = {}
    for i, g in group.items():
        ids = [x for x in (least.get(g), keyed[i][0]) if x is not None]
        least[g] = min(ids, default=None)
    expected = sorted((keyed[i][0] if keyed[i][0] is not None else -1, signed(keyed[i][1]), least[group[i]]) for i in keyed)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"], r["component_id"]) for r in found) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(3, text, "a"), (1, text, "b"), (1, text, "b"), (2, "something else entirely here", "c"), (4, None, "d"), (5, "", "e")], "doc_id long, text string, u string")
    kept = simhash.keep_first(df, simhash.near_duplicates(df))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


def test_which_row_stays_is_defined(spark):
    """Null ids of different groups stay each, one id's different texts stay each, equal rows are one."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "thirteen fourteen fifteen sixteen"
    rows = [(None, a, "x"), (None, b, "y"), (None, b, "x"), (5, c, "p"), (5, "other words of the same id", "q"), (6, c, "r"), (None, c, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_first string")
    runs = [sorted(map(tuple, simhash.keep_first(x, simhash.near_duplicates(x)).collect()), key=str) for x in (df, df.repartition(4))]
    assert runs[0] == runs[1]
    assert sorted((r[0] or -1, r[1]) for r in runs[0]) == sorted([(-1, a), (-1, b), (5, c), (5, "other words of the same id")])


def test_hot_keys_meet_in_no_task(spark, monkeypatch):
    """With a bound of one row all keys take the way of the hot ones; the result is the same."""
    from strandwise.llm import _common

    r = random.Random(4)
    links = spark.createDataFrame([(r.randint(0, 60), r.randint(0, 60)) for _ in range(50)] + [(100, i) for i in range(101, 140)], "u long, v long")
    texts = spark.createDataFrame([(i, ["same words here now", "", "other words there then"][i % 3]) for i in range(30)], "doc_id long, text string")
    wanted = sorted(map(tuple, graph.connected_components(links).collect())), sorted(map(tuple, simhash.near_duplicates(texts).collect()))
    monkeypatch.setattr(_common, "HOT_ROWS", 1)
    assert (sorted(map(tuple, graph.connected_components(links).collect())), sorted(map(tuple, simhash.near_duplicates(texts).collect()))) == wanted


def test_threshold_bound(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), threshold=4)
    assert simhash.near_links(spark.createDataFrame([(1,), (15,)], "fp long"), threshold=2).count() == 0
    assert simhash.near_links(spark.createDataFrame([(1,), (7,)], "fp long").select(F.col("fp")), threshold=2).count() >= 1
