import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.llm import url_rules as u


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path


def plain_rule(host, path):
    fits = [r for r, _ in u.BASE_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "nothing", "http://", "http://A.COM", "http://a.com/", "http://example.com/en/x", "https://www.example.com/en/?q", "https://xwww.example.com/en/", "http://b.net/es/1#x", "http://net/fr/",
    "http://xnet/fr/", "x://y://z/p", "http://com?x/", "http://É.com/É", "http://a.com:80/en/", "http://example.com/EN/", "http://m.www.example.com/en/z",
]


def judged(spark, urls, rules=u.Rules((), ())):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    return {r["page_id"]: r for r in u.filter_urls(df, rules).collect()}


def check(spark, urls):
    out = judged(spark, urls)
    for i, x in enumerate(urls):
        host, path = plain_parts(x)
        rule = plain_rule(host, path)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (host, path, rule, dict(u.BASE_RULES).get(rule, "allow")), x


def test_base_rules(spark):
    check(spark, URLS)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ahtp:/?#.Encomts\n", max_size=25), min_size=30, max_size=40))
def test_any_url(spark, urls):
    check(spark, urls)


def test_mined_rules(spark):
    r = random.Random(3)
    pages, labels = [], []
    for i in range(400):
        spam = i % 4 == 0
        name = r.choice(["casino-win", "free-bets"]) if spam else r.choice(["news", "wiki", "shop"])
        pages.append((i, f"https://{name}{'.example.org' if spam else '.site.org'}/{r.choice(['a', 'b'])}/{i}"))
        labels.append((i, 0 if spam else 1, 0))
    pages += [(1000, "http://casino-win.example.org/zz/7"), (1001, "http://fresh.site.org/a/1"), (None, None), (1000, "http://casino-win.example.org/zz/7"), (1002, "http://casino.net/es/1")]
    labels += [(None, 0, 1), (0, None, None), (5000, 0, 1)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    rules = u.mine(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rules.combinations and min(rules.confidence) >= u.MIN_CONFIDENCE
    index = rules.index()
    assert all(i in index[t] for i, c in enumerate(rules.combinations) for t in c)
    out = u.filter_urls(p, rules).collect()
    assert len(out) == len(pages)
    # the inverted index gives what looking at every rule gives
    for row in out:
        have = set(u.tokens(row["host"], row["path"]))
        fired = any(set(c) <= have for c in rules.combinations)
        assert (row["mined_rule"] is not None) == fired
        assert row["verdict"] == (dict(u.BASE_RULES)[row["rule"]] if row["rule"] else "block" if fired else "allow")
    by_id = {r["page_id"]: r["verdict"] for r in out}
    assert by_id[1000] == "block" and by_id[1001] == "allow" and by_id[None] == "allow"
    assert all(by_id[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))


def test_nothing_labelled(spark):
    p = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert u.mine(p, labels) == u.Rules((), ())
    assert u.filter_urls(p.limit(0), u.Rules((), ())).count() == 0


def labelled(spark, rows):
    """pages and labels from (url, bad)."""
    pages = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "page_id long, url string")
    return pages, spark.createDataFrame([(i, 0 if b else 1, 0) for i, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")


def test_rules_of_every_shape_survive(spark):
    """90 sure shapes of 8 tokens, and shapes of confidence 0.9 that the sure ones' supersets must not push out."""
    rows = [(f"http://s{i}.t{i}.u{i}.v{i}/w{i}/x{i}/y{i}", True) for i in range(90) for _ in range(8)]
    rows += [(f"http://less{i}.org/{k}", k > 0) for i in range(5) for k in range(10)]
    rows += [(f"http://good{k}.org/a", False) for k in range(50)]
    rules = u.mine(*labelled(spark, rows))
    assert {f"host=less{i}.org" for i in range(5)} | {f"host=s{i}.t{i}.u{i}.v{i}" for i in range(90)} <= {c[0] for c in rules.combinations}
    have = set(rules.combinations)
    assert not any(set(a) < set(b) for a in have for b in have)


def test_support_does_not_grow_with_the_labelled_pages(spark):
    rows = [("http://bad.net/p", True)] * 10 + [(f"http://good.org/{'abc'[k % 3]}", False) for k in range(6000)]
    p, labels = labelled(spark, rows)
    assert ("host=bad.net",) in u.mine(p, labels).combinations


def test_combinations_against_all_subsets(spark):
    r = random.Random(5)
    rows = [("http://h{}.com/{}/{}".format(r.randrange(2), r.choice("ab"), r.choice("cd")), None) for _ in range(400)]
    rows = [(x, "h0" in x and "/a" in x if r.random() < 0.93 else r.random() < 0.5) for x, _ in rows]
    sets = [(set(u.tokens(*plain_parts(x))), b) for x, b in rows]
    names = sorted(set().union(*(t for t, _ in sets)))
    wanted = {}
    for k in range(1, len(names) + 1):
        for c in itertools.combinations(names, k):
            hits = [b for t, b in sets if set(c) <= t]
            if sum(hits) >= u.MIN_PAGES and sum(hits) / len(hits) >= u.MIN_CONFIDENCE and not any(set(w) < set(c) for w in wanted):
                wanted[c] = sum(hits) / len(hits)
    rules = u.mine(*labelled(spark, rows))
    assert any(len(c) > 1 for c in wanted) and dict(zip(rules.combinations, rules.confidence)) == wanted
