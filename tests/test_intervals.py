"""Common prefixes from irreducible places, and the tree of intervals, against plain enumeration."""

import random

import pytest

from strandwise.operators import intervals, irreducible
from strandwise.operators import suffix_array as sa

from .test_engine import TEXTS, common, rows


def texts():
    r = random.Random(3)
    long = "".join(r.choice("ab") for _ in range(300))
    out = [t or "" for t in TEXTS] + [long, long, "c" + long[40:], "a" * 70, "é😀\x00é😀\x00é"]
    return out + ["".join(r.choice("abé") for _ in range(r.randint(0, 40))) for _ in range(12)]


def order(given):
    return sorted((t[i:], d, i) for d, t in enumerate(given) for i in range(len(t)))


def substrings(given):
    """{text: (ranks, symbols before, symbols behind)}; ends of documents are like no symbol."""
    found = {}
    for k, (s, d, i) in enumerate(order(given)):
        for n in range(1, len(s) + 1):
            ranks, before, behind = found.setdefault(s[:n], ([], set(), set()))
            ranks.append(k)
            before.add(given[d][i - 1] if i else ("doc", d))
            behind.add(s[n] if n < len(s) else ("end", d))
    return found


def array_of(docs):
    return sa.gsa(docs, plan="ranges"), sa.gsa_lcp(docs, plan="ranges")


@pytest.mark.parametrize("block", [16, 1 << 14])
def test_prefixes(docs_of, monkeypatch, block):
    monkeypatch.setattr(irreducible, "RANKS", block)
    monkeypatch.setattr(irreducible, "LONGEST", 64)
    given = texts()
    suffixes = order(given)
    wanted = [(k, i, d, common(s, suffixes[k - 1][0]) if k else 0) for k, (s, d, i) in enumerate(suffixes)]
    docs = docs_of(given)
    assert rows(irreducible.prefixes(docs, sa.gsa(docs, plan="ranges")), "rnk", "idx", "doc", "lcp") == wanted
    plcp = {(d, i): n for _, i, d, n in wanted}
    before = lambda d, i: given[d][i - 1] if i else None
    own = [(d, i, plcp[d, i]) for k, (_, d, i) in enumerate(suffixes) if not k or not i or before(d, i) != before(*suffixes[k - 1][1:])]
    assert rows(irreducible.irreducible_prefixes(docs, sa.gsa(docs, plan="ranges")), "doc", "idx", "plcp") == sorted(own)


def test_documents_of_any_numbers(docs_of):
    given = [(-(1 << 62), "banana"), (5, "ananas"), (1 << 62, "banana")]
    suffixes = sorted((t[i:], d, i) for d, t in given for i in range(len(t)))
    wanted = [(k, i, d, common(s, suffixes[k - 1][0]) if k else 0) for k, (s, d, i) in enumerate(suffixes)]
    assert rows(sa.gsa_lcp(docs_of(given), plan="cover"), "rnk", "idx", "doc", "lcp") == wanted


def test_nothing(docs_of):
    for given in ([""], ["", ""]):
        docs = docs_of(given)
        assert sa.gsa_lcp(docs, plan="cover").count() == 0
    array, prefixes = array_of(docs_of(["x"]))
    assert rows(intervals.tree(prefixes), "first", "last", "depth", "parent_first") == [(0, 0, 0, None)]
    assert intervals.suffix_links(array, prefixes).count() == 0
    assert intervals.maximal_repeats(docs_of(["x"]), array, prefixes).count() == 0


@pytest.mark.parametrize("part", [16, 1 << 16])
def test_tree(docs_of, part):
    given = texts()[-14:] + ["ab" * 12, "ab" * 12]
    found = substrings(given)
    n = sum(map(len, given))
    nodes = {w: (x[0][0], x[0][-1], len(w)) for w, x in found.items() if len(x[0]) > 1 and len(x[2]) > 1}
    up = lambda w: next((nodes[w[:k]] for k in range(len(w) - 1, 0, -1) if w[:k] in nodes), (0, n - 1, 0))
    docs = docs_of(given)
    array, prefixes = array_of(docs)
    wanted = [(0, n - 1, 0, None, None, None)] + [(*x, *up(w)) for w, x in nodes.items()]
    key = lambda x: x[:3]
    columns = ("first", "last", "depth", "parent_first", "parent_last", "parent_depth")
    assert sorted((tuple(r[c] for c in columns) for r in intervals.tree(prefixes, part).collect()), key=key) == sorted(wanted, key=key)
    links = [(*x, *(nodes[w[1:]][:2] if len(w) > 1 else (0, n - 1))) for w, x in nodes.items()]
    assert rows(intervals.suffix_links(array, prefixes, part), "first", "last", "depth", "link_first", "link_last") == sorted(links)
    suffixes = order(given)
    for least in (1, 3):
        repeats = [(a, z, d, *suffixes[a][1:]) for w, (a, z, d) in nodes.items() if len(found[w][1]) > 1 and d >= least]
        assert rows(intervals.maximal_repeats(docs, array, prefixes, least, part), "first", "last", "len", "doc", "idx") == sorted(repeats)
