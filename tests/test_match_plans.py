"""Joins of a row a suffix on both sides send neither to all tasks."""

from strandwise.operators import matching
from strandwise.operators import suffix_array as sa
from strandwise.plans import ranking, storage


def test_order_by_matches_sends_no_suffixes_to_all(docs_of, monkeypatch):
    docs, ref, plans, write = docs_of(["banana band", "bandana", "ana"]), docs_of(["a banana and a band"]), [], storage.materialise

    def seen(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **options)

    for module in (storage, ranking):
        monkeypatch.setattr(module, "materialise", seen)
    found = matching.order_by_matches(matching.matching_statistics(ref, docs), sa.isa(sa.gsa(ref)))
    suffixes = sorted(t[i:] for t in ("banana band", "bandana", "ana") for i in range(len(t)))
    assert sorted(r["rank"] for r in found.collect()) == sorted(suffixes.index(s) for s in suffixes)
    assert len(plans) > 3 and not any("BroadcastHashJoin [doc" in p for p in plans)
