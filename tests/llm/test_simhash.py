"""SimHash near duplicates against all pairs, on texts and on clusters of fingerprints that share long keys."""

import random

from formweave.llm import simhash
from formweave.llm.common import table, written
from formweave.llm.components import connected_components

ODD = [None, "", " \n", "one", "One", "one two", "A b c", "a B C d", "é日 ÀB c d " * 5, "w " * 40_000, "w " * 40_000, "x\x0by\x1cz \x85 q", "a b c"]


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_simhash(spark, sf):
    want = simhash.brute_force([tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()])
    got = {r.doc_id: tuple(r)[1:] for r in simhash.op11_simhash(spark, sf).collect()}
    assert got == want and any(c != d for d, (_, c) in want.items())


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, fp int, component_id string")
    got = {r.doc_id: tuple(r)[1:] for r in simhash.near_duplicates(docs, "doc_id", "text").collect()}
    assert got == simhash.brute_force(list(enumerate(ODD)))
    assert got[0] == got[1] == ("0" * 16, 0)
    assert simhash.near_duplicates(docs.limit(0), "doc_id", "text").collect() == []
    odd = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "A  b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(odd, "doc_id", "text").collect()) == [(0, 0), (5, 5), (5, 5), (7, 5)]


def test_links_of_clusters_equal_all_pairs(spark):
    """Clusters spread over few bits (long keys), over all bits (short keys), and at the sign bit."""
    rng, values = random.Random(4), set()
    for centre, flexible, n in ((rng.getrandbits(64), range(40, 52), 400), (rng.getrandbits(64), range(64), 300), (1 << 63, (0, 1, 22, 43, 62, 63), 40)):
        flexible = list(flexible)
        for _ in range(n):
            x = centre
            for b in rng.sample(flexible, rng.randint(0, 3)):
                x ^= 1 << b
            values.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    links = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    rows = [(r.a, r.b) for r in links.collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in rows)
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & mask).bit_count() <= 2]
    want = groups(signed, pairs)
    assert groups(signed, rows) == want
    linked = {r.node: r.component for r in connected_components(links).collect()}
    assert linked == {n: want[n] for n in linked} and len(set(want.values())) == len(signed) - len(linked) + len(set(linked.values()))


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes probes, 66 a class, for as large as their classes: no join may send them to the driver."""
    plans, classes = [], written(spark.range(2000).selectExpr("xxhash64(id) AS fp"), "classes")

    def seen(df, label, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label, **kw)

    monkeypatch.setattr(simhash, "written", seen)
    assert simhash.hamming_links(classes).count() == 0
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
