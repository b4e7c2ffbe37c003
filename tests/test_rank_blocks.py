"""Ranks by blocks of nodes: against a plain loop, and what a step moves."""

import random

import pytest

from codeloom.operators import rank


def by_hand(nodes, edges, steps, damping):
    nodes = set(nodes)
    edges = [e for e in edges if e[1] is not None and e[1] in nodes]
    total = {}
    for src, _, strength in edges:
        total[src] = total.get(src, 0.0) + strength
    ranks = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(steps):
        got = dict.fromkeys(nodes, 0.0)
        for src, dst, strength in edges:
            if src is not None and src in nodes:
                got[dst] += ranks[src] * strength / total[src]
        ranks = {p: (1 - damping) / len(nodes) + damping * g for p, g in got.items()}
    return ranks


@pytest.mark.parametrize("block_nodes,row_edges,steps", [(1 << 20, 1 << 19, 21), (40, 7, 0), (40, 7, 11)])
def test_ranks(spark, monkeypatch, block_nodes, row_edges, steps):
    for name, value in (("BLOCK_NODES", block_nodes), ("BLOCK_EDGES", block_nodes), ("ROW_EDGES", row_edges)):
        monkeypatch.setattr(rank, name, value, raising=False)
    rng = random.Random(5)
    nodes = [f"d/{i}.py" for i in range(150)] + [None, "", "d/1.py"]
    ends = [*nodes[:140], "gone.py", None]
    edges = [(rng.choice(ends), rng.choice(ends), rng.choice((1.0, 2.0))) for _ in range(700)] + [("d/7.py", n, 1.0) for n in nodes[:140]] + [(n, "d/9.py", 2.0) for n in nodes[:140]]
    found = rank.pagerank(spark.createDataFrame([(n,) for n in nodes], "path string"), spark.createDataFrame(edges, "src string, dst string, strength double"), steps, 0.7).collect()
    want = by_hand(nodes, edges, steps, 0.7)
    assert len(found) == len(want) and {r.path: pytest.approx(r["rank"], rel=1e-12) for r in found} == want


def test_what_steps_move(spark, monkeypatch):
    """Rows of all shuffles: some for each edge before the steps, but none for each edge and step."""
    monkeypatch.setattr(rank, "BLOCK_EDGES", 16_000, raising=False)
    n, m = 20_000, 60_000
    nodes, edges = spark.range(n).withColumnRenamed("id", "path"), spark.range(m).selectExpr("pmod(hash(id), 20000L) src", "pmod(hash(id, 1), 20000L) dst", "1.0D strength")
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    assert rank.pagerank(nodes, edges).count() == n
    assert moved() - before < 8 * m
