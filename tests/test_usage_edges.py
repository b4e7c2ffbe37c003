"""Edges by names used: whatever fits a broadcast, the same pairs, and what is shuffled for them."""

import random

import pytest

from codeloom import tables
from codeloom.operators import graph


@pytest.fixture(autouse=True)
def no_broadcast_of_its_own(spark):
    """Small tables are broadcast only where the operator says so, as large ones would be."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def by_hand(definitions, usages, limit):
    files = {}
    for path, name, _ in definitions:
        files.setdefault(name, set()).update({path} - {None})
    return {(a, b) for a, n, f in usages for b, m, g in definitions if None not in (a, b, n, f) and a != b and n == m and f == g and len(files[n]) <= limit}


@pytest.mark.parametrize("bound", [32 << 20, 2000, 0])
def test_pairs(spark, monkeypatch, bound):
    rng = random.Random(7)
    paths, names, families = [*map(str, range(60)), None], [*(f"n{i}" for i in range(90)), "", None], ["a", "b", None]
    rows = lambda n: [(rng.choice(paths), rng.choice(names), rng.choice(families)) for _ in range(n)]
    definitions, usages = rows(330), rows(900)
    definitions += definitions[:40]
    monkeypatch.setattr(tables, "BROADCAST_BYTES", bound)
    found = graph.symbol_usage_edges(*(spark.createDataFrame(x, "path string, name string, family string") for x in (definitions, usages))).collect()
    want = by_hand(definitions, usages, graph.NOISY_DEFINITIONS)
    assert want and len(found) == len(want) and {(r.src, r.dst) for r in found} == want


@pytest.mark.parametrize("bound", [32 << 20, 100_000])
def test_what_usages_move(spark, monkeypatch, bound):
    """Usages of names that nothing keeps are not shuffled, even where definitions don't fit a broadcast."""
    monkeypatch.setattr(tables, "BROADCAST_BYTES", bound)
    definitions = spark.range(6000).selectExpr("id path", "concat('some longer name ', xxhash64(id)) name", "'f' family")
    usages = spark.range(200_000).selectExpr("id % 20000 path", "if(id % 100 = 0, concat('some longer name ', xxhash64(id div 100)), concat('x', id)) name", "'f' family")
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    assert graph.symbol_usage_edges(definitions, usages).count() == 1999  # the first name is used where it is defined
    assert moved() - before < 100_000
