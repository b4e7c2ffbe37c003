"""The registered queries against their SQL: literal repositories, and the given tables at a small scale."""

import duckdb
import pytest

from codeloom.plans import code_queries, registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    return round(v, 6) if isinstance(v, float) else v


def same(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in found.fetchall())


#: These build whole repositories; test_engine has such, and they run with all others against the given tables.
LARGE = ("q29", "q70", "q71", "q75", "q88", "q89", "q90", "q91", "q92", "q96", "q28b")


@pytest.mark.parametrize("name", [n for n in code_queries.QUERIES if not n.startswith(LARGE)])
def test_literal_repositories(spark, duck, name):
    same(spark, duck, name)


@pytest.mark.parametrize("name", ["q03_dependents", "q09_symbol_usage_edges", "q10_cosine_topk", "q15_greedy_fill", "q16_adaptive_params", "q19_debounce_leading", "q27_theta_prefix_join", "q30_consistency_checks"])
def test_tables(spark, duck, name):
    same(spark, duck, name)
