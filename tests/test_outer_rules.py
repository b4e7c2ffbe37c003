"""Ignore rules from above a folder, and operators that the tables don't show in full."""

from pyspark.sql import functions as F

from codeloom.operators import graph, packing, rank, search
from codeloom.sources import repository


def test_rules_of_outer_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    tree = tmp_path / "tree"
    texts = {"config/git/ignore": "*.mine\n", "tree/.git/HEAD": "", "tree/.gitignore": "*.log\n/top.py\n/in/gone.py\n", "tree/in/.gitignore": "!keep.log\n", "tree/in/a.py": "", "tree/in/b.log": "", "tree/in/keep.log": "", "tree/in/c.mine": "", "tree/in/gone.py": "", "tree/in/top.py": ""}
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.path for r in repository.read_repository(spark, str(tree / "in")).collect()}
    assert got == {".gitignore", "a.py", "keep.log", "top.py"}
    assert repository.configured_roots(str(tree)) is None


def test_rank_of_dangling_and_missing_nodes(spark):
    nodes = spark.createDataFrame([(p,) for p in "abcd"] + [("a",)], "path string")
    edges = graph.upgraded_edges(spark.createDataFrame([("a", "b", "Import"), ("a", "b", "SymbolUsage"), ("a", "c", "SymbolUsage"), ("b", "a", "Import"), ("c", "ghost", "Import"), ("d", "d", "Import")], "src string, dst string, kind string"))
    want = {p: 0.25 for p in "abcd"}
    for _ in range(20):  # the mass that c, d and the missing node hold is lost
        want = {"a": 0.0375 + 0.85 * want["b"], "b": 0.0375 + 0.85 * want["a"] * 2 / 3, "c": 0.0375 + 0.85 * want["a"] / 3, "d": 0.0375}
    got = {r.path: r["rank"] for r in rank.pagerank(nodes, edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert rank.pagerank(nodes.limit(0), edges).count() == 0 and rank.pagerank(nodes, edges.limit(0)).filter("abs(rank - 0.0375) < 1e-12").count() == 4


def test_neighborhood_without_edges(spark):
    edges = spark.createDataFrame([("a", "b", "Import"), ("b", "c", "SymbolUsage"), ("c", "d", "Import"), ("x", "c", "SymbolUsage")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("a",)], "path string")
    assert {(r.path, r.hop) for r in rank.neighborhood(edges, seeds, 5).collect()} == {("b", 1), ("c", 2), ("x", 3)}
    assert rank.neighborhood(edges.limit(0), seeds, 5).count() == 0 and rank.neighborhood(edges, seeds.limit(0), 5).count() == 0


def test_searches_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 3)
    rows = [(f"p{i % 7}", [float(i), 1.0, -float(i % 3)]) for i in range(20)] + [("zero", [0.0, 0.0, 0.0]), ("none", None), ("p0", [0.0, 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "path string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None)], "query_id int, embedding array<float>")

    def cosine(x, y):
        n = (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
        return sum(a * b for a, b in zip(x, y)) / n if n else 0.0

    for k in (None, 2):
        got = {(r.query_id, r.path): r.similarity for r in search.similarities(vectors, queries, k).collect()}
        want = {}
        for q, v in ((1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])):
            best = {}
            for p, e in rows:
                if e is not None:
                    best[p] = max(best.get(p, -2.0), cosine(v, e))
            top = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
            want |= {(q, p): s for p, s in top}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
    assert search.similarities(vectors.limit(0), queries, 3).count() == 0 and search.similarities(vectors, queries.limit(0)).count() == 0
    one = search.file_scores(vectors, queries).filter("query_id = 2 and path = 'p0'").first()
    exact = vectors.select("path", search.cosine(F.col("embedding"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).alias("s")).groupBy("path").agg(F.max("s").alias("s"))
    assert abs(one.similarity - exact.filter("path = 'p0'").first().s) < 1e-6


def test_first_fit_of_many(spark):
    sizes = [(g, i, [700, 1, 3000, 299, 0, -4, 4000, 7][(i * 7 + g) % 8]) for g in range(3) for i in range(400)]
    items = spark.createDataFrame(sizes, "grp int, ord int, tokens int")
    want = []
    for g in range(3):
        used = 0
        for i, n in [(i, n) for h, i, n in sizes if h == g]:
            if 0 < n and used + n <= 3000:
                used += n
                want.append((g, i, used))
    assert sorted(tuple(r) for r in packing.first_fit(items.repartition(5), 3000).collect()) == want
    assert packing.first_fit(items.limit(0), 3000).count() == 0
