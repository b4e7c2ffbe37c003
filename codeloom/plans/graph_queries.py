"""Graph operators over the successor graph and the word graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, rank
from ..tables import written
from . import testgraph
from .testgraph import SQL, table


def q01_edges_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testgraph.edges(spark, sf_dir)


def q02_graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statistics(testgraph.nodes(spark, sf_dir), testgraph.edges(spark, sf_dir))


def q03_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the part with the most edges into it."""
    edges = written(testgraph.edges(spark, sf_dir), "edges")
    top = graph.in_degree(edges).orderBy(F.desc("in_degree"), "path").first()
    node = top.path if top else None
    sides = (("dependent", graph.dependents(edges, node)), ("dependency", graph.dependencies(edges, node)))
    into, out = (found.select(F.lit(side).alias("side"), "path", "kind") for side, found in sides)
    return into.unionByName(out)


def ranks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.pagerank(testgraph.nodes(spark, sf_dir), testgraph.edges(spark, sf_dir))


def q04_pagerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ranks_of(spark, sf_dir).withColumn("rank", F.round("rank", 9))
    return rank.top_ranked(rounded, 50)


def q04b_pagerank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks_of(spark, sf_dir).withColumn("rank", F.round("rank", 9))


def q05_weighted_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each edge in the outgoing strength of its source."""
    return rank.weighted_shares(testgraph.edges(spark, sf_dir)).withColumn("share", F.round("share", 9))


def q06_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(testgraph.edges(spark, sf_dir), "edges")
    seed = graph.in_degree(edges).orderBy(F.desc("in_degree"), "path").limit(3)
    return rank.decayed(rank.neighborhood(edges, seed, 3), 40)


def q07_rank_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ranks_of(spark, sf_dir).withColumn("rank", F.round("rank", 9))
    return rank.stars(rounded)


def words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Definitions (the first word of a line) and usages (the others) of documents, with the language as family."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select(F.col("doc_id").alias("path"), F.col("lang").alias("family"), "source", F.filter(F.split("line", " "), lambda w: w != "").alias("ws")).filter(F.size("ws") > 0)
    definitions = lines.select("path", "family", "source", F.col("ws")[0].alias("name"))
    usages = lines.select("path", "family", "source", F.explode(F.slice("ws", 2, F.size("ws"))).alias("name"))
    return definitions, usages


def q08_noisy_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.noisy_symbols(words(spark, sf_dir)[0])


def q09_symbol_usage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate: both documents are of one source, which therefore is part of the family that pairs are made in."""
    definitions, usages = (w.withColumn("family", F.struct("family", "source")) for w in words(spark, sf_dir))
    return graph.symbol_usage_edges(definitions, usages)


def q26_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that lead to no page."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("dst"))
    return graph.unresolved(links, pages.select(F.col("url").alias("path")))


#: Edges and nodes that break a rule each, as (src, dst, kind, strength) and path.
BROKEN_EDGES = ((-1, 1, "Import", 2.0), (-1, 2, "Import", 2.0), (1, -2, "Import", 2.0), (3, 3, "Import", 2.0), (1, 2, "Guess", 1.0), (1, -3, "Import", 7.0), (-4, -4, "SymbolUsage", 1.0), (-4, -4, "SymbolUsage", 1.0))
BROKEN_NODES = (1, 1, 2)


def q30_consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The successor graph with edges and nodes that break every rule."""
    edges = testgraph.edges(spark, sf_dir).unionByName(spark.createDataFrame(BROKEN_EDGES, "src long, dst long, kind string, strength double"))
    nodes = testgraph.nodes(spark, sf_dir).unionByName(spark.createDataFrame([(n,) for n in BROKEN_NODES], "path long"))
    return graph.consistency(nodes, written(edges, "edges"))


def q31_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph, one without edges by symbols, one without edges, none at all."""
    nodes, edges = testgraph.nodes(spark, sf_dir), written(testgraph.edges(spark, sf_dir), "edges")
    cases = {"whole": (nodes, edges), "imports": (nodes, edges.filter("kind = 'Import'")), "no edges": (nodes, edges.limit(0)), "empty": (nodes.limit(0), edges.limit(0))}
    out = None
    for name, (n, e) in cases.items():
        one = graph.health(graph.statistics(n, e)).select(F.lit(name).alias("graph"), "status", F.array_join("issues", ", ").alias("issues"))
        out = one if out is None else out.unionByName(one)
    return out


def q18_edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of lines shipped before 1996 against that of lines before 1997."""
    all_lines = testgraph.candidates(spark, sf_dir)
    old, new = (graph.upgraded_edges(all_lines.filter(F.col("l_shipdate") < F.lit(d).cast("timestamp_ntz"))) for d in ("1996-01-01", "1997-01-01"))
    return graph.edge_differences(old, new)


QUERIES = {f.__name__: f for f in (q01_edges_upgrade, q02_graph_statistics, q03_dependents, q04_pagerank_top, q04b_pagerank_all, q05_weighted_out_degree, q06_neighborhood, q07_rank_stars, q08_noisy_symbols, q09_symbol_usage_edges, q18_edge_diff, q26_unresolved, q30_consistency_checks, q31_health)}

_RANK = SQL + """,
tot AS (SELECT src, sum(strength) AS total FROM edges GROUP BY src),
sh AS MATERIALIZED (SELECT e.src, e.dst, e.strength / t.total AS share FROM edges e JOIN tot t USING (src)),
cnt AS (SELECT count(*)::DOUBLE AS n FROM nodes),
r0 AS MATERIALIZED (SELECT path, 1.0 / n AS rank FROM nodes, cnt)""" + "".join(
    f""",
r{i} AS MATERIALIZED (SELECT nodes.path, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * coalesce(g.got, 0) AS rank FROM nodes CROSS JOIN cnt LEFT JOIN
  (SELECT dst, sum(rank * share) AS got FROM r{i - 1} JOIN sh ON r{i - 1}.path = sh.src GROUP BY dst) g ON g.dst = nodes.path)"""
    for i in range(1, 21)
)
_WORDS = """WITH li AS (SELECT doc_id AS path, lang AS family, source, unnest(string_split(text, chr(10))) AS line FROM documents),
ws AS (SELECT path, family, source, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM li),
def AS (SELECT path, family, source, ws[1] AS name FROM ws WHERE len(ws) > 0),
use AS (SELECT path, family, source, unnest(ws[2:]) AS name FROM ws WHERE len(ws) > 0),
noisy AS (SELECT name, count(DISTINCT path) AS n_definitions FROM def GROUP BY name HAVING count(DISTINCT path) > 5)"""
_HOPS = SQL + """,
both_ways AS (SELECT src AS here, dst AS path, kind FROM edges UNION ALL SELECT dst, src, kind FROM edges),
s AS (SELECT dst AS path FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3),
h1 AS (SELECT DISTINCT path FROM both_ways WHERE here IN (SELECT path FROM s) AND path NOT IN (SELECT path FROM s)),
h2 AS (SELECT DISTINCT path FROM both_ways WHERE kind = 'SymbolUsage' AND here IN (SELECT path FROM h1) AND path NOT IN (SELECT path FROM s UNION ALL SELECT path FROM h1)),
h3 AS (SELECT DISTINCT path FROM both_ways WHERE kind = 'SymbolUsage' AND here IN (SELECT path FROM h2) AND path NOT IN (SELECT path FROM s UNION ALL SELECT path FROM h1 UNION ALL SELECT path FROM h2)),
h AS (SELECT path, 1 AS hop FROM h1 UNION ALL SELECT path, 2 FROM h2 UNION ALL SELECT path, 3 FROM h3)"""
_STATS = SQL + """,
ends AS (SELECT src AS path, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges),
deg AS (SELECT path, max(o) AS o FROM ends GROUP BY path),
st AS (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE kind = 'Import') AS n_import, (SELECT count(*) FROM edges WHERE kind = 'SymbolUsage') AS n_symbol,
 (SELECT count(*) FROM nodes LEFT JOIN deg USING (path) WHERE o IS NULL) AS n_isolated, (SELECT count(*) FROM nodes LEFT JOIN deg USING (path) WHERE coalesce(o, 0) = 0) AS n_dangling)"""
_BROKEN = SQL.replace("edges AS (", "sound AS (").replace("nodes AS (", "own AS (") + f""",
edges AS (SELECT src, dst, kind, strength FROM sound UNION ALL SELECT * FROM (VALUES {", ".join(f"({a}, {b}, '{k}', {s}::DOUBLE)" for a, b, k, s in BROKEN_EDGES)})),
nodes AS (SELECT path FROM own UNION ALL SELECT * FROM (VALUES {", ".join(f"({n})" for n in BROKEN_NODES)}))"""
_CHECKS = [
    ("edge_source_missing", "SELECT count(*) FROM edges WHERE src NOT IN (SELECT path FROM nodes)"),
    ("edge_target_missing", "SELECT count(*) FROM edges WHERE dst NOT IN (SELECT path FROM nodes)"),
    ("edge_repeated", "SELECT count(*) FROM (SELECT 1 FROM edges GROUP BY src, dst HAVING count(*) > 1)"),
    ("edge_to_itself", "SELECT count(*) FROM edges WHERE src = dst"),
    ("edge_kind_unknown", "SELECT count(*) FROM edges WHERE kind NOT IN ('Import', 'SymbolUsage')"),
    ("edge_strength_wrong", "SELECT count(*) FROM edges WHERE strength <> CASE WHEN kind = 'Import' THEN 2 ELSE 1 END"),
    ("node_repeated", "SELECT count(*) FROM (SELECT 1 FROM nodes GROUP BY path HAVING count(*) > 1)"),
]
ORACLE_SQL = {
    "q01_edges_upgrade": SQL + " SELECT src, dst, kind, strength FROM edges",
    "q02_graph_statistics": _STATS + " SELECT * FROM st",
    "q03_dependents": SQL + """, top AS (SELECT dst AS path FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)
SELECT 'dependent' AS side, src AS path, kind FROM edges WHERE dst IN (SELECT path FROM top) UNION ALL SELECT 'dependency', dst, kind FROM edges WHERE src IN (SELECT path FROM top)""",
    "q04_pagerank_top": _RANK + " SELECT path, round(rank, 9) AS rank FROM r20 ORDER BY round(rank, 9) DESC, path LIMIT 50",
    "q04b_pagerank_all": _RANK + " SELECT path, round(rank, 9) AS rank FROM r20",
    "q05_weighted_out_degree": SQL + " SELECT src, dst, round(strength / sum(strength) OVER (PARTITION BY src), 9) AS share FROM edges",
    "q06_neighborhood": _HOPS + " SELECT path, CAST(hop AS INTEGER) AS hop, pow(0.5, hop - 1) AS weight FROM h ORDER BY hop, path LIMIT 40",
    "q07_rank_stars": _RANK + """, rr AS (SELECT path, round(rank, 9) AS rank FROM r20)
SELECT path, rank, repeat('★', CASE WHEN (SELECT max(rank) FROM rr) > 0 THEN greatest(1, least(5, CAST(ceil(rank / (SELECT max(rank) FROM rr) * 5) AS INTEGER))) ELSE 1 END) AS stars FROM rr""",
    "q08_noisy_symbols": _WORDS + " SELECT * FROM noisy",
    "q09_symbol_usage_edges": _WORDS + """, d AS (SELECT DISTINCT path, family, source, name FROM def WHERE name NOT IN (SELECT name FROM noisy)), u AS (SELECT DISTINCT path, family, source, name FROM use)
SELECT DISTINCT u.path AS src, d.path AS dst FROM u JOIN d ON u.name = d.name AND u.family = d.family AND u.source = d.source WHERE u.path <> d.path""",
    "q18_edge_diff": f"WITH {testgraph.SQL_CANDIDATES}" + """,
o AS (SELECT src, dst, min(kind) AS kind FROM cand WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY src, dst), n AS (SELECT src, dst, min(kind) AS kind FROM cand WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY src, dst)
SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""",
    "q26_unresolved": """WITH l AS (SELECT url AS src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst FROM pages)
SELECT dst, count(DISTINCT src) AS n_waiting FROM l WHERE dst NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY dst""",
    "q30_consistency_checks": _BROKEN + " " + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", ({sql}) AS n_bad" for name, sql in _CHECKS),
    "q31_health": _STATS + """, cases AS (SELECT 'whole' AS graph, n_nodes, n_edges, n_symbol FROM st UNION ALL SELECT 'imports', n_nodes, n_import, 0 FROM st UNION ALL SELECT 'no edges', n_nodes, 0, 0 FROM st UNION ALL SELECT 'empty', 0, 0, 0)
SELECT graph, CASE WHEN n_nodes = 0 THEN 'critical' WHEN NOT ((n_nodes > 10 AND n_edges = 0) OR (n_nodes > 5 AND n_symbol = 0)) THEN 'healthy' ELSE 'degraded' END AS status,
concat_ws(', ', CASE WHEN n_nodes = 0 THEN 'no files' END, CASE WHEN n_nodes > 10 AND n_edges = 0 THEN 'no edges' END, CASE WHEN n_nodes > 5 AND n_symbol = 0 THEN 'no symbol edges' END) AS issues FROM cases""",
}
