"""Search, packing, changes and chat operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, graph, imports, packing, parsing, rank, report, search
from ..streaming import changes
from ..tables import written
from . import testgraph
from .graph_queries import _RANK, ranks_of
from .testgraph import SQL, table


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of a search: every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vectors(spark: SparkSession, sf_dir: str, path: str = "vec_id") -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col(path).alias("path"), "embedding")


def q10_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.relevant(_vectors(spark, sf_dir), _queries(spark, sf_dir), 20).withColumn("similarity", F.round("similarity", 6))


def q11_max_chunk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_scores(_vectors(spark, sf_dir, "label"), _queries(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def q12_hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose document is a trivial file are left out."""
    found = search.candidates(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10).withColumn("similarity", F.round("similarity", 6))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    ranks = ranks_of(spark, sf_dir).withColumn("rank", F.round("rank", 9))
    best = search.reranked(found.join(docs, "path", "left"), ranks, 10, keep=~search.is_trivial_init(F.lit("a/__init__.py"), F.col("text")))
    return best.withColumn("score", F.round("score", 6))


def q13_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a definition line before every sentence that begins with a t, so that long ones are cut."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.regexp_replace("text", r"\nT", "\ndef T").alias("text"))
    return search.chunks(texts).select("path", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def q14_trivial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/__init__.py")).alias("path"), F.col("text").alias("content"))
    return docs.select("doc_id", search.is_trivial_init(F.col("path"), F.col("content")).alias("trivial"))


def q15_greedy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("grp"), F.col("doc_id").alias("ord"), packing.estimated_tokens(F.col("text")).alias("tokens"))
    return packing.first_fit(docs, 3000)


#: Models of parts, by size: exact names, prefixes, and one that no prefix fits.
MODELS = ("gpt-4-{}", "claude", "CLAUDE-opus-{}", "gpt-4o-mini", "mlx-community/llama-3-{}", "unknown-{}", "gemini-pro", "llama3")


def q16_adaptive_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.replace(F.element_at(F.array(*(F.lit(m) for m in MODELS)), (F.col("p_size") % len(MODELS) + 1).cast("int")), F.lit("{}"), F.col("p_brand"))
    budgets = packing.token_budgets(table(spark, sf_dir, "part").select(model.alias("model")))
    stats = graph.statistics(testgraph.nodes(spark, sf_dir), testgraph.edges(spark, sf_dir))
    sized = written(budgets.crossJoin(stats.select("n_nodes", "n_edges")).select("model", "n_nodes", "n_edges", F.col("max_tokens").cast("long").alias("budget"), F.lit(900).alias("map_tokens")), "sized")
    rows = packing.adaptive_parameters(sized.select("n_nodes", "n_edges", "budget", "map_tokens").distinct())
    # Parameters hang on the budget, which content and map tokens add up to.
    return sized.select("model", "budget").join(rows.withColumn("budget", F.col("content_tokens") + F.col("map_tokens")), "budget")


def _state(docs: DataFrame) -> DataFrame:
    lines = F.split("text", "\n")
    heads = F.transform(lines, lambda x: F.substring_index(x, " ", 1))
    return docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"), F.md5("lang").alias("imports_hash"), F.md5(F.array_join(F.array_sort(heads), "|")).alias("definitions_hash"), F.md5(F.length("text").cast("string")).alias("usages_hash"))


def q17_classify_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a copy in which some are gone, some changed inside, some at their head, some in language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    k = F.col("doc_id") % 10
    text = F.when(k == 1, F.concat(F.lit("Changed "), F.col("text"))).when(k == 2, F.concat("text", F.lit(" more"))).when(k == 3, F.reverse("text")).otherwise(F.col("text"))
    new = docs.filter(k != 0).select("doc_id", text.alias("text"), F.when(k == 3, "xx").otherwise(F.col("lang")).alias("lang"))
    new = new.unionByName(docs.filter(k == 0).select((-F.col("doc_id") - 1).alias("doc_id"), "text", "lang"))
    return graph.classified_changes(_state(docs), _state(new))


def q19_debounce_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return changes.debounced_leading_batch(events, "user_id", "ts", 3_600_000_000, ("event_id",))


def q20_event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("created")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.col("event_id").alias("seq"), kind.alias("event_type"))
    return changes.classified(events).select(F.col("seq").alias("event_id"), "meaning")


def q21_session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    found = changes.debounced_sessions(events, "30 minutes")
    return found.select("path", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


def q22_history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.trimmed_history(table(spark, sf_dir, "conversations"), 300)


def q23_content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the same words, in any order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", graph.set_hash(F.split("text", " ")).alias("words_hash"))
    return docs.groupBy("words_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("first_id", "n")


def q24_module_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://", "/repo/src/")
    return table(spark, sf_dir, "pages").select("page_id", search.module_prefix(F.concat(path, F.lit(".py")), "/repo").alias("module"))


def q25_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of scripts that have the links of each page as their specifiers, in three forms."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    form = F.element_at(F.array(F.lit('import x from "{}";'), F.lit('export * from "{}";'), F.lit('const y = require("{}"); // "z"')), (F.col("page_id") % 3 + 1).cast("int"))
    script = F.array_join(F.transform(links, lambda x: F.replace(form, F.lit("{}"), x)), "\n")
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), "page_id", F.lit(".js")).alias("path"), script.alias("content"))
    return parsing.imports(files).select("path", "statement", "module").distinct()


def q27_theta_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifiers of documents through aliases, of which the longest prefix wins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    files = docs.select(F.concat_ws("/", F.lit("src"), "lang", "source", F.concat("doc_id", F.lit(".ts"))).alias("path")).unionByName(docs.select(F.concat_ws("/", F.lit("other"), "source", F.concat("doc_id", F.lit(".js"))).alias("path")))
    statements = docs.select(F.concat_ws("/", F.lit("app"), F.concat("doc_id", F.lit(".js"))).alias("path"), F.lit(0).alias("statement"), F.concat_ws("/", F.lit("@"), "lang", "source", "doc_id").alias("module"))
    aliases = spark.createDataFrame([("@/*", "src/*"), ("@/de/*", "other/*"), ("~/*", "nowhere/*")], "pattern string, target string")
    return imports.js_resolved(statements, files, aliases).select("path", "module", "resolved_path")


def q32_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked list of a repository map."""
    edges = written(testgraph.edges(spark, sf_dir), "edges")
    ranks = rank.pagerank(testgraph.nodes(spark, sf_dir), edges).withColumn("rank", F.round("rank", 9))
    return report.map_lines(ranks, edges, 50)


QUERIES = {f.__name__: f for f in (q10_cosine_topk, q11_max_chunk_score, q12_hybrid_rerank, q13_chunking, q14_trivial_filter, q15_greedy_fill, q16_adaptive_params, q17_classify_change, q19_debounce_leading, q20_event_state, q21_session_debounce, q22_history_trim, q23_content_hash_dups, q24_module_prefix, q25_link_extract, q27_theta_prefix_join, q32_map_entries)}

_COS = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM embeddings, q),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM s)"""
_TRIVIAL = "length(array_to_string(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#')), chr(10))) < 50"
_STATE = """SELECT doc_id AS path, md5(text) AS c, md5(lang) AS i, md5(array_to_string(list_sort(list_transform(string_split(text, chr(10)), lambda x: split_part(x, ' ', 1))), '|')) AS d, md5(CAST(length(text) AS VARCHAR)) AS u"""
ORACLE_SQL = {
    "q10_cosine_topk": _COS + " SELECT query_id, vec_id AS path, round(sim, 6) AS similarity FROM p WHERE place <= 20",
    "q11_max_chunk_score": _COS + " SELECT query_id, label AS path, round(max(sim), 6) AS similarity FROM s GROUP BY query_id, label",
    "q12_hybrid_rerank": _RANK + ", " + _COS[5:] + f""", c AS (SELECT query_id, vec_id AS path, round(sim, 6) AS similarity FROM p WHERE place <= 40),
k AS (SELECT c.* FROM c LEFT JOIN documents d ON c.path = d.doc_id WHERE NOT {_TRIVIAL.replace("text", "coalesce(d.text, '')")}),
rr AS (SELECT path, round(rank, 9) AS rank FROM r20), t AS (SELECT max(rank) AS top FROM rr),
x AS (SELECT query_id, k.path, similarity, coalesce(rr.rank, 0) AS rank, 0.8::DOUBLE * similarity + 0.2::DOUBLE * CASE WHEN top > 0 THEN coalesce(rr.rank, 0) / top ELSE 0 END AS score FROM k LEFT JOIN rr USING (path) CROSS JOIN t),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS place FROM x)
SELECT query_id, path, similarity, rank, round(score, 6) AS score FROM y WHERE place <= 10""",
    "q13_chunking": r"""WITH d AS (SELECT doc_id AS path, replace(text, chr(10) || 'T', chr(10) || 'def T') AS text FROM documents),
n AS (SELECT path, text, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words FROM d),
l AS (SELECT path, string_split(text, chr(10)) AS ls FROM n WHERE words > 300),
e AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
g AS (SELECT *, sum(CASE WHEN i > 1 AND regexp_matches(trim(line, E' \t\r\f\v'), '^(def |async def |class |fn |pub fn |impl |function |export function |export default function |export class |export interface |func )') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS c FROM e),
p AS (SELECT path, c, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS chunk FROM g GROUP BY path, c),
o AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY c) - 1 AS INTEGER) AS chunk_no, chunk FROM p WHERE chunk <> '')
SELECT path, chunk_no, md5(chunk) AS chunk_md5 FROM o UNION ALL SELECT path, 0, md5(text) FROM n WHERE words <= 300""",
    "q14_trivial_filter": f"SELECT doc_id, {_TRIVIAL} AS trivial FROM documents",
    "q15_greedy_fill": """WITH RECURSIVE i AS (SELECT source || '/' || lang AS grp, doc_id AS ord, length(text) // 4 AS tokens FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS k FROM i WHERE tokens > 0),
f AS (SELECT grp, k, ord, CASE WHEN tokens <= 3000 THEN tokens ELSE 0 END AS used, tokens <= 3000 AS took FROM n WHERE k = 1
UNION ALL SELECT n.grp, n.k, n.ord, CASE WHEN f.used + n.tokens <= 3000 THEN f.used + n.tokens ELSE f.used END, f.used + n.tokens <= 3000 FROM f JOIN n ON n.grp = f.grp AND n.k = f.k + 1)
SELECT grp, ord, CAST(used AS BIGINT) AS used FROM f WHERE took""",
    "q16_adaptive_params": SQL + f""", b AS (SELECT DISTINCT replace([{", ".join(f"'{m}'" for m in MODELS)}][p_size % {len(MODELS)} + 1], '{{}}', p_brand) AS model FROM part),
w AS (SELECT model, CASE WHEN starts_with(model, 'gpt-4') THEN 128000 WHEN starts_with(lower(model), 'claude') THEN 200000 WHEN starts_with(model, 'mlx-community/llama-3') THEN 8000 WHEN model = 'gemini-pro' THEN 1000000 WHEN model = 'llama3' THEN 8000 ELSE 100000 END * 6 // 10 AS budget FROM b),
c AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e), m AS (SELECT *, least(900, CAST(floor(budget * 0.08) AS BIGINT)) AS mt FROM w, c)
SELECT model, CAST(budget AS BIGINT) AS budget, CAST(mt AS BIGINT) AS map_tokens, CAST(budget - mt AS BIGINT) AS content_tokens, CAST(least(greatest(n // 10, 3), 10) AS INTEGER) AS anchors, CAST(least(greatest(n // 4, 20), 75) AS INTEGER) AS map_files,
CASE WHEN e::DOUBLE / greatest(n, 1) < 3 THEN 3 ELSE 2 END AS hops, CAST(least(greatest(n // 5, 10), 40) AS INTEGER) AS neighborhood_files FROM m""",
    "q17_classify_change": f"""WITH n0 AS (SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'Changed ' || text WHEN 2 THEN text || ' more' WHEN 3 THEN reverse(text) ELSE text END AS text, CASE WHEN doc_id % 10 = 3 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT -doc_id - 1, text, lang FROM documents WHERE doc_id % 10 = 0),
o AS ({_STATE} FROM documents), n AS ({_STATE} FROM n0),
x AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN o.c = n.c THEN 'unchanged' ELSE 'modified' END AS change, o.i = n.i AS si, o.d = n.d AND o.u = n.u AS sd FROM o FULL OUTER JOIN n ON o.path = n.path)
SELECT path, change, CASE WHEN change = 'unchanged' THEN 'Local' WHEN change <> 'modified' THEN 'GraphScope' WHEN NOT si THEN 'GraphScope' WHEN NOT sd THEN 'FileScope' ELSE 'Local' END AS tier FROM x""",
    "q19_debounce_leading": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS micros, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
f AS (SELECT user_id, k, micros, event_id, micros AS last, TRUE AS ok FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.micros, e.event_id, CASE WHEN e.micros - f.last >= 3600000000 THEN e.micros ELSE f.last END, e.micros - f.last >= 3600000000 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, micros, event_id FROM f WHERE ok""",
    "q20_event_state": """WITH e AS (SELECT event_id, event_type = 'error' AS gone, coalesce(NOT lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS there FROM events)
SELECT event_id, CASE WHEN gone AND there THEN 'deleted' WHEN gone THEN 'ignored' WHEN there THEN 'modified' ELSE 'created' END AS meaning FROM e""",
    "q21_session_debounce": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS path, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "q22_history_trim": """WITH m AS (SELECT conv_id, turn, role, length(text) // 4 AS tokens FROM conversations),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, tokens ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, tokens) AS nth FROM m)
SELECT conv_id, turn, role, CAST(tokens AS BIGINT) AS tokens FROM w WHERE nth = 1 OR used <= 300""",
    "q23_content_hash_dups": "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY list_sort(string_split(text, ' ')) HAVING count(*) > 1",
    "q24_module_prefix": r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', 'src/') || '.py', '/'), lambda x: x <> '' AND lower(x) NOT IN ('src', 'lib', 'source', 'sources')) AS ps FROM pages)
SELECT page_id, array_to_string(list_concat(ps[:len(ps) - 1], [regexp_replace(ps[len(ps)], '^(.+)\.[^.]*$', '\1')]), '.') AS module FROM p""",
    "q25_link_extract": """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS ls FROM pages)
SELECT 'p/' || page_id || '.js' AS path, CAST(unnest(range(len(ls))) AS INTEGER) AS statement, unnest(ls) AS module FROM l""",
    "q27_theta_prefix_join": """SELECT 'app/' || doc_id || '.js' AS path, '@/' || lang || '/' || source || '/' || doc_id AS module,
CASE WHEN lang = 'de' THEN 'other/' || source || '/' || doc_id || '.js' ELSE 'src/' || lang || '/' || source || '/' || doc_id || '.ts' END AS resolved_path FROM documents""",
    "q32_map_entries": _RANK + """, rr AS (SELECT path, round(rank, 9) AS rank FROM r20), t AS (SELECT * FROM rr ORDER BY rank DESC, path LIMIT 50), d AS (SELECT dst AS path, count(*) AS n FROM edges GROUP BY dst)
SELECT path, rank, printf('%s %d (rank %.3f, used by %d)', repeat('★', CASE WHEN (SELECT max(rank) FROM rr) > 0 THEN greatest(1, least(5, CAST(ceil(rank / (SELECT max(rank) FROM rr) * 5) AS INTEGER))) ELSE 1 END), path, rank, coalesce(n, 0)) AS line FROM t LEFT JOIN d USING (path)""",
}
