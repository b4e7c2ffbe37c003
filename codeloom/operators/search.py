"""Similarity search over files: texts to embed, chunks, cosine, re-ranking by rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SOURCE_DIRS = ("src", "lib", "source", "sources")
DEFINITIONS = tuple(w + " " for w in sorted({"class", "def", "async def", "impl", "fn", "pub fn", "func", "function", *("export " + w for w in ("class", "default function", "function", "interface"))}))
#: What \\s stands for, and the same without the line break.
SPACE, BLANK = " \t\n\x0b\f\r", r"[ \t\x0b\f\r]"
#: The line break before a line that, without blanks at its ends, begins with a definition: more must follow the word than blanks.
CUT = rf"\n(?={BLANK}*+(?:{'|'.join(DEFINITIONS)}){BLANK}*+[^ \t\x0b\f\r\n])"
CHUNK_WORDS = 300
SIMILARITY_WEIGHT, RANK_WEIGHT = 0.8, 0.2
TRIVIAL_CHARS = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def module_prefix(path: Column, root: str = "") -> Column:
    """Dotted module of a path below root; empty outside of it. Source folders and __init__ fall away."""
    relative = path if not root else F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise("")
    parts = F.filter(F.split(relative, "/"), lambda p: (p != "") & ~F.lower(p).isin(*SOURCE_DIRS))
    n = F.size(parts)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    body = F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
    return F.when(n <= 0, "").otherwise(F.array_join(F.when(stem == "__init__", body).otherwise(F.concat(body, F.array(stem))), "."))


def embedding_text(path: Column, skeleton: Column, content: Column, root: str = "") -> Column:
    """Module prefix and a line break before the skeleton, or before the content where the skeleton is blank."""
    prefix = module_prefix(path, root)
    text = F.when(F.trim(skeleton) != "", skeleton).otherwise(content)
    return F.when(prefix == "", text).otherwise(F.concat(prefix, F.lit("\n"), text))


def chunks(texts: DataFrame) -> DataFrame:
    """path, chunk_no, chunk from path, text: texts over CHUNK_WORDS words are cut before lines that define something.

    Within a row: no shuffle, whatever the number of lines.  A text is read once for its words and once for its cuts.
    """
    kept = F.filter(F.transform(F.split("text", CUT, -1), lambda p: F.btrim(p, F.lit(SPACE))), lambda p: p != "")
    parts = F.when(F.regexp_count("text", F.lit(r"\S++")) <= CHUNK_WORDS, F.array("text")).otherwise(kept)
    cut = texts.select("path", "text", parts.alias("parts"))
    return cut.select("path", F.posexplode(F.when(F.size("parts") == 0, F.array("text")).otherwise(F.col("parts"))).alias("chunk_no", "chunk"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 where one has length 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def similarities(vectors: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, path, similarity (cosine) of vectors (path, embedding) to queries (query_id, embedding); with k the best k paths of each query.

    Both sides are packed into blocks of BLOCK_ROWS rows, and a pair of blocks is one product of two matrices: a
    stated set of queries of any size against all vectors, with nothing broadcast but what Catalyst's own bound
    allows.  Of several rows of a path in a block the best one counts; where k is given, so do the k best paths
    of a block, ties by path.  A null vector has no row; a vector of length 0 has similarity 0.
    """
    path_type, id_type = dict(vectors.dtypes)["path"], dict(queries.dtypes)["query_id"]
    left, right = _packed(vectors, "path", path_type), _packed(queries, "query_id", id_type)
    cells = right.select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")).crossJoin(left)
    id_arrow, path_arrow = (to_arrow_type(T._parse_datatype_string(t)) for t in (id_type, path_type))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids = batch.column(0)[i].values, batch.column(2)[i].values
                q, v = (_unit(np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.float64).reshape(len(n), -1)) for c, n in ((1, q_ids), (3, ids)))
                product = q @ v.T
                if path_arrow != pa.string() and len(ids):
                    order = np.argsort(keys := ids.to_numpy(zero_copy_only=False), kind="stable")
                else:
                    order = np.argsort(keys := np.array(ids.to_pylist(), dtype=object), kind="stable")
                keys = keys[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                best = np.maximum.reduceat(product[:, order], first, axis=1)
                n = best.shape[1] if k is None else min(k, best.shape[1])
                pick = np.argsort(-best, axis=1, kind="stable")[:, :n]  # of equals the first path
                yield pa.RecordBatch.from_arrays(
                    [q_ids.take(pa.array(np.repeat(np.arange(len(q_ids)), n))), ids.take(pa.array(order[first[pick.ravel()]])), pa.array(np.take_along_axis(best, pick, axis=1).ravel())],
                    schema=pa.schema([("query_id", id_arrow), ("path", path_arrow), ("similarity", pa.float64())]),
                )

    found = cells.mapInArrow(stage, f"query_id {id_type}, path {path_type}, similarity double")
    found = found.groupBy("query_id", "path").agg(F.max("similarity").alias("similarity"))
    if k is None:
        return found
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "path"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


BLOCK_ROWS = 1024


def _packed(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """ids, matrix (doubles, row by row): at most BLOCK_ROWS rows of a partition in each row. Rows of one block have one width."""
    ids_arrow = to_arrow_type(T._parse_datatype_string(kind))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0)], pa.list_(ids_arrow)), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "matrix"])

    return rows.select(key, "embedding").dropna().mapInArrow(stage, f"ids array<{kind}>, matrix binary")


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def file_scores(chunk_embeddings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, path, similarity: the best chunk of each file for each query (query_id, embedding); 0 without a chunk."""
    return similarities(chunk_embeddings, queries)


def relevant(chunk_embeddings: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The n most similar files of each query, ties by path."""
    return similarities(chunk_embeddings, queries, n)


def candidates(chunk_embeddings: DataFrame, queries: DataFrame, n: int, over: Callable[[int], int] = lambda n: 3 * n + 10) -> DataFrame:
    """What reranked() chooses the n best from: the over(n) most similar files of each query."""
    return similarities(chunk_embeddings, queries, over(n))


def reranked(found: DataFrame, ranks: DataFrame, n: int, keep: Column | None = None) -> DataFrame:
    """query_id, path, similarity, rank, score: of candidates() those that keep allows, by 0.8 similarity and 0.2 rank
    in proportion to the greatest rank; the n best of each query."""
    top = ranks.agg(F.max("rank").alias("top"))
    joined = (found if keep is None else found.filter(keep)).join(ranks, "path", "left")
    share = F.when(F.col("top") > 0, F.coalesce("rank", F.lit(0.0)) / F.col("top")).otherwise(0.0)
    score = F.lit(SIMILARITY_WEIGHT) * F.col("similarity") + F.lit(RANK_WEIGHT) * share
    scored = joined.crossJoin(F.broadcast(top)).select("query_id", "path", "similarity", F.coalesce("rank", F.lit(0.0)).alias("rank"), score.alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    return scored.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def meaningful(content: Column) -> Column:
    """Content without blank lines and comment lines."""
    return F.array_join(F.filter(F.split(content, "\n", -1), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#")), "\n")


def is_trivial_init(path: Column, content: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).eqNullSafe("__init__.py") & (F.length(meaningful(F.trim(F.coalesce(content, F.lit(""))))) < TRIVIAL_CHARS)


def is_noise(path: Column, content: Column) -> Column:
    """Trivial package files, tests and test configuration."""
    name = F.element_at(F.split(path, "/"), -1)
    return is_trivial_init(path, content) | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")


def embedded(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """path, chunk_no, embedding from path, chunk_no, chunk; embedder works on lists, in order of length.

    embedder is loaded once in each Python worker; neighbours of like length make even batches.
    """
    ordered = texts.withColumn("size", F.length("chunk")).sortWithinPartitions("size").drop("size")

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "chunk_no": frame["chunk_no"], "embedding": embedder(frame["chunk"].tolist())})

    return ordered.select("path", "chunk_no", "chunk").mapInPandas(stage, "path string, chunk_no int, embedding array<float>")


def hashing_embedder(texts: list[str], width: int = 64) -> list[list[float]]:
    """A deterministic stand-in for a model: signed counts of hashed words."""
    import re
    import zlib

    out = []
    for text in texts:
        v = [0.0] * width
        for w in re.findall(r"[A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text or "")):
            h = zlib.crc32(w.lower().encode())
            v[h % width] += 1.0 if h & 0x80000000 else -1.0
        out.append(v)
    return out
