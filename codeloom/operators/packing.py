"""Packing of the most useful files into a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import small
from . import rank, search
from .folds import folded

UTILIZATION, DEFAULT_WINDOW = 0.6, 100_000
MAX_OUTPUT = 60_000
CUT_MARK = "\n\n[... truncated ...]"
#: Models and their windows, in the order in which prefixes are tried.
WINDOWS = (
    ("claude", 200_000), ("claude-opus", 200_000), ("claude-sonnet", 200_000), ("gpt-4", 128_000), ("gpt-4o", 128_000), ("gemini", 1_000_000), ("gemini-pro", 1_000_000),
    ("deepseek-coder", 128_000), ("deepseek-r2-distill-qwen-32b", 128_000), ("codellama", 16_000), ("llama3", 8_000), ("mistral", 32_000), ("qwen2.5-coder", 128_000),
    ("mlx-community/deepseek-coder", 128_000), ("mlx-community/mistral", 32_000), ("mlx-community/codellama", 16_000), ("mlx-community/llama-3", 8_000), ("mlx-community/qwen2.5-coder", 128_000),
)


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, w) for i, (p, w) in enumerate(WINDOWS)], "place int, prefix string, window int")


def token_budgets(models: DataFrame) -> DataFrame:
    """model, max_tokens: the window of the exact name, else of the first prefix in order, else the default; 60 %.

    The table of windows is a constant of 18 rows, which any join may broadcast.
    """
    name = F.lower("model")
    table = F.broadcast(windows(models.sparkSession))
    hits = models.select("model").distinct().join(table, name.startswith(F.col("prefix")), "left")
    best = hits.groupBy("model").agg(F.min_by("window", F.when(F.col("prefix") == name, -1).otherwise(F.col("place"))).alias("window"))
    return best.select("model", F.floor(F.coalesce("window", F.lit(DEFAULT_WINDOW)) * UTILIZATION).cast("int").alias("max_tokens"))


def adaptive_parameters(counts: DataFrame) -> DataFrame:
    """Parameters of packing from n_nodes, n_edges, budget and map_tokens (the first two as in statistics())."""

    def clamp(x: Column, low: int, high: int) -> Column:
        return F.least(F.greatest(x, F.lit(low)), F.lit(high)).cast("int")

    n = F.col("n_nodes")
    density = F.col("n_edges") / F.greatest(n, F.lit(1))
    map_tokens = F.least(F.col("map_tokens").cast("long"), F.floor(F.col("budget") * 0.08))
    return counts.select(
        map_tokens.alias("map_tokens"),
        (F.col("budget") - map_tokens).alias("content_tokens"),
        clamp(F.floor(n / 10), 3, 10).alias("anchors"),
        clamp(F.floor(n / 4), 20, 75).alias("map_files"),
        F.when(density < 3, 3).otherwise(2).alias("hops"),
        clamp(F.floor(n / 5), 10, 40).alias("neighborhood_files"),
    )


def first_fit(items: DataFrame, budget: int, group: str = "grp", order: str = "ord", size: str = "tokens") -> DataFrame:
    """The items of each group that fit when taken in order: one too large is left out and the next one tried.

    Blank items (size 0 or less) are left out.  Of one size at most budget / size items ever fit, and only the
    first ones in order: each task keeps those alone before anything is sent, so a group that folds() walks
    through has at most budget x ln(budget) rows of each task, however large it is.
    """
    kinds = dict(items.dtypes)
    rows = items.select(group, order, F.col(size).cast("long").alias("size")).filter(F.col("size").between(1, budget))

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            keep = []
            for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                n = n + 1 if key == last else 1
                last = key
                keep.append(n * key[1] <= budget)
            yield batch.filter(pa.array(keep, pa.bool_()))

    few = rows.sortWithinPartitions(group, "size", order).mapInArrow(first_ones, rows.schema)

    def step(used: int, row: tuple) -> tuple[int, tuple | None]:
        total = used + row[2]
        return (total, (row[0], row[1], total)) if total <= budget else (used, None)

    return folded(few, [group], [order], int, step, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, used long")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters; the default where no tokenizer is given."""
    return F.floor(F.length(text) / 4).cast("int")


def truncated(text: Column, limit: int = MAX_OUTPUT) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit(CUT_MARK)))


def within_tokens(text: str, limit: int, count_tokens: Callable[[str], int]) -> str:
    """text, or the longest beginning that has limit tokens with the mark of a cut behind it; nothing where not even that fits."""
    if count_tokens(text) <= limit:
        return text
    low, high = 0, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if count_tokens(text[:middle] + CUT_MARK) <= limit else (low, middle - 1)
    return text[:low] + CUT_MARK if low else ""


@dataclass
class Packer:
    """Assembles a context. files: path, skeleton, content; the other relations as in the modules beside."""

    files: DataFrame
    edges: DataFrame
    ranks: DataFrame
    chunk_embeddings: DataFrame
    count_tokens: Callable[[str], int] = staticmethod(lambda text: len(text) // 4)

    def _fill(self, paths: list[str], budget: int, done: set[str]) -> tuple[str, set[str]]:
        """First fit of skeletons in order; the lists are short, bounded by the parameters."""
        wanted = [p for p in paths if p not in done]
        if not wanted or budget <= 0:
            return "", set()
        spark = self.files.sparkSession
        order = spark.createDataFrame([(p, i) for i, p in enumerate(wanted)], "path string, ord int")
        texts = {r.path: r.skeleton for r in self.files.join(small(order), "path").select("path", "skeleton").collect()}
        out, used, taken = [], 0, set()
        for p in wanted:
            if used >= budget:
                break
            text = texts.get(p)
            if not text or not text.strip() or p in taken:
                continue
            block = f"\n# {p} (SKELETON)\n{text}\n"
            n = self.count_tokens(block)
            if used + n <= budget:
                out.append(block)
                used += n
                taken.add(p)
        return "".join(out), taken

    def _near(self, seeds: list[str], done: set[str], hops: int, limit: int) -> list[str]:
        if not seeds:
            return []
        spark = self.files.sparkSession
        near = rank.neighborhood(self.edges, spark.createDataFrame([(s,) for s in set(seeds)], "path string"), hops)
        if done:
            near = near.join(small(spark.createDataFrame([(d,) for d in done], "path string")), "path", "left_anti")
        return [r.path for r in rank.decayed(near, limit).collect()]

    def context(self, query: DataFrame, budget: int, map_text: str, explicit: tuple[str, ...] = ()) -> str:
        """Map, explicit files, anchors, their neighborhood, then what is near all of these, in that order."""
        spark = self.files.sparkSession
        counts = spark.createDataFrame([(self.files.count(), self.edges.count(), budget, self.count_tokens(map_text))], "n_nodes long, n_edges long, budget long, map_tokens long")
        p = adaptive_parameters(counts).first()
        # The map has its share of the budget and no more.
        parts, done, left = [("REPOSITORY_MAP", within_tokens(map_text, p.map_tokens, self.count_tokens))], set(), p.content_tokens

        def add(label: str, paths: list[str]) -> None:
            nonlocal left
            text, taken = self._fill(paths, left, done)
            if text:
                parts.append((f"{label} (skeletons)", text))
                done.update(taken)
                left -= self.count_tokens(text)

        add("EXPLICIT_FILES", list(explicit))
        found = search.candidates(self.chunk_embeddings, query, p.anchors, lambda n: 3 * n)
        anchors = [r.path for r in search.reranked(found, self.ranks, p.anchors).orderBy(F.desc("score"), "path").collect()]
        add("ANCHOR_FILES", anchors)
        near = self._near([*explicit, *anchors], done, p.hops, p.neighborhood_files)
        add("NEIGHBORHOOD_FILES", near)
        more = self._near([*explicit, *anchors, *near], done, 1, 100)
        if len(more) < 20:
            more += [r.path for r in search.relevant(self.chunk_embeddings, query, 50).orderBy(F.desc("similarity"), "path").collect() if r.path not in more and r.path not in done]
        if len(more) < 20:
            more += [r.path for r in rank.top_ranked(self.ranks, 100).collect() if r.path not in more and r.path not in done]
        if more:
            quiet = self.files.join(small(spark.createDataFrame([(m,) for m in more], "path string")), "path").filter(~search.is_noise(F.col("path"), F.col("content")))
            calm = {r.path for r in quiet.select("path").collect()}
            add("EXTENDED_CONTEXT", [m for m in more if m in calm])
        bar = "=" * 80
        text = "\n".join(f"{bar}\n{label}\n{bar}\n{content}\n" for label, content in parts)
        return text if len(text) <= MAX_OUTPUT else text[:MAX_OUTPUT] + CUT_MARK
