"""Weighted PageRank, neighborhoods and what is read from ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import discard, small, written

STEPS, DAMPING = 20, 0.85
#: So many steps are one plan before the ranks are written; plans would grow without end otherwise.
STEPS_IN_A_PLAN = 10


def weighted_shares(edges: DataFrame) -> DataFrame:
    """src, dst, share: an edge's part of its source's outgoing strength."""
    total = edges.groupBy("src").agg(F.sum("strength").alias("total"))
    return edges.join(total, "src").select("src", "dst", (F.col("strength") / F.col("total")).alias("share"))


def pagerank(nodes: DataFrame, edges: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """path, rank after exactly so many steps from 1/N; the mass of dangling nodes isn't handed on.

    Nodes fall into blocks by the hash of their path and have a place in theirs.  Edges are turned into places once
    and packed by the blocks of both ends, so a step multiplies arrays: packed edges stay where they are, the ranks
    of a block go to its edges as one array, and what blocks get comes back as arrays.  A step moves at most 12 bytes
    an edge, or 8 bytes a node and block.  The result is a written table.
    """
    spark = nodes.sparkSession
    given = written(nodes.select("path").distinct(), "rank-paths")
    n = given.count()
    if not n:
        return given.withColumn("rank", F.lit(0.0))
    listed = written(edges.select("src", "dst", F.col("strength").cast("double").alias("strength")), "rank-edges")
    blocks = max(1, -(-n // BLOCK_NODES), min(spark.sparkContext.defaultParallelism, -(-listed.count() // BLOCK_EDGES)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("path")) - 1
    numbered = written(given.withColumn("block", F.pmod(F.hash("path"), F.lit(blocks))).withColumn("place", place), "rank-nodes")
    source, target = (numbered.select(F.col("path").alias(end), F.col("block").alias(f"{end}_block"), F.col("place").alias(f"{end}_place")) for end in ("src", "dst"))
    known = listed.join(target.hint("shuffle_hash"), "dst").select("src", "dst_block", "dst_place", "strength")
    known = known.join(source.hint("shuffle_hash"), "src")
    key = F.element_at(F.array(*(F.lit(k) for k in _apart(spark, blocks))), F.col("block") + 1)

    def laid(rows: DataFrame) -> DataFrame:
        """rows with the key of their block, each block in a partition of its own."""
        return rows.withColumn("key", key).repartition(blocks, "key")

    cell = F.col("block").cast("long") * blocks + F.col("dst_block")
    lined = laid(known.withColumnRenamed("src_block", "block")).select(cell.alias("cell"), "src_place", "dst_place", "strength").sortWithinPartitions("cell")
    packed = written(lined.mapInArrow(_packing(blocks), CELLS), "rank-cells")
    cells = laid(packed).persist(StorageLevel.MEMORY_AND_DISK)
    # Only a cached table that is there tells how it is partitioned.
    cells.count()
    none = F.lit(None).cast("binary")
    sizes = numbered.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumns({c: none for c in ("place", "got", "total")})
    strengths = packed.select("block", "src_place", "strength").mapInArrow(_strengths, PARTS).withColumn("total", none)
    base = written(laid(sizes.unionByName(strengths)).select(sizes.columns).mapInArrow(_totals, "block int, n int, total binary"), "rank-base")
    base = base.select("block", "n", none.alias("place"), none.alias("got"), "total")
    ranks, table = base.mapInArrow(_ranked(1 / n, 0.0), RANKS), None
    for step in range(1, steps + 1):
        shares = laid(ranks.select("block", "share")).select("key", "share").hint("shuffle_hash")
        parts = cells.join(shares, "key").select(F.col("to").alias("block"), "src_place", "dst_place", "strength", "share").mapInArrow(_sent, PARTS)
        ranks = laid(base.unionByName(parts.withColumn("total", none))).select(base.columns).mapInArrow(_ranked((1 - damping) / n, damping), RANKS)
        if step % STEPS_IN_A_PLAN == 0 and step < steps:
            before, table = table, written(ranks, "ranks")
            ranks = table
            if before is not None:
                discard(before)
    placed = ranks.select("block", "rank").mapInArrow(_placed, "block int, place int, rank double")
    out = written(numbered.join(placed, ["block", "place"]).select("path", "rank"), "ranks")
    cells.unpersist()
    for done in (given, listed, numbered, packed, base, table):
        if done is not None:
            discard(done)
    return out


#: Nodes of a block, on average; edges of a block, as long as there are no more blocks than cores; edges of a packed row.
BLOCK_NODES, BLOCK_EDGES, ROW_EDGES = 1 << 20, 2 << 20, 1 << 19
#: Edges from a block to another one: places and strengths.
CELLS = "block int, to int, src_place binary, dst_place binary, strength binary"
#: What places of a block get; places are null for the first ones in order.
PARTS = "block int, n int, place binary, got binary"
RANKS = "block int, share binary, rank binary"


def _apart(spark: SparkSession, blocks: int) -> list[int]:
    """A key for each block; hashed, these put each block into a partition of its own."""
    at = F.pmod(F.hash("key"), F.lit(blocks))
    rows = spark.range(64 * blocks).select(F.col("id").cast("int").alias("key")).groupBy(at.alias("at")).agg(F.min("key").alias("key")).collect()
    if len(rows) < blocks:
        raise ValueError(f"too few keys for {blocks} blocks")
    return [r.key for r in sorted(rows, key=lambda r: r.at)]


def _row(schema: str, *values) -> pa.RecordBatch:
    """values as a batch of one row; schema has ints and binaries alone."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if kind == "int" else pa.binary()) for v, (_, kind) in zip(values, fields)], names=[name for name, _ in fields])


def _array(cell: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=kind)


def _part(block: int, got: np.ndarray) -> pa.RecordBatch:
    """A row of PARTS, by places where that is shorter."""
    at = np.flatnonzero(got)
    if 12 * len(at) < 8 * len(got):
        return _row(PARTS, block, None, at.astype(np.int32).tobytes(), got[at].tobytes())
    return _row(PARTS, block, None, None, got.tobytes())


def _grown(sums: np.ndarray, n: int) -> np.ndarray:
    return sums if len(sums) >= n else np.concatenate([sums, np.zeros(n - len(sums))])


def _summed(rows) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of the arrays of neighbouring rows (block, array) of one block."""
    last, sums = None, None
    for block, got in rows:
        if block != last:
            if last is not None:
                yield last, sums
            last, sums = block, got
        else:
            sums = _grown(sums, len(got))
            sums[: len(got)] += got
    if last is not None:
        yield last, sums


def _packing(blocks: int) -> Callable:
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0

        def row() -> pa.RecordBatch:
            return _row(CELLS, last // blocks, last % blocks, *(np.concatenate(x).astype(t).tobytes() for x, t in zip(zip(*held), (np.int32, np.int32, np.float64))))

        for batch in batches:
            cell, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            ends = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(ends, ends[1:]):
                if a == b:
                    continue
                if held and (cell[a] != last or size >= ROW_EDGES):
                    yield row()
                    held, size = [], 0
                last, size = int(cell[a]), size + b - a
                held.append([c[a:b] for c in columns])
        if held:
            yield row()

    return stage


def _strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What leaves each place, from block, src_place, strength."""
    rows = ((b["block"][i].as_py(), np.bincount(_array(b["src_place"][i], np.int32), _array(b["strength"][i], np.float64))) for b in batches for i in range(b.num_rows))
    for block, got in _summed(rows):
        yield _part(block, got)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What places get, from block, src_place, dst_place, strength, share."""

    def rows() -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            for i in range(b.num_rows):
                sent = _array(b["share"][i], np.float64)[_array(b["src_place"][i], np.int32)] * _array(b["strength"][i], np.float64)
                yield b["block"][i].as_py(), np.bincount(_array(b["dst_place"][i], np.int32), sent)

    for block, got in _summed(rows()):
        yield _part(block, got)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Scalar | None]]:
    """Block, what all of its places get, total; each block has one row with its n."""
    found: dict[int, list] = {}
    for b in batches:
        for i in range(b.num_rows):
            one = found.setdefault(b["block"][i].as_py(), [0, np.zeros(0), None])
            if b["n"][i].is_valid:
                one[0], total = b["n"][i].as_py(), b["total"][i]
                one[2] = _array(total, np.float64).copy() if total.is_valid else None
                continue
            got, place = _array(b["got"][i], np.float64), b["place"][i]
            at = _array(place, np.int32) if place.is_valid else None
            one[1] = _grown(one[1], len(got) if at is None else int(at[-1]) + 1 if len(at) else 0)
            if at is None:
                one[1][: len(got)] += got
            else:
                one[1][at] += got
    for block, (n, got, total) in found.items():
        yield block, _grown(got, n), total


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, got, _ in _gathered(batches):
        yield _row("block int, n int, total binary", block, len(got), got.tobytes())


def _ranked(base: float, damping: float) -> Callable:
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got, total in _gathered(batches):
            rank = base + damping * got
            yield _row(RANKS, block, np.divide(rank, total, out=np.zeros_like(rank), where=total > 0).tobytes(), rank.tobytes())

    return stage


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            rank = _array(b["rank"][i], np.float64)
            for at in range(0, len(rank), 1 << 16):
                part = rank[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b["block"][i].as_py(), np.int32)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part)], names=["block", "place", "rank"])


def top_ranked(ranks: DataFrame, k: int) -> DataFrame:
    """The k greatest ranks, ties by path."""
    return ranks.orderBy(F.desc("rank"), "path").limit(k)


def stars(ranks: DataFrame) -> DataFrame:
    """path, rank, stars: 1 to 5 of them, in proportion to the greatest rank; 1 where that is 0."""
    top = ranks.agg(F.max("rank").alias("top"))
    n = F.when(F.col("top") > 0, F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(F.col("rank") / F.col("top") * 5).cast("int")))).otherwise(1)
    return ranks.crossJoin(F.broadcast(top)).select("path", "rank", F.repeat(F.lit("★"), n.cast("int")).alias("stars"))


def neighborhood(edges: DataFrame, seeds: DataFrame, max_hops: int, first_import_only: bool = True) -> DataFrame:
    """path, hop of the nodes within max_hops of the seeds, both ways, seeds left out; the first hop counts.

    From hop 0 and on, edges of kind SymbolUsage lead anywhere, those of kind Import from the seeds alone.
    Edges and every frontier are written tables, so plans don't grow with the hops.
    """
    edges = written(edges.select("src", "dst", "kind"), "hops")
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("path"), "kind").unionByName(edges.select(F.col("dst").alias("at"), F.col("src").alias("path"), "kind"))
    frontier = written(seeds.select("path").distinct().withColumn("hop", F.lit(0)), "frontier")
    visited = frontier
    for hop in range(1, max_hops + 1):
        usable = both if hop == 1 or not first_import_only else both.filter("kind = 'SymbolUsage'")
        reached = usable.join(small(frontier.select(F.col("path").alias("at"))), "at", "left_semi").select("path").distinct()
        frontier = written(reached.join(small(visited.select("path")), "path", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return visited.filter("hop > 0")


def decayed(near: DataFrame, max_files: int) -> DataFrame:
    """path, hop, weight = 1/2^(hop - 1); the max_files nearest, ties by path."""
    return near.withColumn("weight", F.pow(F.lit(0.5), F.col("hop") - 1)).orderBy("hop", "path").limit(max_files)


def position(ranks: DataFrame) -> DataFrame:
    """path, rank, place, within rows that are few already."""
    return ranks.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "path")))
