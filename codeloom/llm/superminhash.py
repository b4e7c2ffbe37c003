"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

Each element (a run of SHINGLE words) draws, for step j = 0, 1, ..., a number r in [0, 1) and the j-th entry p
of a random permutation; slot p of the signature is the least r + j.  Ranks of one element never collide, so
the estimate varies less than with independent hashes.  A document is done at the first step j with no slot
over j, mostly after a few steps.  A slice of documents is taken one step at a time, as arrays.

Texts of the same words are one text, before anything else is done.  Texts with a common band meet in a
bucket.  Each is paired with the first of its bucket, and the exact Jaccard similarity of the pair decides.
Two texts that match the first are one group by it; one that fails is held against every other text of the
bucket in a second round, so no pair of a bucket is lost.  Where that would be many pairs (a template whose
pages differ) the second round takes only pairs that have one of their rarest shingles in common: of two
sets with a similarity of t, ordered by how few texts of the bucket have a shingle, the first |x| - t|x| + 1
of each always share one, so this loses nothing either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext
from .components import connected
from .shared import discard, fresh, tune, written

#: 40 bands of 4 slots: a pair just at the threshold meets in a bucket with a chance of 1 - (1 - 0.5^4)^40 = 0.92.
SHINGLE, SLOTS, BANDS, THRESHOLD = 3, 160, 40, 0.5
#: Pairs of a bucket's second round, as a multiple of its texts, beyond which rare shingles say which ones to take.
MANY_PAIRS = 64


def elements(words: vectext.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of shingle words, and its document; a document with fewer words is one run."""
    h, at = words.grams(shingle)
    docs = words.doc_of(at)
    sizes = np.diff(words.starts)
    few = np.flatnonzero((sizes > 0) & (sizes < shingle))
    if len(few):
        short = np.zeros(len(few), dtype=np.uint64)
        for k in range(shingle):
            left = sizes[few] > k
            short[left] = vectext.mix(short[left] * np.uint64(31) + words.hash[words.starts[few[left]] + k])
        h, docs = np.concatenate([h, short]), np.concatenate([docs, few])
        order = np.argsort(docs, kind="stable")
        h, docs = h[order], docs[order]
    return h, docs


def signatures(h: np.ndarray, docs: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """n_docs x slots; infinite throughout for a document without elements."""
    sig = np.full(n_docs * slots, np.inf)
    drawn: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for j in range(slots):
            if not len(h):
                break
            x = vectext.mix(h + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            r = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
            y = vectext.mix(x ^ np.uint64(0xD6E8FEB86659FD93))
            k = j + ((y >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int16)
            slot = k.copy()
            # The permutation is the identity but for the swaps (t, drawn[t]) of earlier steps, taken backwards.
            for t in range(j - 1, -1, -1):
                other = drawn[t]
                slot = np.where(slot == t, other, np.where(slot == other, np.int16(t), slot))
            drawn.append(k)
            np.minimum.at(sig, docs * slots + slot, r + j)
            open_docs = sig.reshape(n_docs, slots).max(axis=1) > j + 1
            more = open_docs[docs]
            if not more.all():
                h, docs = h[more], docs[more]
                drawn = [d[more] for d in drawn]
    return sig.reshape(n_docs, slots)


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands hashes of the signature's parts."""
    n, slots = sig.shape
    bits = vectext.mix(np.ascontiguousarray(sig).view(np.uint64)).reshape(n, bands, slots // bands)
    out = np.zeros((n, bands), dtype=np.uint64)
    out += np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(slots // bands):
        out = vectext.mix(out * np.uint64(3) + bits[:, :, k])
    return out


def sequence_hashes(words: vectext.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all the words of each document, in their order."""
    out = []
    for salt in (1, 0x2545F4914F6CDD1D):
        h = vectext.mix(words.hash + np.uint64(salt))
        power, inverse = vectext._powers_to(len(h) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[: len(h)], dtype=np.uint64)])
        out.append(vectext.mix((total[words.starts[1:]] - total[words.starts[:-1]]) * inverse[words.starts[:-1]]))
    return out[0], out[1]


def banded(documents: DataFrame, shingle: int, slots: int, bands: int) -> DataFrame:
    """doc_id, h1, h2 (of the words), bands; rows with a null id or without a word are left out."""

    def stage(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, raw = vectext.strings(vectext.lowered(batch.column(1)))
            for first, last in vectext.slices(offsets):
                words = vectext.Words(offsets, raw, first, last, vectext.WORD)
                h, docs = elements(words, shingle)
                full = np.flatnonzero(np.diff(words.starts) > 0)
                if not len(full):
                    continue
                same = [vectext.long_array(x[full]) for x in sequence_hashes(words)]
                sig = signatures(h, np.searchsorted(full, docs), len(full), slots)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), vectext.long_array(band_hashes(sig, bands).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:last][full].astype(np.int64)), *same, lists], names=["doc_id", "h1", "h2", "bands"])

    rows = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(stage, "doc_id long, h1 long, h2 long, bands array<long>")


def shingle_set(words: vectext.Words, i: int, h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    a, b = np.searchsorted(docs, [i, i + 1])
    return np.unique(h[a:b])


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """pairs (a, b) with a < b, with their exact Jaccard similarity, the sizes of both sets, and whether it reaches the threshold.

    The rows of one a lie together, a's own text first, and stream by: a first document with any number of
    partners costs the memory of one batch.
    """
    wanted = pairs.select("a", F.col("b").alias("doc_id")).unionByName(pairs.select("a", F.col("a").alias("doc_id")).distinct())
    rows = wanted.join(texts, "doc_id").select("a", F.col("doc_id").alias("b"), "text")
    rows = rows.repartition("a").sortWithinPartitions("a", F.col("b") != F.col("a"), "b")

    def stage(batches):
        leader, own = None, None
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            offsets, raw = vectext.strings(vectext.lowered(batch.column(2)))
            found = []
            for first, last in vectext.slices(offsets):
                words = vectext.Words(offsets, raw, first, last, vectext.WORD)
                h, docs = elements(words, shingle)
                for i in range(last - first):
                    mine, x, y = shingle_set(words, i, h, docs), int(a[first + i]), int(b[first + i])
                    if x == y:
                        leader, own = x, mine
                    elif leader == x:
                        both = len(np.intersect1d(own, mine, assume_unique=True))
                        found.append((x, y, both / max(1, len(own) + len(mine) - both), len(own), len(mine)))
            if found:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["a", "b", "jaccard", "n_a", "n_b"])

    return rows.mapInArrow(stage, "a long, b long, jaccard double, n_a int, n_b int").withColumn("same", F.col("jaccard") >= threshold)


def _key(documents: DataFrame):
    """One for each id and text; null without id."""
    own = F.col("doc_id").cast("long")
    return F.when(own.isNotNull(), F.xxhash64(own, F.col("text").cast("string")))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _key(documents).alias("key"), F.col("text").cast("string").alias("text"))


def _rare(members: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """bucket, x, lost, n, s: of each member of a bucket its rarest shingles, as many as two similar sets must share one of."""
    rows = members.join(texts.withColumnRenamed("doc_id", "x"), "x").select("bucket", "x", "lost", "text")

    def stage(batches):
        for batch in batches:
            offsets, raw = vectext.strings(vectext.lowered(batch.column(3)))
            for first, last in vectext.slices(offsets):
                words = vectext.Words(offsets, raw, first, last, vectext.WORD)
                h, docs = elements(words, shingle)
                sets = [shingle_set(words, i, h, docs) for i in range(last - first)]
                sizes = np.array([len(x) for x in sets])
                own = pa.array(np.repeat(np.arange(first, last), sizes))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(3)), pa.array(np.repeat(sizes, sizes).astype(np.int32)), vectext.long_array(np.concatenate(sets))], names=["bucket", "x", "lost", "n", "s"])

    every = rows.mapInArrow(stage, "bucket long, x long, lost boolean, n int, s long")
    few = every.groupBy("bucket", "s").agg(F.count(F.lit(1)).alias("df"))
    nth = F.row_number().over(Window.partitionBy("bucket", "x").orderBy("df", "s"))
    return every.join(few, ["bucket", "s"]).withColumn("nth", nth).filter(F.col("nth") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).drop("nth", "df")


def _second_pairs(members: DataFrame, first: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """a, b: the pairs of a bucket that one who failed against its first may still make, of sizes that allow it."""
    sizes = first.select(F.col("b").alias("x"), F.col("n_b").alias("n")).distinct()
    failed = first.filter(~F.col("same")).select("a", "b", F.lit(True).alias("lost"))
    flagged = members.withColumnRenamed("b", "x").join(failed.withColumnRenamed("b", "x"), ["a", "x"], "left").select("bucket", "x", F.coalesce("lost", F.lit(False)).alias("lost"))
    weight = flagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.count_if("lost").alias("f")).filter("f > 0 and m > 1")
    flagged = written(flagged.join(weight, "bucket").join(sizes, "x").select("bucket", "x", "lost", "n", (F.col("f") * F.col("m") > MANY_PAIRS * (F.col("f") + F.col("m"))).alias("many")), "second")
    lost = flagged.filter("lost and not many")
    other = flagged.filter("not many").select("bucket", F.col("x").alias("y"), F.col("n").alias("n_y"))
    pairs = lost.join(other, "bucket").select("x", "y", "n", "n_y")
    if not flagged.filter("many").isEmpty():
        rare = written(_rare(flagged.filter("many").select("bucket", "x", "lost"), texts, shingle, threshold), "rare")
        pairs = pairs.unionByName(rare.filter("lost").join(rare.select("bucket", "s", F.col("x").alias("y"), F.col("n").alias("n_y")), ["bucket", "s"]).select("x", "y", "n", "n_y"))
    fits = (F.least("n", "n_y") >= F.lit(threshold) * F.greatest("n", "n_y")) & (F.col("x") != F.col("y"))
    found = pairs.filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return found.join(first, ["a", "b"], "left_anti")


def _texts_and_pairs(documents: DataFrame, shingle: int = SHINGLE, slots: int = SLOTS, bands: int = BANDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(key, rep of each key: the least key with the same words), verified pairs a, b, jaccard of reps."""
    tune(documents.sparkSession)
    keyed = _keyed(documents).select(F.col("key").alias("doc_id"), "text")
    every = written(banded(keyed, shingle, slots, bands), "bands")
    reps = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    buckets = reps.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("bucket"))
    by = Window.partitionBy("bucket").orderBy("doc_id")
    # The first of a bucket; the frame up to the row streams, whatever the bucket's size.
    members = buckets.withColumn("a", F.first("doc_id").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    members = written(members.filter("a <> doc_id").select("bucket", "a", F.col("doc_id").alias("b")).distinct(), "buckets")
    first_pairs = members.select("a", "b").distinct()
    touched = first_pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # Rows of one key are copies.
    texts = written(keyed.join(touched, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "near-texts")
    first = written(verified(first_pairs, texts, shingle, threshold), "pairs")
    second = _second_pairs(members, first, texts, shingle, threshold)
    again = verified(second, texts, shingle, threshold)
    pairs = written(first.filter("same").unionByName(again.filter("same")).select("a", "b", "jaccard"), "near-pairs")
    for table in (members, texts, first):
        discard(table)
    same = every.select(F.col("doc_id").alias("key"), "h1", "h2").distinct()
    # A join, not a window: copies of one text may be a third of all rows, and such a join is split.
    return same.join(every.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), ["h1", "h2"]).select("key", "rep"), pairs


def near_pairs(documents: DataFrame, **settings) -> DataFrame:
    """Verified pairs a, b, jaccard, of keys of different texts, that connect all near duplicates which share a bucket."""
    return _texts_and_pairs(documents, **settings)[1]


def _members(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, key, n_links, group_id and first (the least id with its key) of each distinct id and text that is in a group."""
    texts, pairs = _texts_and_pairs(documents, **settings)
    roots = connected(pairs).select(F.col("node").alias("rep"), "root")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    members = _keyed(documents).select("doc_id", "key").distinct().join(texts, "key").join(roots, "rep", "left").join(links, "rep", "left")
    members = members.select("doc_id", "key", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    firsts = members.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.join(firsts, "root").select("doc_id", "key", "n_links", F.col("first.doc_id").alias("group_id"), F.col("first.key").alias("first"))


def near_groups(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, group_id, n_links of the documents that have a near duplicate; group_id is the least id of the group.

    Two documents are near duplicates where the sets of their runs of 3 words (lower case, no punctuation)
    have a Jaccard similarity of THRESHOLD or more; groups are closed over such pairs.  n_links is the number of
    verified pairs of its text with other texts that hold the group together; copies of the same words are one
    text.  Rows of one id and text are one document; an id with several texts may be in several groups, with a
    row for each.  A text that is null, empty or without a word, and a row without id, is in no group.
    """
    return _members(documents, **settings).groupBy("doc_id", "group_id").agg(F.sum("n_links").alias("n_links"))


def without_near_duplicates(documents: DataFrame, **settings) -> DataFrame:
    """One document of each group, the one with the least id, and all documents of no group, with all columns.

    Of rows that repeat an id and its text one stays; rows of one id with other texts and rows with a null id stay.
    """
    mark, nth, own = (fresh(documents, c) for c in ("__gone", "__nth", "__own"))
    gone = _members(documents, **settings).filter("key <> first").select(F.col("key").alias(mark))
    keyed = documents.withColumn(own, _key(documents))
    kept = keyed.join(gone, keyed[own] == F.col(mark), "left_anti")
    # The join has put equal keys together, so the window needs no further exchange.
    by = Window.partitionBy(own).orderBy("text")
    return kept.withColumn(nth, F.when(F.col(own).isNotNull(), F.row_number().over(by)).otherwise(1)).filter(F.col(nth) == 1).drop(nth, own)


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_superminhash": op9_superminhash}
