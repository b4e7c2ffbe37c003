"""Content-defined chunking of payload columns, a chunk store without repeats, and verified reconstruction.

A gear hash rolls over each payload: h = (h << 1) + G[byte] in 32 bits, so it depends on the last 32 bytes
alone.  A cut falls behind a byte where the top bits of h are 0, at least min_size behind the last cut, and
at max_size at the latest.  Equal content gives equal cuts, wherever it stands, and thus equal chunks.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext
from .shared import tune

MIN_SIZE, MEAN_SIZE, MAX_SIZE = 1024, 4096, 32768
_GEAR = np.random.Generator(np.random.PCG64(31337)).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNKS = "doc_id long, seq int, n_chunks int, media_digest binary, digest binary, size int, payload binary"


def gear_hash(b: np.ndarray) -> np.ndarray:
    """The rolling hash behind every byte; each pass doubles the bytes that a value covers."""
    h = _GEAR[b]
    span = 1
    while span < 32 and span < len(h):
        low = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += low
        span *= 2
    return h


def cuts(b: np.ndarray, bounds: np.ndarray, min_size: int, mean_size: int, max_size: int) -> list[list[int]]:
    """Ends of the chunks of each payload bounds[i]..bounds[i + 1] of the buffer b."""
    bits = max(1, int(mean_size).bit_length() - 1)
    hits = np.flatnonzero(gear_hash(b) >> np.uint32(32 - bits) == 0) + 1
    first = np.searchsorted(hits, bounds)
    hits = hits.tolist()
    out = []
    for i in range(len(bounds) - 1):
        start, end, ends = int(bounds[i]), int(bounds[i + 1]), []
        for at in hits[first[i] : first[i + 1]]:
            while at - start > max_size:
                start += max_size
                ends.append(start)
            if at - start >= min_size:
                start = at
                ends.append(at)
        while end - start > max_size:
            start += max_size
            ends.append(start)
        if end > start:
            ends.append(end)
        out.append(ends)
    return out


def chunks(media: DataFrame, id_col: str = "doc_id", payload_col: str = "text", min_size: int = MIN_SIZE, mean_size: int = MEAN_SIZE, max_size: int = MAX_SIZE, with_payload: bool = True) -> DataFrame:
    """One row a chunk, its payload deflated (null with with_payload off, where the lists alone are wanted).

    A null or empty payload is one row with seq -1 and no chunk, so that it is reconstructed as empty; a null
    id stays null.  min_size is at least 32, the reach of the hash.  Other columns are not read.
    """
    if not 32 <= min_size <= mean_size <= max_size:
        raise ValueError("32 <= min_size <= mean_size <= max_size")
    tune(media.sparkSession)

    def stage(batches):
        for batch in batches:
            ids, (offsets, raw) = batch.column(0).to_pylist(), vectext.strings(batch.column(1))
            for first, last in vectext.slices(offsets):
                base = int(offsets[first])
                b = raw[base : offsets[last]]
                data, rows = b.tobytes(), []
                bounds = offsets[first : last + 1] - base
                for i, ends in enumerate(cuts(b, bounds, min_size, mean_size, max_size)):
                    at, whole = int(bounds[i]), hashlib.sha256(data[int(bounds[i]) : int(bounds[i + 1])]).digest()
                    if not ends:
                        rows.append((ids[first + i], -1, 0, whole, None, 0, None))
                    for seq, end in enumerate(ends):
                        part = data[at:end]
                        rows.append((ids[first + i], seq, len(ends), whole, hashlib.sha256(part).digest(), end - at, zlib.compress(part, 5) if with_payload else None))
                        at = end
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], names=["doc_id", "seq", "n_chunks", "media_digest", "digest", "size", "payload"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(payload_col).cast("binary").alias("payload")).mapInArrow(stage, CHUNKS)


def store(parts: DataFrame) -> DataFrame:
    """One row a distinct chunk: digest, size, payload, uses, the first use by (doc_id, seq)."""
    return (
        parts.filter(F.col("seq") >= 0)
        .groupBy("digest")
        .agg(F.first("size").alias("size"), F.first("payload").alias("payload"), F.count(F.lit(1)).alias("uses"), F.min(F.struct("doc_id", "seq")).alias("first_use"))
    )


def manifests(parts: DataFrame) -> DataFrame:
    """One row a chunk of a medium, without its bytes."""
    return parts.select("doc_id", "media_digest", "n_chunks", "seq", "digest", "size")


def _same(whole, payloads) -> bytes | None:
    """The payload, if all chunks are there and have the digest of the whole."""
    parts = [] if payloads is None else payloads
    if any(p is None for p in parts):
        return None
    data = b"".join(zlib.decompress(p) for p in parts)
    return data if hashlib.sha256(data).digest() == bytes(whole) else None


@F.pandas_udf(T.BooleanType())
def _verified(whole: pd.Series, payloads: pd.Series) -> pd.Series:
    return pd.Series([_same(w, p) is not None for w, p in zip(whole, payloads)], dtype=bool)


@F.pandas_udf(T.BinaryType())
def _payload(whole: pd.Series, payloads: pd.Series) -> pd.Series:
    return pd.Series([_same(w, p) for w, p in zip(whole, payloads)], dtype=object)


def _lists(refs: DataFrame, chunk_store: DataFrame, check_alone: bool) -> DataFrame:
    """One row a medium, its chunks in order with the bytes that the store has."""
    found = refs.join(chunk_store.select("digest", "payload", "first_use"), "digest", "left")
    use = F.struct("doc_id", "seq")
    found = found.withColumn("first_here", F.coalesce(use.eqNullSafe(F.col("first_use")), F.lit(False)))
    if check_alone:
        # A medium of one chunk is checked where the store's bytes are; only longer ones have to be gathered.
        alone = F.col("n_chunks") == 1
        found = found.withColumn("sound", _verified("media_digest", F.array(F.when(alone, F.col("payload")))) | ~alone)
        found = found.withColumn("payload", F.when(~alone, F.col("payload")))
    else:
        found = found.withColumn("sound", F.lit(True))
    lists = found.groupBy("doc_id", "media_digest", "n_chunks").agg(
        F.array_sort(F.collect_list(F.when(F.col("seq") >= 0, F.struct("seq", "size", "digest", "first_here", "payload")))).alias("list"),
        F.min("sound").alias("sound"),
    )
    # Repeated rows of one medium bring every part again, side by side.
    return lists.withColumn("list", F.filter("list", lambda x, i: (i == 0) | (x["seq"] != F.col("list")[F.greatest(i - 1, F.lit(0))]["seq"])))


def chunked_media(media: DataFrame, id_col: str = "doc_id", payload_col: str = "text", **sizes: int) -> DataFrame:
    """Chunks every payload, stores each distinct chunk once and puts every medium together from the store.

    Returns, for each medium, its ordered chunk list (the first 128 bits of each SHA-256), its bytes, the
    bytes of chunks that no smaller (doc_id, seq) has, and whether the bytes from the store have the digest of
    the whole payload.  Repeated rows give one row; rows of one id with different payloads give one each.  An
    empty table gives an empty one.
    """
    # Both sides of the join come from the payloads; only the store's side deflates them.
    lists = _lists(manifests(chunks(media, id_col, payload_col, with_payload=False, **sizes)), store(chunks(media, id_col, payload_col, **sizes)), True)
    return lists.select(
        "doc_id",
        F.hex("media_digest").alias("media_digest"),
        "n_chunks",
        F.aggregate("list", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("n_bytes"),
        F.aggregate("list", F.lit(0).cast("long"), lambda a, x: a + F.when(x["first_here"], x["size"]).otherwise(0)).alias("new_bytes"),
        F.transform("list", lambda x: F.substring(F.hex(x["digest"]), 1, 32)).alias("chunks"),
        F.when(F.col("n_chunks") == 1, F.col("sound")).otherwise(_verified("media_digest", F.transform("list", lambda x: x["payload"]))).alias("verified"),
    )


def reconstruct(refs: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """doc_id, payload (null where a chunk lacks or the digest differs) from manifests and a chunk store."""
    lists = _lists(refs, chunk_store, False)
    return lists.select("doc_id", _payload("media_digest", F.transform("list", lambda x: x["payload"])).alias("payload"))


def op1_payload_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_payload_chunking": op1_payload_chunking}
