"""Byte-pair encoding and decoding with the published ranks of a public tokenizer.

A text is cut into words by the tokenizer's pattern.  A short word is an array of part boundaries beside an
array of the ranks of adjacent parts: the least rank is looked for again and again, its inner boundary goes,
and the two ranks beside it are taken anew.  A word over LONG bytes would make that quadratic, so there the
same merges come from a heap over a linked list.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, once, send, tune

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
LONG = 96
#: Encoded words that a worker keeps; a full cache starts again, which changes no result.
CACHE = 300_000
NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by scans for the least adjacent rank, the leftmost of equals."""
    get = ranks.get
    n = len(word)
    bound = list(range(n + 1))
    rank = [get(word[i : i + 2], NONE) for i in range(n - 1)]
    while rank:
        least = min(rank)
        if least == NONE:
            break
        i = rank.index(least)
        del bound[i + 1], rank[i]
        if i:
            rank[i - 1] = get(word[bound[i - 1] : bound[i + 1]], NONE)
        if i < len(rank):
            rank[i] = get(word[bound[i] : bound[i + 2]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids in n log n."""
    get, n = ranks.get, len(word)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
            continue
        end[i], alive[middle] = stop, False
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if before[i] >= 0 and (r := get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts with a bounded cache of words."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        outer = self

        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                b = word.encode()
                ids = (ranks[b],) if b in ranks else tuple(merge_short(b, ranks) if len(b) <= LONG else merge_long(b, ranks))
                if len(self) >= CACHE:
                    self.clear()
                if len(b) <= LONG:
                    self[word] = ids
                return ids

        outer.words = regex.compile(PATTERN).findall
        outer.known = Known()
        outer.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            outer.bytes_of[i] = b

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.known.__getitem__, self.words(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _lists(found: list) -> pa.Array:
    """Lists of ids, null for None."""
    sizes = np.array([0 if x is None else len(x) for x in found], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = array("i")
    for x in found:
        if x is not None:
            flat += x
    mask = pa.array([x is None for x in found], pa.bool_()) if any(x is None for x in found) else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, np.int32)), mask=mask)


def encode(documents: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The id columns, n_tokens, tokens, and exact: whether the tokens decode to the text.

    A null text has null tokens, an empty one no token; repeated rows stay repeated; other columns are not read.
    Where an id column has the name of a result, the result's name ends in an underscore.
    """
    spark = documents.sparkSession
    tune(spark)
    ranks = read_ranks(vocabulary)
    sent = send(spark, ranks, sum(len(b) + 60 for b in ranks))
    results = [fresh(documents.select(*id_cols), c) for c in ("n_tokens", "tokens", "exact")]

    def stage(batches):
        for batch in batches:
            encoder = once(sent, Encoder)
            texts = batch.column(len(id_cols)).to_pylist()
            found = [None if t is None else encoder.encode(t) for t in texts]
            exact = [None if x is None else encoder.decode(x) == t.encode() for x, t in zip(found, texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(id_cols)], pa.array([None if x is None else len(x) for x in found], pa.int32()), _lists(found), pa.array(exact, pa.bool_())],
                names=[*id_cols, *results],
            )

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", " + ", ".join(f"{c} {kind}" for c, kind in zip(results, ("int", "array<int>", "boolean")))
    return documents.select(*id_cols, F.col(text_col).cast("string").alias(text_col)).mapInArrow(stage, schema)


def decode(encoded: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The id columns and text; null tokens give a null text, bytes that are no UTF-8 the replacement character."""
    spark = encoded.sparkSession
    tune(spark)
    ranks = read_ranks(vocabulary)
    sent = send(spark, ranks, sum(len(b) + 60 for b in ranks))

    def stage(batches):
        for batch in batches:
            encoder = once(sent, Encoder)
            found = [None if x is None else encoder.decode(x).decode("utf-8", "replace") for x in batch.column(len(id_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(found, pa.string())], names=[*id_cols, "text"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*id_cols, "tokens").mapInArrow(stage, ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_bpe": op3_bpe}
