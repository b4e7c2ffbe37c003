"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to ORDER deep, with counts of the bytes that follow a context.
The code length of a byte is that of escape method C: in a context seen n times with d different followers,
a follower seen c times costs log2((n + d) / c), any other the escape log2((n + d) / d) and its cost in the
context one byte shorter; a context never seen costs nothing and passes on; below the empty context a byte
costs 8 bits.  Statistics are frozen, so costs are looked up: contexts of all languages are numbered, and a
table has the cost of each byte behind each of them in every language, in whole 65536ths of a bit, which
makes sums exact and independent of how texts are batched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext
from .shared import BROADCAST_BYTES, send, tune, written

ORDER, UNIT = 3, 65536
#: The models are fitted on the whole texts of at most so many documents of each language (those whose id hashes lowest).
MAX_DOCUMENTS = 400
#: Bytes of text that are coded at once.
PIECE = 1 << 19


def _count(batches):
    """Counts of runs of 1..ORDER + 1 bytes by language."""
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), dtype=object)
        offsets, raw = vectext.strings(batch.column(1))
        for lang in np.unique(languages):
            which = np.flatnonzero(languages == lang)
            grams: dict[bytes, int] = {}
            for i in which:
                data = raw[offsets[i] : offsets[i + 1]].tobytes()
                for n in range(1, ORDER + 2):
                    for k in range(len(data) - n + 1):
                        g = data[k : k + n]
                        grams[g] = grams.get(g, 0) + 1
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.binary()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])


class Model:
    """Cost tables of all languages. grams: language -> run of bytes -> count."""

    def __init__(self, grams: dict[str, dict[bytes, int]], order: int = ORDER) -> None:
        self.languages, self.order = sorted(grams), order
        #: Models of further languages, where one table for all would be too large to send.
        self.others: list[Model] = []
        seen = sorted({b for g in grams.values() for run in g for b in run})
        #: Bytes never seen share the last symbol.
        self.symbol = np.full(256, len(seen), dtype=np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.width = width = len(seen) + 1
        contexts: list[set[bytes]] = [set() for _ in range(order + 1)]
        for g in grams.values():
            for run in g:
                if len(run) <= order + 1:
                    contexts[len(run) - 1].add(run[:-1])
        contexts[0].add(b"")
        names = [c for level in contexts for c in sorted(level)]
        number = {c: i for i, c in enumerate(names)}
        # Where a context of a level leads with one more byte; the context one byte shorter where that isn't one.
        self.steps: list[np.ndarray] = []
        for level in range(order):
            step = np.full((len(names), width), -1, dtype=np.int32)
            for c in contexts[level + 1]:
                if c[:-1] in number:
                    step[number[c[:-1]], self.symbol[c[-1]]] = number[c]
            self.steps.append(step)
        self.suffix = np.array([number[c[1:]] if c and c[1:] in number else 0 for c in names], dtype=np.int32)
        self.cost = np.zeros((len(names), width, len(self.languages)), dtype=np.int32)
        for k, lang in enumerate(self.languages):
            g = grams[lang]
            follow: dict[bytes, list[tuple[int, int]]] = {}
            for run, n in g.items():
                if len(run) <= order + 1:
                    follow.setdefault(run[:-1], []).append((run[-1], n))
            bits = np.full((len(names), width), 8.0)
            for c in names:  # shorter ones first
                i = number[c]
                below = bits[self._shorter(number, c)] if c else np.full(width, 8.0)
                if c in follow:
                    total, kinds = sum(n for _, n in follow[c]), len(follow[c])
                    bits[i] = below + np.log2((total + kinds) / kinds)
                    for b, n in follow[c]:
                        bits[i, self.symbol[b]] = np.log2((total + kinds) / n)
                else:
                    bits[i] = below
            self.cost[:, :, k] = np.round(bits * UNIT)
        self.cost = self.cost.reshape(len(names) * width, len(self.languages))

    @staticmethod
    def _shorter(number: dict[bytes, int], c: bytes) -> int:
        c = c[1:]
        while c not in number:
            c = c[1:]
        return number[c]

    def nbytes(self) -> int:
        return self.cost.nbytes + sum(s.nbytes for s in self.steps)

    def lengths(self, offsets: np.ndarray, raw: np.ndarray, first: int, last: int, piece: int = PIECE) -> np.ndarray:
        """Code length of each document in each language, in 65536ths of a bit, in pieces of so many bytes."""
        b = raw[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        out = np.zeros((last - first, len(self.languages)), dtype=np.int64)
        if not self.languages:
            return out
        for x in range(0, len(b), piece):
            y = min(x + piece, len(b))
            # Documents of the piece, and the bytes before it that its contexts reach.
            a, z = int(np.searchsorted(bounds, x, side="right")) - 1, int(np.searchsorted(bounds, y, side="left"))
            back = min(self.order, x - int(bounds[a]))
            s = self.symbol[b[x - back : y]]
            own = np.concatenate([[x - back], bounds[a + 1 : z], [y]])
            state = self._states(s, own - (x - back))
            costs = self.cost[state * self.width + s][back:].astype(np.int64)
            own = np.maximum(own - x, 0)
            full = np.flatnonzero(np.diff(own) > 0)
            out[a + full] += np.add.reduceat(costs, own[full], axis=0)
        return out

    def _states(self, s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of the longest known context before each byte, within its document."""
        n = len(s)
        best = np.zeros(n, dtype=np.int64)
        since = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
        for depth in range(1, self.order + 1):
            # The run of depth bytes before each position, followed from the empty context.
            at = np.flatnonzero(since >= depth)
            state = np.zeros(len(at), dtype=np.int64)
            for k in range(depth):
                state = self.steps[k][state, s[at - depth + k]].astype(np.int64)
                known = state >= 0
                if not known.all():
                    at, state = at[known], state[known]
            best[at] = state
        return best


def fit(documents: DataFrame, max_documents: int = MAX_DOCUMENTS) -> Model:
    """Models of the values of lang; rows without lang, id or text are left out. No row gives no language.

    Rows that share an id and a language are all taken where the id is; repeated ones count as often.
    """
    spark = documents.sparkSession
    tune(spark)
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter("doc_id is not null and lang is not null and text is not null and text <> ''")
    # Ids are small beside texts: the lowest hashes are found without them, and the texts of those ids follow.
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("lang", "doc_id").distinct().withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= max_documents).drop("nth")
    sample = known.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", "text").repartition(max(8, spark.sparkContext.defaultParallelism))
    counts = written(sample.mapInArrow(_count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ppm")
    grams: dict[str, dict[bytes, int]] = {}
    for r in counts.toLocalIterator():
        grams.setdefault(r.lang, {})[bytes(r.gram)] = r.n
    first, *others = split(grams)
    first.others = others
    return first


def split(grams: dict[str, dict[bytes, int]], most: int | None = None) -> list[Model]:
    """Models of neighbouring languages, each within the broadcast bound; a language's costs don't depend on the others."""
    most = BROADCAST_BYTES if most is None else most
    contexts = {run[:-1] for g in grams.values() for run in g}
    size = 4 * len(contexts) * (len({b for g in grams.values() for run in g for b in run}) + 1) * (len(grams) + ORDER)
    if size <= most or len(grams) < 2:
        return [Model(grams)]
    names = sorted(grams)
    half = len(names) // 2
    return [m for part in (names[:half], names[half:]) for m in split({x: grams[x] for x in part}, most)]


def identified(documents: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, language, bits (per byte in that language), margin (to the next best), lengths.

    lengths has the code length in bits by language.  Ties go to the language first in order.  A null or empty
    text, or a model without languages, has a null language.
    """
    tune(documents.sparkSession)
    models, languages = [model, *model.others], [x for m in (model, *model.others) for x in m.languages]
    model.others = []
    sent = [send(documents.sparkSession, m, m.nbytes()) for m in models]
    model.others = models[1:]

    def stage(batches):
        for batch in batches:
            offsets, raw = vectext.strings(batch.column(1))
            each = [p.value[1] for p in sent]
            total = np.concatenate([np.concatenate([m.lengths(offsets, raw, a, b) for m in each], axis=1) for a, b in vectext.slices(offsets, 1 << 19)]) if batch.num_rows else np.zeros((0, len(languages)), dtype=np.int64)
            size = np.diff(offsets)
            if languages:
                best = total.argmin(axis=1)
                ranked = np.sort(total, axis=1)
                gap = ranked[:, 1] - ranked[:, 0] if len(languages) > 1 else np.zeros(len(size), dtype=np.int64)
                names = [languages[i] if n else None for i, n in zip(best, size)]
                low = ranked[:, 0]
            else:
                names, low, gap = [None] * len(size), np.zeros(len(size)), np.zeros(len(size))
            per = np.maximum(size, 1) * UNIT
            keys = pa.array(languages * len(size), pa.string())
            maps = pa.MapArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * len(languages)), keys, pa.array((total / UNIT).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(low / per), pa.array(gap / per), maps], names=["doc_id", "language", "bits", "margin", "lengths"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(stage, "doc_id long, language string, bits double, margin double, lengths map<string,double>")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(documents, fit(documents))


QUERIES = {"op8_language_id": op8_language_id}
