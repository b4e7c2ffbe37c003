"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items and documents are normalised to lower-case words.  The automaton holds every run of words of every
item; a document's words walk through it and the length of the longest match that ends at each word is
known.  A run goes when it has MIN_WORDS words, or when it has COVERAGE of the words of an item that holds
it and COVER_WORDS at least.  A run that fails may have a shorter suffix of a shorter item that passes, so
each state knows the longest state on its way of suffix links that does: no item hides another one.

The automaton is built once, on the driver, and sent as flat arrays.  A benchmark too large for one is
several automata, in as many Python stages in a row as the broadcast bound needs; what they find in the
text as it came is united before anything is cut, so the rows are the same for any number of parts.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext
from .shared import BROADCAST_BYTES, fresh, once, send, tune

MIN_WORDS, COVERAGE, COVER_WORDS = 13, 0.8, 5
#: Words of items in one automaton.
PART_WORDS = 150_000
#: Bytes of automata that one Python stage holds; further ones are in another stage.
STAGE_BYTES = BROADCAST_BYTES
SPAN = "struct<begin:int,end:int,words:int,item_id:long>"
RESULT = f"doc_id long, removed_words int, item_ids array<long>, spans array<{SPAN}>, clean_text string"
#: A match as it travels between stages: words of the text, words of the item, the item.
FOUND = "array<struct<first:int,last:int,size:int,item:long>>"
_FOUND = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("size", pa.int32()), ("item", pa.int64())]))


class Automaton:
    """Suffix automaton of several word sequences; a state knows the shortest item that holds it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.item: list[tuple[int, int] | None] = [None]  # (words of the item, its id)

    def _state(self, length: int, copy: int | None = None) -> int:
        self.next.append(dict(self.next[copy]) if copy is not None else {})
        self.link.append(self.link[copy] if copy is not None else 0)
        self.length.append(length)
        self.item.append(self.item[copy] if copy is not None else None)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, q)
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int], item_id: int) -> None:
        last, mark = 0, (len(words), item_id)
        for w in words:
            if w in self.next[last]:
                q = self.next[last][w]
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p != -1 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p == -1:
                    self.link[new] = 0
                else:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
                last = new
            if self.item[last] is None or mark < self.item[last]:
                self.item[last] = mark

    def closed(self, width: int, coverage: float, cover_words: int) -> tuple[np.ndarray, ...]:
        """Flat arrays: keys (state x width + word) in order and where they lead; link, length, item's words and id, and
        the longest state by suffix links that has the share of its item (0: none)."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):  # the shortest item goes on to all suffixes
            p, mark = self.link[s], self.item[s]
            if p > 0 and mark is not None and (self.item[p] is None or mark < self.item[p]):
                self.item[p] = mark
        best = [0] * len(self.next)
        for s in order:
            p = self.link[s]
            if p > 0:
                best[s] = p if self.length[p] >= max(cover_words, coverage * self.item[p][0]) else best[p]
        moves = sorted((s * width + w, t) for s, n in enumerate(self.next) for w, t in n.items())
        size, item = zip(*(x or (0, 0) for x in self.item))
        small = (np.array(x, dtype=np.int32) for x in (self.link, self.length, size, best))
        return np.array([k for k, _ in moves], dtype=np.int64), np.array([t for _, t in moves], dtype=np.int32), *small, np.array(item, dtype=np.int64)


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    offsets, raw = vectext.strings(vectext.lowered(pa.array(texts, pa.large_string())))
    words = vectext.Words(offsets, raw, 0, len(texts), vectext.WORD)
    return [words.hash[a:b] for a, b in zip(words.starts, words.starts[1:])]


def compiled(items: list[tuple[int, np.ndarray]], coverage: float, cover_words: int) -> tuple:
    """What a Detector needs, in flat arrays, from items as (id, word hashes)."""
    vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
    automaton = Automaton()
    for i, h in items:
        automaton.add(np.searchsorted(vocabulary, h).tolist(), i)
    return vocabulary, min((len(h) for _, h in items), default=0), automaton.closed(max(1, len(vocabulary)), coverage, cover_words)


class Detector:
    """Matches in a slice of documents."""

    def __init__(self, vocabulary: np.ndarray, shortest: int, flat: tuple[np.ndarray, ...]) -> None:
        self.vocabulary, self.shortest, self.width = vocabulary, shortest, max(1, len(vocabulary))
        keys, to, link, length, size, best, item = flat
        self.keys, self.to = memoryview(keys), memoryview(to)
        self.link, self.length, self.size, self.best, self.item = (memoryview(x) for x in (link, length, size, best, item))
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[vocabulary & np.uint64(0xFFFF)] = True

    def matches(self, words: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest match that ends at each word."""
        out, s, n = [], 0, 0
        keys, to, width, end = self.keys, self.to, self.width, len(self.keys)
        for w in words:
            while True:
                at = bisect_left(keys, s * width + w)
                if at < end and keys[at] == s * width + w:
                    s, n = to[at], n + 1
                    break
                if not s:
                    n = 0
                    break
                s = self.link[s]
                n = self.length[s]
            out.append((n, s))
        return out

    def found(self, words: vectext.Words, min_words: int, coverage: float, cover_words: int) -> dict[int, list[tuple[int, int, int, int]]]:
        """Document -> (first word, behind the last, words of the item, item), words counted in the slice; in order, none within another."""
        h = words.hash
        least = max(1, min(min_words, max(cover_words, int(np.ceil(self.shortest * coverage)))))
        maybe = np.flatnonzero(self.filter[h & np.uint64(0xFFFF)])
        if not len(maybe) or not len(self.vocabulary):
            return {}
        at = np.searchsorted(self.vocabulary, h[maybe])
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == h[maybe]
        ids = np.full(len(h), -1, dtype=np.int64)
        ids[maybe[known]] = at[known]
        # Only runs of known words of one document can hold a match.
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        inner = np.unique(words.starts[1:-1])
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b in zip(begin[end - begin >= least].tolist(), end[end - begin >= least].tolist()):
            cuts = [a, *inner[np.searchsorted(inner, a, "right") : np.searchsorted(inner, b, "left")].tolist(), b]
            for x, y in zip(cuts, cuts[1:]):
                if y - x < least:
                    continue
                bad: list[tuple[int, int, int, int]] = []
                for k, (n, s) in enumerate(self.matches(ids[x:y].tolist())):
                    if n < min_words and (n < cover_words or n < coverage * self.size[s]):
                        s = self.best[s]
                        n = self.length[s]
                        if not s:
                            continue
                    stop = x + k + 1
                    while bad and bad[-1][0] >= stop - n:
                        bad.pop()
                    bad.append((stop - n, stop, self.size[s], self.item[s]))
                if bad:
                    out.setdefault(int(words.doc_of(np.array([x]))[0]), []).extend(bad)
        return out


def items_of(benchmark: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Items with at least one word, as hashes; the test set doesn't grow with the corpus and comes to the driver."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null and item_id is not null").orderBy("item_id", "text").collect()
    return [(r[0], h) for r, h in zip(rows, _word_hashes([r[1] for r in rows])) if len(h)] if rows else []


def _parts(items: list[tuple[int, np.ndarray]]) -> list[list[tuple[int, np.ndarray]]]:
    parts, room = [[]], PART_WORDS
    for i, h in items:
        if parts[-1] and len(h) > room:
            parts.append([])
            room = PART_WORDS
        parts[-1].append((i, h))
        room -= len(h)
    return parts


def _cut(data: bytes, spans: list[tuple[int, int, int, int]]) -> bytes:
    out, at = [], 0
    for begin, end, *_ in spans:
        out.append(data[at:begin])
        at = end
    return b"".join([*out, data[at:]])


def _maximal(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches in order without those that lie within another; of equal ones that of the shortest item, then the least id."""
    out: list[tuple[int, int, int, int]] = []
    for m in sorted(found, key=lambda m: (m[0], -m[1], m[2], m[3])):
        if not out or m[1] > out[-1][1]:
            out.append(m)
    return out


def _merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(first, behind the last, item) of maximal matches; those that overlap or touch are one, with the item of the longest."""
    out: list[list[int]] = []  # first, last, item, length of the longest
    for p, q, _, i in found:
        if out and p <= out[-1][1]:
            if q - p > out[-1][3]:
                out[-1][2:] = [i, q - p]
            out[-1][1] = max(out[-1][1], q)
        else:
            out.append([p, q, i, q - p])
    return [(p, q, i) for p, q, i, _ in out]


def _matches(column: pa.Array, earlier: pa.Array | None, detectors: list[Detector], settings: tuple):
    """(row, words of its slice, its number there, maximal matches) of rows with a match here or in earlier stages."""
    offsets, _ = vectext.strings(column)
    low_offsets, low = vectext.strings(vectext.lowered(column))
    before = {} if earlier is None else {r: x for r, x in enumerate(earlier.to_pylist()) if x}
    for first, last in vectext.slices(offsets):
        words = vectext.Words(low_offsets, low, first, last, vectext.WORD)
        by_doc: dict[int, list[tuple[int, int, int, int]]] = {}
        for row in range(first, last) if before else ():
            at = int(words.starts[row - first])
            by_doc[row - first] = [(at + m["first"], at + m["last"], m["size"], m["item"]) for m in before.get(row, ())]
        for detector in detectors:
            for doc, found in detector.found(words, *settings).items():
                by_doc.setdefault(doc, []).extend(found)
        for doc, found in sorted(by_doc.items()):
            if found:
                yield first + doc, words, doc, _maximal(found)


def _found(column: pa.Array, earlier: pa.Array | None, detectors: list[Detector], settings: tuple):
    """(row, text in bytes, spans in bytes as (begin, end, words, item), items) of the rows with a match."""
    offsets, raw = vectext.strings(column)
    for row, words, doc, found in _matches(column, earlier, detectors, settings):
        base = int(words.bounds[doc])
        data = raw[offsets[row] : offsets[row + 1]].tobytes()
        yield row, data, [(int(words.begin[p]) - base, int(words.end[q - 1]) - base, q - p, i) for p, q, i in _merged(found)], sorted({i for *_, i in found})


def _sent_parts(spark: SparkSession, benchmark: DataFrame, coverage: float, cover_words: int) -> list[list]:
    """Broadcasts of automata, by stage."""
    stages, room = [[]], STAGE_BYTES
    for part in _parts(items_of(benchmark)):
        flat = compiled(part, coverage, cover_words)
        size = flat[0].nbytes + sum(x.nbytes for x in flat[2])
        if stages[-1] and size > room:
            stages.append([])
            room = STAGE_BYTES
        stages[-1].append(send(spark, flat, size))
        room -= size
    return stages


def _detectors(sent: list) -> list[Detector]:
    """All parts' detectors, under one name, so a worker keeps them whatever their number."""
    return once(sent[0], lambda first: [Detector(*first), *(Detector(*p.value[1]) for p in sent[1:])])


def _with_matches(rows: DataFrame, at_text: int, name: str, stages: list[list], settings: tuple) -> DataFrame:
    """rows with a last column: the matches that all stages but the last one find; rows as they are where there is one."""
    for k, sent in enumerate(stages[:-1]):
        given, wanted = rows, rows.withColumn(name, F.lit(None).cast(FOUND)) if not k else rows

        def stage(batches, sent=sent, has=k > 0):
            for batch in batches:
                earlier = batch.column(batch.num_columns - 1) if has else None
                lists: list = [None] * batch.num_rows
                for row, words, doc, found in _matches(batch.column(at_text), earlier, _detectors(sent), settings):
                    at = int(words.starts[doc])
                    lists[row] = [{"first": p - at, "last": q - at, "size": n, "item": i} for p, q, n, i in found]
                own = batch.columns[:-1] if has else batch.columns
                yield pa.RecordBatch.from_arrays([*own, pa.array(lists, _FOUND)], names=[*batch.schema.names[: len(own)], name])

        rows = given.mapInArrow(stage, wanted.schema)
    return rows


def contaminated(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, coverage: float = COVERAGE, cover_words: int = COVER_WORDS) -> DataFrame:
    """One row for each document with a match: removed words, items, spans (in characters), the text without them.

    A match is named after the shortest item that holds it, of equals the least id; item_ids has those of all
    matches that lie within no other.  Texts that are null or empty and clean documents give no row; rows with a
    null or repeated id are taken one by one; items without a word or an id match nothing, so an empty benchmark
    gives no row.
    """
    tune(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    stages, settings = _sent_parts(documents.sparkSession, benchmark, coverage, cover_words), (min_words, coverage, cover_words)
    rows = _with_matches(rows, 1, "found", stages, settings)
    sent, before = stages[-1], len(stages) > 1

    def stage(batches):
        for batch in batches:
            out = []
            for row, data, spans, items in _found(batch.column(1), batch.column(2) if before else None, _detectors(sent), settings):
                chars, at, n = [], 0, 0
                for a, b, *_ in spans:  # each byte is decoded once
                    n += len(data[at:a].decode())
                    size = len(data[a:b].decode())
                    chars.append((n, n + size))
                    at, n = b, n + size
                out.append((row, sum(s[2] for s in spans), items, [{"begin": c, "end": e, "words": n, "item_id": i} for (c, e), (_, _, n, i) in zip(chars, spans)], _cut(data, spans).decode()))
            if out:
                at, *cols = zip(*out)
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("item_id", pa.int64())])), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "removed_words", "item_ids", "spans", "clean_text"])

    return rows.mapInArrow(stage, RESULT)


def decontaminated(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, coverage: float = COVERAGE, cover_words: int = COVER_WORDS) -> DataFrame:
    """All rows and columns, matches cut out of text and n_chars counted anew; a row left without a word goes.

    Rows without a match stay as they are, those with a null or empty text too.
    """
    tune(documents.sparkSession)
    at_text, n = documents.columns.index("text"), len(documents.columns)
    at_size = documents.columns.index("n_chars") if "n_chars" in documents.columns else None
    stages, settings = _sent_parts(documents.sparkSession, benchmark, coverage, cover_words), (min_words, coverage, cover_words)
    rows, schema = _with_matches(documents, at_text, fresh(documents, "__found"), stages, settings), documents.schema
    sent, before = stages[-1], len(stages) > 1

    def stage(batches):
        for batch in batches:
            column, columns = batch.column(at_text), list(batch.columns[:n])
            new, keep = {}, np.ones(batch.num_rows, dtype=bool)
            for row, data, spans, _ in _found(column, batch.column(n) if before else None, _detectors(sent), settings):
                left = _cut(data, spans)
                new[row] = left.decode()
                keep[row] = bool(vectext.WORD[np.frombuffer(left, dtype=np.uint8)].any())
            if new:
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[list(new)] = True
                columns[at_text] = pa.compute.replace_with_mask(column, pa.array(mask), pa.array([new[k] for k in sorted(new)], column.type))
                if at_size is not None:
                    sizes = pa.array([len(new[k]) for k in sorted(new)]).cast(columns[at_size].type)
                    columns[at_size] = pa.compute.replace_with_mask(columns[at_size], pa.array(mask), sizes)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n]).filter(pa.array(keep))

    return rows.mapInArrow(stage, schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op10_decontamination": op10_decontamination}
