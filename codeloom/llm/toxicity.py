"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and their stems (the first letters), all that the labelled examples have, known by 64-bit
hashes: a slice of documents is counted as arrays, without a Python object a word.  A term's weight is
its inverse document frequency over all documents times what it tells of the label among the examples: a power
of df x KL divergence, a smooth weight without a threshold or a bound on the number of terms.

Examples that share frequent terms stand together, in blocks of BLOCK.  Terms that many examples of a block have
are rows of its matrix; what else an example has stands in the postings of its terms.  Queries that share frequent
terms are scored together: a product with each block's matrix, of the rows that any of them has, and the postings
of each.  Postings that together can add no more than LATE are then read for the examples alone that may still
belong to the nearest, and those that can add no more than SLIGHT are only kept as a margin.  Sums in single precision have a known relative error, and all examples that may belong to the k nearest by it are scored again in
double precision, so the k nearest are exact; ties go to the least id.  Votes fall off with distance; isotonic
regression over leave-one-out votes of the examples turns them into calibrated probabilities.
"""

from __future__ import annotations

import math
import pickle
import uuid
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext
from .shared import BROADCAST_BYTES, send, tune, written

#: The classifier is fitted on at most so many labelled documents (those whose id hashes lowest).
MAX_EXAMPLES = 20_000
STEM, NEIGHBOURS, BANDWIDTH = 4, 15, 0.1
#: The power of what a term tells of the label in its weight.
SHARPNESS = 1.25
#: Texts scored at once; examples of a block; the share of a block's examples over which a term is a row of its matrix.
BATCH, BLOCK, DENSE = 128, 1024, 0.1
#: Frequent terms by which texts are ordered; postings added up at once; examples of which the best one counts for the floor.
LEADING, POSTINGS, GROUP = 32, 1 << 16, 64
#: What the postings that a query leaves out can add to a cosine; a query whose best scores are near it leaves out none.
SLIGHT = 0.005
#: What the postings can add that are read for the best examples alone.
LATE = 0.1
THRESHOLD = 0.5
#: Bytes of texts whose terms are counted at once, in a CPU's cache.
SLICE_BYTES = 1 << 18
RESULT = "doc_id long, toxic boolean, score double, votes double, evidence array<struct<example_id:long,cosine:double,toxic:boolean>>"
POSTING = np.dtype([("example", "<i4"), ("value", "<f4")])
_STEM = np.uint64(0x51ED270B7F4A7C15)


def _spaced(column: pa.Array) -> pa.Array:
    """Lower case; texts with other characters outside ASCII than letters and digits have spaces for all that are neither."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    odd = pc.match_substring_regex(low, r"[^\x00-\x7F\pL\pN]")
    return pc.replace_with_mask(low, odd, pc.replace_substring_regex(low.filter(odd), r"[^\pL\pN_]+", " "))


def _terms(column: pa.Array, limit: int = SLICE_BYTES):
    """(first, last, document of each occurrence, its term) of slices of a column: words, and stems of those over STEM letters."""
    offsets, raw = vectext.strings(_spaced(column))
    for first, last in vectext.slices(offsets, limit):
        words = vectext.Words(offsets, raw, first, last, vectext.WORD)
        starting = (raw[offsets[first] : offsets[last]] & 0xC0) != 0x80  # where characters begin
        letter, before = np.flatnonzero(starting), np.zeros(len(starting) + 1, dtype=np.int64)
        np.cumsum(starting, out=before[1:])
        at = before[words.begin]
        long = np.flatnonzero(before[words.end] - at > STEM)
        stems = vectext.mix(words.hash_between(words.begin[long], letter[at[long] + STEM]) + _STEM)
        docs = np.repeat(np.arange(last - first), np.diff(words.starts))
        yield first, last, np.concatenate([docs, docs[long]]), np.concatenate([words.hash, stems])


def _distinct(docs: np.ndarray, terms: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each pair, in order; terms as numbers in vocabulary, others left out, where it is given."""
    seen, which = np.unique(terms, return_inverse=True)
    if vocabulary is not None:
        at = np.minimum(np.searchsorted(vocabulary, seen), max(0, len(vocabulary) - 1))
        known = vocabulary[at] == seen if len(vocabulary) else np.zeros(len(seen), dtype=bool)
        use = known[which]
        docs, which = docs[use], which[use]
    pairs, n = np.unique(docs.astype(np.int64) * len(seen) + which, return_counts=True)
    docs, which = np.divmod(pairs, max(1, len(seen)))
    return docs, (seen if vocabulary is None else at)[which], n


def term_hashes(names: list[str]) -> np.ndarray:
    """Terms of single words; those that end in * are stems."""
    offsets, raw = vectext.strings(pa.array([n.rstrip("*") for n in names], pa.large_string()))
    words = vectext.Words(offsets, raw, 0, len(names), np.ones(256, dtype=bool))
    return np.where(np.array([n.endswith("*") for n in names], dtype=bool), vectext.mix(words.hash + _STEM), words.hash)


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (sizes[0] numbers), begin[1], ..."""
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _normed(at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at, w / math.sqrt(w @ w) if len(w) else w


@dataclass
class Index:
    """Unit vectors of the examples, by example and by term."""

    vocabulary: np.ndarray  # hashes in order
    weight: np.ndarray  # of each term
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray  # of each example in terms and counts, and the end
    terms: np.ndarray
    counts: np.ndarray
    steps: list[tuple[float, float]] = field(default_factory=list)  # isotonic: from this vote on, this probability
    base: float = 0.0  # of examples without any term

    @cached_property
    def sizes(self) -> np.ndarray:
        """Length of each example's vector before it is made 1."""
        out = np.empty(len(self.ids))
        for a in range(0, len(out), BLOCK):  # a block at a time, so that all weights are never there at once
            x = self._raw(slice(self.starts[a], self.starts[min(a + BLOCK, len(out))]))
            out[a : a + BLOCK] = np.sqrt(np.add.reduceat(x * x, self.starts[a : min(a + BLOCK, len(out))] - self.starts[a]))
        return out

    def _raw(self, which) -> np.ndarray:
        return (1 + np.log(self.counts[which].astype(np.float64))) * self.weight[self.terms[which]]

    @cached_property
    def by_term(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Row of each term that is in a matrix or -1; of each block these rows and their values by example; postings
        of what isn't in a matrix: starts, and POSTING (example, value) each."""
        n, rest, dense = len(self.ids), np.bincount(self.terms, minlength=len(self.weight)), []
        for first in range(0, n, BLOCK):
            last = min(first + BLOCK, n)
            many = np.bincount(self.terms[self.starts[first] : self.starts[last]], minlength=len(self.weight))
            dense.append(np.flatnonzero(many > DENSE * (last - first)))
            rest[dense[-1]] -= many[dense[-1]]
        common = np.unique(np.concatenate(dense))
        row, own = np.full(len(self.weight), -1, dtype=np.int32), np.full(len(self.weight), -1, dtype=np.int32)
        row[common] = np.arange(len(common))
        starts = np.concatenate([[0], np.cumsum(rest)])
        postings = np.empty(starts[-1], dtype=POSTING)
        blocks, free = [], starts[:-1].copy()
        for b, known in enumerate(dense):
            first, last = b * BLOCK, min((b + 1) * BLOCK, n)
            which = slice(self.starts[first], self.starts[last])
            who = np.repeat(np.arange(first, last), np.diff(self.starts[first : last + 1]))
            terms, x = self.terms[which], self._raw(which) / self.sizes[who]
            own[known] = np.arange(len(known))
            of = own[terms] >= 0
            matrix = np.zeros((len(known), last - first), dtype=np.float32)
            matrix[own[terms[of]], who[of] - first] = x[of]
            blocks.append((row[known], matrix))
            own[known] = -1
            rare = np.flatnonzero(~of)
            rare = rare[np.argsort(terms[rare], kind="stable")]
            seen, begin, many = np.unique(terms[rare], return_index=True, return_counts=True)
            at = np.repeat(free[seen] - begin, many) + np.arange(len(rare))
            postings["example"][at], postings["value"][at] = who[rare], x[rare]
            free[seen] += many
        return row, blocks, starts, postings.view(np.int64)

    @cached_property
    def peaks(self) -> np.ndarray:
        """Greatest value in the postings of each term."""
        _, _, starts, postings = self.by_term
        out, full = np.zeros(len(starts) - 1), np.flatnonzero(np.diff(starts))
        if len(full):
            out[full] = np.maximum.reduceat(postings.view(POSTING)["value"], starts[full])
        return out

    @cached_property
    def tops(self) -> np.ndarray:
        """Greatest value of each term that is in a matrix, over these."""
        row, blocks, _, _ = self.by_term
        out = np.zeros(row.max(initial=-1) + 1, dtype=np.float32)
        for rows, matrix in blocks:
            out[rows] = np.maximum(out[rows], matrix.max(axis=1))
        return out

    @cached_property
    def place(self) -> dict[int, int]:
        return {i: k for k, i in enumerate(self.ids.tolist())}

    @cached_property
    def leading(self) -> np.ndarray:
        return leading(np.bincount(self.terms, minlength=len(self.weight)))

    @cached_property
    def _query(self) -> tuple[np.ndarray, np.ndarray]:
        """By term, all 0: weights of a query, and whether it has the term, which is small enough for a CPU's cache."""
        return np.zeros(len(self.weight)), np.zeros(len(self.weight), dtype=bool)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in order and weights of length 1; none where no term has a weight."""
        h = term_hashes(list(counts))
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        known = np.flatnonzero(self.vocabulary[at] == h) if len(self.vocabulary) else np.zeros(0, dtype=np.int64)
        known = known[np.argsort(at[known])]
        return self._unit(at[known], np.array(list(counts.values()), dtype=np.int64)[known])

    def _unit(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n.astype(np.float64))) * self.weight[at]
        return _normed(at[w > 0], w[w > 0])

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """vector() of each text."""
        out = []
        for first, last, docs, terms in _terms(column):
            docs, terms, n = _distinct(docs, terms, self.vocabulary)
            w = (1 + np.log(n.astype(np.float64))) * self.weight[terms]
            docs, terms, w = docs[w > 0], terms[w > 0], w[w > 0]
            bounds = np.searchsorted(docs, np.arange(last - first + 1)).tolist()
            out += [_normed(terms[a:b], w[a:b]) for a, b in zip(bounds, bounds[1:])]
        return out

    def nearest(self, v: tuple[np.ndarray, np.ndarray], k: int, but: int | None = None) -> list[tuple[float, int, int]]:
        """The k best (cosine, id, label) with cosine over 0, ties by id; but is an id to leave out."""
        return self.nearest_of([v], k, [but])[0]

    def nearest_of(self, vectors: list, k: int, buts: list, slight: float = SLIGHT) -> list[list[tuple[float, int, int]]]:
        out: list[list[tuple[float, int, int]]] = [[] for _ in vectors]
        if len(self.ids):
            order = sorted(range(len(vectors)), key=lambda i: likeness(vectors[i][0], self.leading))
            for first in range(0, len(order), BATCH):
                which = order[first : first + BATCH]
                for i, near in zip(which, self._nearest([vectors[i] for i in which], k, [buts[i] for i in which], slight)):
                    out[i] = near
        return out

    def _nearest(self, part: list, k: int, buts: list, slight: float) -> list[list[tuple[float, int, int]]]:
        """nearest_of() a batch."""
        row, blocks, starts, postings = self.by_term
        n = len(self.ids)
        # All weights are positive, so the error of a sum is relative.
        error = (max(len(rows) for rows, _ in blocks) + max(len(at) for at, _ in part) + 2 * BATCH) * 2.0**-22
        query = np.zeros((row.max(initial=-1) + 1, len(part)), dtype=np.float32)
        spare, more, read, late = np.zeros(len(part)), np.zeros(len(part)), [], []
        for i, (at, w) in enumerate(part):
            r = row[at]
            query[r[r >= 0], i] = w[r >= 0]
            sizes, most_of = starts[at + 1] - starts[at], w * self.peaks[at]
            order = np.argsort(most_of / np.maximum(sizes, 1))
            total = np.cumsum(most_of[order])
            left, after = np.searchsorted(total, (slight, LATE), side="right").tolist() if slight else (0, 0)
            spare[i], more[i] = (total[j - 1] * (1 + error) if j else 0.0 for j in (left, after))
            for lists, use in ((late, order[left:after]), (read, order[after:])):
                lists.append((starts[at[use]], sizes[use], w[use].astype(np.float32)))
        scored = self._from_postings(read)
        # Rows that together can add no more than SLIGHT to any of the queries are a margin too.
        reach = query * self.tops[:, None]
        most_of = reach.max(axis=1, initial=0)
        active = most_of > 0
        order = np.flatnonzero(active & (most_of <= slight))
        order = order[np.argsort(most_of[order])]
        if len(order):  # 16 rows at a time
            total = np.cumsum(np.add.reduceat(reach[order], np.arange(0, len(order), 16), axis=0), axis=0)
            left = int(np.searchsorted(total.max(axis=1), slight, side="right"))
            if left:
                active[order[: 16 * left]] = False
                spare, more = spare + total[left - 1] * (1 + error), more + total[left - 1] * (1 + error)
        for b, (rows, matrix) in enumerate(blocks):
            use = np.flatnonzero(active[rows])
            if len(use):
                scored[:, b * BLOCK : b * BLOCK + matrix.shape[1]] += query[rows[use]].T @ (matrix if len(use) == len(rows) else matrix[use])
        for i, but in enumerate(buts):
            if but in self.place:
                scored[i, self.place[but]] = -9
        # The k-th best of the groups' best is a floor for the k-th best of all.
        best = scored.reshape(len(part), -1, GROUP).max(axis=2)
        floor = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if best.shape[1] >= k else np.zeros(len(part), dtype=np.float32)
        slot, seen = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
        out: list[list[tuple[float, int, int]]] = [[] for _ in part]
        again = []
        for i, (at, w) in enumerate(part):
            maybe = np.flatnonzero(scored[i, :n] >= max(0.0, floor[i] * (1 - 2 * error) - more[i]))
            near = scored[i, maybe]
            begin, sizes, of = late[i]
            if len(begin):
                slot[maybe], seen[maybe] = np.arange(len(maybe)), True
                found = np.concatenate([postings[a:b] for a, b in zip(begin.tolist(), (begin + sizes).tolist())])
                to = found.view(np.int32)[::2]
                use = np.flatnonzero(seen[to])
                near += np.bincount(slot[to[use]], found.view(np.float32)[1::2][use] * np.repeat(of, sizes)[use], len(maybe)).astype(np.float32)
                seen[maybe] = False
            kth = float(np.partition(near, len(near) - k)[len(near) - k]) if len(near) >= k else 0.0
            if spare[i] and kth <= 4 * spare[i]:
                again.append(i)
                continue
            maybe = maybe[near >= max(kth * (1 - 2 * error) - spare[i], 1e-30)]
            if not len(maybe):
                continue
            weights, has = self._query
            weights[at], has[at] = w * self.weight[at], True
            sizes = self.starts[maybe + 1] - self.starts[maybe]
            own = [slice(a, b) for a, b in zip(self.starts[maybe].tolist(), self.starts[maybe + 1].tolist())]
            terms = np.concatenate([self.terms[x] for x in own])
            shared = np.flatnonzero(has[terms])
            counts = np.concatenate([self.counts[x] for x in own])[shared]
            who = np.repeat(np.arange(len(maybe)), sizes)[shared]
            cosines = np.bincount(who, weights[terms[shared]] * (1 + np.log(counts.astype(np.float64))), len(maybe)) / self.sizes[maybe]
            weights[at], has[at] = 0, False
            all_near = [(float(c), int(self.ids[j]), int(self.labels[j])) for c, j in zip(np.round(cosines, 12), maybe) if c > 0]
            out[i] = sorted(all_near, key=lambda x: (-x[0], x[1]))[:k]
        if again:
            for i, near in zip(again, self._nearest([part[i] for i in again], k, [buts[i] for i in again], 0.0)):
                out[i] = near
        return out

    def _from_postings(self, read: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Sums by query and example (and as many more as fill a group) of postings: where they begin, how many, the weight of their term."""
        postings = self.by_term[3]
        sums = np.zeros((len(read), -(-len(self.ids) // GROUP) * GROUP), dtype=np.float32)
        begins = np.repeat(np.arange(len(read)) * sums.shape[1], [len(begin) for begin, _, _ in read])
        begin, sizes, w = (np.concatenate(x) for x in zip(*read))
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + POSTINGS, side="right")))
            many = sizes[a:b]
            found = postings[_ranges(begin[a:b], many)]
            at = np.repeat(begins[a:b], many)
            at += found.view(np.int32)[::2]
            x = np.repeat(w[a:b], many)
            x *= found.view(np.float32)[1::2]
            np.add.at(sums.reshape(-1), at, x)
            a = b
        return sums


def probability(steps: list[tuple[float, float]], votes: float) -> float:
    p = 0.0
    for start, value in steps:
        if votes < start:
            break
        p = value
    return p


def votes_of(near: list[tuple[float, int, int]], bandwidth: float) -> float:
    """Share of toxic examples, each with weight exp(-distance / bandwidth); one clean vote at distance 1."""
    weights = [math.exp((c - 1) / bandwidth) for c, _, _ in near]
    return sum(w for w, (_, _, y) in zip(weights, near) if y) / (sum(weights) + math.exp(-1 / bandwidth) + 1e-300)


def isotonic(points: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """Rising step function nearest to the labels (pool adjacent violators), lightly smoothed."""
    pools: list[list[float]] = []  # start, sum, n
    by_vote: dict[float, list[int]] = {}
    for x, y in points:
        by_vote.setdefault(x, []).append(y)
    for x in sorted(by_vote):
        pools.append([x, sum(by_vote[x]), len(by_vote[x])])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return [(x, (s + 0.5) / (n + 1)) for x, s, n in pools]


def inverse_frequency(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((1 + n_docs) / (1 + df)) + 1


def assembled(vocabulary: np.ndarray, weight: np.ndarray, ids, labels, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> Index:
    """An index without calibration, from examples in their order with sizes terms each. Those without a term make its base."""
    full, labels, ids = sizes > 0, np.asarray(labels, dtype=np.int8), np.asarray(ids, dtype=np.int64)
    index = Index(vocabulary, weight, ids[full], labels[full], np.concatenate([[0], np.cumsum(sizes[full])]), terms.astype(np.int32, copy=False), counts)
    blank = labels[~full]
    index.base = (float(blank.sum()) + 0.5) / (len(blank) + 1) if len(blank) else 0.0
    return index


def leading(df: np.ndarray) -> np.ndarray:
    """The most frequent terms."""
    return np.argsort(-df, kind="stable")[:LEADING]


def likeness(terms: np.ndarray, first: np.ndarray) -> int:
    """A bit for each of the leading terms that is among terms (in order), the most frequent one first: texts alike are near in this order."""
    at = np.minimum(np.searchsorted(terms, first), len(terms) - 1)
    return int((terms[at] == first) @ (1 << np.arange(len(first))[::-1])) if len(terms) else 0


def build(examples: list[tuple[int, int, dict[str, int]]], df: dict[str, int], n_docs: int, k: int = NEIGHBOURS, bandwidth: float = BANDWIDTH) -> Index:
    """The index over examples (id, label, term counts) by inverse document frequency alone, calibrated by leaving one out."""
    names = list(df)
    hashes = term_hashes(names)
    order = np.argsort(hashes)
    names = [names[i] for i in order]
    number = {t: i for i, t in enumerate(names)}
    weight = inverse_frequency(np.array([df[t] for t in names], dtype=np.float64), n_docs)
    lists = [np.array(sorted((number[t], n) for t, n in c.items() if t in number), dtype=np.int64).reshape(-1, 2) for _, _, c in examples]
    frequent = leading(np.bincount(np.concatenate([x[:, 0] for x in lists]), minlength=len(names))) if examples else np.zeros(0, dtype=np.int64)
    order_of = sorted(range(len(examples)), key=lambda i: (likeness(lists[i][:, 0], frequent), examples[i][0]))
    flat = np.concatenate([lists[i] for i in order_of]) if examples else np.zeros((0, 2), dtype=np.int64)
    index = assembled(hashes[order], weight, [examples[i][0] for i in order_of], [examples[i][1] for i in order_of], np.array([len(lists[i]) for i in order_of], dtype=np.int64), flat[:, 0], flat[:, 1])
    vectors = [v for _, _, c in examples if len((v := index.vector(c))[0])]
    own = {i: y for i, y, _ in examples}
    near = index.nearest_of(vectors, k, [i for i, _, c in examples if len(index.vector(c)[0])])
    index.steps = isotonic([(votes_of(x, bandwidth), own[i]) for x, i in zip(near, [i for i, _, c in examples if len(index.vector(c)[0])])])
    return index


def _example_counts(batches):
    """term, a, n: examples, toxic and all, by term, of each slice. Columns: text, label."""
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for first, _, docs, terms in _terms(batch.column(0), vectext.SLICE_BYTES):  # longer ones give fewer rows
            docs, terms, _ = _distinct(docs, terms, None)
            if len(terms):
                seen, which = np.unique(terms, return_inverse=True)
                toxic = np.bincount(which, y[first + docs] > 0)
                yield pa.RecordBatch.from_arrays([vectext.long_array(seen), pa.array(toxic.astype(np.int64)), pa.array(np.bincount(which))], names=["term", "a", "n"])


def _document_counts(vocabulary: tuple):
    """A stage that gives term (its number), n: how many of a task's texts have each known term."""

    def stage(batches):
        known, total = _received(vocabulary), None
        for batch in batches:
            total = np.zeros(len(known), dtype=np.int64) if total is None else total
            for _, _, docs, terms in _terms(batch.column(0)):
                np.add.at(total, _distinct(docs, terms, known)[1], 1)
        if total is not None:
            at = np.flatnonzero(total)
            for k in range(0, len(at), 1 << 16):
                part = at[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["term", "n"])

    return stage


def _sent(spark: SparkSession, value) -> tuple[str, list]:
    """A name and broadcasts of value's bytes, compressed, in parts within the broadcast bound."""
    data = pickle.dumps(value, protocol=5)
    data = len(data).to_bytes(8, "big") + pa.compress(data, "zstd", asbytes=True)
    return uuid.uuid4().hex, [send(spark, data[a : a + BROADCAST_BYTES], min(BROADCAST_BYTES, len(data) - a)) for a in range(0, len(data), BROADCAST_BYTES)]


_kept: dict[str, object] = {}


def _received(sent: tuple[str, list], make=lambda x: x):
    """make(what was sent), kept for the life of a Python worker, without the bytes that it came in."""
    name, parts = sent
    if name not in _kept:
        if len(_kept) > 1:  # so that no two indexes are there at once
            _kept.clear()
        data = b"".join(p.value[1] for p in parts)
        for p in parts:
            p.__dict__.pop("_value", None)
        _kept[name] = make(pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "big"), "zstd")))
    return _kept[name]


def fit(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, bandwidth: float = BANDWIDTH) -> Index:
    """Fits on labelled documents; labels with a null are left out, of labels that differ the toxic one holds.

    With no labelled document, or one label alone, there is no term, and every document gets probability 0.
    """
    spark = documents.sparkSession
    tune(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    # At most max_examples rows of 12 bytes, so that side may be broadcast.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = written(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "toxicity-examples")
    n, pos = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < pos < n:
        return build([], {}, 0)
    counts = examples.select("text", "y").mapInArrow(_example_counts, "term long, a long, n long")
    counts = counts.groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("df")).toArrow()
    hashes = counts["term"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    known, toxic, size = hashes[order], counts["a"].to_numpy()[order], counts["df"].to_numpy()[order]
    del counts, hashes, order
    vocabulary = _sent(spark, known)
    every = texts.select("text").mapInArrow(_document_counts(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(known), dtype=np.int64)
    df[every["term"].to_numpy()] = every["n"].to_numpy()
    del every
    # df x KL divergence bounds the logarithm of the chance to see such a share at random.
    share, p = toxic / size, pos / n

    def part(x: np.ndarray, y: float) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / y), 0.0)

    gain = size * np.maximum(part(share, p) + part(1 - share, 1 - p), 0.0)
    weight = inverse_frequency(df, texts.count()) * gain**SHARPNESS
    frequent = leading(np.where(weight > 0, size, 0))
    del df, size, toxic, share, gain
    rows = _vectors(examples, vocabulary, _sent(spark, weight), frequent).toArrow()
    ids, y, like = (rows[c].to_numpy() for c in ("doc_id", "y", "likeness"))
    order = np.lexsort((ids, like))
    lists = [np.frombuffer(rows["terms"][i].as_buffer(), dtype=np.int32) for i in order.tolist()]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    terms = np.concatenate(lists)
    tf = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint8 if len(x.as_buffer()) == n else np.int32) for x, n in zip((rows["counts"][i] for i in order.tolist()), sizes.tolist())])
    index = assembled(known, weight, ids[order], y[order], sizes, terms, tf)
    del rows, lists, terms, tf
    # Leave-one-out votes: an example never votes on itself.
    own = dict(zip(index.ids.tolist(), index.labels.tolist()))
    votes = score(examples, index, k, bandwidth).select("doc_id", "votes").toArrow()
    index.steps = isotonic([(v, own[i]) for i, v in zip(votes["doc_id"].to_pylist(), votes["votes"].to_pylist()) if i in own])
    return index


def _vectors(examples: DataFrame, vocabulary: tuple, weights: tuple, frequent: np.ndarray) -> DataFrame:
    """doc_id, y, terms of some weight (32-bit numbers, in order), counts (in 8 bits if all fit, else 32), likeness; at most max_examples rows."""

    def stage(batches):
        for batch in batches:
            known, weight = _received(vocabulary), _received(weights)
            for first, last, docs, terms in _terms(batch.column(2)):
                docs, terms, n = _distinct(docs, terms, known)
                use = weight[terms] > 0
                docs, terms, n = docs[use], terms[use], n[use]
                bounds = np.searchsorted(docs, np.arange(last - first + 1))
                pairs = [(terms[a:b], n[a:b]) for a, b in zip(bounds, bounds[1:])]
                packed = ([t.astype(np.int32).tobytes() for t, _ in pairs], [m.astype(np.uint8 if not len(m) or m.max() < 256 else np.int32).tobytes() for _, m in pairs])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, last - first) for i in range(2)), *(pa.array(x, pa.binary()) for x in packed), pa.array([likeness(t, frequent) for t, _ in pairs], pa.int64())], names=["doc_id", "y", "terms", "counts", "likeness"]
                )

    return examples.select("doc_id", "y", "text").mapInArrow(stage, "doc_id long, y int, terms binary, counts binary, likeness long")


def _sent_index(spark: SparkSession, index: Index) -> tuple:
    """Broadcasts of an index without its calibration: the same for the votes that it is calibrated by and for all later ones."""
    app = spark.sparkContext.applicationId
    if index.__dict__.get("sent", (None,))[0] != app:
        index.__dict__["sent"] = app, _sent(spark, (index.vocabulary, index.weight, index.ids, index.labels, index.starts, np.diff(index.terms, prepend=np.int32(0)), index.counts))
    return index.__dict__["sent"][1]


def _unpacked(packed: tuple) -> Index:
    *head, steps, counts = packed
    return Index(*head, np.cumsum(steps, dtype=np.int32), counts)


def judged(index: Index, steps: list, base: float, texts: pa.Array, ids: list, k: int, bandwidth: float) -> list[tuple[float, float, list]]:
    """(votes, probability, neighbours) of each text."""
    out, vectors = [], index.vectors(texts)
    for (at, _), near in zip(vectors, index.nearest_of(vectors, k, ids)):
        votes = votes_of(near, bandwidth)
        out.append((votes, probability(steps, votes), near) if len(at) else (0.0, base, []))
    return out


def score(documents: DataFrame, index: Index, k: int = NEIGHBOURS, bandwidth: float = BANDWIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, toxic, score (a calibrated probability), votes, evidence.

    An example never votes on the document with its own id.  A text without any term, an empty or a null one
    is scored as such examples are; rows with a null or repeated id are scored one by one.
    """
    tune(documents.sparkSession)
    sent, steps, base = _sent_index(documents.sparkSession, index), index.steps, index.base

    def stage(batches):
        for batch in batches:
            model = _received(sent, _unpacked)
            ids = batch.column(0).to_pylist()
            found = judged(model, steps, base, batch.column(1), ids, k, bandwidth)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p >= threshold for _, p, _ in found], pa.bool_()),
                    pa.array([p for _, p, _ in found], pa.float64()),
                    pa.array([v for v, _, _ in found], pa.float64()),
                    pa.array([[{"example_id": i, "cosine": c, "toxic": bool(y)} for c, i, y in near] for _, _, near in found], pa.list_(pa.struct([("example_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.bool_())]))),
                ],
                names=["doc_id", "toxic", "score", "votes", "evidence"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(stage, RESULT)


def without_toxic(documents: DataFrame, index: Index, k: int = NEIGHBOURS, bandwidth: float = BANDWIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text isn't judged toxic, with all their columns; null and empty texts are judged as score() says."""
    tune(documents.sparkSession)
    sent, steps, base = _sent_index(documents.sparkSession, index), index.steps, index.base
    at = [documents.columns.index(c) for c in ("doc_id", "text")]

    def stage(batches):
        for batch in batches:
            model = _received(sent, _unpacked)
            ids = batch.column(at[0]).cast(pa.int64(), safe=False).to_pylist()
            keep = [p < threshold for _, p, _ in judged(model, steps, base, batch.column(at[1]), ids, k, bandwidth)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(stage, documents.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op2_toxicity": op2_toxicity}
