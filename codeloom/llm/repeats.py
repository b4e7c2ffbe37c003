"""Removal of repeated passages by longest-previous-factor arrays over the whole corpus.

All documents in the order of their ids are one text of words.  LPF[p] is the length of the longest match of
the words from p on with words that begin earlier; in suffix order the earlier candidates are the previous
and the next smaller position.  Words that a match of MIN_WORDS or more covers are later copies.

lpf() is that method to the letter, for texts that fit into one process.  Over a corpus repeated_spans() asks
less of it: whether LPF[p] reaches MIN_WORDS, which is all that the removals hang on, as a longer match of p is
one of p + 1, p + 2, ... as well and covers the same words.  Suffixes with one beginning of MIN_WORDS words are
neighbours in suffix order, whatever the order of the groups of such suffixes; within one, ordered by position,
the previous smaller position of each is the one before it.  So suffixes are grouped by hashes of their first
MIN_WORDS words (95 bits), not sorted by words, and match lengths beyond MIN_WORDS aren't computed: sorting all
suffixes by prefix doubling would send 24 bytes a word in each round, about 8 times the input.  Positions that
can't have a match are left out beforehand: every window of MIN_WORDS words holds a minimizer (the least hash
of WINDOW neighbouring runs of words), which a second copy of the window holds too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext
from .shared import fresh, tune

MIN_WORDS = 50


def lpf(words: list) -> list[int]:
    """The whole LPF array of one text, by a suffix array, its LCP array and smaller neighbours in suffix order.

    For texts that fit into one process; the corpus version gives the same removals.
    """
    n = len(words)
    names = {w: i for i, w in enumerate(sorted(set(words)))}
    rank, step = np.array([names[w] for w in words], dtype=np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        second = np.full(n, -1, dtype=np.int64)
        second[:-step] = rank[step:] if step < n else second[:-step]
        order = np.lexsort((second, rank))
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            break
        step *= 2

    def common(a: int, b: int) -> int:
        k = 0
        while a + k < n and b + k < n and words[a + k] == words[b + k]:
            k += 1
        return k

    out, stack = [0] * n, []
    sa = order.tolist()
    lcp = [0] + [common(a, b) for a, b in zip(sa, sa[1:])]
    # Going one way gives the previous smaller position, the other way the next; lcp's minimum travels along.
    for seq in (list(zip(sa, lcp)), list(zip(sa[::-1], [0, *lcp[:0:-1]]))):
        stack = []  # (position, least lcp since the entry below)
        for p, low in seq:
            while stack and stack[-1][0] > p:
                low = min(low, stack.pop()[1])
            if stack:
                out[p] = max(out[p], low)
            stack.append((p, low))
    return out


def _anchors(words: vectext.Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs, which of their positions are minimizers, and which positions have min_words words left."""
    run = (min_words + 1) // 2
    window = min_words - run + 1
    g = words.all_grams(run)
    if len(words.hash) < min_words:
        return g, np.zeros(len(g), dtype=bool), np.zeros(0, dtype=bool)
    least = vectext.sliding_min(g, window)
    sizes = np.diff(words.starts)
    whole = (np.repeat(words.starts[1:], sizes) - np.arange(len(words.hash)))[: len(least)] >= min_words
    # g is a minimizer if a window of its document has it as the least: the greatest of these least ones is g.
    pad = np.zeros(window - 1, dtype=np.uint64)
    padded = np.concatenate([pad, np.where(whole, least, 0).astype(np.uint64), pad])
    greatest = ~vectext.sliding_min(~padded, window)
    return g, (greatest == g) & (greatest > 0), whole


def _words(column: pa.Array):
    offsets, raw = vectext.strings(column)
    for first, last in vectext.slices(offsets):
        yield first, last, vectext.Words(offsets, raw, first, last, vectext.SOLID)


def repeated_spans(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a removable span: doc_id, begin_word, end_word (behind the last), words, source_id, source_word.

    Words are separated by ASCII white space and compared as they are.  source_id and source_word are where the
    passage that begins the span is first found, which may be the document itself.  Rows without an id or text
    take no part; of rows with one id the one with the least text does.  A corpus without repeats gives no row.
    """
    tune(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")

    def anchors(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, last, words in _words(batch.column(1)):
                g, is_anchor, _ = _anchors(words, min_words)
                at = np.flatnonzero(is_anchor)
                if len(at):
                    doc = words.doc_of(at)
                    yield pa.RecordBatch.from_arrays([vectext.long_array(g[at]), pa.array(ids[first + doc]), pa.array((at - words.starts[doc]).astype(np.int32))], names=["h", "doc_id", "pos"])

    found = rows.mapInArrow(anchors, "h long, doc_id long, pos int")
    by = Window.partitionBy("h").orderBy("doc_id", "pos")
    shared = found.withColumn("more", (F.row_number().over(by) > 1) | F.lead("pos").over(by).isNotNull()).filter("more")
    shared = shared.groupBy("doc_id").agg(F.collect_set("pos").alias("shared"))
    # With repeated ids several texts share the positions: the one text that counts is taken here.
    texts = rows.join(shared, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "shared"), "text").alias("r")).select("doc_id", "r.text", "r.shared")

    def suffixes(batches):
        window = min_words - (min_words + 1) // 2 + 1
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for first, last, words in _words(batch.column(1)):
                g, _, whole = _anchors(words, min_words)
                if not len(whole):
                    continue
                mark = np.zeros(len(g), dtype=bool)
                part = lists.slice(first, last - first)
                docs = np.repeat(np.arange(last - first), pa.compute.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64))
                at = words.starts[docs] + part.flatten().to_numpy(zero_copy_only=False)
                mark[at[at < len(mark)]] = True
                # The least run of a window with a second copy is a minimizer of both, and thus shared.
                least = vectext.sliding_min(g, window)
                least_shared = vectext.sliding_min(np.where(mark, g, np.uint64((1 << 64) - 1)), window)
                may = np.flatnonzero(whole & (least_shared == least))
                if len(may):
                    h, c = words.all_grams(min_words)[may], words.all_grams(min_words, 0x5851F42D4C957F2D)[may]
                    doc = words.doc_of(may)
                    yield pa.RecordBatch.from_arrays(
                        [vectext.long_array(h), pa.array((c & np.uint64(0x7FFFFFFF)).astype(np.int32)), pa.array(ids[first + doc]), pa.array((may - words.starts[doc]).astype(np.int32))],
                        names=["h", "c", "doc_id", "pos"],
                    )

    order = Window.partitionBy("h", "c").orderBy("doc_id", "pos")
    suffix = texts.mapInArrow(suffixes, "h long, c int, doc_id long, pos int")
    later = suffix.select("doc_id", "pos", F.first(F.struct("doc_id", "pos")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("source"))
    later = later.filter((F.col("source.doc_id") != F.col("doc_id")) | (F.col("source.pos") != F.col("pos")))
    in_doc = Window.partitionBy("doc_id").orderBy("pos")
    last = F.lag("pos").over(in_doc)
    later = later.withColumn("fresh", (last.isNull() | (F.col("pos") > last + min_words)).cast("int"))
    later = later.withColumn("span", F.sum("fresh").over(in_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = later.groupBy("doc_id", "span").agg(F.min("pos").alias("begin_word"), (F.max("pos") + min_words).alias("end_word"), F.min_by("source", "pos").alias("source"))
    return spans.select("doc_id", "begin_word", "end_word", (F.col("end_word") - F.col("begin_word")).alias("words"), F.col("source.doc_id").alias("source_id"), F.col("source.pos").alias("source_word"))


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, later copies cut out of text and n_chars counted anew.

    Rows that take no part in the search stay as they are, as do further rows with one id, unless they have the
    same text: these are cut alike.
    """
    tune(documents.sparkSession)
    listed, key, least = (fresh(documents, c) for c in ("__spans", "__id", "__least"))
    spans = repeated_spans(documents, min_words).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin_word", "end_word"))).alias(listed))
    rows = documents.withColumn(key, F.col("doc_id").cast("long"))
    joined = rows.join(spans.withColumnRenamed("doc_id", key), key, "left")
    # Rows of one id lie together by then; the text that was searched is the least of them.
    joined = joined.withColumn(least, F.min(F.col("text").cast("string")).over(Window.partitionBy(key)))
    joined = joined.withColumn(listed, F.when(F.col("text").cast("string") == F.col(least), F.col(listed))).select(*documents.columns, listed)
    at_text, n = documents.columns.index("text"), len(documents.columns)
    at_size = documents.columns.index("n_chars") if "n_chars" in documents.columns else None
    names = documents.columns  # not the DataFrame, which no executor can hold

    def stage(batches):
        for batch in batches:
            columns, lists = list(batch.columns[:n]), batch.column(n)
            new = {}
            for row in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                text = columns[at_text][row]
                if not text.is_valid:
                    continue
                offsets, raw = vectext.strings(columns[at_text].slice(row, 1))
                words, data = vectext.Words(offsets, raw, 0, 1, vectext.SOLID), raw.tobytes()
                out, at = [], 0
                for span in lists[row].as_py():
                    if span["end_word"] <= len(words.begin):
                        out.append(data[at : words.begin[span["begin_word"]]])
                        at = int(words.end[span["end_word"] - 1])
                new[row] = b"".join([*out, data[at:]]).decode()
            if new:
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[list(new)] = True
                columns[at_text] = pa.compute.replace_with_mask(columns[at_text], pa.array(mask), pa.array(list(new.values()), columns[at_text].type))
                if at_size is not None:
                    columns[at_size] = pa.compute.replace_with_mask(columns[at_size], pa.array(mask), pa.array([len(t) for t in new.values()]).cast(columns[at_size].type))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(stage, documents.schema)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_repeats": op6_repeats}
ORACLE_SQL = {
    "op6_repeats": r"""
WITH d AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS pos FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 50], ' ')) AS h FROM p),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS source_id, first_value(pos) OVER o AS source_word FROM g WINDOW o AS (PARTITION BY h ORDER BY doc_id, pos)),
l AS (SELECT * FROM f WHERE source_id <> doc_id OR source_word <> pos),
b AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM l),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM b)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS begin_word, CAST(max(pos) + 50 AS INTEGER) AS end_word, CAST(max(pos) + 50 - min(pos) AS INTEGER) AS words,
       arg_min(source_id, pos) AS source_id, CAST(arg_min(source_word, pos) AS INTEGER) AS source_word
FROM s GROUP BY doc_id, span
"""
}
