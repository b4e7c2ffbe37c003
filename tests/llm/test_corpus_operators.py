"""Operators that compare documents with each other, and the pipeline, against slow versions."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.llm import components, repeats, superminhash, vectext

rnd = random.Random(11)
SCHEMA = "a long, b long"


def text_of(n, kinds=5000):
    return " ".join(f"w{rnd.randrange(kinds)}" for _ in range(n))


def near(text, share):
    return " ".join(f"z{rnd.randrange(10**6)}" if rnd.random() < share else w for w in text.split())


def shingles(text):
    w = re.findall(rb"[A-Za-z0-9_\x80-\xff]+", (text or "").lower().encode())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def slow_groups(texts):
    sets, root = {i: s for i, t in texts.items() if (s := shingles(t))}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids if any(find(j) == find(i) for j in ids if j != i)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (200, 100), (7, 3)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, SCHEMA)).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 100}
    assert components.connected(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_estimates():
    errors = []
    for _ in range(30):
        both, own = rnd.randrange(5, 300), rnd.randrange(5, 300)
        x = np.array([rnd.getrandbits(64) for _ in range(both + 2 * own)], dtype=np.uint64)
        h = np.concatenate([x[: both + own], x[:both], x[both + own :]])
        docs = np.repeat([0, 1], both + own)
        sig = superminhash.signatures(h, docs, 2)
        assert np.isfinite(sig).all()
        errors.append((sig[0] == sig[1]).mean() - both / (both + 2 * own))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_near_duplicates(spark, docs_of):
    texts = {i: text_of(rnd.randrange(3, 120)) for i in range(0, 60, 2)}
    for i in range(1, 60, 2):
        texts[i] = near(texts[i - 1], rnd.choice([0, 0, 0.03, 0.1, 0.3]))
    texts |= {70: None, 71: "", 72: "?!", 73: "One.", 74: "one", 75: text_of(30_000), 76: "ab cd", 77: "AB, cd"}
    texts[78] = near(texts[75], 0.02)
    want = slow_groups(texts)
    rows = [*texts.items(), (None, texts[0]), (None, None), (3, texts[3])]
    got = {r.doc_id: r.group_id for r in superminhash.near_groups(docs_of(rows)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and all(want[i] == g or want[i] == want[g] for i, g in got.items())
    kept = superminhash.without_near_duplicates(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in texts if got.get(i, i) == i) and ids.count(None) == 2
    assert superminhash.without_near_duplicates(docs_of([])).count() == 0


def test_templates(docs_of, monkeypatch):
    """Pages of one template meet in many buckets and are mostly not alike; some have near copies, and many copies of the same words."""
    template = text_of(60)
    texts = {i: f"{template} {text_of(rnd.randrange(60, 120))}" for i in range(60)}
    texts |= {100 + i: near(texts[i], 0.02) for i in range(20)}
    texts |= {200 + i: texts[3].upper() + "!" for i in range(50)} | {300: template, 301: template}
    want = slow_groups(texts)
    for many in (64, 0):
        monkeypatch.setattr(superminhash, "MANY_PAIRS", many)
        got = {r.doc_id: r for r in superminhash.near_groups(docs_of(list(texts.items()))).collect()}
        assert {i: r.group_id for i, r in got.items()} == want
        assert got[200].n_links == got[3].n_links >= 1 and got[301].n_links == got[300].n_links


def test_near_duplicates_of_a_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = slow_groups({r.doc_id: r.text for r in documents.collect()})
    got = {r.doc_id: r.group_id for r in superminhash.near_groups(documents).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)


def slow_repeats(rows, least):
    """Words to remove, by the LPF array of all texts in a row, with words between them that occur once."""
    words, where = [], []
    for n, (i, t) in enumerate(sorted(rows.items())):
        w = re.split(r"[ \t\n\r\f\v]+", t.strip(" \t\n\r\f\v")) if t.strip() else []
        words += [*w, ("end", n)]
        where += [*((i, k) for k in range(len(w))), None]
    index = {w: k for k, w in enumerate(sorted(set(words), key=str))}
    gone = set()
    for p, n in enumerate(repeats.lpf([index[w] for w in words])):
        if n >= least:
            gone |= set(range(p, p + n))
    return {where[p] for p in gone if where[p]}


def test_lpf():
    for _ in range(30):
        x = [rnd.randrange(3) for _ in range(rnd.randrange(0, 40))]
        slow = [max([0, *(next((k for k in range(len(x) - p + 1) if p + k == len(x) or x[q + k] != x[p + k]), 0) for q in range(p))]) for p in range(len(x))]
        assert repeats.lpf(x) == slow


def test_repeats(spark, docs_of):
    passage = text_of(60)
    rows = {i: f"{text_of(rnd.randrange(0, 40))} {passage if i % 3 else ''} {text_of(rnd.randrange(0, 30))}" for i in range(25)}
    rows |= {30: " ".join(["again"] * 40), 31: rows[1], 32: "", 33: f"{passage} {passage}", 34: text_of(20_000), 35: text_of(3)}
    rows[36] = rows[34]
    table = docs_of([*rows.items(), (40, None), (None, passage), (31, rows[31])])
    got = repeats.repeated_spans(table, 12).collect()
    assert {(r.doc_id, k) for r in got for k in range(r.begin_word, r.end_word)} == slow_repeats(rows, 12)
    split = {i: t.split() for i, t in rows.items()}
    for r in got:
        assert split[r.doc_id][r.begin_word : r.begin_word + 12] == split[r.source_id][r.source_word : r.source_word + 12]
    kept = repeats.without_repeats(table, 12)
    left = {r.doc_id: r.text for r in kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    assert kept.count() == len(rows) + 3 and kept.columns == table.columns and left[0] == rows[0] and left[36].split() == [] and left[40] is None
    # Another text of an id keeps all its words; the same one again is cut alike.
    other = text_of(71)
    twin = docs_of([(1, passage), (2, f"a b {passage} c"), (2, other + " z"), (2, f"a b {passage} c")])
    assert sorted(r.text for r in repeats.without_repeats(twin, 12).filter("doc_id = 2").collect()) == sorted(["a b  c", "a b  c", other + " z"])
    assert repeats.repeated_spans(docs_of([])).count() == 0 and repeats.repeated_spans(docs_of([(1, passage)])).count() == 0


def test_words_of_slices():
    texts = ["Ab cd", "ef", "", "gh İx é", None, "tail "]
    offsets, raw = vectext.strings(vectext.lowered(pa.array(texts, pa.large_string())))
    words = vectext.Words(offsets, raw, 0, len(texts), vectext.WORD)
    assert [raw[a:b].tobytes().decode() for a, b in zip(words.begin, words.end)] == ["ab", "cd", "ef", "gh", "İx", "é", "tail"]
    assert words.starts.tolist() == [0, 2, 3, 3, 6, 6, 7]


def test_pipeline(spark, tables):
    import corpus_pipeline

    source = duckdb.sql("select doc_id, text, toxic from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id) where lang = 'en'").fetchall()
    clean, item = text_of(80), text_of(40)
    made = {5000: clean, 5001: near(clean, 0.02), 5002: f"{text_of(50)} {item} {text_of(30)}", 5003: f'{text_of(30)} password = "hV8#kd92!mQp" {text_of(20)}', 5004: None, 5005: "", 5006: item}
    rows = [*((i, t) for i, t, _ in source), *made.items(), (None, "no id"), (5000, clean)]
    documents = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("term", pa.int32())])
    columns = {"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": [len(t or "") for _, t in rows], "term": [None] * len(rows)}
    labels = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    bench = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
    folder = tables(documents=(columns, documents), labels=({"doc_id": [i for i, _, _ in source], "quality": [1] * len(source), "toxic": [y for _, _, y in source]}, labels), benchmark=({"item_id": [1], "text": [item]}, bench))
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == list(columns)
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    toxic = {i for i, _, y in source if y}
    assert len(toxic & ids["toxicity"]) <= 0.1 * len(toxic) and len({i for i, _, y in source if not y} - ids["toxicity"]) <= 0.02 * len(source)
    groups = slow_groups({r.doc_id: r.text for r in seen["toxicity"].filter("doc_id is not null").collect()})
    gone = {i for i, g in groups.items() if g != i}
    assert ids["toxicity"] - ids["near_duplicates"] <= gone and len(gone & ids["near_duplicates"]) <= 0.1 * len(gone) and 5001 not in ids["near_duplicates"]
    assert seen["near_duplicates"].filter("doc_id = 5000").count() == 1 and None in ids["near_duplicates"]
    after = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    assert 5006 not in after and item not in after[5002] and len(after[5002].split()) == 80 and after[5004] is None and after[5005] == ""
    last = {r.doc_id: r for r in seen["bpe"].collect()}
    assert "[assigned-secret]" in seen["secrets"].filter("doc_id = 5003").first().text and all(r.exact or r.tokens is None for r in last.values())
    assert corpus_pipeline.run(spark, folder).filter(F.col("n_tokens") > 0).count() == sum(1 for r in last.values() if r.n_tokens)


def test_pipeline_of_empty_tables(spark, tables):
    import corpus_pipeline

    documents = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    folder = tables(documents=({c: [] for c in documents.names}, documents), labels=({"doc_id": [], "toxic": []}, pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32())])), benchmark=({"item_id": [], "text": []}, pa.schema([("item_id", pa.int64()), ("text", pa.string())])))
    assert corpus_pipeline.run(spark, folder).count() == 0
