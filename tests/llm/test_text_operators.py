"""Operators that take a document at a time, against slow versions of the same definitions."""

import base64
import hashlib
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from codeloom.llm import bpe, chunking, decontamination, langid, secrets, toxicity, transcripts, warc

SF = "/root/testdata/sf0.001"
rnd = random.Random(5)


def words(n, kinds=60):
    return " ".join(f"w{rnd.randrange(kinds)}" for _ in range(n))


def slow_cuts(data, low, mean, high):
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunking._GEAR[b])) & 0xFFFFFFFF
        hit = h >> (32 - (mean.bit_length() - 1)) == 0
        if (hit and i + 1 - start >= low) or i + 1 - start == high:
            out.append(i + 1)
            start = i + 1
    return out + [len(data)] * (start < len(data))


def test_cuts_and_reconstruction(docs_of):
    long = "".join(chr(97 + rnd.randrange(26)) for _ in range(60_000))
    for data in (long.encode(), b"a" * 5000, b"xy", b""):
        assert chunking.cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 64, 256, 1024)[0] == slow_cuts(data, 64, 256, 1024)
    rows = [(1, long), (2, "abc" + long), (3, None), (4, ""), (None, "q"), (5, "same"), (5, "same"), (6, long)]
    parts = chunking.chunks(docs_of(rows), min_size=64, mean_size=256, max_size=1024)
    got = chunking.chunked_media(docs_of(rows), min_size=64, mean_size=256, max_size=1024).collect()
    assert all(r.verified for r in got) and len(got) == 7
    by = {r.doc_id: r for r in got}
    assert by[6].new_bytes == 0 and by[2].new_bytes < 3000 and by[1].n_bytes == by[1].new_bytes == len(long) and by[3].chunks == []
    back = {r.doc_id: bytes(r.payload) for r in chunking.reconstruct(chunking.manifests(parts), chunking.store(parts)).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    broken = chunking.reconstruct(chunking.manifests(parts), chunking.store(parts).filter("size < 1000 and first_use.doc_id <> 5"))
    assert {r.doc_id: r.payload for r in broken.collect()}[5] is None
    assert chunking.chunked_media(docs_of([])).count() == 0


def test_nearest_is_exact():
    for case in range(5):
        names = [f"t{i}" for i in range(40)]
        examples = [(i, rnd.randrange(2), {t: rnd.randrange(1, 5) for t in rnd.sample(names, rnd.randrange(0, 6))}) for i in range(300)]
        df = {t: 1 + sum(t in c for _, _, c in examples) for t in names}
        index = toxicity.build(examples, df, 900)

        def unit(counts):
            v = {t: (1 + math.log(n)) * (math.log(901 / (1 + df[t])) + 1) for t, n in counts.items()}
            size = math.sqrt(sum(w * w for w in v.values()))
            return {t: w / size for t, w in v.items()}

        units = [(i, y, unit(c)) for i, y, c in examples if c]
        for i, _, c in examples[:40]:
            if not c:
                continue
            q = unit(c)
            slow = sorted(((-round(sum(q[t] * v.get(t, 0) for t in q), 10), j, y) for j, y, v in units if j != i and any(t in v for t in q)))[:15]
            fast = index.nearest(index.vector(c), 15, i)
            assert [x for x, _, _ in fast] == pytest.approx([-s for s, _, _ in slow], abs=1e-9)
            assert {j for x, j, _ in fast if x > fast[-1][0] + 1e-8} == {j for s, j, _ in slow if -s > fast[-1][0] + 1e-8}
    assert toxicity.isotonic([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)]) == [(0.1, 0.25), (0.2, 0.5), (0.4, 0.75)]


def test_toxicity_of_labelled_documents(spark, docs_of):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(documents, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = {r.doc_id: r for r in toxicity.score(documents, index).collect()}
    hit = sum(found[i].toxic for i, y in truth.items() if y)
    false = sum(found[i].toxic for i, y in truth.items() if not y)
    assert len(found) == documents.count() and hit >= 0.85 * sum(truth.values()) and false <= 0.01 * len(truth)
    assert all(e.example_id != i and 0 < e.cosine <= 1 + 1e-9 for i, r in found.items() for e in r.evidence)
    odd = docs_of([(None, "abc"), (1, None), (2, ""), (2, "")])
    assert toxicity.score(odd, index).filter("not toxic and size(evidence) = 0").count() == 4
    kept = toxicity.without_toxic(odd, index)
    assert kept.columns == odd.columns and kept.count() == 4
    none = toxicity.fit(docs_of([]), labels.limit(0))
    assert toxicity.score(odd, none).filter("score = 0").count() == 4 and toxicity.score(docs_of([]), none).count() == 0


def test_bpe(docs_of, spark):
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    other = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(30):
        b = bytes(rnd.choice(b"abcdefgh 123\xc3\xa9") for _ in range(rnd.randrange(1, 90)))
        assert bpe.merge_short(b, ranks) == bpe.merge_long(b, ranks)
    texts = [None, "", " ", "Hello world's 123  \n\n x", "é漢字🙂 ñandú", "a" * 3000, words(2000), words(2000), "ab\u0000cd\r\n\t"]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 50").fetchall()]
    got = {r.doc_id: r for r in bpe.encode(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i].tokens == (None if t is None else other.encode(t, disallowed_special=())) and got[i].exact is (None if t is None else True)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs_of(list(enumerate(texts))))).collect()}
    assert back == dict(enumerate(texts))
    clash = bpe.encode(docs_of([(1, "ab c")]).withColumnRenamed("bucket", "tokens"), ("doc_id", "tokens"))
    assert clash.columns == ["doc_id", "tokens", "n_tokens", "tokens_", "exact"] and clash.first().tokens_ == other.encode("ab c")
    assert bpe.encode(docs_of([])).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 9000 + "é"), (2, None, None), (3, "v", ""), (1, "u", "x" * 9000 + "é"), (None, "w", "z"), (4, "y", "\r\n0\r\n\r\n")], "page_id long, url string, html string")
    records = warc.archived(pages, 500, 700)
    got = {r.record_id: r for r in warc.reassembled(records).collect()}
    assert len(got) == 4 and all(r.complete for r in got.values())
    assert {bytes(r.payload).decode() for r in got.values()} == {"x" * 9000 + "é", "", "\r\n0\r\n\r\n"}
    lost = warc.reassembled(records.filter("not (record_id = '<urn:page:1:3>')"))
    assert [r.record_id for r in lost.filter("not complete and payload is null").collect()] == ["<urn:page:1:1>"]
    short = warc.reassembled(records.selectExpr("record_id", "kind", "target_uri", "segment_number", "origin_id", "total_length + 1 as total_length", "block"))
    assert short.filter("complete").count() == 0 and warc.reassembled(records.limit(0)).count() == 0
    assert warc.dechunked(b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert all(warc.dechunked(b) is None for b in (b"", b"3\r\nab", b"x\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"-1\r\n"))
    assert warc.joined([(None, None, b"q")]) == b"q" and warc.joined([(1, None, b"q"), (1, None, b"r"), (2, 2, b"")]) is None
    whole = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = zlib.compressobj(9, 8, 31)
    assert [r[0] for r in warc.split_records(whole * 2)] == ["<a>", "<a>"] and warc.split_records(two.compress(whole) + two.flush())[0][6] == b"abc"
    assert warc.dechunked(b"1_0\r\n" + b"x" * 16 + b"\r\n0\r\n\r\n") is None and warc.dechunked(b"+1\r\na\r\n0\r\n\r\n") is None


def test_damaged_archives(spark, tmp_path):
    def record(n, length=None, block=b"abc"):
        size = len(block) if length is None else length
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{n}>\r\n{f'Content-Length: {size}' if size != '' else 'X: y'}\r\n\r\n".encode() + block + b"\r\n\r\n"

    def seen(data):
        return [(r[0], r[1], r[6]) for r in warc.split_records(data)]

    good = lambda n: (f"<{n}>", "response", b"abc")
    for bad in ("", "x", "-1", 5000, 1):
        assert seen(record(1) + record(2, bad) + record(3)) == [good(1), ("<2>", "damaged", None), good(3)], bad
    assert seen(record(1) + record(2)[:-6]) == [good(1), ("<2>", "damaged", None)] and seen(record(1) + b"WARC/1.0\r\nX") == [good(1), (None, "damaged", None)]
    rows = [(f"<{n}>", "response", "u", None, None, None, bytes([65 + n]) * 300) for n in range(3)]
    packed = [warc.written_records([r]) for r in rows]
    spoilt = packed[1][:20] + b"\xff" * 8 + packed[1][28:]
    assert [r[0] for r in warc.split_records(b"".join(packed))] == ["<0>", "<1>", "<2>"]
    assert [r[0] for r in warc.split_records(packed[0] + spoilt + packed[2]) if r[1] != "damaged"] == ["<0>", "<2>"]
    assert [r[0] for r in warc.split_records(packed[0] + packed[1][:-9]) if r[1] != "damaged"][:1] == ["<0>"]
    assert seen(b"") == [] and seen(b"\x1f\x8b\x08junk")[0][1] == "damaged"
    for name, data in (("a.warc", record(1) + record(2, "") + record(3)), ("b.warc.gz", packed[0] + spoilt), ("c", b""), ("d.warc", b"nothing here")):
        (tmp_path / name).write_bytes(data)
    found = warc.read_archives(spark, str(tmp_path))
    assert sorted(r.record_id for r in warc.reassembled(found).collect()) == ["<0>", "<1>", "<3>"] and found.filter("kind = 'damaged'").count() >= 2
    back = warc.records_of(warc.archives_of(found.filter("kind <> 'damaged'")))
    assert sorted(back.collect()) == sorted(found.filter("kind <> 'damaged'").collect())
    # Segments without numbers, without a first segment, with other columns, many times over.
    odd = spark.createDataFrame(
        [("<a>", "response", "u", 1, None, None, b"x", 1), ("<b>", "continuation", None, None, "<a>", 2, b"y", 1), ("<c>", "continuation", None, 2, "<q>", 2, b"y", 2), ("<d>", "continuation", None, 2, None, 2, b"y", 3), (None, "response", "u", None, None, None, b"z", 4), ("<e>", None, None, None, None, None, b"", 5)]
        + [("<f>", "response", "v", 1, None, None, b"12", 6), ("<g>", "continuation", "v", 2, "<f>", 3, b"3", 7)] * 300,
        warc.RECORDS + ", parts int",
    )
    got = {r.record_id: (r.complete, r.payload and bytes(r.payload)) for r in warc.reassembled(odd).collect()}
    assert got == {"<a>": (False, None), "<q>": (False, None), "<e>": (True, b""), "<f>": (True, b"123")}


def with_crc(prefix):
    body = "".join(rnd.choice(secrets._BASE62) for _ in range(30))
    n, mark = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        mark = secrets._BASE62[r] + mark
    return prefix + body + mark.rjust(6, "0")


def test_secrets(docs_of):
    good = with_crc("ghp_")
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    planted = {
        "github-token": f"key {good} end", "json-web-token": f"{head}.eyJzdWIiOiIxIn0.c2lnbmF0dXJl x", "card-number": "card: 4111 1111 1111 1111.", "iban": "IBAN: DE89 3704 0044 0532 0130 00",
        "assigned-secret": 'password = "hV8#kd92!mQp"', "url-credentials": "see https://me:s3cr3tpw@host.example/x", "slack-token": "xoxb-123456789012-abcdefABCDEF",
    }
    clean = ["", None, "ghp_" + "a" * 36, "card: 4111 1111 1111 1112", "the token is here", "the password for all of us", "IBAN: DE89 3704 0044 0532 0130 01", "x" * 50_000]
    texts = [*planted.values(), *clean, planted["github-token"], "İ " + planted["github-token"]]
    found = secrets.findings(docs_of(list(enumerate(texts)))).collect()
    assert [(r.doc_id, r.rule) for r in sorted(found)] == [*enumerate(planted), (len(texts) - 2, "github-token"), (len(texts) - 1, "github-token")]
    assert len({r.fingerprint for r in found if r.rule == "github-token"}) == 1 and found[0].fingerprint == hashlib.sha256(good.encode()).hexdigest()[:16]
    # Expressions tried at every place of the text find nothing more.
    everywhere = secrets.Scanner()
    for text in filter(None, texts):
        slow = []
        for k, (rule, pattern, _) in enumerate(everywhere.rules):
            for at in range(len(text)):
                if m := re.compile(pattern).match(text, at):
                    s = m["secret"]
                    sound = bool(rule.check and rule.check(s))
                    if not (rule.check and rule.strict and not sound) and secrets.entropy(s) >= rule.min_entropy:
                        slow.append((*m.span("secret"), k, sound))
        out = []
        for f in sorted(set(slow), key=lambda f: (f[2], f[0], -f[1])):
            if all(f[1] <= o[0] or f[0] >= o[1] for o in out):
                out.append(f)
        assert everywhere.scan(text) == [(b, e, everywhere.rules[i][0].name, s) for b, e, i, s in sorted(out)]
    red = {r.doc_id: r for r in secrets.redacted(docs_of(list(enumerate(texts)))).collect()}
    assert red[0].text == "key [github-token] end" and red[0].n_chars == len(red[0].text) and all(red[i].text == t for i, t in enumerate(texts) if t in clean)
    assert secrets.findings(docs_of([])).count() == 0


def test_transcripts(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    labelled = transcripts.transcripts(conversations)
    models = transcripts.fit_folds(labelled)
    model = transcripts.fit(labelled)
    assert model.counts == models[0].counts + models[1].counts and all(m.counts["start", 0, 0] + m.counts["start", 2, 0] for m in models)
    truth = {r.conv_id: [(t.role, t.text.strip()) for t in r.turns if t.text.strip()] for r in labelled.collect()}
    got = {r.conv_id: list(zip(r.roles, r.texts)) for r in transcripts.parsed(transcripts.written_out(labelled).withColumn("roles", F.lit(1)), models).collect()}
    right = sum(a == b for i, t in truth.items() for a, b in zip(t, got[i]))
    assert set(got) == set(truth) and right >= 0.9 * sum(map(len, truth.values()))
    # Viterbi against all paths.
    for _ in range(5):
        seen = [(rnd.randrange(len(transcripts.MARKERS)), rnd.randrange(len(transcripts.SHAPES))) for _ in range(4)]

        def value(path):
            s = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return s + sum(model.marker[p, m] + model.shape[p, x] for p, (m, x) in zip(path, seen))

        best = max(value((a, b, c, d)) for a in range(6) for b in range(6) for c in range(6) for d in range(6))
        assert value(model.viterbi(seen)) == pytest.approx(best)
    raw = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "User: a\nAssistant: b"), (3, "no marker at all " * 5000)], "conv_id long, transcript string")
    odd = transcripts.parsed(raw, model).collect()
    assert [r.n_turns for r in odd[:3]] == [0, 0, 0] and odd[3].roles == ["user", "assistant"] and odd[3].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n" and len(odd) == 5
    nulls = spark.createDataFrame([(1, None, "user", "a"), (1, 2, None, "a"), (None, 1, "user", "a"), (1, 1, "USER", "a"), (1, 1, "USER", "a")], "conv_id long, turn long, role string, text string")
    assert [len(r.turns) for r in transcripts.transcripts(nulls).collect()] == [1]
    empty = transcripts.transcripts(nulls.limit(0))
    assert transcripts.parsed(transcripts.written_out(empty), transcripts.fit(empty)).count() == 0


def test_language(spark, docs_of):
    grams = {}
    for lang, text in (("a", b"abracadabra abc"), ("b", b"banana bandana band"), ("c", b"")):
        g = grams.setdefault(lang, {})
        for n in range(1, 5):
            for k in range(len(text) - n + 1):
                g[text[k : k + n]] = g.get(text[k : k + n], 0) + 1
    model = langid.Model(grams)

    def slow(g, c, b):
        follow = {run[-1]: n for run, n in g.items() if run[:-1] == c}
        below = (lambda: slow(g, c[1:], b)) if c else (lambda: 8.0)
        if not follow:
            return below()
        total, kinds = sum(follow.values()), len(follow)
        return math.log2((total + kinds) / follow[b]) if b in follow else math.log2((total + kinds) / kinds) + below()

    texts = ["abrabandana", "zzz", "é", "x" * 100, "ban"]
    got = {r.doc_id: r for r in langid.identified(docs_of([*enumerate(texts), (8, None), (9, "")]), model).collect()}
    for i, t in enumerate(texts):
        data = t.encode()
        for lang, g in grams.items():
            want = sum(slow(g, data[max(0, k - 3) : k], data[k]) for k in range(len(data)))
            assert got[i].lengths[lang] == pytest.approx(want, abs=1e-3)
    long = [rnd.choice(["abra", "ban", "", "zé", "c" * 50]) * rnd.randrange(1, 9) for _ in range(60)]
    data, offsets = np.frombuffer("".join(long).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in long)])
    whole = model.lengths(offsets, data, 0, len(long))
    assert all((model.lengths(offsets, data, 0, len(long), piece) == whole).all() for piece in (1, 2, 3, 7, 64))
    assert got[8].language is None and got[9].language is None and got[4].language == "b"
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(documents.filter("doc_id % 2 = 0"), 40)
    held = langid.identified(documents.filter("doc_id % 2 = 1"), model).join(documents.select("doc_id", "lang"), "doc_id")
    assert held.filter("language = lang").count() >= 0.95 * held.filter("language is not null").count()
    none = langid.fit(docs_of([]))
    assert langid.identified(docs_of([(1, "a")]), none).first().language is None


def slow_spans(text, items, least, coverage, cover):
    own = re.findall(r"\w+", text.lower())
    gone = set()
    for end in range(1, len(own) + 1):
        for n in range(end, 0, -1):
            run = own[end - n : end]
            holders = [len(i) for i in items if any(i[k : k + n] == run for k in range(len(i) - n + 1))]
            if holders and (n >= least or (n >= cover and n >= coverage * min(holders))):
                gone |= set(range(end - n, end))
                break
    return gone


def test_decontamination(spark, docs_of, monkeypatch):
    items = [words(12, 9), words(20, 9), "one two three four five six", words(9, 9)]
    bench = spark.createDataFrame([*enumerate(items), (10, None), (None, "x y z"), (11, ""), (0, items[0])], "item_id long, text string")
    texts = [words(80, 9) for _ in range(25)] + ["Start, ONE two; three four five six. End", "one two three four five", "one two three four", items[1], None, "", "clean text here", items[1] + " tail"]
    docs = docs_of(list(enumerate(texts)))
    got = {r.doc_id: r for r in decontamination.contaminated(docs, bench, 7, 0.8, 5).collect()}
    split = [i.split() for i in items]
    for i, t in enumerate(texts):
        gone = slow_spans(t or "", split, 7, 0.8, 5)
        assert (got[i].removed_words if i in got else 0) == len(gone)
        if gone:
            assert re.findall(r"\w+", got[i].clean_text.lower()) == [w for k, w in enumerate(re.findall(r"\w+", t.lower())) if k not in gone]
    assert got[25].clean_text == "Start, . End" and got[25].item_ids == [2] and got[25].spans[0].begin == 7
    left = {r.doc_id: r for r in decontamination.decontaminated(docs, bench, 7, 0.8, 5).collect()}
    assert 28 not in left and left[30].text == "" and left[31].text == "clean text here" and left[25].n_chars == len("Start, . End") and left[29].text is None
    # Nothing hides a short item within a long one, whatever the number of automata and stages.
    long = words(20, 3) + " a b c d e " + words(15, 3)
    nested = spark.createDataFrame([(1, long), (2, "a b c d e"), (3, "a b c d e f g h"), (4, "d e f g h i")], "item_id long, text string")
    odd = docs_of([(1, "p q r x a b c d e f z z"), (2, "c d e f g h i " * 2), (3, "x " * 40_000 + long), (4, long)])
    seen = [sorted(decontamination.contaminated(odd, nested).collect()), sorted(decontamination.decontaminated(odd, nested).collect())]
    assert [r.doc_id for r in seen[0]] == [1, 2, 3, 4] and seen[0][0].clean_text == "p q r x  f z z" and seen[0][2].removed_words == 40
    for part, stage in ((6, 1 << 26), (6, 1)):
        monkeypatch.setattr(decontamination, "PART_WORDS", part)
        monkeypatch.setattr(decontamination, "STAGE_BYTES", stage)
        assert [sorted(decontamination.contaminated(odd, nested).collect()), sorted(decontamination.decontaminated(odd, nested).collect())] == seen
        assert {r.doc_id: r for r in decontamination.contaminated(docs, bench, 7, 0.8, 5).collect()} == got
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.decontaminated(docs_of([]), bench).count() == 0
