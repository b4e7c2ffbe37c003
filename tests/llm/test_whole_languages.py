"""Any number of languages, in as many models as the broadcast bound needs."""

from codeloom.llm import langid


def test_models_in_parts(spark):
    texts = {f"l{k:03}": " ".join(chr(97 + (k * j + j * j) % 26) * (1 + k % 3) + chr(97 + k % 26) for j in range(40)) for k in range(300)}
    rows = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    few = rows.filter("doc_id < 6")
    whole = langid.fit(few)
    got = {r.doc_id: r.lengths for r in langid.identified(few, whole).collect()}
    limit, langid.BROADCAST_BYTES = langid.BROADCAST_BYTES, whole.nbytes() // 2
    try:
        parts = langid.fit(few)
        assert len(parts.others) >= 1
        assert {r.doc_id: r.lengths for r in langid.identified(few, parts).collect()} == got
    finally:
        langid.BROADCAST_BYTES = limit
    every = langid.fit(rows)
    assert len({x for m in (every, *every.others) for x in m.languages}) == 300
