"""What the search for neighbours and the terms of texts may cost, with the same results."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codeloom.llm import toxicity


def test_texts_of_letters_are_not_rewritten(monkeypatch):
    rows = []
    replace = pc.replace_substring_regex
    monkeypatch.setattr(toxicity.pc, "replace_substring_regex", lambda column, *x: rows.append(len(column)) or replace(column, *x))
    texts = ["It's a_b, c-d!", "Größte Straße naïve", "“Größte”—Straße…naïve €5", None, "", "a\x00b\x1fc", "日本語。テキスト"]
    found = [Counter() for _ in texts]
    for first, _, docs, terms in toxicity._terms(pa.array(texts, pa.string())):
        for d, t in zip(docs.tolist(), terms.tolist()):
            found[first + d][t] += 1
    assert sum(rows) == 2  # those with other characters outside ASCII

    def expected(words):
        return Counter(toxicity.term_hashes(words.split() + [w[:4] + "*" for w in words.split() if len(w) > 4]).tolist())

    assert found == [expected(x) for x in ("it s a_b c d", "größte straße naïve", "größte straße naïve 5", "", "", "a b c", "日本語 テキスト")]


def test_neighbours_over_blocks_without_all_postings(monkeypatch):
    rnd = random.Random(5)
    names = [[f"{x}{i}" for i in range(300)] for x in "uv"]
    share = [1 / (i + 4) for i in range(300)]

    def text(i):
        return Counter(rnd.choices(names[i % 2], share, k=60)) + Counter([f"rare{rnd.randrange(4000)}", f"{'uv'[i % 2]}{i % 40}"])

    examples = [(i, int(i % 9 == 0), text(i)) for i in range(2500)]
    df = Counter(t for _, _, c in examples for t in c)
    index = toxicity.build(examples, df, 9000)
    number = {t: i for i, t in enumerate(df)}
    units = np.zeros((len(examples) + 300, len(number)))
    queries = [(i, 0, text(i)) for i in range(5000, 5150)] + examples[:150]
    for row, (_, _, c) in zip(units, examples + queries):
        for t, n in c.items():
            if t in number:
                row[number[t]] = (1 + math.log(n)) * (math.log(9001 / (1 + df[t])) + 1)
        row /= np.sqrt(row @ row)
    cosines, read = units[2500:] @ units[:2500].T, []
    from_postings = toxicity.Index._from_postings
    monkeypatch.setattr(toxicity.Index, "_from_postings", lambda self, lists: read.append(sum(int(n.sum()) for _, n, _ in lists)) or from_postings(self, lists))
    near = index.nearest_of([index.vector(c) for _, _, c in queries], 15, [i for i, _, _ in queries])
    for (own, _, _), row, got in zip(queries, cosines, near):
        if own < 2500:
            row[own] = 0
        want = np.sort(row)[::-1][:15]
        assert np.allclose([c for c, _, _ in got], want, atol=1e-9)
        assert {i for c, i, _ in got if c > want[-1] + 1e-9} == set(np.flatnonzero(row > want[-1] + 1e-9).tolist())
    # Most of what the queries' terms have stands in the matrices.
    assert 0 < sum(read) < 0.5 * sum(df[t] for _, _, c in queries for t in c)
