"""Chunks of texts: where they are cut, and what that costs."""

import random
import re
import time

from codeloom.operators import search

DEFINES = ("class ", "def ", "async def ", "impl ", "fn ", "pub fn ", "func ", "function ", "export class ", "export default function ", "export function ", "export interface ")


def by_hand(text):
    """Line by line."""
    if len(re.findall(r"[^ \t\n\x0b\f\r]+", text)) <= search.CHUNK_WORDS:
        return [text]
    pieces = [[]]
    for i, line in enumerate(text.split("\n")):
        if i and line.strip(" \t\r\f\x0b").startswith(DEFINES):
            pieces.append([])
        pieces[-1].append(line)
    return [p for p in ("\n".join(x).strip(" \t\n\x0b\f\r") for x in pieces) if p] or [text]


def test_cuts(spark):
    rng = random.Random(3)
    parts = [*DEFINES, "def", "default ", "export ", "export  class x", " ", "\t", "\r", "\x0b", "\f", "\n", "\n", "\n\n", "x", "f(y)", "def f(): ", " ", " ", "\u0085", "wörd "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 900))) for _ in range(300)]
    texts += ["", "w " * 300, "w " * 301, "\n" * 9, "w " * 301 + "\ndef ", "w " * 301 + "\ndef \t\n", "w " * 301 + "\n \tdef \x0b x", "def a\n" + "w " * 301 + "   \ndef b", "def b\ndef c " + "w " * 301]
    rows = search.chunks(spark.createDataFrame(list(enumerate(texts)), "path long, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.chunk_no)):
        got.setdefault(r.path, []).append(r.chunk)
    assert [got[i] for i in range(len(texts))] == [by_hand(t) for t in texts]
    assert search.chunks(spark.createDataFrame([(1, None)], "path long, text string")).count() == 0


def test_cost_of_a_text(spark):
    """Long texts cost what as many words in short ones do, not their lines times their definitions."""
    line = "def f(a, b):\n    return a + b\n"
    short = spark.createDataFrame([(i, line * 100) for i in range(80)], "path long, text string").coalesce(1)
    long = spark.createDataFrame([(0, line * 8000)], "path long, text string").coalesce(1)

    def seconds(texts):
        best = []
        for _ in range(3):
            began = time.time()
            n = search.chunks(texts).count()
            best.append(time.time() - began)
        assert n == 8000
        return min(best)

    assert seconds(long) < 3 * seconds(short) + 1
