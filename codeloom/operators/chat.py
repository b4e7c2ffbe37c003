"""Agent helpers as relations: history trimming, response parsing, tool results."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_TOKENS, RESULT_CHARS = 50_000, 5000
TOOLS = ("read_file", "write_file", "list_directory", "generate_repository_map")


def trimmed_history(messages: DataFrame, max_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, turn, role, tokens: newest messages of each conversation within max_tokens, at least one.

    The first message that goes beyond ends the history, so a running sum says it.
    """
    rows = messages.select("conv_id", "turn", "role", F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "tokens")
    summed = rows.withColumn("used", F.sum("tokens").over(newest)).withColumn("nth", F.row_number().over(order))
    return summed.filter((F.col("nth") == 1) | (F.col("used") <= max_tokens)).select("conv_id", "turn", "role", "tokens")


_CALL = re.compile(r"(?P<tool>[A-Za-z_]\w*)\s*[(](?P<given>.*)[)]", re.DOTALL)
_TAG = re.compile(r"<[ \t\n]*(?P<close>/?)[ \t\n]*(?P<name>action|think)[ \t\n]*>")
_KNOWN = re.compile(r"\b(?:%s)\s*[(][^)]*[)]" % "|".join(sorted(TOOLS)))
_QUOTED = re.compile(r"'([^']*)'|\"([^\"]*)\"")


def _call(text: str) -> tuple[str, list[str]] | None:
    m = _CALL.match(text)
    if not m:
        return None
    given = m["given"].strip()
    try:
        return m["tool"], [str(a) for a in ast.literal_eval("[" + given + "]")]
    except (ValueError, SyntaxError):
        quoted = [a or b for a, b in _QUOTED.findall(given)]
        return (m["tool"], quoted) if quoted else None


def _sections(text: str) -> dict[str, list[str]]:
    """Bodies by tag, and under "" what is outside; a tag left open runs to the end."""
    out: dict[str, list[str]] = {"": [], "think": [], "action": []}
    at, inside = 0, ""
    for m in _TAG.finditer(text):
        opens = not m["close"]
        if inside and (opens or m["name"] != inside):
            continue
        out[inside].append(text[at : m.start()])
        at, inside = m.end(), m["name"] if opens else ""
    out[inside].append(text[at:])
    return out


def parse_response(text: str) -> tuple[str | None, list[tuple[str, list[str]]], str]:
    """(thoughts, calls of tools, plain text); tags may be left open, and calls of known tools untagged."""
    parts = _sections(text)
    calls = [c for body in parts["action"] if (c := _call(body.strip()))]
    if not calls:
        calls = [c for m in _KNOWN.finditer(text) if (c := _call(m[0]))]
    return (parts["think"][0].strip() if parts["think"] else None), calls, "".join(parts[""]).strip()


def parsed_responses(messages: DataFrame) -> DataFrame:
    """conv_id, turn, thoughts, calls, plain_text of each message."""

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [parse_response(t or "") for t in f["text"]]
            yield pd.DataFrame({"conv_id": f["conv_id"], "turn": f["turn"], "thoughts": [x[0] for x in found], "calls": [[{"tool": a, "args": b} for a, b in x[1]] for x in found], "plain_text": [x[2] for x in found]})

    return messages.select("conv_id", "turn", "text").mapInPandas(stage, "conv_id long, turn long, thoughts string, calls array<struct<tool:string,args:array<string>>>, plain_text string")


def formatted_results(results: DataFrame) -> DataFrame:
    """conv_id, message from conv_id, seq, tool, args (array), success, content, error."""
    call = F.concat(F.lit("### "), F.col("tool"), F.lit("("), F.array_join(F.transform("args", lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", "), F.lit(") — "), F.when(F.col("success"), "SUCCESS").otherwise("FAILED"))
    content = F.when(F.length("content") > RESULT_CHARS, F.concat(F.substring("content", 1, RESULT_CHARS), F.lit("\n\n[... truncated ...]"))).otherwise(F.col("content"))
    body = F.when(~F.col("success"), F.concat(F.lit("Error: "), F.coalesce("error", F.lit("Unknown error")))).otherwise(F.concat(F.lit("```\n"), content, F.lit("\n```")))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat(call, F.lit("\n"), body, F.lit("\n")).alias("part"))))
    return results.groupBy("conv_id").agg(F.concat(F.lit("## Tool Results\n\n"), F.array_join(F.transform(parts, lambda p: p["part"]), "\n")).alias("message"))
