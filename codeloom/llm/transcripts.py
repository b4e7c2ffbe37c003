"""Transcripts to chat turns: roles by a hidden Markov model over lines, then canonical rendering.

Every line has two observed features: the speaker marker that it begins with, if any, and a class of its shape
(length, question, list, code, blank).  A state is a role beside whether the line opens a turn or continues
it.  Start, transition and emission counts of labelled conversations, smoothed, make the model; Viterbi
finds the most likely states, and lines of one turn become one turn.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import once, send, tune, written

ROLES = ("system", "user", "assistant")
STATES = tuple((r, begins) for r in ROLES for begins in (True, False))
#: Names that stand for a role, in any language that the styles below use.
NAMES = {
    "system": ("system", "instructions", "context", "setup"),
    "user": ("user", "human", "question", "q", "customer", "prompt", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "response", "model"),
}
_ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_MARKER = re.compile(
    r"\s{0,3}(?:#{1,4}\s*|\*\*|\[|<\|?|>\s*)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\*\*)?(?:\]|\|?>)?(?:\*\*)?\s*(:|-{1,2}|>|$)(?:\*\*)?\s*",
    re.IGNORECASE,
)
_BARE = re.compile(r"\s{0,3}(?:#{1,4}\s*|\[|<\|?)(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\]|\|?>)?\s*", re.IGNORECASE)
_DASH = re.compile(r"\s{0,3}[-–—]\s+")
MARKERS = ("none", "dash", *ROLES)
SHAPES = tuple(f"{size}{end}" for size in ("blank", "short", "middle", "long", "longest") for end in ("", "?", ":"))
#: Ways to write a turn that fixtures and the query use; {} is its text.
STYLES = (
    {"system": "System: {}", "user": "User: {}", "assistant": "Assistant: {}"},
    {"system": "### System\n{}", "user": "### Human\n{}", "assistant": "### Assistant\n{}"},
    {"system": "[SYSTEM] {}", "user": "[USER] {}", "assistant": "[BOT] {}"},
    {"system": "Context: {}", "user": "Q: {}", "assistant": "A: {}"},
    {"system": "{}", "user": "- {}", "assistant": "- {}"},
    {"system": "**System:** {}", "user": "**Me:** {}", "assistant": "**AI:** {}"},
    {"system": "<|system|>\n{}", "user": "<|user|>\n{}", "assistant": "<|assistant|>\n{}"},
)
PRIOR = 0.5


def observe(line: str) -> tuple[int, int, int]:
    """(marker, shape, where the line's own text begins)."""
    marker, at = "none", 0
    m = _MARKER.match(line)
    if m and (m[2] or m.end() == len(line)):
        marker, at = _ROLE_OF[m[1].lower()], m.end()
    elif m := _BARE.match(line):
        marker, at = _ROLE_OF[m[1].lower()], m.end()
    elif m := _DASH.match(line):
        marker, at = "dash", m.end()
    text = line[at:].strip()
    n = len(text)
    size = 0 if not n else 1 if n < 60 else 2 if n < 200 else 3 if n < 600 else 4
    return MARKERS.index(marker), size * 3 + (1 if text.endswith("?") else 2 if text.endswith(":") else 0), at


class Hmm:
    """Logarithms of start, transition and both emissions. counts: ("start", s), ("step", s, t), ("marker", s, m), ("shape", s, x)."""

    def __init__(self, counts: dict[tuple, float]) -> None:
        n, self.counts = len(STATES), Counter(counts)

        def table(kind: str, width: int) -> np.ndarray:
            t = np.full((n, width), PRIOR)
            for key, c in counts.items():
                if key[0] == kind:
                    t[key[1], key[2]] += c
            return np.log(t / t.sum(axis=1, keepdims=True))

        start = np.full(n, PRIOR)
        for key, c in counts.items():
            if key[0] == "start":
                start[key[1]] += c
        begins = np.array([b for _, b in STATES])
        start[~begins] = 1e-12
        self.start = np.log(start / start.sum())
        step = table("step", n)
        for s, (role, _) in enumerate(STATES):
            for t, (other, opens) in enumerate(STATES):
                if not opens and other != role:
                    step[s, t] = -np.inf
        self.step = step
        self.marker, self.shape = table("marker", len(MARKERS)), table("shape", len(SHAPES))

    def __add__(self, other: Hmm) -> Hmm:
        return Hmm(self.counts + other.counts)

    def viterbi(self, seen: list[tuple[int, int]]) -> list[int]:
        """The most likely states; of equals the first in order."""
        if not seen:
            return []
        emit = np.array([self.marker[:, m] + self.shape[:, x] for m, x in seen])
        score, back = self.start + emit[0], np.zeros((len(seen), len(STATES)), dtype=np.int8)
        for i in range(1, len(seen)):
            ways = score[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            score = ways.max(axis=0) + emit[i]
        path = [int(score.argmax())]
        for i in range(len(seen) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return path[::-1]


def rendered_turn(style: int, role: str, text: str) -> str:
    return STYLES[style % len(STYLES)].get(role, "{}").format(text) if "{" not in text else STYLES[style % len(STYLES)].get(role, "{}").replace("{}", text)


def labelled_lines(style: int, turns: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """Lines of a transcript and the state of each, for turns of (role, text)."""
    lines, states = [], []
    for role, text in turns:
        part = rendered_turn(style, role, text).split("\n")
        lines += part
        states += [STATES.index((role, True))] + [STATES.index((role, False))] * (len(part) - 1)
    return lines, states


def parse(model: Hmm, transcript: str) -> list[tuple[str, str]]:
    """Turns (role, text); turns without any text are left out."""
    lines = transcript.split("\n")
    seen = [observe(line) for line in lines]
    turns: list[tuple[str, list[str]]] = []
    for line, (marker, _, at), s in zip(lines, seen, model.viterbi([(m, x) for m, x, _ in seen])):
        role, begins = STATES[s]
        if begins or not turns:
            turns.append((role, [line[at:] if marker else line]))
        else:
            turns[-1][1].append(line)
    return [(r, t) for r, part in turns if (t := "\n".join(part).strip())]


def canonical(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, style, turns: turns in order of their number, roles in lower case.

    Turns with a null conversation, number or text, or a role other than ROLES, are left out; repeated rows
    count once.  The style hangs on the id alone.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower("role").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("role").isin(*ROLES)).dropna().distinct()
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).withColumn("style", F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int"))


def _fold(conv_id):
    """Which of the two models a conversation is read by; the other half trains it."""
    return F.pmod(F.xxhash64(conv_id, F.lit("fold")), F.lit(2)).cast("int")


def fit_folds(labelled: DataFrame) -> list[Hmm]:
    """Two models from the rows of transcripts(): model k has the counts of all conversations that aren't of fold k."""
    tune(labelled.sparkSession)

    def stage(batches):
        counts: Counter = Counter()
        for batch in batches:
            for style, turns, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines, states = labelled_lines(style, [(t["role"], t["text"]) for t in turns])
                counts["start", states[0], 0, fold] += 1
                for line, s in zip(lines, states):
                    m, x, _ = observe(line)
                    counts["marker", s, m, fold] += 1
                    counts["shape", s, x, fold] += 1
                for s, t in zip(states, states[1:]):
                    counts["step", s, t, fold] += 1
        if counts:
            kind, a, b, fold = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(fold, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["kind", "a", "b", "fold", "n"])

    # At most 2 x states x (states + markers + shapes + 1) rows come back.
    found = labelled.select("style", "turns", _fold("conv_id")).mapInArrow(stage, "kind string, a int, b int, fold int, n long").groupBy("kind", "a", "b", "fold").agg(F.sum("n").alias("n"))
    rows = found.collect()
    return [Hmm({(r.kind, r.a, r.b): r.n for r in rows if r.fold != k}) for k in (0, 1)]


def fit(labelled: DataFrame) -> Hmm:
    """The model from the rows of transcripts(): counts over all of them."""
    one, other = fit_folds(labelled)
    return one + other


def written_out(labelled: DataFrame) -> DataFrame:
    """conv_id, transcript: what transcripts() has, without roles but for the style's markers."""

    def stage(batches):
        for batch in batches:
            out = ["\n".join(labelled_lines(s, [(t["role"], t["text"]) for t in turns])[0]) for s, turns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["conv_id", "transcript"])

    return labelled.select("conv_id", "style", "turns").mapInArrow(stage, "conv_id long, transcript string")


def parsed(raw: DataFrame, model: Hmm | list[Hmm]) -> DataFrame:
    """One row a transcript: conv_id, n_turns, roles, texts, rendered (canonical).

    Of the two models of fit_folds each transcript is read by the one that hasn't seen its conversation.  A null
    or empty transcript has no turn and renders as an empty text; repeated rows stay repeated; of likely roles
    that are equal the first in order counts; other columns are not read.
    """
    tune(raw.sparkSession)
    models = model if isinstance(model, list) else [model, model]
    sent = send(raw.sparkSession, models, len(pickle.dumps(models)))

    def stage(batches):
        for batch in batches:
            of = once(sent)
            found = [parse(of[k], t) if t else [] for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in found], pa.int32()), pa.array([[r for r, _ in t] for t in found], pa.list_(pa.string())), pa.array([[x for _, x in t] for t in found], pa.list_(pa.string())), pa.array([canonical(t) for t in found], pa.string())],
                names=["conv_id", "n_turns", "roles", "texts", "rendered"],
            )

    rows = raw.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("transcript").cast("string").alias("transcript")).withColumn("fold", _fold("conv_id"))
    return rows.mapInArrow(stage, "conv_id long, n_turns int, roles array<string>, texts array<string>, rendered string")


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written out in several styles and parsed again, each by a model that hasn't seen it."""
    labelled = written(transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "transcripts")
    return parsed(written_out(labelled), fit_folds(labelled))


QUERIES = {"op7_transcripts": op7_transcripts}
