"""Changes of files as a stream: filter, debounce, state, application to the graph; also as batch relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import folded
from ..sources import repository
from ..tables import written

EVENTS = "ts timestamp, path string, event_type string, from_path string, content string"
IGNORED = ("__pycache__", ".git", "node_modules", ".venv", "venv", "target", "dist", "build")
EXTENSIONS = ("py", "pyi")


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Events from JSON files that appear in a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def relevant(events: DataFrame, ignored: tuple[str, ...] = IGNORED, names: tuple[str, ...] = (), extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Events outside of ignored folders and names, with an extension that counts; dotfiles and backups go."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return events.filter(~F.arrays_overlap(parts, F.array(*(F.lit(i) for i in ignored)))).filter(extension.isin(*extensions) & ~name.startswith(".") & ~name.endswith("~") & ~name.isin(*names))


def debounced_sessions(events: DataFrame, gap: str = "100 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """One row a burst: path, first, last, n. Works on streams, whose state the watermark bounds."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


def _accept(times: list[float], last: float | None, gap: float) -> tuple[list[bool], float | None]:
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        out.append(ok)
        if ok:
            last = t
    return out, last


def debounced_leading(events: DataFrame, gap: float = 0.5, watermark: str = "10 seconds") -> DataFrame:
    """Stream: the first event of a path, then the first one gap seconds or more after the last accepted one.

    A path's state goes when the watermark is gap behind its last accepted event: any later event is accepted anyway.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        keep, last = _accept([t.timestamp() for t in frame["ts"]], last, gap)
        yield frame[keep][["ts", "path", "event_type"]]
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + gap) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    rows = events.filter("ts is not null").select("ts", "path", "event_type").withWatermark("ts", watermark)
    return rows.groupBy("path").applyInPandasWithState(step, "ts timestamp, path string, event_type string", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def debounced_leading_batch(events: DataFrame, key: str, ts: str, gap_us: int, rest: tuple[str, ...] = ()) -> DataFrame:
    """The same over a finished table: rows stream by in the order of each key's times, with the last accepted one as state."""
    kinds = dict(events.dtypes)
    rows = events.filter(F.col(ts).isNotNull()).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), *rest)

    def step(last: list, row: tuple) -> tuple[list, tuple | None]:
        if last and row[1] - last[0] < gap_us:
            return last, None
        return [row[1]], row

    return folded(rows, [key], ["micros", *rest], list, step, ", ".join([f"`{key}` {kinds[key]}", "micros long", *(f"`{r}` {kinds[r]}" for r in rest)]))


def classified(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Batch: what each event means by what was known before: a create of a known path is a modification, a
    modification of an unknown one a creation, a delete of an unknown one nothing. events: path, ts, seq, event_type."""
    by = Window.partitionBy("path").orderBy("ts", "seq")
    before = F.lag(F.when(F.col("event_type") == "deleted", False).otherwise(True)).over(by)
    if known is not None:
        events = events.join(known.select("path").distinct().withColumn("was_known", F.lit(True)), "path", "left")
    else:
        events = events.withColumn("was_known", F.lit(False))
    exists = F.coalesce(before, F.col("was_known"), F.lit(False))
    meaning = F.when(F.col("event_type") == "deleted", F.when(exists, "deleted").otherwise("ignored")).when(exists, "modified").otherwise("created")
    return events.withColumn("meaning", meaning).drop("was_known")


def classified_stream(events: DataFrame, known: DataFrame | None = None, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Stream: classified() with whether a path exists as its state.

    known (path) has the paths from before the stream: the initial snapshot.  A path's state goes when nothing
    happened to it for idle_ms; what it was then is looked up in known again.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        exists, meanings = state.get[0] if state.exists else bool(frame["was_known"].any()), []
        for kind in frame["event_type"]:
            gone = kind == "deleted"
            meanings.append(("deleted" if exists else "ignored") if gone else "modified" if exists else "created")
            exists = not gone
        yield frame.assign(meaning=meanings)[["ts", "path", "meaning", "content"]]
        state.update((exists,))
        state.setTimeoutDuration(idle_ms)

    split = events.filter("event_type <> 'renamed'").select("ts", "path", "event_type", "content")
    # A rename is a delete of the old path and a create of the new one.
    moved = events.filter("event_type = 'renamed'").select("ts", F.explode(F.array(F.struct(F.col("from_path").alias("path"), F.lit("deleted").alias("event_type")), F.struct(F.col("path"), F.lit("created").alias("event_type")))).alias("e"), "content")
    rows = split.unionByName(moved.select("ts", F.col("e.path").alias("path"), F.col("e.event_type").alias("event_type"), "content"))
    if known is not None:
        rows = rows.join(known.select("path").distinct().withColumn("was_known", F.lit(True)), "path", "left")
    else:
        rows = rows.withColumn("was_known", F.lit(False))
    rows = rows.select("ts", "path", "event_type", "content", F.coalesce("was_known", F.lit(False)).alias("was_known"))
    return rows.groupBy("path").applyInPandasWithState(step, "ts timestamp, path string, meaning string, content string", "known boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def snapshot_events(before: DataFrame, now: DataFrame, at: str) -> DataFrame:
    """EVENTS between two readings of a folder (path, content): what was created, modified and deleted, at one time.

    An empty reading before gives the initial snapshot.
    """
    old, new = before.select("path", F.md5("content").alias("old")), now.select("path", "content")
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("is", F.lit(True)), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(~F.md5("content").eqNullSafe(F.col("old")), "modified")
    return both.withColumn("event_type", kind).filter("event_type is not null").select(F.lit(at).cast("timestamp").alias("ts"), "path", "event_type", F.lit(None).cast("string").alias("from_path"), "content")


def poll(spark: SparkSession, root: str, folder: str, before: DataFrame, at: str) -> DataFrame:
    """Reads a repository again, puts its changes into a folder that watch() follows, and returns the reading."""
    now = written(repository.read_repository(spark, root), "reading")
    snapshot_events(before, now, at).write.mode("append").json(folder)
    return now


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Starts the stream; each batch brings (changed files, deleted paths) of the last event of every path."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.filter("meaning <> 'ignored'").groupBy("path").agg(F.max_by(F.struct("meaning", "content"), "ts").alias("e"))
        changed = last.filter("e.meaning <> 'deleted' and e.content is not null").select("path", F.col("e.content").alias("content"))
        apply(changed, last.filter("e.meaning = 'deleted'").select("path"), epoch)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)


def stats(events: DataFrame, name: str = "watcher") -> DataFrame:
    """events with counters that a query listener sees under name."""
    return events.observe(name, F.count(F.lit(1)).alias("received"), F.count_if(F.col("path").isNull()).alias("errors"))
