"""Bounds on batches, and checks on what is sent to every executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..tables import discard, shared_dir, written

__all__ = ["discard", "fresh", "once", "send", "shared_dir", "tune", "written"]

#: Bytes of a model that may be broadcast; operators split their work beyond it or refuse.
BROADCAST_BYTES = 64 << 20
#: Python stages get at most so many rows and bytes at once, so that very long texts fit.
BATCH_ROWS, BATCH_BYTES = "2000", str(32 << 20)


def tune(spark: SparkSession) -> None:
    """Bounds on Arrow batches where the session has none of its own."""
    for key, value, usual in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, None),
    ):
        if usual is None or spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)


def fresh(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def send(spark: SparkSession, value, size: int):
    """A broadcast of value, whose size in bytes is checked."""
    if size > BROADCAST_BYTES:
        raise ValueError(f"a model of {size} bytes is over the broadcast bound of {BROADCAST_BYTES}")
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


_loaded: dict[str, object] = {}


def once(broadcast, make=lambda x: x):
    """make(what was sent), kept for the life of a Python worker."""
    token, value = broadcast.value
    if token not in _loaded:
        if len(_loaded) > 4:
            _loaded.clear()
        _loaded[token] = make(value)
    return _loaded[token]
