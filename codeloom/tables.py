"""Tables that cut lineage, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on a single machine, as in tests, a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "folder" not in _own:
            _own["folder"] = tempfile.mkdtemp(prefix="codeloom-")
        folder = _own["folder"]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its plan is a scan, whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from written() that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if f.rsplit("/", 2)[-2].startswith("codeloom-")}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A side is broadcast only where its plan's size estimate is within this bound.
BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame) -> bool:
    """Whether df is within the bound by Catalyst's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if Catalyst's estimate of its size allows; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df) else df
