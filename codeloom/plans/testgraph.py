"""The successor graph of parts: each line of an order leads to the next line's part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import upgraded_edges

SQL_CANDIDATES = """
lines AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) AS dst,
  CASE WHEN l_returnflag = 'A' THEN 'Import' ELSE 'SymbolUsage' END AS kind, l_shipdate FROM lineitem),
cand AS (SELECT * FROM lines WHERE dst IS NOT NULL AND src <> dst)"""
SQL = f"""WITH {SQL_CANDIDATES},
edges AS (SELECT src, dst, min(kind) AS kind, CASE WHEN min(kind) = 'Import' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS strength FROM cand GROUP BY src, dst),
nodes AS (SELECT p_partkey AS path FROM part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    kind = F.when(F.col("l_returnflag") == "A", "Import").otherwise("SymbolUsage")
    out = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(by).alias("dst"), kind.alias("kind"), "l_shipdate")
    return out.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upgraded_edges(candidates(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
