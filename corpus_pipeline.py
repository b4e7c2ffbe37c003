"""From documents to tokens: toxic documents, near duplicates, test items and secrets go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the docs of the next one.  All but the last return the columns of docs, whatever these are and are called.  An
empty table stays empty throughout; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, decontamination, secrets, superminhash, toxicity
from codeloom.llm.shared import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic by their nearest labelled examples go.

    Null and empty texts are judged as labelled examples without a term are, so they stay where there are none such
    or these are clean; rows with a null or repeated id are judged one by one; of examples at one distance the
    least ids vote.  Labels with a null don't count; without toxic and clean labels nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, of texts that share an id the one of the least key.

    Of rows that repeat an id and its text one stays.  Rows with a null id and texts without a word, null ones too, all stay.
    """
    return superminhash.without_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; a document of which no word is left goes.

    Null, empty and clean texts stay as they are; repeated rows are cut alike; an empty benchmark cuts nothing.
    """
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their rule; all rows stay, repeated ones and those with nulls too.

    Of overlapping secrets that of the first rule counts, then the first and longest.
    """
    return secrets.redacted(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source, as far as docs has them, with the tokens of the text, and whether they decode to it.

    A null text has null tokens, an empty one none; repeated rows stay repeated.
    """
    return bpe.encode(docs, tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode_tokens),
]

#: No stage can be put into SQL; tests/llm holds each one against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
