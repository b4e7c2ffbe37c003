import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture
def docs_of(spark):
    """Documents with columns whose names the operators use within; rows are (doc_id, text)."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, bucket int, __gone string")


@pytest.fixture
def tables(tmp_path):
    """Writes named tables, and gives their folder."""

    def write(**named):
        for name, (columns, schema) in named.items():
            pq.write_table(pa.table(columns, schema=schema), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write
