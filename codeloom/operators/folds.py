"""Folds over the sorted rows of each group, for what a running sum can't say."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def folded(rows: DataFrame, group: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows that step(state, row) -> (state, row or None) gives, group by group in order, from state start().

    Rows stream by: a group costs its state, whatever its size. Columns of rows come in the order group, order, rest.
    """
    rest = [c for c in rows.columns if c not in (*group, *order)]
    lined = rows.select(*group, *order, *rest).repartition(*group).sortWithinPartitions(*group, *order)
    arrow, n = to_arrow_schema(T._parse_datatype_string(schema)), len(group)

    def stage(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[:n] != last:
                    last, state = row[:n], start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return lined.mapInArrow(stage, schema)
