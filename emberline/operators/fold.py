"""Ordered folds: sequential recurrences over each key's rows.

Rows are hash-partitioned by key and sorted; a pass over the sorted rows keeps
one state for the key at hand. A key of any length needs no memory beyond its
state, and partitions are recomputed from their inputs when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK = 4096


def ordered_fold(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], start: Callable[[], Callable[[tuple], Iterator[tuple]]], schema: str) -> DataFrame:
    """For each key in turn, step = start(); each row (keys, then columns) in order goes to step(row), which yields output rows.

    Empty input gives no rows; null keys are one key.
    """
    spark_schema = T.DataType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spark_schema)
        key, step, out, n = object(), None, [], len(keys)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    key, step = row[:n], start()
                out.extend(step(row))
                if len(out) >= CHUNK:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, spark_schema)
