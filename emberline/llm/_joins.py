"""A join whose frequent keys are nobody's single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000


def met(rows: DataFrame, table: DataFrame, by: list[str], count: str, limit: int | None = None) -> DataFrame:
    """rows left joined with table, which has one row for each key, and in count the number of that key's rows.

    The keys with the most rows are broadcast: those with a limit-th of all rows or more, so at most limit keys.
    table should be written, since it is read three times.
    """
    many = max(2, -(-(table.agg(F.sum(count)).first()[0] or 0) // (limit or BROADCAST_ROWS)))
    heavy, light = F.broadcast(table.where(F.col(count) >= many)), table.where(F.col(count) < many)
    return rows.join(heavy, by).unionByName(rows.join(heavy, by, "left_anti").join(light, by, "left"))
