"""Places of rows in a global order, without a task that sees all rows of the table or of a group.

Rows are dealt to tasks by ranges of the order and sorted there, and the table is written as it then is. A group that is
too large for a range lies in several; how many of its rows stand in earlier ranges is a sum over one row for each range
and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.sources import shared

#: Bits of ``_at`` that number the rows of a range; those above number the range.
WITHIN = 33


def in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` as a written table with ``_at``, a number that ascends with ``by`` (nulls first; not without gaps).

    Rows that are alike in all of ``by`` stand in any order.
    """
    return shared.written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_at``, ``_place`` (0, 1, ... by ``order`` within the rows alike in ``group``) and ``_size`` (how many
    these are). Null is a group as any other; without ``group``, all rows are one."""
    table = in_order(rows, [*group, *order])
    keys = [F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]
    names = [f"_g{k}" for k in range(len(group))]
    pieces = table.groupBy(*keys, F.shiftright("_at", WITHIN).alias("_range")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    same = W.partitionBy(*(names or [F.lit(0)]))  # without groups, a row for each range
    before = F.sum("_rows").over(same.orderBy("_range")) - F.col("_rows") - F.col("_first")
    pieces = shared.written(pieces.select(*names, "_range", before.alias("_shift"), F.sum("_rows").over(same).alias("_size")))
    alike = F.shiftright("_at", WITHIN) == F.col("_range")
    for g, name in zip(group, names, strict=True):
        alike &= F.col(g).eqNullSafe(F.col(name))
    found = table.join(shared.sized(pieces), alike)
    return found.select(*rows.columns, "_at", (F.col("_at") + F.col("_shift")).alias("_place"), "_size")
