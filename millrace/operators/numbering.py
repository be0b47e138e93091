"""Row numbers in a total order without a single sorting task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize


def number_rows(rows: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """``rows`` with their position from 0 in ``order``, which has to be unique.

    Rows are range-partitioned and sorted, written once, and numbered by the rows of the partitions before theirs: only
    the counts of partitions, a row each, meet in one task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_held"))
    before = counts.withColumn("_before", F.sum("_held").over(Window.orderBy("_part")) - F.col("_held")).drop("_held")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
