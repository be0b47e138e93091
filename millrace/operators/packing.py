"""Batches of tasks under bounds of count and bytes, with no two tasks of a group in one batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.gates import GateError

MOST, MAX_BYTES = 10, 175_000


def pack_batches(tasks: DataFrame, key: str, group: str, size: str, most: int = MOST, max_bytes: int = MAX_BYTES, shards: int = 64, oversized: str = "raise") -> DataFrame:
    """``tasks`` with a ``batch``: at most ``most`` tasks and ``max_bytes`` bytes.

    A task that is larger alone is an error, or with ``oversized="alone"`` a batch of its own. A group's n-th task belongs to round n, so a batch, which never leaves its round, holds a group once. Rounds are
    dealt to shards by hash and filled in order of keys: only the fill of one shard carries state.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key))
    rows = tasks.select(F.col(key).cast("string").alias("key"), turn.alias("round"), F.col(size).cast("long").alias("size"))
    rows = rows.withColumn("shard", (F.conv(F.substring(F.sha2("key", 256), 1, 7), 16, 10).cast("int") % shards).cast("int"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        if oversized == "raise" and max((n or 0 for n in table.column("size").to_pylist()), default=0) > max_bytes:
            raise GateError(f"a task exceeds {max_bytes} bytes")
        names, batch, count, held = [], 0, 0, 0
        where = f"{table.column('round')[0].as_py()}-{table.column('shard')[0].as_py()}"
        for n in table.column("size").to_pylist():
            if count and (count == most or held + (n or 0) > max_bytes):
                batch, count, held = batch + 1, 0, 0
            names.append(f"{where}-{batch}")
            count, held = count + 1, held + (n or 0)
        return pa.table({"key": table.column("key"), "batch": names})

    packed = rows.groupBy("round", "shard").applyInArrow(fill, "key string, batch string")
    return tasks.join(packed, F.col(key).cast("string") == packed["key"]).drop("key")
