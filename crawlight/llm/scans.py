"""Running sums over ordered groups of any size.

Rows are dealt by range over group and order, so a group may lie in several
partitions, and every task sums what it has.  Partitions are numbered; what
their last groups have summed so far goes on to the next partition, which is
one state a partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one partition of a scan is laid out for.
TASK_ROWS = 1 << 20


def ranged(df: DataFrame, rows: int, *order: Column | str) -> DataFrame:
    """The rows dealt by range and sorted; ``rows`` is about how many there are."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def segments(new: np.ndarray) -> np.ndarray:
    """For each row the row at which its group starts, -1 where that was before the first row; ``new`` marks first rows."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))


def carried(table: DataFrame, group: str, state: list[str], plus: Callable) -> dict:
    """part -> (group, state before the part) of parts that begin within a group.

    ``table`` has ``part`` and ``at`` (the row's place in its part) and, in ``state``, the sums within the part up
    to and with the row.  One row a part is collected.
    """
    found = table.groupBy("part").agg(F.min_by(group, "at").alias("first"), F.max_by(group, "at").alias("last"), F.max_by(F.struct(*state), "at").alias("state")).collect()
    out, before = {}, None
    for r in sorted(found, key=lambda r: r["part"]):
        first, last, own = _plain(r["first"]), _plain(r["last"]), tuple(r["state"])
        if before is not None and before[0] == first:
            out[r["part"]] = before
            if first == last:
                own = plus(before[1], own)
        before = (last, own)
    return out


def _plain(x):
    return bytes(x) if isinstance(x, bytearray) else x
