"""Ranks over a whole table, without bringing it into one task.

Rows are dealt into ranges of the order and sorted within; how many rows the ranges before a range
have is a table of as many rows as there are ranges, and a row's rank is that and its place in its
own range.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.sources.shared import shared_dir, write


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "rank", ranges: int | None = None) -> tuple[DataFrame, int]:
    """(``rows`` with their place from 1 in ``order``, number of rows).

    Rows that ``order`` leaves equal are numbered in any order among themselves: put a key last. They
    lie in one range, so an order with few values has few ranges.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    in_order = dealt.sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = write(in_order.withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), f"{shared_dir(spark)}/ranks-{uuid.uuid4().hex}")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()  # one row a range
    before, total = [], 0
    for r in sizes:
        before.append((r["_range"], total))
        total += r.n
    offsets = spark.createDataFrame(before, "_range long, _before long")
    found = placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1)
    return found.drop("_range", "_at", "_before"), total


def ntile(rows: DataFrame, order: Sequence[Column], tiles: int, name: str = "tile", ranges: int | None = None) -> DataFrame:
    """``rows`` with their tile from 1 to ``tiles``: sizes at most one apart, larger ones first."""
    found, total = numbered(rows, order, "_rank", ranges)
    each, more = divmod(total, tiles)
    at = F.col("_rank") - 1
    tile = F.when(at < more * (each + 1), F.floor(at / (each + 1))).otherwise(more + F.floor((at - more * (each + 1)) / max(each, 1)))
    return found.withColumn(name, (tile + 1).cast("int")).drop("_rank")
