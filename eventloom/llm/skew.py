"""Joins on a key that may hold a large share of all rows, and ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.graph import stored

#: A key with more than one in so many rows is hot; there are fewer than that of them.
HOT_SHARE = 1000
_PLACE_BITS = 33  # of monotonically_increasing_id: the place inside a task


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` joined with ``keyed``, whose ``key`` is unique and whose ``copies`` says how many
    of the rows carry it (never null).  ``keyed`` should be a stored table.

    Hot keys, under HOT_SHARE of them whatever the size of the table, are sent to all tasks, so
    their rows stay where they are; all others meet in a shuffle that no key can unbalance.
    """
    total = keyed.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    is_hot = F.col(copies) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(keyed.where(is_hot).drop(copies))
    met = rows.join(hot, key)
    rest = rows.join(F.broadcast(keyed.where(is_hot).select(key)), key, "left_anti")
    return met.unionByName(rest.join(keyed.where(~is_hot).drop(copies), key))


def ranked(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Adds ``place``, 1, 2, 3... in the given order, which should leave no ties.

    Rows are cut into sorted ranges, written down; a place is the position inside the range
    plus the sizes of the ranges before it, of which there is one small row each.
    """
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stored(cut.withColumn("__at", F.monotonically_increasing_id()), label)
    cut = cut.select("*", F.shiftright("__at", _PLACE_BITS).alias("__range"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("__size")).select(
        "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return cut.join(F.broadcast(sizes), "__range").withColumn(
        "place", F.col("__before") + inside + 1).drop("__at", "__range", "__before")
