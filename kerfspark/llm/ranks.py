"""Running totals within groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group. Only sums by group and part are ordered as a whole; rows only within a part.
PARTS = 16_384


def running_total(rows: DataFrame, group: str, unique: str, weight: Column, seed: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of the weights of the group's rows before each row, in an order shuffled by the seed.

    Rows with a null group form a group.
    """
    order = F.xxhash64(F.lit(seed), F.col(unique))
    dealt = rows.withColumns({"_order": order, "_part": F.pmod(F.shiftrightunsigned(order, 20), F.lit(PARTS)), "_weight": weight})
    sums = dealt.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_group", "_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    met = dealt.join(starts, dealt[group].eqNullSafe(starts["_group"]) & (dealt["_part"] == starts["_p"]))
    inside = Window.partitionBy(group, "_part").orderBy("_order", unique).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    return met.withColumn(name, total).select(*rows.columns, name)
