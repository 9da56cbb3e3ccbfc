"""Percentiles per group by radix selection, exact or with a stated error, and combinable from parts.

A double is mapped to a signed integer of the same order. Each pass counts, a group, the values by their next 16 bits
below the prefixes that hold a wanted rank, and keeps the one digit each rank falls in; after four passes the digits
are the value. Only counts by digit are ever shuffled: at most 65,536 a group and pass. With fewer passes the result is
a digit's lower end, of which the value is at most 2^-(16 * passes - 12) off, relative to itself.

``histogram`` keeps the first ``bits`` bits, by group and by any other columns (a day, a file): such tables add up, and
``from_histogram`` gives percentiles of any sum of them with relative error 2^-(bits - 12).

The q-percentile is the smallest value with at least q of the group's values at or below it. Null and NaN are left out,
and values <= 0 where ``positive`` is set; infinities count. A group without values gives no row; null group keys form
a group. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from kerfspark.runtime import cut

DIGIT_BITS = 16


@F.pandas_udf(LongType())
def order_key(v: pd.Series) -> pd.Series:
    """Integers ordered as the doubles are; -0.0 is 0.0."""
    bits = (v.to_numpy(dtype="float64") + 0.0).view("int64")
    return pd.Series(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(dtype="int64")
    return pd.Series((bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"))


def keyed(rows: DataFrame, groups: Sequence[str], value: Column, positive: bool) -> DataFrame:
    v = value.cast("double")
    kept = rows.select(*groups, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_v") > 0 if positive else F.lit(True)))
    return kept.select(*groups, order_key("_v").alias("_key"))


def wanted(n: Column, q: Column) -> Column:
    return F.greatest(F.ceil(F.round(q * n, 9)), F.lit(1)).cast("bigint")


def descend(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (_g, q, _prefix, _rank), the digit that holds the rank, and the rank within it."""
    up = Window.partitionBy("_g", "_prefix").orderBy("_digit")
    steps = counts.withColumn("_to", F.sum("_n").over(up))
    met = steps.join(targets, ["_g", "_prefix"]).where((F.col("_rank") <= F.col("_to")) & (F.col("_rank") > F.col("_to") - F.col("_n")))
    return met.select("_g", "q", F.col("_digit").alias("_prefix"), (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"))


def percentiles(rows: DataFrame, groups: Sequence[str], value: Column, qs: Sequence[float] = (0.5, 0.9, 0.99), positive: bool = False, passes: int = 4) -> DataFrame:
    """(groups, q, n, value, relative_error) of each group and q."""
    data = cut(keyed(rows, groups, value, positive).withColumn("_g", F.to_json(F.struct(*groups))))
    ask = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    top = DIGIT_BITS * (64 // DIGIT_BITS - 1)
    counts = data.groupBy("_g", F.lit(0).cast("bigint").alias("_prefix"), F.shiftright("_key", top).alias("_digit")).agg(F.count(F.lit(1)).alias("_n"), *[F.first(g).alias(g) for g in groups])
    counts = cut(counts)
    sizes = counts.groupBy("_g").agg(F.sum("_n").alias("n"), *[F.first(g).alias(g) for g in groups])
    targets = descend(counts.drop(*groups), sizes.select("_g", "n", ask.alias("q")).select("_g", "q", F.lit(0).cast("bigint").alias("_prefix"), wanted(F.col("n"), F.col("q")).alias("_rank")))
    for i in range(1, passes):
        targets = cut(targets)
        shift = top - DIGIT_BITS * i
        live = data.withColumn("_prefix", F.shiftright("_key", shift + DIGIT_BITS)).join(targets.select("_g", "_prefix").distinct(), ["_g", "_prefix"], "left_semi")
        targets = descend(live.groupBy("_g", "_prefix", F.shiftright("_key", shift).alias("_digit")).agg(F.count(F.lit(1)).alias("_n")), targets)
    low = F.shiftleft("_prefix", 64 - DIGIT_BITS * passes)
    error = 0.0 if passes == 4 else 2.0 ** -(DIGIT_BITS * passes - 12)
    return targets.join(sizes, "_g").select(*groups, "q", "n", key_value(low).alias("value"), F.lit(error).alias("relative_error"))


def histogram(rows: DataFrame, groups: Sequence[str], parts: Sequence[str], value: Column, positive: bool = False, bits: int = 26) -> DataFrame:
    """(groups, parts, digit, n): counts that add up over parts."""
    return keyed(rows, [*groups, *parts], value, positive).groupBy(*groups, *parts, F.shiftright("_key", 64 - bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def from_histogram(parts: DataFrame, groups: Sequence[str], qs: Sequence[float] = (0.5, 0.9, 0.99), bits: int = 26) -> DataFrame:
    """Percentiles of the sum of histograms; the result's value is a digit's lower end."""
    merged = parts.groupBy(*groups, "digit").agg(F.sum("n").alias("_n"))
    summed = merged.withColumn("_to", F.sum("_n").over(Window.partitionBy(*groups).orderBy("digit"))).withColumn("n", F.sum("_n").over(Window.partitionBy(*groups)))
    met = summed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_rank", wanted(F.col("n"), F.col("q")))
    met = met.where((F.col("_rank") <= F.col("_to")) & (F.col("_rank") > F.col("_to") - F.col("_n")))
    return met.select(*groups, "q", "n", key_value(F.shiftleft("digit", 64 - bits)).alias("value"), F.lit(2.0 ** -(bits - 12)).alias("relative_error"))
