"""A plain model of labelled vectors: nearest centroid, trained and applied as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean of each place of the label's vectors."""
    each = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "v"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


#: Centroids that may go along with every row, by numbers held; more meet the rows block by block.
MOST_NUMBERS, BLOCK = 1_000_000, 1024


def predict(rows: DataFrame, ident: str, vector: str, means: DataFrame) -> DataFrame:
    """(ident, predicted, distance): the label of the nearest centroid, the smaller of two.

    Few centroids are packed into one row that every task gets; where labels or vectors make more than MOST_NUMBERS, each row meets them
    in blocks of BLOCK labels, a join, and keeps the best of its blocks. Rows without vector have nulls.
    """
    gap = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_m", lambda m: F.struct(gap(m["centroid"]).alias("d"), m["label"].alias("label"))))
    size = means.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0)).alias("numbers"), F.count(F.lit(1)).alias("labels")).first()
    pack = F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("_m")
    if size["numbers"] <= MOST_NUMBERS:
        return rows.join(F.broadcast(means.agg(pack))).select(ident, best["label"].alias("predicted"), F.sqrt(best["d"]).alias("distance"))
    n = -(-size["labels"] // BLOCK)
    blocks = means.groupBy(F.pmod(F.xxhash64("label"), F.lit(n)).cast("int").alias("_b")).agg(pack)
    each = rows.select(ident, vector, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_b")).join(blocks, "_b").select(ident, best.alias("_r"))
    won = each.groupBy(ident).agg(F.min("_r").alias("_r"))
    return won.select(ident, F.col("_r.label").alias("predicted"), F.sqrt("_r.d").alias("distance"))
