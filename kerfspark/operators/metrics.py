"""Agreement of predictions with labels, as grouped aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerfspark.runtime import cut


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where nothing is to divide by."""
    each = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("said")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("said")))).alias("e")).select("e.*")
    s = each.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("true").alias("support"), F.sum("said").alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    r = s.select("label", "support", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"))
    p, q = F.col("precision"), F.col("recall")
    return r.withColumn("f1", ratio(2 * p * q, p + q))


def summary(matrix: DataFrame) -> DataFrame:
    """macro_f1 of all labels, of those that occur, micro_f1 and accuracy."""
    c = per_class(matrix)
    macro = c.agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_present"))
    micro = matrix.agg((F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return macro.join(F.broadcast(micro)).select("macro_f1", "macro_f1_present", F.col("accuracy").alias("micro_f1"), "accuracy")


def binary_rates(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    n = lambda t, g: F.sum(((F.col(truth) == t) & (F.col(guess) == g)).cast("bigint"))
    r = rows.agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return r.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, tp + fn).alias("fnr"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def ordered(by: DataFrame, key: str, *amounts: str) -> DataFrame:
    """Adds, to rows unique in ``key``, each amount's sum over all smaller keys as ``<amount>_below``: rows are ordered by ranges of keys, a range a task, and only the ranges' sums as a whole."""
    ranged = cut(by.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(*[F.sum(a).alias(a) for a in amounts]).select("_range", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_{a}") for a in amounts])
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.join(F.broadcast(sums), "_range")  # a row a task
    return met.select(*by.columns, *[(F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"_{a}")).alias(f"{a}_below") for a in amounts])


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Rank-sum AUC with mean ranks of ties, from counts by score; 0.5 where one class is missing."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("bigint")).alias("p"), F.sum((~F.col(truth)).cast("bigint")).alias("n"))
    r = ordered(by, "s", "n").agg(F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)).alias("_u"), F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    return r.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n"))).otherwise(0.5).alias("auc"))


def best_threshold(rows: DataFrame, truth: str, score: str, steps: int = 100) -> DataFrame:
    """The first of the thresholds 0, 1/steps, ... 1 with the best F1. Scores are counted by the highest threshold they reach."""
    reached = F.least(F.greatest(F.floor(F.round(F.col(score) * steps, 6)), F.lit(-1)), F.lit(steps))
    by = rows.groupBy(reached.alias("k")).agg(F.sum(F.col(truth).cast("bigint")).alias("p"), F.sum((~F.col(truth)).cast("bigint")).alias("n"))
    all_p = F.broadcast(by.agg(F.sum("p").alias("_all")))
    grid = rows.sparkSession.range(steps + 1).withColumnRenamed("id", "t")
    met = grid.join(F.broadcast(by), F.col("k") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp")).join(all_p)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("_all"))).otherwise(0.0)
    return met.agg(F.max_by(F.struct((F.col("t") / steps).alias("threshold"), f1.alias("f1")), F.struct(f1.alias("f"), (-F.col("t")).alias("m"))).alias("_b")).select("_b.*")


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of confidence: count, mean confidence, share correct."""
    c = F.least(F.greatest(F.col(confidence), F.lit(0.0)), F.lit(1.0))
    return rows.groupBy(F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def isotonic(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """(x_from, x_to, n, y): the steps of the pooled-adjacent-violators fit over all confidences, clamped to [0, 1].

    Counts by confidence are pooled within ranges of it, a range a task; what is left of each range, its rising steps, is
    pooled again in one task. Pooling parts first changes nothing, as steps that fall within a part fall in the whole.
    """
    c = F.least(F.greatest(F.col(confidence), F.lit(0.0)), F.lit(1.0))
    by = rows.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).groupBy(c.alias("x_from")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("bigint")).alias("k"))
    shape = "x_from double, x_to double, n bigint, k bigint"

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps: list[list] = []
        for batch in batches:
            for lo, hi, n, k in zip(batch["x_from"].tolist(), batch["x_to"].tolist(), batch["n"].tolist(), batch["k"].tolist()):
                steps.append([lo, hi, n, k])
                while len(steps) > 1 and steps[-2][3] * steps[-1][2] >= steps[-1][3] * steps[-2][2]:
                    _, hi, n, k = steps.pop()
                    steps[-1] = [steps[-1][0], hi, steps[-1][2] + n, steps[-1][3] + k]
        yield pd.DataFrame(steps, columns=["x_from", "x_to", "n", "k"])

    ranged = by.select("x_from", F.col("x_from").alias("x_to"), "n", "k").repartitionByRange("x_from").sortWithinPartitions("x_from").mapInPandas(pool, shape)
    whole = ranged.repartition(1).sortWithinPartitions("x_from").mapInPandas(pool, shape)
    return whole.select("x_from", "x_to", "n", (F.col("k") / F.col("n")).alias("y"))


#: Steps of a fit that may go along with every row.
MOST_STEPS = 65_536


def calibrated(rows: DataFrame, steps: DataFrame, confidence: str) -> DataFrame:
    """Adds ``calibrated``: the value of the last step that begins at or below the confidence, of the first one below all, to 6 places; the confidence itself without a fit.

    A fit of more than MOST_STEPS steps is refused: it is no calibration but a copy of its data.
    """
    packed = steps.agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("x_from", "y"))).alias("_s"))
    packed = packed.select(F.when(F.col("_n") > MOST_STEPS, F.raise_error(F.lit("too many steps"))).otherwise(F.col("_s")).alias("_s"))
    c = F.least(F.greatest(F.col(confidence), F.lit(0.0)), F.lit(1.0))
    reached = F.filter("_s", lambda x: x["x_from"] <= c)
    value = F.coalesce(F.get(reached, F.size(reached) - 1)["y"], F.get("_s", F.lit(0))["y"])
    return rows.join(F.broadcast(packed)).withColumn("calibrated", F.when(F.size("_s") == 0, F.col(confidence)).otherwise(F.bround(value, 6))).drop("_s")


def multilabel(rows: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(label, support, precision, recall, f1) of each label of two columns of sets, labels that never occur included."""
    n = lambda cond: F.sum(cond.cast("bigint"))
    has = lambda c, label: F.array_contains(F.col(c), label)
    sums = rows.agg(*[n(cond).alias(f"_{i}{name}") for i, label in enumerate(labels) for name, cond in (("hit", has(truth, label) & has(guess, label)), ("true", has(truth, label)), ("said", has(guess, label)))])
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), *[F.coalesce(f"_{i}{name}", F.lit(0)).alias(name) for name in ("hit", "true", "said")]) for i, label in enumerate(labels)])).alias("_e")).select("_e.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return each.select("label", F.col("true").alias("support"), ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("true")).alias("recall"), ratio(2 * F.col("hit"), F.col("true") + F.col("said")).alias("f1"), "hit", "said")


def set_agreement(rows: DataFrame, truth: str, guess: str, slots: int) -> DataFrame:
    """Hamming loss over the slots, and share of equal sets, of two array columns."""
    off = F.size(F.array_except(truth, guess)) + F.size(F.array_except(guess, truth))
    return rows.agg((F.sum(off) / (F.count(F.lit(1)) * slots)).alias("hamming_loss"), F.avg((off == 0).cast("double")).alias("subset_accuracy"))


def iou(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    union = F.size(F.array_union(truth, guess))
    return rows.agg(F.avg(F.when(union > 0, F.size(F.array_intersect(truth, guess)) / union).otherwise(1.0)).alias("mean_iou"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    by = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(by.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k")))
    return by.join(whole).select("label", "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))
