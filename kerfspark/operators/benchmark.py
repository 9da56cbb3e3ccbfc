"""Benchmark tasks: predictions against truth, a row a metric, with what each task has to reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.operators import metrics
from kerfspark.runtime import cut

# Label spaces of the tasks, operations of feature classes, what has to be reached.
FEATURE_CLASSES = ["THROUGH_HOLE", "BLIND_HOLE", "SHELF_PIN_HOLE", "HINGE_CUP_HOLE", "CONFIRMAT_HOLE", "DOWEL_HOLE", "POCKET", "GROOVE", "DADO", "RABBET", "OPEN_SLOT", "PROFILE_CUT", "INTERNAL_CUTOUT", "UNKNOWN_FEATURE"]
OPERATIONS = {
    "DRILLING": ["THROUGH_HOLE", "BLIND_HOLE", "SHELF_PIN_HOLE", "HINGE_CUP_HOLE", "CONFIRMAT_HOLE", "DOWEL_HOLE"],
    "CNC_ROUTING": ["GROOVE", "POCKET", "RABBET", "DADO", "OPEN_SLOT"],
    "PROFILE_CUTTING": ["PROFILE_CUT", "INTERNAL_CUTOUT"],
}
OPERATION_LABELS = [*OPERATIONS, "NESTING"]
REACH = {"BENCH-001": ("macro_f1", 0.80), "BENCH-002": ("binary_f1", 0.85), "BENCH-003": ("macro_f1", 0.85), "BENCH-004": ("auroc", 0.80)}
MOST_MISSED = 0.10
SAME_PLACE_MM, SAME_SIZE_MM = 0.001, 0.5


def operations_of(classes: Column) -> Column:
    """The sorted operations that a set of feature classes needs; nesting too where there is any feature."""
    named = [F.when(F.arrays_overlap(classes, F.lit(of)), F.lit(name)) for name, of in OPERATIONS.items()]
    return F.array_sort(F.array_compact(F.array(*named, F.when(F.size(classes) > 0, F.lit("NESTING")))))


def validity(errors: Column) -> Column:
    """How sure a panel is taken for a good one, from its number of errors."""
    return 1 / (1 + errors)


def anomaly(errors: Column, warnings: Column, unknown: Column) -> Column:
    raw = errors + 0.25 * warnings + 0.5 * unknown
    return raw / (1 + raw)


def joined_truth(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """(panel_id, node, truth, is_valid) of each node: of the features at its place the nearest of its size, each feature once.

    ``nodes`` needs panel_id, node, x, y, diameter and is_boundary, ``features`` panel_id, seq, feature_class, x, y,
    diameter and is_valid. A feature at the place of several nodes goes to the first of them. A boundary is a profile cut;
    nodes and features that are left over pair in their order; what is left of the nodes is unknown.
    """
    cell = lambda c: F.floor(F.col(c) / (2 * SAME_PLACE_MM)).cast("bigint")
    inner = nodes.where("not is_boundary")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = inner.select("panel_id", "node", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("diameter").alias("nd"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    right = features.withColumn("_s", around).select("panel_id", "seq", "feature_class", "is_valid", F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("diameter").alias("fd"), (cell("x") + F.col("_s.i")).alias("_cx"), (cell("y") + F.col("_s.j")).alias("_cy"))
    gap = F.sqrt((F.col("nx") - F.col("fx")) * (F.col("nx") - F.col("fx")) + (F.col("ny") - F.col("fy")) * (F.col("ny") - F.col("fy")))
    sized = F.coalesce(F.abs(F.col("nd") - F.col("fd")) <= SAME_SIZE_MM, F.lit(True))
    met = left.join(right, ["panel_id", "_cx", "_cy"]).where((gap <= SAME_PLACE_MM) & sized).withColumn("_gap", gap)
    best = met.groupBy("panel_id", "node").agg(F.min_by(F.struct("seq", "feature_class", "is_valid"), F.struct("_gap", "seq")).alias("_f"))
    own = cut(best.groupBy("panel_id", F.col("_f.seq").alias("seq")).agg(F.min("node").alias("node"), F.first("_f").alias("_f")))
    placed = own.select("panel_id", "node", F.col("_f.feature_class").alias("truth"), F.col("_f.is_valid").alias("is_valid"))
    profile = features.where("feature_class = 'PROFILE_CUT'").join(own.select("panel_id", "seq"), ["panel_id", "seq"], "left_anti").groupBy("panel_id").agg(F.min_by(F.struct("seq", "is_valid"), "seq").alias("_p"))
    edges = nodes.where("is_boundary").join(profile, "panel_id", "left").select("panel_id", "node", F.lit("PROFILE_CUT").alias("truth"), F.coalesce("_p.is_valid", F.lit(True)).alias("is_valid"))
    used = own.select("panel_id", "seq").unionByName(profile.select("panel_id", "_p.seq"))
    rest = lambda d, k, name: d.groupBy("panel_id").agg(F.posexplode(F.sort_array(F.collect_list(k))).alias("_i", name))
    loose = inner.select("panel_id", "node").join(own.select("panel_id", "node"), ["panel_id", "node"], "left_anti")
    spare = features.join(used, ["panel_id", "seq"], "left_anti")
    ordered = rest(loose, F.col("node"), "node").join(rest(spare, F.struct("seq", "feature_class", "is_valid"), "_f"), ["panel_id", "_i"], "left")
    filled = ordered.select("panel_id", "node", F.coalesce("_f.feature_class", F.lit("UNKNOWN_FEATURE")).alias("truth"), F.coalesce("_f.is_valid", F.lit(True)).alias("is_valid"))
    return placed.unionByName(edges).unionByName(filled)


def _long(task: str, row: DataFrame, units: Column) -> DataFrame:
    """A row a metric of one row of metrics."""
    main, least = REACH[task]
    passed = F.col(main) >= least
    if task == "BENCH-002":
        passed = passed & (F.col("fnr") <= MOST_MISSED)
    names = [c for c in row.columns if c != "_units"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(n == main).alias("is_primary")) for n in names]))
    return row.select(F.lit(task).alias("task_id"), units.alias("units"), passed.alias("passed"), each.alias("_m")).select("task_id", "units", "passed", "_m.*")


def node_task(nodes: DataFrame) -> DataFrame:
    """Feature classes of nodes: columns truth and guess."""
    m = cut(metrics.confusion(nodes, "truth", "guess"))
    scored = metrics.per_class(m.where(F.col("truth").isin(FEATURE_CLASSES) & F.col("guess").isin(FEATURE_CLASSES)))
    macro = scored.agg((F.sum("f1") / len(FEATURE_CLASSES)).alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_present"))
    inside = F.col("truth").isin(FEATURE_CLASSES) & F.col("guess").isin(FEATURE_CLASSES)
    hit = F.col("truth") == F.col("guess")
    rest = m.agg((F.sum(F.when(inside & hit, F.col("n")).otherwise(0)) / F.sum(F.when(inside, F.col("n")).otherwise(0))).alias("micro_f1"), (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("_units"))
    return _long("BENCH-001", macro.join(F.broadcast(rest)), F.col("_units"))


def validity_task(panels: DataFrame) -> DataFrame:
    """Whether panels are valid: columns truth and guess (flags), confidence of a valid one, and the nodes named at fault, ``truth_nodes`` and ``guess_nodes``."""
    flags = panels.withColumns({"_bad": ~F.col("truth"), "_said_bad": ~F.col("guess")})
    good, bad = metrics.binary_rates(flags, "truth", "guess"), metrics.binary_rates(flags, "_bad", "_said_bad")
    where = metrics.iou(panels.where("not truth"), "truth_nodes", "guess_nodes")
    one = good.select(F.col("f1").alias("binary_f1"), "accuracy").join(F.broadcast(bad.select("fpr", "fnr"))).join(F.broadcast(metrics.roc_auc(panels, "truth", "confidence").withColumnRenamed("auc", "auroc"))).join(F.broadcast(where.select(F.coalesce("mean_iou", F.lit(1.0)).alias("violation_localization_iou")))).join(F.broadcast(panels.agg(F.count(F.lit(1)).alias("_units"))))
    return _long("BENCH-002", one, F.col("_units"))


def operation_task(panels: DataFrame) -> DataFrame:
    """Operations of panels: columns truth and guess (sets)."""
    each = metrics.multilabel(panels, "truth", "guess", OPERATION_LABELS)
    one = each.agg(F.avg("f1").alias("macro_f1"), F.coalesce(2 * F.sum("hit") / F.nullif(F.sum("support") + F.sum("said"), F.lit(0)), F.lit(0.0)).alias("micro_f1"))
    whole = one.join(F.broadcast(metrics.set_agreement(panels, "truth", "guess", len(OPERATION_LABELS)))).join(F.broadcast(panels.agg(F.count(F.lit(1)).alias("_units"))))
    return _long("BENCH-003", whole, F.col("_units"))


def anomaly_task(panels: DataFrame) -> DataFrame:
    """Scores of panels: columns truth (whether it is an anomaly) and score."""
    best = metrics.best_threshold(panels, "truth", "score").select(F.col("f1").alias("f1_optimal"), F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.0).alias("f1_optimal_threshold"))
    counts = panels.agg(F.sum(F.col("truth").cast("bigint")).alias("n_anomalous"), F.sum((~F.col("truth")).cast("bigint")).alias("n_normal"), F.count(F.lit(1)).alias("_units"))
    return _long("BENCH-004", metrics.roc_auc(panels, "truth", "score").withColumnRenamed("auc", "auroc").join(F.broadcast(best)).join(F.broadcast(counts)), F.col("_units"))


def run(nodes: DataFrame, validity_rows: DataFrame, operation_rows: DataFrame, anomaly_rows: DataFrame) -> DataFrame:
    """All tasks: (task_id, units, passed, metric, value, is_primary)."""
    return reduce(DataFrame.unionByName, [node_task(nodes), validity_task(validity_rows), operation_task(operation_rows), anomaly_task(anomaly_rows)])
