"""Datasets of panels: each sample's labels, graph, verdict and provenance as documents, statistics, and checks of what was written.

A sample's documents are rows (sample_id, split, name, text), not files: millions of tiny files are what ``packing`` undoes.
``write`` stores them by split as lines of JSON. Everything follows from the inputs; nothing of it depends on the clock,
so the same input gives the same documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.operators.benchmark import operations_of
from kerfspark.operators.classify import CATEGORIES

# The documents' version, the fields labels must have, what a panel's block says where a drawing doesn't.
VERSION = "v0.1.0"
REQUIRED = ["sample_id", "schema_version", "is_valid", "panel", "features", "feature_counts", "split"]
THICKNESS_MM, MATERIAL = 18.0, "MDF"
FEATURE_KINDS_HARD, FEATURES_HARD, KINDS_EASY, FEATURES_EASY = 5, 15, 3, 5


def complexity(kinds: Column, features: Column, milled: Column, drilled: Column) -> Column:
    hard = (kinds > FEATURE_KINDS_HARD) | (features > FEATURES_HARD) | (milled & drilled)
    easy = (kinds <= KINDS_EASY) & (features <= FEATURES_EASY) & ~milled
    return F.when(hard, "complex").when(easy, "simple").otherwise("medium")


def sample_name(panel: Column) -> Column:
    return F.concat(F.lit("sample_"), panel.cast("string"))


def labels(shapes: DataFrame, annotations: DataFrame, report: DataFrame) -> DataFrame:
    """A row a panel: sample_id, split, is_valid, panel, features, feature_counts, operations, complexity."""
    c = F.col
    known = annotations.join(shapes.where("not is_boundary").select("panel_id", "node", "x", "y", "radius", "depth"), ["panel_id", "node"])
    feature = F.struct(c("node").alias("feature_id"), "feature_class", F.round(2 * c("radius"), 6).alias("diameter_mm"), c("depth").alias("depth_mm"), F.array(F.round("x", 6), F.round("y", 6)).alias("position_mm"), "confidence")
    milled, drilled = c("feature_class").isin(CATEGORIES["MILLED_FEATURES"] + ["INTERNAL_CUTOUT"]), c("feature_class").isin(CATEGORIES["HOLE_FEATURES"])
    counts = known.groupBy("panel_id", "feature_class").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(feature)).alias("_f"), F.max(milled).alias("_m"), F.max(drilled).alias("_d"))
    by = counts.groupBy("panel_id").agg(F.sort_array(F.flatten(F.collect_list("_f"))).alias("features"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature_class", "n")))).alias("feature_counts"), F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"), F.max("_m").alias("_m"), F.max("_d").alias("_d"))
    box = shapes.where("xmin is not null").groupBy("panel_id").agg(*[F.first(b).alias(b) for b in ("xmin", "ymin", "xmax", "ymax")])
    panel = F.struct((c("xmax") - c("xmin")).alias("width_mm"), (c("ymax") - c("ymin")).alias("height_mm"), F.lit(THICKNESS_MM).alias("thickness_mm"), F.lit(MATERIAL).alias("material"))
    met = report.select("panel_id", c("overall_valid").alias("is_valid")).join(box, "panel_id", "left").join(by, "panel_id", "left")
    none = {"features": "array<struct<feature_id:string,feature_class:string,diameter_mm:double,depth_mm:double,position_mm:array<double>,confidence:double>>", "feature_counts": "map<string,bigint>"}
    filled = met.withColumns({"features": F.coalesce("features", F.array().cast(none["features"])), "feature_counts": F.coalesce("feature_counts", F.create_map().cast(none["feature_counts"])), **{k: F.coalesce(k, F.lit(0)) for k in ("_k", "_n")}, **{k: F.coalesce(k, F.lit(False)) for k in ("_m", "_d")}})
    named = filled.withColumn("sample_id", sample_name(c("panel_id")))
    n = F.pmod(F.coalesce(F.regexp_extract("sample_id", r"(\d+)\D*$", 1).try_cast("bigint"), F.xxhash64("sample_id")), F.lit(100))
    return named.select("panel_id", "sample_id", F.lit(VERSION).alias("schema_version"), "is_valid", panel.alias("panel"), "features", "feature_counts", operations_of(F.map_keys("feature_counts")).alias("operations"), complexity(c("_k"), c("_n"), c("_m"), c("_d")).alias("complexity"), F.when(n < 70, "train").when(n < 85, "val").otherwise("test").alias("split"))


def provenance(table: DataFrame) -> DataFrame:
    """(sample_id, text): the stages a sample went through, with the mean confidence of its features."""
    stage = lambda name, how, sure: F.struct(F.lit(name).alias("stage"), F.lit(how).alias("inference_method"), sure.cast("double").alias("confidence"))
    mean = F.when(F.size("features") > 0, F.round(F.aggregate("features", F.lit(0.0), lambda s, f: s + f["confidence"]) / F.size("features"), 4)).otherwise(1.0)
    stages = F.array(*[stage(n, "deterministic", F.lit(1.0)) for n in ("parser", "graph_builder", "validation")], stage("semantic", "heuristic", mean))
    return table.select("sample_id", F.to_json(F.struct("sample_id", "schema_version", stages.alias("pipeline_stages"))).alias("text"))


def verdicts(report: DataFrame, results: DataFrame) -> DataFrame:
    """(sample_id, text): a panel's verdict with all its findings, sorted; nothing in it depends on when it was made."""
    each = results.where("severity <> 'PASS'").groupBy("panel_id").agg(F.sort_array(F.collect_list(F.struct("rule_id", "node", "severity", F.round("measured", 6).alias("measured")))).alias("findings"))
    met = report.join(each, "panel_id", "left").withColumn("sample_id", sample_name(F.col("panel_id")))
    return met.select("sample_id", F.to_json(F.struct("sample_id", "layer1_passed", "layer2_passed", "overall_valid", "has_warnings", F.struct("n_error", "n_warning", "n_info").alias("severity_summary"), "findings")).alias("text"))


def documents(table: DataFrame, report: DataFrame, results: DataFrame) -> DataFrame:
    """(sample_id, split, name, text) of every sample's documents."""
    own = table.select("sample_id", "split")
    body = table.select("sample_id", F.to_json(F.struct(*[c for c in table.columns if c != "panel_id"])).alias("text"))
    parts = {"labels.json": body, "validation.json": verdicts(report, results), "provenance.json": provenance(table)}
    named = [d.withColumn("name", F.lit(n)) for n, d in parts.items()]
    return reduce(DataFrame.unionByName, named).join(own, "sample_id").select("sample_id", "split", "name", "text")


def statistics(table: DataFrame) -> DataFrame:
    """(what, value, n): samples by split, verdict and complexity, and features by class."""
    count = lambda what, by: by.groupBy(F.col("value").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "value", "n")
    parts = [count(c, table.select(F.col(c).alias("value"))) for c in ("split", "is_valid", "complexity")]
    classes = table.select(F.explode("feature_counts").alias("value", "k")).groupBy("value").agg(F.sum("k").alias("n")).select(F.lit("feature_class").alias("what"), "value", "n")
    return reduce(DataFrame.unionByName, [*parts, classes])


def metadata(table: DataFrame, seed: int | None = None) -> DataFrame:
    """One row: the dataset's description with its statistics as a JSON text."""
    s = statistics(table).groupBy("what").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("m"))
    packed = s.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("what", F.to_json("m").alias("j"))))).alias("statistics"))
    return packed.select(F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(seed).cast("bigint").alias("seed"), "statistics")).alias("text"))


def write(table: DataFrame, folder: str) -> None:
    """Documents as lines of JSON, a folder a split and document."""
    table.write.mode("errorifexists").partitionBy("split", "name").json(folder)


def schema_problems(texts: DataFrame) -> DataFrame:
    """(sample_id, problem) of labels (sample_id, text): what isn't JSON, lacks a field, or names another sample."""
    parsed = texts.withColumn("_v", F.try_parse_json("text"))
    broken = parsed.where("_v is null").select("sample_id", F.lit("no complete JSON").alias("problem"))
    present = F.json_object_keys("text")
    lacking = parsed.where("_v is not null").select("sample_id", F.explode(F.array_except(F.lit(REQUIRED), F.coalesce(present, F.array().cast("array<string>")))).alias("_k")).select("sample_id", F.concat(F.lit("lacks "), "_k").alias("problem"))
    other = texts.where(F.get_json_object("text", "$.sample_id") != F.col("sample_id")).select("sample_id", F.lit("names another sample").alias("problem"))
    return broken.unionByName(lacking).unionByName(other)


def consistency_problems(table: DataFrame, splits: DataFrame) -> DataFrame:
    """(sample_id, problem) between samples and split lists (sample_id, split): samples in no list, in several, or listed but not there, or under another split."""
    listed = splits.groupBy("sample_id").agg(F.sort_array(F.collect_set("split")).alias("_s"))
    met = table.select("sample_id", F.col("split").alias("_own")).join(listed, "sample_id", "full")
    tests = [(F.col("_s").isNull(), "in no split"), (F.size("_s") > 1, "in several splits"), (F.col("_own").isNull(), "listed but not there"), (F.col("_own").isNotNull() & F.col("_s").isNotNull() & ~F.array_contains("_s", F.col("_own")), "under another split")]
    problems = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in tests]))
    return met.select("sample_id", F.explode(problems).alias("problem"))
