"""Readers of the other inputs: graph documents, diagrams in GraphML, split lists, label lists, reviews, settings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graph documents, one a file, as rows for the nested-record operators: (delivery_id, graph_id, received_at, payload)."""
    files = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    name = F.regexp_extract("_path", r"([^/]+)\.\w+$", 1)
    known = F.coalesce(F.get_json_object("value", "$.graph_id"), F.get_json_object("value", "$.mgg.graph_id"), name)
    return files.select(F.xxhash64("_path").alias("delivery_id"), known.alias("graph_id"), F.lit(None).cast("timestamp").alias("received_at"), F.col("value").alias("payload"))


def first_attribute(attributes: Column, names: list[str]) -> Column:
    """The first of several attributes of a map that isn't empty."""
    return F.coalesce(*[F.nullif(F.trim(attributes[n]), F.lit("")) for n in names])


GRAPHML_DATA = "data array<struct<_key:string,_VALUE:string>>"


def read_graphml(spark: SparkSession, path: str, tag: list[str] = ("tag", "label", "name"), symbol: list[str] = ("symbol_class", "class", "type"), relation: list[str] = ("relationship", "relation")) -> tuple[DataFrame, DataFrame]:
    """(components, connections) of GraphML files, their attributes found under any of several names."""
    read = lambda row, ids: spark.read.format("xml").option("rowTag", row).schema(f"{ids}, {GRAPHML_DATA}").load(path).withColumn("_a", F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"]))))
    nodes, edges = read("node", "_id string"), read("edge", "_source string, _target string")
    a = F.col("_a")
    components = nodes.select(F.col("_id").alias("component_id"), first_attribute(a, list(tag)).alias("tag"), first_attribute(a, list(symbol)).alias("symbol_class"))
    connections = edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(first_attribute(a, list(relation)), F.lit("CONNECTED_TO")).alias("relationship"))
    return components, connections


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, split) of ``train``, ``val`` and ``test`` .jsonl files whose lines are a JSON string, an object or bare text; the first split of an id wins."""
    lines = spark.read.text([f"{folder.rstrip('/')}/{s}.jsonl" for s in ("train", "val", "test")]).withColumn("split", F.regexp_extract(F.input_file_name(), r"(train|val|test)\.jsonl$", 1))
    v = F.trim("value")
    ident = F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.sample_id"), F.get_json_object(v, "$.id"))).when(v.startswith('"'), F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]")).otherwise(v)
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return lines.select(ident.alias("sample_id"), "split", rank.alias("_r")).where("sample_id <> ''").groupBy("sample_id").agg(F.min_by("split", "_r").alias("split"))


def read_label_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a given shape; malformed lines go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


REVIEW = "set_id string, source_file string, label struct<label_id:string,value:string,confidence:double>, decision string, corrected_value string, note string"


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, decision, corrected_value) of edited review lines; of several of one label the last in the file wins."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    parsed = lines.select("_at", F.from_json("value", REVIEW).alias("r")).where("r.label.label_id is not null and trim(coalesce(r.decision, '')) <> ''")
    return parsed.groupBy(F.col("r.label.label_id").alias("label_id")).agg(F.max_by(F.struct(F.lower(F.trim("r.decision")).alias("decision"), "r.corrected_value"), "_at").alias("_d")).select("label_id", "_d.*")


def sheet_decision(right: Column, instead: Column) -> Column:
    """A reviewer's yes or no, and what they wrote instead, as a decision; null where they wrote nothing."""
    said = F.lower(F.trim(right))
    return F.when(said.isin("yes", "y", "true", "1", "ja", "ok"), "confirm").when(said.isin("no", "n", "false", "0", "nein"), F.when(F.trim(F.coalesce(instead, F.lit(""))) != "", "correct").otherwise("reject"))


def apply_reviews(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labels with the reviewers' decisions: confirmed, corrected (with the new value) or rejected; a correction without value changes nothing."""
    d = decisions.select("label_id", "decision", "corrected_value")
    met = labels.join(d, "label_id", "left")
    fixed = (F.col("decision") == "correct") & (F.trim(F.coalesce("corrected_value", F.lit(""))) != "")
    status = F.when(F.col("decision") == "confirm", "confirmed").when(fixed, "corrected").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status"))
    return met.select(*[c for c in labels.columns if c not in ("status", "value")], F.when(fixed, F.col("corrected_value")).otherwise(F.col("value")).alias("value"), status.alias("status"), F.coalesce(status.isin("confirmed", "corrected"), F.lit(False)).alias("is_gold"))


def rule_settings(spark: SparkSession, folder: str) -> DataFrame:
    """(rule_id, enabled, params) of the YAML files of a folder, small settings read by the driver; a missing folder gives none."""
    import yaml

    rows = []
    for f in sorted(Path(folder).glob("*.yaml")) if Path(folder).is_dir() else []:
        try:
            found = yaml.safe_load(f.read_text()) or {}
        except yaml.YAMLError:
            continue
        for r in found.get("rules", []) if isinstance(found, dict) else []:
            if isinstance(r, dict) and r.get("rule_id", r.get("id")):
                params = {k: float(v) for k, v in (r.get("parameters") or r.get("params") or {}).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
                rows.append((str(r.get("rule_id", r.get("id"))), bool(r.get("enabled", True)), params))
    return spark.createDataFrame(rows, "rule_id string, enabled boolean, params map<string,double>")
