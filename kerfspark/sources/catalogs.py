"""Small catalogues and settings, read on the driver: vocabularies, layer profiles, calibrations, labels of other datasets, versions of datasets.

All of these are tables of at most some thousand rows, one row a term, rule or step. Files that are missing or can't be
read give empty tables; unknown fields are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfspark.functions.layers import LAYER_PREFIXES

ONTOLOGY = {
    "features": "feature_id string, name string, category string, operation string",
    "operations": "operation_id string, name string",
    "rules": "rule_id string, layer int, severity string, applies_to array<string>",
}


def _yaml(path: Path):
    import yaml

    try:
        return yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError):
        return {}


def _listed(found, key: str) -> list[dict]:
    rows = found.get(key, found) if isinstance(found, dict) else found
    rows = list(rows.values()) if isinstance(rows, dict) else rows
    return [r for r in rows or [] if isinstance(r, dict)]


def read_ontology(spark: SparkSession, folder: str, rules_folder: str | None = None) -> dict[str, DataFrame]:
    """Tables of features, operations and rules from a folder's YAML files (``features.yaml``, ``operations.yaml``, and the rules' own)."""
    root = Path(folder)
    features = [(str(r.get("feature_id", r.get("id"))), r.get("name"), r.get("category"), r.get("operation") or next(iter(r.get("operations") or []), None)) for r in _listed(_yaml(root / "features.yaml"), "features") if r.get("feature_id", r.get("id"))]
    operations = [(str(r.get("operation_id", r.get("id"))), r.get("name")) for r in _listed(_yaml(root / "operations.yaml"), "operations") if r.get("operation_id", r.get("id"))]
    rules = []
    for f in sorted(Path(rules_folder or folder).glob("*.yaml")):
        for r in _listed(_yaml(f), "rules"):
            if r.get("rule_id"):
                rules.append((str(r["rule_id"]), r.get("layer"), r.get("severity"), [str(x) for x in r.get("applies_to") or []]))
    return {n: spark.createDataFrame(rows, ONTOLOGY[n]) for n, rows in (("features", features), ("operations", operations), ("rules", rules))}


def rule_references(ontology: dict[str, DataFrame]) -> DataFrame:
    """(rule_id, feature_id) of the features that rules name: words in capitals with underscores."""
    each = ontology["rules"].select("rule_id", F.explode("applies_to").alias("feature_id"))
    return each.where(F.col("feature_id").rlike("^[A-Z]+(_[A-Z]+)+$")).distinct()


def ontology_problems(ontology: dict[str, DataFrame]) -> DataFrame:
    """(problem, subject, names): rules that name features, and features that name operations, that aren't in the vocabulary."""
    f, o = ontology["features"], ontology["operations"]
    unknown = rule_references(ontology).join(f.select("feature_id"), "feature_id", "left_anti").select(F.lit("rule names no feature").alias("problem"), F.col("rule_id").alias("subject"), F.col("feature_id").alias("names"))
    lost = f.where("operation is not null").join(o.select(F.col("operation_id").alias("operation")), "operation", "left_anti").select(F.lit("feature names no operation").alias("problem"), F.col("feature_id").alias("subject"), F.col("operation").alias("names"))
    return unknown.unionByName(lost)


def ontology_summary(ontology: dict[str, DataFrame]) -> DataFrame:
    """(what, value, n): features by category, rules by layer and severity, operations."""
    count = lambda d, what, c: d.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "value", "n")
    parts = [count(ontology["features"], "category", "category"), count(ontology["rules"], "layer", "layer"), count(ontology["rules"], "severity", "severity")]
    whole = ontology["operations"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("operations").alias("what"), F.lit(None).cast("string").alias("value"), "n")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(whole)


def layer_profile(name_or_path: str | None = None) -> dict[str, list[str]]:
    """Prefixes by layer type, in capitals: the built-in ones (``cabinet`` or no name), or a YAML file's ``prefixes``; KeyError for anything else.

    A type that isn't one of the built-in ones is a ValueError.
    """
    if name_or_path in (None, "cabinet"):
        return LAYER_PREFIXES
    path = Path(name_or_path)
    if path.suffix.lower() not in (".yaml", ".yml") or not path.exists():
        raise KeyError(f"{name_or_path} is no built-in profile and no YAML file")
    found = _yaml(path)
    prefixes = found.get("prefixes") or found.get("layer_conventions") or {}
    if wrong := set(prefixes) - {*LAYER_PREFIXES, "unknown"}:
        raise ValueError(f"no layer types: {sorted(wrong)}")
    return {kind: [str(p).upper() for p in of] for kind, of in prefixes.items()}


def save_calibration(steps: DataFrame, path: str) -> None:
    """The steps of a fit as one JSON file."""
    points = [[round(r["x_from"], 6), round(r["y"], 6)] for r in steps.orderBy("x_from").collect()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"kind": "isotonic", "fitted": bool(points), "breakpoints": points}, indent=2), encoding="utf-8")


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(x_from, y) of a saved fit; none where it wasn't fitted."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    points = [(float(x), float(y)) for x, y in found.get("breakpoints", [])] if found.get("fitted") else []
    return spark.createDataFrame(points, "x_from double, y double")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON file: a list of them, an object with a list under ``models``, or one a line."""
    whole = spark.read.text(path, wholetext=True).withColumn("value", F.trim("value"))
    kind = f"struct<{_fields(schema)}>"
    many = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{kind}>")).otherwise(F.from_json("value", f"struct<models:array<{kind}>>")["models"])
    listed = whole.select(F.explode(many).alias("r")).where("r is not null").select("r.*")
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", kind).alias("r")).where("r is not null").select("r.*")
    return lines.dropna("all") if listed.isEmpty() else listed


def _fields(schema: str) -> str:
    out, depth, cut_at = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            name, kind = schema[cut_at:i].strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            cut_at = i + 1
    return ",".join(out)


def mapped_labels(records: DataFrame, elements: str, names: dict[str, str]) -> DataFrame:
    """(sample_id, element_id, label, feature_class) of every element of other datasets' records; feature_class is null where their label has no counterpart.

    An element is a struct with ``id`` and ``label``; without an id it is named by its place.
    """
    each = records.select(F.col("id").cast("string").alias("sample_id"), F.posexplode(elements).alias("_i", "_e")).where("_e is not null")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    return each.select("sample_id", F.coalesce(F.col("_e.id").cast("string"), F.col("_i").cast("string")).alias("element_id"), F.col("_e.label").alias("label"), F.element_at(table, F.lower(F.trim("_e.label"))).alias("feature_class"))


def label_manifest(labels: DataFrame) -> DataFrame:
    """One row: samples, elements, mapped elements, their share to 4 places, the classes seen and the labels without counterpart, sorted."""
    n = F.count(F.lit(1))
    mapped = F.count("feature_class")
    lost = F.when(F.col("feature_class").isNull() & (F.trim("label") != ""), F.col("label"))
    return labels.agg(F.countDistinct("sample_id").alias("samples"), n.alias("elements"), mapped.alias("mapped"), F.coalesce(F.round(mapped / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("coverage"), F.sort_array(F.collect_set("feature_class")).alias("classes"), F.sort_array(F.collect_set(lost)).alias("unmapped"))


def migration_path(steps: list[tuple[str, str]], start: str, end: str) -> list[tuple[str, str]]:
    """The shortest way of known steps from one version of a dataset to another; ValueError without one."""
    came: dict[str, tuple[str, str] | None] = {start: None}
    queue = deque([start])
    while queue:
        at = queue.popleft()
        for step in steps:
            if step[0] == at and step[1] not in came:
                came[step[1]] = step
                queue.append(step[1])
    if end not in came:
        raise ValueError(f"no way from {start} to {end}")
    out: list[tuple[str, str]] = []
    while came[end] is not None:
        out.append(came[end])
        end = came[end][0]
    return out[::-1]


def migrate(documents: DataFrame, changes: dict[tuple[str, str], "callable"], target: str) -> DataFrame:
    """Documents (schema_version and any columns) brought to a version: each change is a plan over the rows of its version; rows of versions without a way are an error of ``migration_path``."""
    versions = [r[0] for r in documents.select("schema_version").distinct().collect()]  # a row a version
    out = None
    for v in versions:
        rows = documents.where(F.col("schema_version") == v)
        for step in migration_path(list(changes), v, target):
            rows = changes[step](rows).withColumn("schema_version", F.lit(step[1]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return documents if out is None else out


def plain_name(value: Column) -> Column:
    """A class in plain words."""
    return F.lower(F.regexp_replace(value, "_", " "))


def class_of_plain(text: Column, classes: list[str]) -> Column:
    """The class that words mean: its code, its plain name, or one that holds or is held by them, in the order of the list; else the words themselves."""
    said = F.lower(F.trim(text))
    out = text
    for c in reversed(classes):
        plain = c.lower().replace("_", " ")
        out = F.when((F.length(said) > 0) & (said.contains(plain) | F.lit(plain).contains(said)), c).otherwise(out)
    for c in reversed(classes):
        out = F.when(F.upper(F.trim(text)).isin(c) | (said == c.lower().replace("_", " ")), c).otherwise(out)
    return out
