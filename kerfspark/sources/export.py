"""Results as documents: graphs, labels, review sheets, pictures; each a table of texts that Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graph_json(nodes: DataFrame, edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """(graph, text): one node-link document a graph. ``nodes`` and ``edges`` hold the graph's id and any columns."""
    rest = lambda d: F.struct(*[c for c in d.columns if c != graph])
    n = nodes.groupBy(graph).agg(F.array_sort(F.collect_list(rest(nodes))).alias("nodes"))
    e = edges.groupBy(graph).agg(F.array_sort(F.collect_list(rest(edges))).alias("links"))
    met = n.join(e.withColumnRenamed(graph, "_graph"), F.col(graph).eqNullSafe(F.col("_graph")), "full")
    listed = lambda d, c: F.coalesce(c, F.array().cast(d.schema[c].dataType)).alias(c)
    return met.select(F.coalesce(graph, "_graph").alias(graph), listed(n, "nodes"), listed(e, "links")).select(graph, F.to_json(F.struct(graph, "nodes", "links")).alias("text"))


def labels_json(annotations: DataFrame, parts: DataFrame) -> DataFrame:
    """(panel_id, text): labels, counts by class and part of each panel."""
    by = annotations.groupBy("panel_id", "feature_class").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("seq", "confidence"))).alias("f"))
    one = by.groupBy("panel_id").agg(F.array_sort(F.collect_list(F.struct("feature_class", F.col("f").alias("features")))).alias("features"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_class", "n")))).alias("feature_counts"))
    met = parts.select("panel_id", F.col("part_type").alias("part")).join(one, "panel_id", "left")
    return met.select("panel_id", F.to_json(F.struct("panel_id", "part", "features", "feature_counts")).alias("text"))


def review_lines(labels: DataFrame) -> DataFrame:
    """(value): the labels that need a review as JSON lines, sorted; write with ``.coalesce(1).write.text``."""
    return labels.where("status = 'needs_review'").select(F.to_json(F.struct(F.struct("label_id", "value", "confidence").alias("label"), F.lit(None).cast("string").alias("decision"))).alias("value")).orderBy("value")


def review_sheet(labels: DataFrame) -> DataFrame:
    """Rows of a reviewer's table: row_id, what the label says in plain words, how sure in per cent, and empty answers."""
    plain = F.lower(F.regexp_replace("value", "_", " "))
    empty = F.lit("")
    others = F.array_join(F.transform(F.slice(F.filter(F.split("alternatives", ","), lambda x: x != ""), 1, 3), lambda x: F.lower(F.regexp_replace(x, "_", " "))), ", ") if "alternatives" in labels.columns else empty
    return labels.where("status = 'needs_review'").select(F.col("label_id").alias("row_id"), plain.alias("thought_to_be"), F.round(F.col("confidence") * 100, 0).cast("int").alias("sure_percent"), others.alias("other_guesses"), empty.alias("is_it_right"), empty.alias("if_not_what"), empty.alias("notes")).orderBy("row_id")


def glossary(classes: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(code, plain words, category) of the classes of a vocabulary, by code: a table of a few dozen rows."""
    return sorted((c, c.replace("_", " ").lower(), k) for k, of in classes.items() for c in of)


def markdown(results: DataFrame) -> str:
    """A table of benchmark results (a row a task: its main metric) as Markdown text."""
    rows = results.where("is_primary").orderBy("task_id").collect()
    lines = ["| task | metric | value | units | passed |", "|-|-|-|-|-|"]
    return "\n".join(lines + [f"| {r['task_id']} | {r['metric']} | {r['value']:.4f} | {r['units']} | {'yes' if r['passed'] else 'no'} |" for r in rows])


def safe_name(name: Column) -> Column:
    """A name that every file system takes."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def panel_svg(panel: dict[str, Column], circles: Column, size: int = 240) -> Column:
    """A picture of a panel (xmin, ymin, xmax, ymax) with its holes (array of structs x, y, r), y upwards."""
    s = lambda c: F.round(c, 3).cast("string")
    w, h = panel["xmax"] - panel["xmin"], panel["ymax"] - panel["ymin"]
    body = F.array_join(F.transform(circles, lambda c: F.concat(F.lit('<circle cx="'), s(c["x"] - panel["xmin"]), F.lit('" cy="'), s(panel["ymax"] - c["y"]), F.lit('" r="'), s(c["r"]), F.lit('" fill="none" stroke="black"/>'))), "")
    head = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" viewBox="0 0 '), s(w), F.lit(" "), s(h), F.lit('"><rect width="'), s(w), F.lit('" height="'), s(h), F.lit('" fill="none" stroke="black"/>'))
    return F.concat(head, body, F.lit("</svg>"))
