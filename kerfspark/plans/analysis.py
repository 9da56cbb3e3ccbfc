"""A whole analysis of drawing files: parse, find panels, check all rules, tell features, one row a drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfspark.functions import geometry as g
from kerfspark.functions.layers import thickness_from_layer
from kerfspark.operators import classify, rules
from kerfspark.runtime import cut, lookup
from kerfspark.sources import dxf


def shapes(entities: DataFrame) -> DataFrame:
    """Entities of ``dxf.entities`` as shapes with their panel: the file's boundary, or, where no ring can be one, the box of all shapes."""
    c = F.col
    v, n, box = c("vertices"), c("numbers"), c("box")
    round_ = n.isNotNull()
    steps = F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.struct(F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1])).alias("l"), ((a[0] + b[0]) / 2).alias("x"), ((a[1] + b[1]) / 2).alias("y")))
    along = lambda k: F.aggregate(steps, F.lit(0.0), lambda s, e: s + e["l"] * e[k]) / F.nullif(F.aggregate(steps, F.lit(0.0), lambda s, e: s + e["l"]), F.lit(0.0))
    inside = F.when(c("is_closed") & (F.size(v) >= 3), g.area_centroid(v))
    centre = lambda i, k: F.when(round_, n[i]).otherwise(F.coalesce(inside[k], along(k), F.get(F.get(v, F.lit(0)), F.lit(i))))
    radius = F.when(round_, n[2])
    own = entities.select(
        c("source_file").alias("panel_id"), F.concat(F.lit("g"), c("seq").cast("string")).alias("node"), "seq", F.lower("entity_type").alias("geometry_type"), "layer", c("layer_type").alias("kind"), "vertices", centre(0, "x").alias("x"), centre(1, "y").alias("y"),
        radius.alias("radius"), "is_closed", "is_approximated", c("area_mm2").alias("area"), c("perimeter_mm").alias("perimeter"), *[box[a].alias(b) for a, b in zip(rules.BOX, ("bx0", "by0", "bx1", "by1"))], c("depth_mm").alias("depth"))
    edges = dxf.boundaries(entities)
    ring = entities.where("size(vertices) >= 3").select(c("source_file").alias("_file"), c("seq").alias("_ring"), c("vertices").alias("_v"), c("area_mm2").alias("_a"))
    held = edges.join(ring, (c("source_file") == c("_file")) & (c("seq") == c("_ring")), "left")
    boxed = c("_a") > (1 - 1e-6) * (c("xmax") - c("xmin")) * (c("ymax") - c("ymin"))
    index = held.select(c("source_file").alias("panel_id"), c("seq").alias("_edge"), *rules.BOX, F.when(~boxed, c("_v")).alias("outline"))
    met = lookup(own, index, "panel_id", "node")
    return met.withColumn("is_boundary", F.coalesce(c("seq") == c("_edge"), F.lit(False))).drop("_edge", "seq")


def thicknesses(entities: DataFrame) -> DataFrame:
    """(source_file, thickness_mm, thickness_source): from the span of heights, else from the first layer that names one."""
    low, high = 3.0, 80.0  # as plausible as a layer's
    named = thickness_from_layer(F.col("layer"))
    by = entities.groupBy("source_file").agg((F.max("elevation_z") - F.min("elevation_z")).alias("_span"), F.min_by(named, F.when(named.isNotNull(), F.col("seq"))).alias("_named"))
    spans = F.col("_span").between(low, high)
    return by.select("source_file", F.when(spans, F.round("_span", 3)).otherwise(F.col("_named")).alias("thickness_mm"), F.when(spans, "z_extent").when(F.col("_named").isNotNull(), "layer_name").alias("thickness_source"))


def analyze(parsed: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """One row a file of ``dxf.parse``: entities, warnings, panel size and thickness, verdict of the rules, features recognised.

    Files without shapes have their warnings and nulls. ``settings`` switches rules off and sets their parameters.
    """
    entities = cut(dxf.entities(parsed))
    placed = cut(shapes(entities))
    found = rules.findings(placed, rules.settings(settings))
    verdict = cut(rules.report(placed, found))
    seen = cut(classify.coverage(classify.nodes(placed)))
    size = placed.where("xmin is not null").groupBy("panel_id").agg(F.max(F.col("xmax") - F.col("xmin")).alias("width_mm"), F.max(F.col("ymax") - F.col("ymin")).alias("height_mm"), F.max("is_boundary").alias("has_outline"))
    files = parsed.groupBy(F.col("source_file").alias("panel_id")).agg(F.sum((F.col("kind") == "entity").cast("bigint")).alias("entities"), F.sort_array(F.collect_set("warning")).alias("warnings"))
    thick = thicknesses(entities).withColumnRenamed("source_file", "panel_id")
    out = files
    for more in (size, thick, verdict, seen):
        out = out.join(more, "panel_id", "left")
    return out.withColumnRenamed("panel_id", "source_file")


def nest_shapes(entities: DataFrame) -> DataFrame:
    """Entities of ``dxf.entities`` as ``nesting`` takes them."""
    ring = F.col("entity_type").isin("LWPOLYLINE", "POLYLINE")
    centre = shapes(entities).select(F.col("panel_id").alias("drawing"), F.substring("node", F.lit(2), F.lit(20)).cast("int").alias("seq"), "x", "y")
    own = entities.select(F.col("source_file").alias("drawing"), "seq", "entity_type", "layer", F.when(ring, F.col("vertices")).alias("vertices"), "is_closed")
    return own.join(centre, ["drawing", "seq"])
