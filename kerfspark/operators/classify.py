"""Features from geometry: a first-match cascade with graded confidence, and the operations features need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.functions import geometry as g
from kerfspark.functions.layers import layer_type
from kerfspark.operators.metrics import ordered
from kerfspark.operators.pairs import block_pairs, distance, near_pairs

# Ceilings of confidence; operations of features; canonical bores and their catalogue classes.
CEILINGS = {"hardware": 0.90, "standard": 0.95, "shop": 0.75, "material": 0.70, "machine": 0.65}
OPERATIONS = {
    "DRILLING": ["THROUGH_HOLE", "BLIND_HOLE", "COUNTERSINK", "COUNTERBORE", "SHELF_PIN_HOLE", "HINGE_CUP_HOLE", "CONFIRMAT_HOLE", "DOWEL_HOLE", "HARDWARE_HOLE"],
    "CNC_ROUTING": ["GROOVE", "POCKET", "THROUGH_POCKET", "RABBET", "OPEN_SLOT", "DADO", "ENGRAVING"],
    "PROFILE_CUTTING": ["PROFILE_CUT", "INTERNAL_CUTOUT"],
}
BORES = [5.0, 6.0, 7.0, 8.0, 10.0, 15.0, 35.0]
THROUGH_MM, THROUGH_RAMP_MM = (3.0, 30.0), 4.0


def close(d: Column, to: float, tol: float) -> Column:
    return F.abs(d - to) <= tol


def hole_confidence(d: Column, to: float, tol: float, ceiling: float, context: bool = False, pattern: bool = False) -> Column:
    bonus = 0.05 * context + 0.08 * pattern
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.abs(d - to) / tol) + bonus, F.lit(ceiling))


def through_confidence(d: Column, ceiling: float) -> Column:
    lo, hi = THROUGH_MM
    missed = F.when(d < lo, lo - d).when(d > hi, d - hi).otherwise(0.0)
    return F.when(d.isNull(), 0.0).otherwise(ceiling * F.greatest(F.lit(0.0), 1 - missed / THROUGH_RAMP_MM))


def grid_peers(holes: DataFrame) -> DataFrame:
    """(panel_id, seq, peers): holes of like diameter at a multiple of the 32 mm grid from each pin hole. Pairs of a large panel meet in blocks."""
    pins = holes.where(close(F.col("diameter"), 5.0, 1.0)).select("panel_id", "seq", "x", "y", "diameter")
    d = distance()
    pairs = block_pairs(pins, "panel_id", "seq", ["x", "y", "diameter"]).where((d >= 1.0) & ((d % 32.0 < 1.0) | (d % 32.0 > 31.0)) & close(F.col("diameter_a") - F.col("diameter_b"), 0.0, 0.5))
    ends = F.array(*[F.struct(F.col(f"seq_{e}").alias("seq"), F.col(f"diameter_{e}").alias("diameter")) for e in "ab"])
    asked = pairs.select("panel_id", F.explode(ends).alias("_e")).where(close(F.col("_e.diameter"), 5.0, 0.5))
    return asked.groupBy("panel_id", F.col("_e.seq").alias("seq")).agg(F.count(F.lit(1)).alias("peers"))


def cascade() -> Column:
    """(feature_class, confidence, priority) of a circle with its ``peers``; the first rule that fits wins."""
    d, layer, kind = F.col("diameter"), F.upper("layer"), layer_type(F.col("layer"))
    edge = g.edge_distance(F.col("x"), F.col("y"))
    dowel = F.when(close(d, 6.0, 0.2), hole_confidence(d, 6.0, 0.2, CEILINGS["material"])).when(close(d, 8.0, 0.2), hole_confidence(d, 8.0, 0.2, CEILINGS["material"])).otherwise(hole_confidence(d, 10.0, 0.2, CEILINGS["material"]))
    drill = (kind == "drill") | layer.contains("DRILL")
    by_layer, generic = through_confidence(d, CEILINGS["shop"]), through_confidence(d, CEILINGS["material"])
    rules = [
        ("P1", close(d, 35.0, 1.0) & layer.contains("HINGE"), "HINGE_CUP_HOLE", hole_confidence(d, 35.0, 1.0, CEILINGS["hardware"], context=True)),
        ("P2", close(d, 35.0, 1.0) & close(edge, 22.5, 2.0), "HINGE_CUP_HOLE", hole_confidence(d, 35.0, 1.0, CEILINGS["hardware"], context=True)),
        ("P3", close(d, 5.0, 0.5) & (F.col("peers") >= 2), "SHELF_PIN_HOLE", hole_confidence(d, 5.0, 0.5, CEILINGS["standard"], context=True, pattern=True)),
        ("P4", close(d, 7.0, 0.5) & layer.contains("CONFIRMAT"), "CONFIRMAT_HOLE", hole_confidence(d, 7.0, 0.5, CEILINGS["hardware"], context=True)),
        ("P4b", close(d, 7.0, 0.3), "CONFIRMAT_HOLE", hole_confidence(d, 7.0, 0.3, CEILINGS["material"])),
        ("P5", close(d, 6.0, 0.2) | close(d, 8.0, 0.2) | close(d, 10.0, 0.2), "DOWEL_HOLE", dowel),
        ("P5b", d.between(20.0, 50.0) & kind.isin("drill", "cut", "unknown"), "HARDWARE_HOLE", F.lit(0.68)),
        ("P6", drill, F.when(by_layer >= 0.30, "THROUGH_HOLE").otherwise("UNKNOWN_FEATURE"), by_layer),
    ]
    out = F.struct(F.when(generic >= 0.30, "THROUGH_HOLE").otherwise("UNKNOWN_FEATURE").alias("feature_class"), generic.alias("confidence"), F.lit("P7").alias("priority"))
    for name, cond, label, confidence in reversed(rules):
        label = F.lit(label) if isinstance(label, str) else label
        out = F.when(cond, F.struct(label.alias("feature_class"), confidence.alias("confidence"), F.lit(name).alias("priority"))).otherwise(out)
    return out


def classify(holes: DataFrame) -> DataFrame:
    """(panel_id, seq, feature_class, confidence, priority) of circles."""
    met = holes.join(grid_peers(holes), ["panel_id", "seq"], "left")
    return met.select("panel_id", "seq", cascade().alias("_r")).select("panel_id", "seq", "_r.*")


def nodes(shapes: DataFrame) -> DataFrame:
    """(panel_id, node, feature_class, confidence, priority) of all shapes of ``rules.with_panel``: outlines are profile cuts, circles go through the cascade of holes, arcs too as far as a size tells what they are, all else through that of contours."""
    c = F.col
    box = ["xmin", "ymin", "xmax", "ymax"]
    inner = shapes.where("not is_boundary")
    edge = shapes.where("is_boundary").select("panel_id", "node", F.lit("PROFILE_CUT").alias("feature_class"), F.lit(0.95).alias("confidence"), F.lit("P9").alias("priority"))
    round_ = inner.where("radius is not null").select("panel_id", c("node").alias("seq"), "geometry_type", "x", "y", (2 * c("radius")).alias("diameter"), "layer", *box)
    holes = classify(round_).withColumnRenamed("seq", "node")
    known = holes.join(inner.select("panel_id", "node", "geometry_type"), ["panel_id", "node"]).where((c("geometry_type") == "circle") | c("priority").isin("P1", "P2", "P3", "P4", "P4b", "P5")).drop("geometry_type")
    rest = inner.where("geometry_type <> 'circle'").join(known.select("panel_id", "node"), ["panel_id", "node"], "left_anti")
    drawn = rest.select(F.struct("panel_id", "node").alias("contour_id"), F.upper("geometry_type").alias("entity_type"), "layer", "is_closed", (c("bx1") - c("bx0")).alias("w"), (c("by1") - c("by0")).alias("h"), c("perimeter").alias("length"), g.edge_distance(c("x"), c("y")).alias("edge"))
    shaped = classify_contours(drawn).select("contour_id.*", "feature_class", "confidence", "priority")
    return edge.unionByName(known).unionByName(shaped)


def statuses(annotations: DataFrame) -> DataFrame:
    """Adds ``status``: unknown under 0.30, uncertain under 0.60, else accepted; and whether an unknown class is listed as an alternative (under 0.75)."""
    c = F.col("confidence")
    return annotations.withColumns({"status": F.when((c < 0.30) | (F.col("feature_class") == "UNKNOWN_FEATURE"), "unknown").when(c < 0.60, "uncertain").otherwise("accepted"), "maybe_unknown": c < 0.75})


# Categories of feature classes.
CATEGORIES = {
    "HOLE_FEATURES": OPERATIONS["DRILLING"],
    "MILLED_FEATURES": ["POCKET", "THROUGH_POCKET", "GROOVE", "DADO", "RABBET", "OPEN_SLOT", "ENGRAVING"],
    "PROFILE_FEATURES": ["PROFILE_CUT", "INTERNAL_CUTOUT", "CHAMFER", "FILLET"],
}


def coverage(annotations: DataFrame) -> DataFrame:
    """(panel_id, nodes, known, coverage, holes, milled, profiles): how much of a panel is recognised, and features by category."""
    n = lambda cond: F.sum(cond.cast("bigint"))
    known = F.col("feature_class") != "UNKNOWN_FEATURE"
    by = annotations.groupBy("panel_id").agg(F.count(F.lit(1)).alias("nodes"), n(known).alias("known"), *[n(F.col("feature_class").isin(CATEGORIES[k])).alias(a) for k, a in (("HOLE_FEATURES", "holes"), ("MILLED_FEATURES", "milled"), ("PROFILE_FEATURES", "profiles"))])
    return by.select("panel_id", "nodes", "known", (F.col("known") / F.col("nodes")).alias("coverage"), "holes", "milled", "profiles")




def operations(annotations: DataFrame) -> DataFrame:
    """(panel_id, operation_type, nodes, confidence): the operations of a panel's features, with their mean confidence (of whole ten-thousandths, so that no order of summing shows)."""
    op = F.create_map(*[F.lit(x) for name, classes in OPERATIONS.items() for c in classes for x in (c, name)])
    a = annotations.withColumn("operation_type", F.element_at(op, F.col("feature_class"))).where(F.col("operation_type").isNotNull())
    return a.groupBy("panel_id", "operation_type").agg(F.count(F.lit(1)).alias("nodes"), F.least(F.sum(F.round(F.col("confidence") * 10000, 0).cast("bigint")) / F.count(F.lit(1)) / 10000, F.lit(1.0)).alias("confidence"))


def nearest_bore(d: Column) -> Column:
    """The canonical bore nearest to a diameter; the smaller of two."""
    return F.array_min(F.array(*[F.struct(F.abs(d - b).alias("gap"), F.lit(b).alias("bore")) for b in BORES]))["bore"]


def bore_clusters(holes: DataFrame) -> DataFrame:
    """Of each canonical bore: count, share, mean, deviation."""
    total = F.broadcast(holes.agg(F.count(F.lit(1)).alias("_all")))
    by = holes.groupBy(nearest_bore(F.col("diameter")).alias("bore")).agg(F.count(F.lit(1)).alias("n"), F.avg("diameter").alias("mean"), F.stddev_pop("diameter").alias("deviation"))
    return by.join(total).select("bore", "n", (F.col("n") / F.col("_all")).alias("share"), "mean", "deviation")


def layer_blind(holes: DataFrame) -> DataFrame:
    """How much of a classification stands without layer names: nodes, agreeing nodes, known nodes of both. The grid's peers, which need no layers, are counted once."""
    met = holes.join(grid_peers(holes), ["panel_id", "seq"], "left")
    both = met.select(cascade()["feature_class"].alias("aware"), "*").withColumn("layer", F.lit("")).select("aware", cascade()["feature_class"].alias("blind"))
    one = lambda c: F.sum(c.cast("bigint"))
    return both.agg(F.count(F.lit(1)).alias("nodes"), one(F.col("aware") == F.col("blind")).alias("agreeing"), one(F.col("aware") != "UNKNOWN_FEATURE").alias("aware_known"), one(F.col("blind") != "UNKNOWN_FEATURE").alias("blind_known"))


def congruent(panels: DataFrame, tol: float = 3.0) -> DataFrame:
    """(project, panel_id, class_id, links): each panel's class, the smallest panel of exactly its sides, and how many other panels of the project have sides within tol.

    Only classes meet, in cells of their sides, and their sizes are added up; so panels that are all alike cost no more than one.
    """
    p = panels.select("project", "panel_id", F.greatest("w", "h").alias("long"), F.least("w", "h").alias("short"))
    classes = p.groupBy("project", "long", "short").agg(F.min("panel_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    cell = lambda c: F.floor(F.col(c) / tol).cast("bigint")
    a = classes.select("project", "class_id", F.col("long").alias("la"), F.col("short").alias("sa"), cell("long").alias("_l"), cell("short").alias("_s"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = classes.withColumn("_d", steps).select("project", (cell("long") + F.col("_d.i")).alias("_l"), (cell("short") + F.col("_d.j")).alias("_s"), F.col("long").alias("lb"), F.col("short").alias("sb"), "n")
    near = a.join(b, ["project", "_l", "_s"]).where((F.abs(F.col("la") - F.col("lb")) <= tol) & (F.abs(F.col("sa") - F.col("sb")) <= tol))
    linked = near.groupBy("project", "class_id", F.col("la").alias("long"), F.col("sa").alias("short")).agg((F.sum("n") - 1).alias("links"))
    return p.join(linked, ["project", "long", "short"]).select("project", "panel_id", "class_id", "links")


def edge_hole_counts(holes: DataFrame, within: float = 50.0) -> DataFrame:
    """Holes near each side of a panel's box."""
    near = lambda a, b: F.sum((F.abs(F.col(a) - F.col(b)) <= within).cast("bigint"))
    return holes.groupBy("panel_id").agg(near("x", "xmin").alias("left_holes"), near("x", "xmax").alias("right_holes"), near("y", "ymin").alias("bottom_holes"), near("y", "ymax").alias("top_holes"))


def nearest_spacing(holes: DataFrame, like: float = 0.6, most: float = 200.0, least: float = 0.1) -> DataFrame:
    """(panel_id, seq, spacing) of each hole to the nearest of like diameter within reach."""
    pairs = near_pairs(holes, "panel_id", "seq", most, (F.abs(F.col("diameter_a") - F.col("diameter_b")) <= like) & (distance() <= most), ["diameter"])
    both = pairs.select("panel_id", F.explode(F.array("seq_a", "seq_b")).alias("seq"), distance().alias("d")).where(F.col("d") > least)
    return both.groupBy("panel_id", "seq").agg(F.min("d").alias("spacing"))


def value_weights(values: DataFrame, column: str) -> DataFrame:
    """Whole-mm values with their share, to 4 places."""
    total = F.broadcast(values.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("_all")))
    by = values.where(F.col(column).isNotNull()).groupBy(F.bround(column, 0).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by.join(total).select("value", "n", F.round(F.col("n") / F.col("_all"), 4).alias("share"))


def describe(values: DataFrame, column: str) -> DataFrame:
    """Count, range, mean, deviation and interpolated percentiles; percentiles come from the counts of distinct values, ordered by ranges, so that no task holds them all."""
    c = F.col(column)
    whole = values.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("deviation"))
    return whole.join(F.broadcast(quantiles(values, column, {"median": 0.5, "p05": 0.05, "p95": 0.95})))


def quantiles(values: DataFrame, column: str, wanted: dict[str, float], groups: list[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles of a column, by groups (few rows of ranks a group), without a buffer of all values."""
    by = values.where(F.col(column).isNotNull()).groupBy(*groups, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    key = F.struct(*groups, "_v") if groups else F.col("_v")
    placed = ordered(by.withColumn("_key", key), "_key", "_n")
    # ranks within the group: what is below it as a whole is taken off
    first = placed.groupBy(*groups).agg(F.min("_n_below").alias("_start"), F.sum("_n").alias("_all"))
    met = placed.join(F.broadcast(first), list(groups)) if groups else placed.join(F.broadcast(first))
    low = F.col("_n_below") - F.col("_start")
    out = []
    for name, q in wanted.items():
        at = (F.col("_all") - 1) * q
        holds = lambda r, low=low: (low <= r) & (r < low + F.col("_n"))
        under, over = F.max(F.when(holds(F.floor(at)), F.col("_v"))), F.max(F.when(holds(F.ceil(at)), F.col("_v")))
        part = F.max(at - F.floor(at))
        out.append((under + (over - under) * part).alias(name))
    return met.groupBy(*groups).agg(*out)


def dialect_reliance(holes: DataFrame) -> DataFrame:
    """A project's dominant diameter, its share, and whether only layers tell what its holes are."""
    by = holes.groupBy("project", F.round("diameter", 1).alias("dominant")).agg(F.count(F.lit(1)).alias("n"))
    best = by.groupBy("project").agg(F.sum("n").alias("holes"), F.max_by(F.struct("dominant", "n"), F.struct("n", (-F.col("dominant")).alias("m"))).alias("_b"))
    share = F.col("_b.n") / F.col("holes")
    off = F.abs(F.col("_b.dominant") - nearest_bore(F.col("_b.dominant"))) > 0.6
    return best.select("project", "holes", F.col("_b.dominant").alias("dominant"), share.alias("share"), ((share >= 0.6) & off).alias("relies_on_layers"))


def thickness_bands(panels: DataFrame, tol: float = 1.0) -> DataFrame:
    """Assemblies by project and thickness band, of two panels and more."""
    return panels.groupBy("project", F.bround(F.col("thickness") / tol, 0).alias("band")).agg(F.count(F.lit(1)).alias("panels"), F.min("panel_id").alias("first_panel")).where("panels >= 2")


def classify_contours(shapes: DataFrame) -> DataFrame:
    """(contour_id, feature_class, confidence, priority) of shapes that aren't circles; ``shapes`` needs entity_type, layer, is_closed, the box's sides w and h, length and edge (distance to the panel's nearest side, or null)."""
    kind, layer, t = layer_type(F.col("layer")), F.upper("layer"), F.col("entity_type")
    poly = t.isin("LWPOLYLINE", "POLYLINE", "SPLINE", "ELLIPSE")
    ring = poly & F.col("is_closed")
    long, short = F.greatest("w", "h"), F.least("w", "h")
    slim = (short > 1e-6) & (long / short >= 5) & short.between(2.0, 20.0)
    rules = [
        ("P7b", (poly | t.isin("LINE", "ARC")) & ((kind == "engrave") | layer.rlike("ENGRAVE|ETCH|SCORE|MARK")), "ENGRAVING", 0.75),
        ("P8a", ring & (kind == "pocket") & slim, "GROOVE", 0.68),
        ("P8", ring & ((kind == "pocket") | layer.contains("POCKET")), "POCKET", 0.65),
        ("P10", ring & kind.isin("cut", "border"), "INTERNAL_CUTOUT", 0.80),
        ("P10b", t.isin("LINE", "ARC") & kind.isin("cut", "border", "unknown") & (F.col("length") <= 60) & (F.col("edge") <= 15), None, 0.65),
    ]
    out = F.struct(F.lit("UNKNOWN_FEATURE").alias("feature_class"), F.lit(0.0).alias("confidence"), F.lit("P11").alias("priority"))
    for name, cond, label, confidence in reversed(rules):
        value = F.lit(label) if label else F.when(t == "LINE", "CHAMFER").otherwise("FILLET")
        out = F.when(F.coalesce(cond, F.lit(False)), F.struct(value.alias("feature_class"), F.lit(confidence).alias("confidence"), F.lit(name).alias("priority"))).otherwise(out)
    return shapes.select("contour_id", out.alias("_r")).select("contour_id", "_r.*")
