"""Sheets with several panels: what is the sheet, which contours are panels, and to which panel each shape belongs.

A drawing may hold a third of all shapes, so shapes meet the contours around them through grid cells: a contour is listed in
the cells its box covers, a point looks into its own cell. Shapes outside every panel look for the nearest one in cells of
growing size, each round only for those that still have none; what is farther than all cells meets every panel of its drawing.

All joins but those of hot keys are by sorting. Contours repeat over the cells, and their few numbers are small in a file, so
Spark's estimates of them are up to some hundred times too low, and a broadcast by such an estimate fills the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.functions import geometry as g
from kerfspark.runtime import HOT_ROWS, copy_to_parts, cut, deal, forget, hot_keys

# Words of sheet layers; least area of a panel and its least share of the largest contour.
SHEET_WORDS = ["SHEET", "STOCK", "MATERIAL", "BLANK", "NEST"]
LEAST_AREA, LEAST_SHARE = 1000.0, 0.05
CELL_MM, ROUNDS = 500.0, 6


def contours(shapes: DataFrame) -> DataFrame:
    """Closed polylines with area: drawing, seq, layer, vertices, area, x and y of a point inside (the area's centroid), box."""
    v = F.col("vertices")
    ring = shapes.where(F.col("entity_type").isin("LWPOLYLINE", "POLYLINE") & F.col("is_closed") & (F.size(v) >= 3)).withColumn("area", F.abs(g.signed_area(v))).where("area > 0")
    c, b = g.area_centroid(v), g.box(v)
    return ring.select("drawing", "seq", "layer", "vertices", "area", c["x"].alias("x"), c["y"].alias("y"), *[b[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])


def joined(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that is never a broadcast, whatever Spark takes the tables' sizes for."""
    return rows.join(other.hint("merge"), on, how)


def with_drawing(rows: DataFrame, one: DataFrame, names: list[str]) -> DataFrame:
    """These columns of the cut ``rows`` with the one row of their drawing; a drawing may hold most of the rows."""
    counts = rows.groupBy("drawing").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "drawing", "n") if rows._cut_rows > HOT_ROWS else None
    return joined(deal(rows.select(names), hot, "drawing", "seq"), copy_to_parts(one, hot, "drawing"), ["drawing", "_part"]).drop("_part")


def inside(points: DataFrame, around: DataFrame, keep: Column, cell: float = CELL_MM) -> DataFrame:
    """(drawing, seq, outer, outer_area): the contours that hold each point's (x, y) and for which ``keep`` holds."""
    at = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    p = points.select("drawing", "seq", "x", "y", "area", at("x").alias("_cx"), at("y").alias("_cy"))
    o = around.select("drawing", F.col("seq").alias("outer"), F.col("area").alias("outer_area"), F.col("vertices").alias("_v"), F.explode(F.sequence(at("xmin"), at("xmax"))).alias("_cx"), "ymin", "ymax").withColumn("_cy", F.explode(F.sequence(at("ymin"), at("ymax")))).drop("ymin", "ymax")
    met = joined(p, o, ["drawing", "_cx", "_cy"]).where((F.col("seq") != F.col("outer")) & keep & g.contains_point(F.col("_v"), F.col("x"), F.col("y")))
    return met.select("drawing", "seq", "outer", "outer_area")


def sheets(c: DataFrame) -> DataFrame:
    """(drawing, sheet, source): the largest contour on a sheet layer, else the largest contour if it holds two others."""
    named = F.upper("layer").rlike("|".join(SHEET_WORDS))
    first = F.struct("area", (-F.col("seq")).alias("o"))
    by = c.groupBy("drawing").agg(F.max_by("seq", F.when(named, first)).alias("_named"), F.max_by("seq", first).alias("_largest"))
    large = joined(c, by.select("drawing", F.col("_largest").alias("seq")), ["drawing", "seq"]).select("drawing", F.col("seq").alias("_k"), F.col("vertices").alias("_v"))
    held = with_drawing(c, large, ["drawing", "seq", "x", "y"]).where((F.col("seq") != F.col("_k")) & g.contains_point(F.col("_v"), F.col("x"), F.col("y"))).groupBy("drawing").agg(F.count(F.lit(1)).alias("_held"))
    met = joined(by, held, "drawing", "left")
    hull = F.coalesce(F.col("_held"), F.lit(0)) >= 2
    return met.select("drawing", F.coalesce("_named", F.when(hull, F.col("_largest"))).alias("sheet"), F.when(F.col("_named").isNotNull(), "sheet_layer").when(hull, "largest_contour").otherwise("none").alias("source"))


def panels(c: DataFrame, s: DataFrame) -> DataFrame:
    """The contours that are panels: large enough, not the sheet, in no larger one."""
    most = c.groupBy("drawing").agg(F.max("area").alias("_most"))
    candidates = with_drawing(c, joined(most, s, "drawing"), c.columns).where((F.col("sheet").isNull() | (F.col("seq") != F.col("sheet"))) & (F.col("area") >= F.greatest(F.lit(LEAST_AREA), LEAST_SHARE * F.col("_most")))).drop("_most", "sheet", "source")
    within = inside(candidates, candidates, F.col("outer_area") > F.col("area")).select("drawing", "seq").distinct()
    return joined(candidates, within, ["drawing", "seq"], "left_anti")


def nearest_panel(points: DataFrame, p: DataFrame) -> DataFrame:
    """(drawing, seq, panel): the panel whose outline is nearest to each point."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    edges = F.zip_with("vertices", g.turned(F.col("vertices")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gap = F.array_min(F.transform(edges, lambda e: g.segment_distance(F.col("x"), F.col("y"), e["a"][0], e["a"][1], e["b"][0], e["b"][1])))
    found, left, cell = None, cut(points.select("drawing", "seq", "x", "y")), CELL_MM
    for k in range(ROUNDS):
        at = lambda c, cell=cell: F.floor(c / cell).cast("bigint")
        q = left.withColumn("_s", steps).select("drawing", "seq", "x", "y", (at(F.col("x")) + F.col("_s.i")).alias("_cx"), (at(F.col("y")) + F.col("_s.j")).alias("_cy"))
        o = joined(p, left.select("drawing").distinct(), "drawing", "left_semi").select("drawing", F.col("seq").alias("panel"), "vertices", F.explode(F.sequence(at(F.col("xmin")), at(F.col("xmax")))).alias("_cx"), "ymin", "ymax").withColumn("_cy", F.explode(F.sequence(at(F.col("ymin")), at(F.col("ymax")))))
        met = joined(q, o, ["drawing", "_cx", "_cy"]).select("drawing", "seq", "panel", gap.alias("_gap"))
        met = met.where(F.col("_gap") <= cell)
        best = cut(met.groupBy("drawing", "seq").agg(F.min_by("panel", F.struct("_gap", "panel")).alias("panel")))
        found = best if found is None else found.unionByName(best)
        rest = cut(joined(left, best, ["drawing", "seq"], "left_anti"))
        forget(left)
        left = rest
        cell *= 4
        if not left._cut_rows:
            return found
    far = joined(left, p.select("drawing", F.col("seq").alias("panel"), "vertices"), "drawing").select("drawing", "seq", "panel", gap.alias("_gap"))
    return found.unionByName(far.groupBy("drawing", "seq").agg(F.min_by("panel", F.struct("_gap", "panel")).alias("panel")))


def assign(shapes: DataFrame) -> DataFrame:
    """(drawing, seq, panel, how): each shape's panel in drawings with two panels and more: its outline, held by it, or the nearest.

    ``shapes`` needs drawing, seq, entity_type, layer, vertices, is_closed and the centroid x, y; those without place have no panel.
    """
    c = cut(contours(shapes))
    s = cut(sheets(c))
    p = cut(panels(c, s))
    several = p.groupBy("drawing").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("drawing")
    p = joined(p, several, "drawing", "left_semi")
    others = joined(shapes, several, "drawing", "left_semi")
    for own in (p.select("drawing", "seq"), s.select("drawing", F.col("sheet").alias("seq"))):
        others = joined(others, own, ["drawing", "seq"], "left_anti")
    points = cut(others.where("x is not null and y is not null").select("drawing", "seq", "x", "y", F.lit(0.0).alias("area")))
    held = cut(inside(points, p, F.lit(True)).groupBy("drawing", "seq").agg(F.min("outer").alias("panel")))
    stray = joined(points, held, ["drawing", "seq"], "left_anti")
    out = p.select("drawing", "seq", F.col("seq").alias("panel"), F.lit("outline").alias("how")).unionByName(held.withColumn("how", F.lit("inside")))
    return out.unionByName(nearest_panel(stray, p).withColumn("how", F.lit("nearest")))


def layouts(shapes: DataFrame) -> DataFrame:
    """(drawing, source, panels, panel_area, sheet_area, utilisation) of each drawing with contours."""
    c = cut(contours(shapes))
    s = cut(sheets(c))
    p = panels(c, s).groupBy("drawing").agg(F.count(F.lit(1)).alias("panels"), F.sum("area").alias("panel_area"))
    whole = c.select("drawing", F.col("seq").alias("sheet"), F.col("area").alias("sheet_area"))
    met = joined(joined(s, p, "drawing", "left"), whole, ["drawing", "sheet"], "left")
    return met.select("drawing", "source", F.coalesce("panels", F.lit(0)).alias("panels"), F.coalesce("panel_area", F.lit(0.0)).alias("panel_area"), "sheet_area", (F.col("panel_area") / F.col("sheet_area")).alias("utilisation"))
