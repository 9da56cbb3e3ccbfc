"""A corpus's bores against the catalogue, and rule parameters tuned to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfspark.operators.classify import bore_clusters, nearest_bore, quantiles, value_weights

# Bore, class, tolerance of the diameter, setback from the edge and its tolerance, in mm.
CATALOGUE = [
    (5.0, "SHELF_PIN_HOLE", 0.2, 37.0, 1.0),
    (6.0, "DOWEL_HOLE", 0.2, None, None),
    (7.0, "CONFIRMAT_HOLE", 0.3, 12.0, 5.0),
    (8.0, "DOWEL_HOLE", 0.2, None, None),
    (10.0, "DOWEL_HOLE", 0.2, None, None),
    (15.0, "HARDWARE_HOLE", 0.3, None, None),
    (35.0, "HINGE_CUP_HOLE", 0.5, 22.5, 1.5),
]
SUPPORT, GRID_MM, ON_GRID_MM = 3, 32.0, 0.5


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "bore double, feature_class string, tolerance double, setback double, setback_tolerance double")


def conformance(holes: DataFrame, spacings: DataFrame) -> DataFrame:
    """(metric, feature_class, bore, measured, expected, deviation, support, passed): mean diameters, upper-median setbacks, and pin spacings on the grid.

    ``holes`` needs diameter and edge (its distance to the nearest side); metrics with less than SUPPORT values are left out.
    """
    known = F.broadcast(catalogue(holes.sparkSession))
    near = holes.withColumn("bore", nearest_bore(F.col("diameter")))
    by = near.groupBy("bore").agg(F.count(F.lit(1)).alias("n"), F.avg("diameter").alias("m")).where(F.col("n") >= SUPPORT).join(known, "bore")
    gap = F.abs(F.col("m") - F.col("bore"))
    diameters = by.select(F.lit("diameter").alias("metric"), "feature_class", "bore", F.col("m").alias("measured"), F.col("bore").alias("expected"), gap.alias("deviation"), F.col("n").alias("support"), (gap <= F.col("tolerance")).alias("passed"))
    at = near.where(F.abs(F.round("diameter", 0) - F.col("bore")) < 0.51).join(known.where("setback is not null"), "bore")
    counted = at.groupBy("bore", "feature_class", "setback", "setback_tolerance").agg(F.count(F.lit(1)).alias("n"))
    mid = counted.join(F.broadcast(quantiles(at, "edge", {"m": 0.5}, ["bore"])), "bore").where(F.col("n") >= SUPPORT)
    gap = F.abs(F.col("m") - F.col("setback"))
    setbacks = mid.select(F.lit("edge_setback").alias("metric"), "feature_class", "bore", F.col("m").alias("measured"), F.col("setback").alias("expected"), gap.alias("deviation"), F.col("n").alias("support"), (gap <= F.col("setback_tolerance")).alias("passed"))
    s = spacings.where(F.col("spacing").between(20.0, 200.0))
    steps = F.greatest(F.lit(1.0), F.bround(F.col("spacing") / GRID_MM, 0))
    off = F.abs(F.col("spacing") - steps * GRID_MM)
    grid = s.agg(F.avg(off).alias("m"), F.avg((off <= ON_GRID_MM).cast("double")).alias("f"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    spaced = grid.select(F.lit("grid_spacing").alias("metric"), F.lit("SHELF_PIN_HOLE").alias("feature_class"), F.lit(5.0).alias("bore"), F.col("m").alias("measured"), F.lit(0.0).alias("expected"), F.col("m").alias("deviation"), F.col("n").alias("support"), (F.col("f") >= 0.5).alias("passed"))
    return diameters.unionByName(setbacks).unionByName(spaced)


def tuned(holes: DataFrame, panels: DataFrame, spacings: DataFrame | None = None, least: int = 5) -> DataFrame:
    """(parameter, value, source, n): rule parameters measured where there are enough values, else the catalogue's."""
    near = holes.withColumn("bore", nearest_bore(F.col("diameter"))).where(F.abs(F.col("diameter") - F.col("bore")) <= 1.0)
    names = F.create_map(*[F.lit(x) for p in ((5.0, "shelf_pin_diameter_mm"), (7.0, "confirmat_diameter_mm"), (35.0, "hinge_cup_diameter_mm")) for x in p])
    by = near.groupBy("bore").agg(F.count(F.lit(1)).alias("n"), F.avg("diameter").alias("m"), F.stddev_pop("diameter").alias("s")).withColumn("parameter", F.element_at(names, F.col("bore"))).where("parameter is not null")
    enough = F.col("n") >= least
    source = F.when(enough, "measured").otherwise("catalogue").alias("source")
    target = by.select("parameter", F.when(enough, F.round("m", 2)).otherwise(F.col("bore")).alias("value"), source, "n")
    slack = by.select(F.regexp_replace("parameter", "_diameter_mm", "_tolerance_mm").alias("parameter"), F.when(enough, F.round(F.greatest(F.lit(0.2), 3 * F.col("s")), 2)).otherwise(0.5).alias("value"), source, "n")
    sizes = panels.agg(F.count("thickness").alias("n")).join(F.broadcast(quantiles(panels, "thickness", {"m": 0.5})))
    thick = sizes.select(F.lit("panel_thickness_mm").alias("parameter"), F.when(enough, F.round("m", 2)).otherwise(18.0).alias("value"), source, "n")
    out = target.unionByName(slack).unionByName(thick)
    if spacings is None:
        return out
    best = dominant_spacing(spacings).select(F.col("spacing").alias("_s"))
    near = spacings.join(F.broadcast(best)).where(F.abs(F.col("spacing") - F.col("_s")) <= 1.0).groupBy("_s").agg(F.count(F.lit(1)).alias("n"))
    none = spacings.sparkSession.range(1).select(F.lit("shelf_pin_spacing_mm").alias("parameter"))
    pitch = none.join(F.broadcast(near), how="left").select("parameter", F.when(enough, F.round("_s", 2)).otherwise(GRID_MM).alias("value"), F.when(enough, "measured").otherwise("catalogue").alias("source"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.unionByName(pitch)


def hole_rate(holes: DataFrame, panels: DataFrame) -> DataFrame:
    """The mean number of holes a panel (the rate of a Poisson draw), panels without holes included."""
    return panels.agg(F.count(F.lit(1)).alias("panels")).join(F.broadcast(holes.agg(F.count(F.lit(1)).alias("holes")))).select("panels", "holes", F.when(F.col("panels") > 0, F.col("holes") / F.col("panels")).alias("rate"))


def dominant_spacing(spacings: DataFrame) -> DataFrame:
    """The most frequent spacing in whole millimetres, the smaller of equals, with its count and share."""
    by = spacings.where(F.col("spacing").isNotNull()).groupBy(F.bround("spacing", 0).alias("spacing")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(by.agg(F.sum("n").alias("_all")))
    best = by.agg(F.max_by(F.struct("spacing", "n"), F.struct("n", (-F.col("spacing")).alias("m"))).alias("_b"))
    return best.join(whole).where("_b is not null").select("_b.spacing", "_b.n", (F.col("_b.n") / F.col("_all")).alias("share"))


def summary(holes: DataFrame, panels: DataFrame, spacings: DataFrame) -> DataFrame:
    """Counters of a corpus in one row."""
    p = panels.agg(F.count(F.lit(1)).alias("panels"), F.countDistinct("project").alias("projects"), F.avg("w").alias("mean_width"), F.avg("h").alias("mean_height"))
    h = holes.agg(F.count(F.lit(1)).alias("holes"), F.countDistinct("panel_id").alias("drilled_panels"), F.countDistinct("layer").alias("layers"))
    return p.join(F.broadcast(h)).join(F.broadcast(spacings.agg(F.count("spacing").alias("spacings"))))


def weighted_summary(values: DataFrame, value: str, weight: str) -> DataFrame:
    """Count, range and weighted mean of a list of values with their weights."""
    v, w = F.col(value), F.col(weight)
    return values.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("mean"))


def profile(holes: DataFrame, panels: DataFrame, spacings: DataFrame) -> DataFrame:
    """(section, name, value) of a corpus's distributions: bores by canonical size, widths, heights and thicknesses by whole mm with their shares, the rate of holes, the dominant spacing."""
    row = lambda d, section, name, value: d.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    parts = [row(bore_clusters(holes), "bore_share", "bore", "share"), row(bore_clusters(holes), "bore_mean", "bore", "mean")]
    parts += [row(value_weights(panels, c), n, "value", "share") for c, n in (("w", "width"), ("h", "height"), ("thickness", "thickness"))]
    parts += [row(hole_rate(holes, panels).withColumn("k", F.lit("rate")), "holes", "k", "rate"), row(dominant_spacing(spacings).withColumn("k", F.lit("dominant")), "spacing", "k", "spacing")]
    return reduce(DataFrame.unionByName, parts)


def tuned_yaml(parameters: DataFrame) -> str:
    """The tuned parameters (a handful of rows) as a YAML document."""
    import yaml

    rows = parameters.collect()
    return yaml.safe_dump({"parameters": {r["parameter"]: r["value"] for r in rows}, "sources": {r["parameter"]: r["source"] for r in rows}, "measured": {r["parameter"]: r["n"] for r in rows}}, sort_keys=True)
