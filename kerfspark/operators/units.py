"""Common units: find the unit each quantity is really in, and convert it to millimetres.

Declarations (a parser configuration, a file header) are read first and believed only as far as the numbers allow.
For each drawing file the unit of its coordinates is the candidate with the least sum of squared log residuals of
three magnitudes (extent, bore, depth) against the corpus medians, less the agreement with two identities (values on
the drafting grid; bores whose size is also written in text), plus a penalty for contradicting the declaration. For each
bore the identity diameter = 2 * radius of its coordinates then fixes the unit of its diameter, and a size written in
text that of the quantity it names. A file whose second best unit comes close is flagged as not unique.

Nulls and odd input: a null, NaN or infinite quantity has no unit and comes out null; entities without file keep their
declaration; empty coordinates are no quantity; unknown unit names count as absent; repeated deliveries give equal rows,
which ``unit_cases`` returns once. Any further columns are ignored by ``unit_cases`` and kept by ``to_millimetres``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.runtime import cut, lookup

# Millimetres in a unit; names of units; codes of units in the header of drawing files.
MILLIMETRES = {"mm": 1.0, "in": 25.4, "cm": 10.0, "m": 1000.0, "mil": 0.0254}
UNIT_NAMES = {
    "mm": ["mm", "millimetre", "millimetres", "millimeter", "millimeters", "milimetro", "milimetros", "4"],
    "in": ["in", "inch", "inches", "zoll", "pouce", "pulgada", '"', "''", "1"],
    "cm": ["cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter", "5"],
    "m": ["m", "metre", "metres", "meter", "meters", "6"],
    "mil": ["mil", "mils", "thou", "9"],
}

#: Step in mm on which drawings are made, and the part of a step by which a value may miss it.
GRID_MM, GRID_SLACK = 0.1, 0.2
#: Least spread of the natural logs of a magnitude among files.
LEAST_SPREAD = 0.3
#: Most that one magnitude's squared log residual counts: a file may hold nothing but hinge cups.
MOST_RESIDUAL = 4.5
#: Weights, in units of log likelihood, of all values on the grid, of one text anchor (three at most) and against the declared unit.
GRID_WEIGHT, ANCHOR_WEIGHT, DECLARED_WEIGHT = 6.0, 3.0, 4.0
#: Log residual within which an identity holds; margin of cost under which a file's solution isn't unique.
IDENTITY_SLACK, UNIQUE_MARGIN = 0.05, 1.0

NUMBER = r"(?:(\d+)[ -](\d+)/(\d+)|(\d+)/(\d+)|(\d+(?:[.,]\d+)?))"
SIZE = rf"(?i)(?:^|[^\w.,/]|_){NUMBER}\s*(mm|millimet(?:er|re)s?|cm|[cz]entimet(?:er|re)s?|met(?:er|re)s?|m|mils?|thou|inch(?:es)?|in|zoll|\"|'')(?![\w/])(?!\s+place)"
DEPTH_WORD = r"(?i)(?<![a-z])(deep|depth|dp|tief|tiefe|profondeur|profundidad)(?![a-z])"


def unit_code(name: Column) -> Column:
    """The unit a declaration names, or null."""
    known = F.create_map(*[F.lit(x) for code, names in UNIT_NAMES.items() for n in names for x in (n, code)])
    return F.element_at(known, F.regexp_replace(F.lower(F.trim(name)), r"(?<=\w)\.$", ""))


def factor(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in MILLIMETRES.items() for x in pair]), code)


def sane(value: Column) -> Column:
    """The magnitude, or null where there is none to take a logarithm of."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) > 0) & (F.abs(value) < F.lit(1e15)), F.abs(value))


def text_size(text: Column) -> dict[str, Column]:
    """What a free text says of a size: its unit, its value and whether it is a depth; nulls where it names none."""
    found = lambda g: F.nullif(F.regexp_extract(text, SIZE, g), F.lit(""))
    number = lambda g: F.regexp_replace(found(g), ",", ".").cast("double")
    value = F.coalesce(number(1) + number(2) / number(3), number(4) / number(5), number(6))
    return {"text_unit": unit_code(found(7)), "text_value": value, "text_is_depth": text.rlike(DEPTH_WORD)}


def nearest_unit(value: Column, length_mm: Column) -> Column:
    """The unit in which the value is the length, or null if it is in none."""
    gaps = F.array(*[F.struct(F.abs(F.log(sane(value) * f / sane(length_mm))).alias("gap"), F.lit(u).alias("unit")) for u, f in MILLIMETRES.items()])
    best = F.array_min(F.filter(gaps, lambda x: x["gap"].isNotNull()))
    return F.when(best["gap"] < IDENTITY_SLACK, best["unit"])


def quantities(entities: DataFrame, configs: DataFrame) -> DataFrame:
    """Of each row, what the unit decisions need and no more."""
    names = configs.groupBy("config_id").agg(unit_code(F.min("target_units")).alias("_target"))
    e = entities.select("entity_key", "source_file", "config_id", "units_original", "entity_type", "coordinates", "diameter_mm", "depth_mm", "size_text")
    e = e.join(names, "config_id", "left").withColumn("declared", F.coalesce("_target", unit_code(F.col("units_original")), F.lit("mm")))
    first = F.when(F.size("coordinates") > 0, F.col("coordinates")[0])
    bore = F.col("entity_type").isin("CIRCLE", "ARC")
    reach = F.array_max(F.transform("coordinates", lambda v: F.greatest(sane(F.get(v, F.lit(0))), sane(F.get(v, F.lit(1))))))
    return e.select(
        "entity_key",
        "source_file",
        "declared",
        (F.size("coordinates") > 0).alias("placed"),
        F.when(~F.isnan("diameter_mm"), F.col("diameter_mm")).alias("diameter"),
        F.when(~F.isnan("depth_mm"), F.col("depth_mm")).alias("depth"),
        F.when(bore, 2 * sane(F.get(first, F.lit(2)))).alias("bore"),
        reach.alias("reach"),
        F.get(first, F.lit(0)).alias("x"),
        F.get(first, F.lit(1)).alias("y"),
        *[c.alias(n) for n, c in text_size(F.col("size_text")).items()],
    )


def file_units(q: DataFrame) -> DataFrame:
    """One row a file: ``unit`` of its coordinates, ``unique`` and ``n`` rows."""
    text_mm = F.when(~F.col("text_is_depth"), F.col("text_value") * factor(F.col("text_unit")))
    measures = [F.count(F.lit(1)).alias("n"), F.min("declared").alias("declared"), F.max("reach").alias("extent"), F.percentile_approx("bore", 0.5, 1000).alias("bore"), F.percentile_approx(F.when(F.col("text_unit").isNull(), sane(F.col("depth"))), 0.5, 1000).alias("depth")]
    for u, f in MILLIMETRES.items():
        off = [F.col(c) * (f / GRID_MM) for c in ("x", "y")]
        on = sum(F.when(F.abs(v - F.rint(v)) < GRID_SLACK / 10, 0.5).when(v.isNotNull(), 0.0) for v in off)
        measures += [F.avg(on).alias(f"grid_{u}"), F.sum(F.when(F.abs(F.log(text_mm / (F.col("bore") * f))) < IDENTITY_SLACK, 1).otherwise(0)).alias(f"anchors_{u}")]
    files = cut(q.where(F.col("source_file").isNotNull()).groupBy("source_file").agg(*measures))
    own = factor(F.col("declared"))
    logs = {m: F.log(F.col(m) * own) for m in ("extent", "bore", "depth")}
    usual = files.agg(*[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"_{m}") for m, x in logs.items()])
    costs = []
    for u, f in MILLIMETRES.items():
        cost = F.when(F.col("declared") == u, 0.0).otherwise(DECLARED_WEIGHT) - GRID_WEIGHT * F.coalesce(f"grid_{u}", F.lit(0.0)) - ANCHOR_WEIGHT * F.least(F.col(f"anchors_{u}"), F.lit(3))
        for m in logs:
            spread = F.greatest((F.col(f"_{m}")[2] - F.col(f"_{m}")[0]) / 1.35, F.lit(LEAST_SPREAD))
            gap = (F.log(F.col(m) * f) - F.col(f"_{m}")[1]) / spread
            cost = cost + F.coalesce(F.least(gap * gap / 2, F.lit(MOST_RESIDUAL)), F.lit(0.0))
        costs.append(F.struct(cost.alias("cost"), F.lit(u).alias("unit")))
    ranked = files.join(F.broadcast(usual)).withColumn("_costs", F.array_sort(F.array(*costs)))
    return ranked.select("source_file", F.col("_costs")[0]["unit"].alias("unit"), (F.col("_costs")[1]["cost"] - F.col("_costs")[0]["cost"] >= UNIQUE_MARGIN).alias("unique"), "n")


def quantity_units(entities: DataFrame, configs: DataFrame) -> DataFrame:
    """One row a delivery: entity_key, unit_coordinates, unit_diameter, unit_depth, ``size_from_text_mm`` and unique."""
    q = quantities(entities, configs)
    files = file_units(q)
    met = lookup(q, files.select("source_file", "unit", "unique"), "source_file", "entity_key", counts=files.select("source_file", "n"))
    unit = F.coalesce("unit", "declared")
    bore_mm = F.col("bore") * factor(unit)
    text_mm = F.col("text_value") * factor(F.col("text_unit"))
    names_depth = F.col("text_unit").isNotNull() & F.col("text_is_depth")
    names_bore = F.col("text_unit").isNotNull() & ~F.col("text_is_depth")
    by_text = lambda column: F.coalesce(nearest_unit(F.col(column), text_mm), F.col("text_unit"))
    diameter = F.when(F.col("diameter").isNull(), F.when(names_bore, F.col("text_unit"))).otherwise(F.coalesce(nearest_unit(F.col("diameter"), bore_mm), F.when(names_bore, by_text("diameter")), unit))
    depth = F.when(F.col("depth").isNotNull(), F.coalesce(F.when(names_depth, by_text("depth")), unit))
    return met.select(
        "entity_key",
        F.when(F.col("placed"), unit).alias("unit_coordinates"),
        diameter.alias("unit_diameter"),
        depth.alias("unit_depth"),
        unit.alias("unit_file"),
        F.when(F.col("diameter").isNull() & names_bore, text_mm).alias("size_from_text_mm"),
        F.coalesce("unique", F.lit(False)).alias("unique"),
    )


def unit_cases(entities: DataFrame, configs: DataFrame) -> DataFrame:
    """(entity_key, field_name, unit_code) of the quantities that aren't in millimetres, each once."""
    fields = (("coordinates", "unit_coordinates"), ("diameter_mm", "unit_diameter"), ("depth_mm", "unit_depth"))
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(c).alias("unit_code")) for n, c in fields]), lambda x: x["unit_code"] != "mm")
    return quantity_units(entities, configs).select("entity_key", F.explode(each).alias("_case")).select("entity_key", "_case.*").distinct()


def to_millimetres(entities: DataFrame, configs: DataFrame) -> DataFrame:
    """Every entity once, its lengths in millimetres (areas in square millimetres, angles as they were)."""
    units = quantity_units(entities, configs).groupBy("entity_key").agg(*[F.first(c).alias(c) for c in ("unit_coordinates", "unit_diameter", "unit_depth", "unit_file", "size_from_text_mm", "unique")])
    once = entities.dropDuplicates(["entity_key"]).join(units, "entity_key")
    at, across, down = (factor(F.coalesce(F.col(c), F.col("unit_file"))) for c in ("unit_coordinates", "unit_diameter", "unit_depth"))
    lengths = F.transform("coordinates", lambda v: F.transform(v, lambda x, i: F.when((F.col("entity_type") == "ARC") & (i >= 3), x).otherwise(x * at)))
    return once.withColumns(
        {
            "coordinates": lengths,
            "bounding_box": F.transform("bounding_box", lambda x: x * at),
            "centroid": F.transform("centroid", lambda x: x * at),
            "area_mm2": F.col("area_mm2") * at * at,
            "perimeter_mm": F.col("perimeter_mm") * at,
            "diameter_mm": F.coalesce(F.col("diameter_mm") * across, F.col("size_from_text_mm")),
            "radius_mm": F.col("radius_mm") * across,
            "depth_mm": F.col("depth_mm") * down,
            "elevation_z": F.col("elevation_z") * down,
        }
    ).drop("unit_file", "size_from_text_mm")
