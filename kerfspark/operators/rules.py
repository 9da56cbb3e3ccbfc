"""Geometric and machining checks of panels, as filters, joins and aggregations over all panels at once.

``shapes`` are the rows of all drawings (``SHAPE``): circles, rings and lines with their measures; the one with
``is_boundary`` is its panel's outline. ``with_panel`` gives every shape its panel's box and outline. Every check gives
(panel_id, rule_id, severity, node, measured): one row a finding. Checks that look at one shape run together in one pass,
those of pairs in one join over grid cells. ``results`` adds a PASS row for each panel and rule without finding; ``report``
folds findings into a row a panel; machining findings count only where no geometric error stands.

Rules can be switched off and their parameters set (``settings``, read from YAML by ``sources.documents.rule_settings``).
The circle of MFG-004 is found to a thousandth of the ring's extent. Shapes with a null measure keep every check that needs it; shapes without a panel's outline keep those that need a panel;
pins of the same place count as pairs of distance 0. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.functions import geometry as g
from kerfspark.operators.nesting import inside
from kerfspark.operators.pairs import block_pairs, distance, near_pairs
from kerfspark.runtime import lookup

#: MFG-010 finds nothing: it stands for a check of pairs of screws that isn't defined.
SHAPE = "panel_id bigint, node string, geometry_type string, kind string, vertices array<array<double>>, x double, y double, radius double, is_closed boolean, is_approximated boolean, is_boundary boolean, area double, perimeter double, bx0 double, by0 double, bx1 double, by1 double, depth double"


@dataclass(frozen=True)
class Rule:
    layer: int
    confidence: float
    params: dict[str, float] = field(default_factory=dict)


# Layer, confidence and parameters (mm, mm2, degrees, ratios) of the rules.
RULES = {
    "GEO-001": Rule(1, 1.0, {"tolerance_mm": 0.01}),
    "GEO-002": Rule(1, 1.0),
    "GEO-003": Rule(1, 1.0, {"min_radius_mm": 0.001, "min_length_mm": 0.001, "min_area_mm2": 0.001}),
    "GEO-004": Rule(1, 1.0, {"min_coordinate_mm": -100.0, "max_coordinate_mm": 5000.0}),
    "GEO-005": Rule(1, 1.0),
    "GEO-006": Rule(1, 1.0, {"center_tolerance_mm": 0.1, "radius_tolerance_pct": 0.01}),
    "GEO-007": Rule(1, 1.0, {"tolerance_mm": 0.1}),
    "GEO-008": Rule(1, 1.0, {"min_area_mm2": 1.0}),
    "MFG-001": Rule(2, 0.75, {"min_clearance_mm": 8.0}),
    "MFG-002": Rule(2, 0.70, {"min_spacing_mm": 3.0}),
    "MFG-003": Rule(2, 0.65, {"min_corner_angle_deg": 90.0}),
    "MFG-004": Rule(2, 0.65, {"tool_diameter_mm": 6.0, "multiplier": 1.2}),
    "MFG-005": Rule(2, 0.90, {"target_diameter_mm": 5.0, "target_spacing_mm": 32.0, "spacing_tolerance_mm": 0.5, "diameter_tolerance_mm": 0.5}),
    "MFG-006": Rule(2, 0.90, {"target_diameter_mm": 35.0, "diameter_tolerance_mm": 1.0, "target_edge_distance_mm": 22.5, "tolerance_mm": 1.0}),
    "MFG-007": Rule(2, 0.70, {"max_depth_ratio": 0.75, "panel_thickness_mm": 18.0}),
    "MFG-008": Rule(2, 0.70, {"max_density_ratio": 0.30}),
    "MFG-009": Rule(2, 0.75, {"min_dimension_mm": 50.0, "max_dimension_mm": 3600.0, "min_area_mm2": 5000.0}),
    "MFG-010": Rule(2, 0.70),
    "MFG-011": Rule(2, 0.75, {"min_diameter_mm": 3.0, "max_diameter_mm": 40.0}),
    "MFG-012": Rule(2, 0.75, {"tolerance_mm": 0.1}),
}
POLYLINES, MILLED = ("lwpolyline", "polyline"), ("pocket", "cut", "engrave")
BOX = ("xmin", "ymin", "xmax", "ymax")


def settings(table: DataFrame | None = None) -> dict[str, dict[str, float]]:
    """Parameters of the rules that are on; ``table`` (rule_id, enabled, params), a row a rule, goes to the driver."""
    given = {r["rule_id"]: r for r in table.collect()} if table is not None else {}
    on = {n: r for n, r in RULES.items() if n not in given or given[n]["enabled"]}
    return {n: r.params | (dict(given[n]["params"] or {}) if n in given else {}) for n, r in on.items()}


def with_panel(shapes: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The shapes with their panel's box, its outline where that is no box, and its size; of several outlines the first by node counts."""
    own = F.struct("node", "bx0", "by0", "bx1", "by1", "vertices", "area")
    p = shapes.where("is_boundary").groupBy("panel_id").agg(F.min_by(own, "node").alias("_p"))
    boxed = (F.col("_p.area") - (F.col("_p.bx1") - F.col("_p.bx0")) * (F.col("_p.by1") - F.col("_p.by0"))) > -1e-6 * F.col("_p.area")
    box = [F.col(f"_p.{a}").alias(b) for a, b in zip(("bx0", "by0", "bx1", "by1"), BOX)]
    index = p.select("panel_id", *box, F.when(~boxed, F.col("_p.vertices")).alias("outline"))
    return lookup(shapes, index, "panel_id", "node", counts=counts)


def finding(rows: DataFrame, rule: str, severity: str, measured: Column, node: Column | None = None) -> DataFrame:
    return rows.select("panel_id", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), (F.lit(None) if node is None else node).cast("string").alias("node"), measured.cast("double").alias("measured"))


def _exploded(rows: DataFrame, node: Column, tests: list[tuple[str, Column | str, Column, Column]]) -> DataFrame:
    """All tests' findings of each row in one pass; a test that null makes undecided finds nothing."""
    none = F.lit(None).cast("double")
    each = F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule_id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (none if measured is None else measured.cast("double")).alias("measured"))) for rule, severity, cond, measured in tests])
    found = rows.select("panel_id", node.cast("string").alias("node"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("_f"))
    return found.select("panel_id", "_f.rule_id", "_f.severity", "node", "_f.measured")


def outside_panel(tolerance: float) -> Column:
    """Whether a circle, or the box of any other shape, leaves its panel by more than the tolerance. Touching it from outside is allowed."""
    c = F.col
    gap = lambda a, z: F.greatest(a, z, F.lit(0.0))
    over_x, over_y = gap(c("xmin") - c("bx0"), c("bx1") - c("xmax")), gap(c("ymin") - c("by0"), c("by1") - c("ymax"))
    circle = (c("geometry_type") == "circle") & c("radius").isNotNull()
    off_x, off_y = gap(c("xmin") - c("x"), c("x") - c("xmax")), gap(c("ymin") - c("y"), c("y") - c("ymax"))
    tangent = F.abs(F.sqrt(off_x * off_x + off_y * off_y) - c("radius")) <= 1e-9
    disc = (F.greatest(over_x, over_y) > tolerance) & ~tangent
    beside = (c("bx0") == c("xmax")) | (c("bx1") == c("xmin")) | (c("by0") == c("ymax")) | (c("by1") == c("ymin"))
    meets = (c("bx0") <= c("xmax")) & (c("bx1") >= c("xmin")) & (c("by0") <= c("ymax")) & (c("by1") >= c("ymin"))
    whole_box = (F.sqrt(over_x * over_x + over_y * over_y) > tolerance) & ~(beside & meets)
    # an outline that is no box
    edges = F.zip_with("outline", g.turned(c("outline")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    near = lambda x, y: F.array_min(F.transform(edges, lambda e: g.segment_distance(x, y, e["a"][0], e["a"][1], e["b"][0], e["b"][1])))
    within = lambda x, y: g.contains_point(c("outline"), x, y)
    disc_far = F.when(within(c("x"), c("y")), near(c("x"), c("y")) < c("radius") - tolerance).otherwise(True)
    held = lambda x, y: within(x, y) | (near(x, y) <= tolerance)
    corners = held(c("bx0"), c("by0")) & held(c("bx1"), c("by0")) & held(c("bx1"), c("by1")) & held(c("bx0"), c("by1"))
    dent = F.exists("outline", lambda v: (v[0] > c("bx0") + tolerance) & (v[0] < c("bx1") - tolerance) & (v[1] > c("by0") + tolerance) & (v[1] < c("by1") - tolerance))
    return F.when(c("outline").isNull(), F.when(circle, disc).otherwise(whole_box)).when(circle, disc_far).otherwise(~corners | dent)


def over_panel() -> Column:
    """How far a shape reaches over its panel's box."""
    c = F.col
    return F.greatest(c("xmin") - c("bx0"), c("bx1") - c("xmax"), c("ymin") - c("by0"), c("by1") - c("ymax"))


def shape_tests(p: dict[str, dict[str, float]]) -> list[tuple[str, Column | str, Column, Column | None]]:
    """(rule, severity, condition, measured) of the checks that need one shape and its panel."""
    c = F.col
    v = c("vertices")
    poly, circle, ring = c("geometry_type").isin(*POLYLINES), c("geometry_type") == "circle", c("is_closed")
    inner, bore = ~c("is_boundary"), 2 * c("radius")
    hole = circle & inner
    edge = g.edge_distance(c("x"), c("y"))
    line = F.least(*[F.abs(c(a) - c(b)) for a, b in (("x", "xmin"), ("x", "xmax"), ("y", "ymin"), ("y", "ymax"))])
    tests = []
    if "GEO-001" in p:
        last = F.size(v) - 1
        gap = F.sqrt((v[last][0] - v[0][0]) * (v[last][0] - v[0][0]) + (v[last][1] - v[0][1]) * (v[last][1] - v[0][1]))
        open_end = F.when(poly & ~ring & (F.size(v) >= 2), gap)
        tests.append(("GEO-001", "ERROR", open_end > p["GEO-001"]["tolerance_mm"], open_end))
    if "GEO-002" in p:
        tests.append(("GEO-002", "ERROR", ~c("_simple") & (F.size(v) >= 4), None))
    if "GEO-003" in p:
        q = p["GEO-003"]
        size = F.when(circle, F.when(F.coalesce("radius", F.lit(0.0)) < q["min_radius_mm"], F.coalesce("radius", F.lit(0.0)))).when(c("perimeter") < q["min_length_mm"], c("perimeter")).when(ring & (c("area") < q["min_area_mm2"]), c("area"))
        tests.append(("GEO-003", "ERROR", size.isNotNull(), size))
    if "GEO-004" in p:
        low, high = F.least("bx0", "by0"), F.greatest("bx1", "by1")
        q = p["GEO-004"]
        tests.append(("GEO-004", "ERROR", (low < q["min_coordinate_mm"]) | (high > q["max_coordinate_mm"]), F.when(low < q["min_coordinate_mm"], low).otherwise(high)))
    if "GEO-005" in p:
        tests.append(("GEO-005", "WARNING", c("is_boundary") & poly & ring & F.coalesce("_simple", F.lit(False)) & (g.signed_area(v) < 0), None))
    if "GEO-007" in p:
        tests.append(("GEO-007", "ERROR", inner & c("xmin").isNotNull() & outside_panel(p["GEO-007"]["tolerance_mm"]), over_panel()))
    if "GEO-008" in p:
        tests.append(("GEO-008", "ERROR", poly & ring & inner & (c("area") < p["GEO-008"]["min_area_mm2"]), c("area")))
    if "MFG-001" in p:
        tests.append(("MFG-001", "ERROR", hole & (edge < p["MFG-001"]["min_clearance_mm"]), edge))
    milled = poly & ring & inner & c("kind").isin(*MILLED) & (F.size(v) >= 3)
    if "MFG-003" in p:
        sharp = F.when(milled & ~c("is_approximated"), g.sharpest_concave(v, p["MFG-003"]["min_corner_angle_deg"]))
        tests.append(("MFG-003", "WARNING", sharp.isNotNull(), F.bround(sharp, 1)))
    if "MFG-004" in p:
        q = p["MFG-004"]
        tests.append(("MFG-004", "WARNING", milled & (c("_widest") < q["tool_diameter_mm"] * q["multiplier"]), F.bround("_widest", 3)))
    if "MFG-006" in p:
        q = p["MFG-006"]
        cup = hole & (F.abs(bore - q["target_diameter_mm"]) <= q["diameter_tolerance_mm"])
        tests.append(("MFG-006", "WARNING", cup & (F.abs(edge - q["target_edge_distance_mm"]) > q["tolerance_mm"]), edge))
    if "MFG-007" in p:
        q = p["MFG-007"]
        tests.append(("MFG-007", "WARNING", inner & (c("depth") > q["max_depth_ratio"] * q["panel_thickness_mm"]), c("depth")))
    if "MFG-011" in p:
        q = p["MFG-011"]
        tests.append(("MFG-011", "ERROR", hole & ((bore < q["min_diameter_mm"]) | (bore > q["max_diameter_mm"])), bore))
    if "MFG-012" in p:
        tests.append(("MFG-012", "ERROR", inner & (line <= p["MFG-012"]["tolerance_mm"]), line))
    return tests


def measured_rings(shapes: DataFrame, p: dict[str, dict[str, float]]) -> DataFrame:
    """Adds ``_simple`` (of rings) and ``_widest`` (of simple ones on milled layers): the only steps in Python, and only for rings that aren't plain rectangles."""
    c = F.col
    poly = c("geometry_type").isin(*POLYLINES)
    w, h = c("bx1") - c("bx0"), c("by1") - c("by0")
    boxed = c("is_closed") & (c("area") > 0) & (c("area") > (1 - 1e-6) * w * h)
    rectangle = poly & boxed & (F.size("vertices") == 4)  # of four corners none but a rectangle's fill their box
    simple = shapes.withColumn("_simple", g.is_simple(F.when(poly & ~F.coalesce(rectangle, F.lit(False)), c("vertices"))))
    simple = simple.withColumn("_simple", F.when(rectangle, True).otherwise(c("_simple")))
    asked = poly & c("is_closed") & ~c("is_boundary") & c("kind").isin(*MILLED) & c("_simple") & (c("area") > 0)
    if "MFG-004" not in p:
        return simple
    enough = p["MFG-004"]["tool_diameter_mm"] * p["MFG-004"]["multiplier"]
    other = simple.withColumn("_widest", g.widest_circle(F.when(asked & ~boxed, c("vertices")), enough))
    return other.withColumn("_widest", F.when(asked & boxed, F.least(w, h)).when(asked, F.nanvl("_widest", F.lit(None).cast("double"))))


def pair_findings(shapes: DataFrame, p: dict[str, dict[str, float]]) -> DataFrame | None:
    """GEO-006 and MFG-002 from one join of near circles."""
    gap = distance() - F.col("radius_a") - F.col("radius_b")
    mean = F.when(F.col("radius_a") + F.col("radius_b") > 0, (F.col("radius_a") + F.col("radius_b")) / 2).otherwise(1.0)
    tests, reach = [], 0.0
    if "GEO-006" in p:
        q, reach = p["GEO-006"], p["GEO-006"]["center_tolerance_mm"]
        tests.append(("GEO-006", "WARNING", (distance() <= q["center_tolerance_mm"]) & (F.abs(F.col("radius_a") - F.col("radius_b")) / mean <= q["radius_tolerance_pct"]), distance()))
    if "MFG-002" in p:
        least = p["MFG-002"]["min_spacing_mm"]
        reach = max(reach, least)
        tests.append(("MFG-002", "ERROR", ~F.col("is_boundary_a") & ~F.col("is_boundary_b") & (gap < least), gap))
    if not tests:
        return None
    circles = shapes.where("geometry_type = 'circle' and radius is not null").withColumn("_d", 2 * F.col("radius"))
    any_of = tests[0][2] if len(tests) == 1 else tests[0][2] | tests[1][2]
    pairs = near_pairs(circles, "panel_id", "node", reach, any_of, ["radius", "is_boundary"], size="_d")
    return _exploded(pairs, F.concat_ws("+", "node_a", "node_b"), tests)


def pin_grid(shapes: DataFrame, q: dict[str, float] = RULES["MFG-005"].params) -> DataFrame:
    """Pairs of pin bores at least half a grid apart that are off the grid."""
    pins = shapes.where((F.col("geometry_type") == "circle") & ~F.col("is_boundary") & (F.abs(2 * F.col("radius") - q["target_diameter_mm"]) <= q["diameter_tolerance_mm"]))
    d, grid = distance(), q["target_spacing_mm"]
    off = F.least(d % grid, grid - d % grid)
    pairs = block_pairs(pins, "panel_id", "node", ["x", "y"]).where((d >= grid / 2) & (off > q["spacing_tolerance_mm"]))
    return finding(pairs, "MFG-005", "WARNING", d, F.concat_ws("+", "node_a", "node_b"))


def same_winding(shapes: DataFrame) -> DataFrame:
    """GEO-005 of inner rings: those that wind as the smallest ring around them."""
    ring = shapes.where(F.col("geometry_type").isin(*POLYLINES) & F.col("is_closed") & F.col("_simple") & (F.col("area") > 0))
    at = g.inner_point(F.col("vertices"))
    ccw = (g.signed_area(F.col("vertices")) > 0).alias("ccw")
    named = ring.select(F.col("panel_id").alias("drawing"), F.col("node").alias("seq"), at.alias("_at"), "area", "vertices", "is_boundary", ccw, *[F.col(a).alias(b) for a, b in zip(("bx0", "by0", "bx1", "by1"), BOX)]).select("*", "_at.x", "_at.y")
    around = inside(named.where("not is_boundary"), named, F.col("outer_area") > F.col("area"))
    parent = around.groupBy("drawing", "seq").agg(F.min_by("outer", F.struct("outer_area", "outer")).alias("outer"))
    met = parent.join(named.select("drawing", "seq", "ccw"), ["drawing", "seq"]).join(named.select("drawing", F.col("seq").alias("outer"), F.col("ccw").alias("_around")), ["drawing", "outer"])
    return finding(met.where(F.col("ccw") == F.col("_around")).withColumnRenamed("drawing", "panel_id"), "GEO-005", "INFO", F.lit(None), F.col("seq"))


def density(shapes: DataFrame, q: dict[str, float] = RULES["MFG-008"].params) -> DataFrame:
    """The areas of all inner shapes against the panel's box, summed in whole ten-thousandths of a mm2, so that no order of summing shows."""
    by = shapes.where("not is_boundary and area > 0").groupBy("panel_id").agg(F.sum(F.round(F.col("area") * 10_000).cast("bigint")).alias("_a"), *[F.first(b).alias(b) for b in BOX])
    share = F.col("_a") / 10_000 / ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    sized = (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))
    return finding(by.where(sized & (share > q["max_density_ratio"])), "MFG-008", "WARNING", share)


def panel_size(shapes: DataFrame, q: dict[str, float] = RULES["MFG-009"].params) -> DataFrame:
    w, h = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    bad = lambda c: (c < q["min_dimension_mm"]) | (c > q["max_dimension_mm"])
    tests = F.array(F.when(bad(w), F.struct(F.lit("width").alias("node"), w.alias("m"))), F.when(bad(h), F.struct(F.lit("height").alias("node"), h.alias("m"))), F.when(w * h < q["min_area_mm2"], F.struct(F.lit("area").alias("node"), (w * h).alias("m"))))
    each = shapes.where("is_boundary").select("panel_id", F.explode(tests).alias("_t")).where("_t is not null")
    return finding(each, "MFG-009", "WARNING", F.col("_t.m"), F.col("_t.node"))


def findings(shapes: DataFrame, params: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The findings of all rules that are on. ``shapes`` come from ``with_panel``."""
    p = settings() if params is None else params
    rings = measured_rings(shapes, p) if {"GEO-002", "GEO-005", "MFG-004"} & set(p) else shapes
    out = [] if not shape_tests(p) else [_exploded(rings, F.col("node"), shape_tests(p))]
    if (pairs := pair_findings(shapes, p)) is not None:
        out.append(pairs)
    if "GEO-005" in p:
        out.append(same_winding(rings))
    out += [f(shapes, p[n]) for n, f in (("MFG-005", pin_grid), ("MFG-008", density), ("MFG-009", panel_size)) if n in p]
    return reduce(DataFrame.unionByName, out)


def results(shapes: DataFrame, found: DataFrame, params: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """All findings, and a row of severity PASS for each panel and rule without any; machining rules only where no geometric error stands."""
    names = sorted(settings() if params is None else params)
    layer = F.when(F.col("rule_id").startswith("GEO"), 1).otherwise(2)
    by = found.groupBy("panel_id").agg(F.collect_set("rule_id").alias("_broken"), F.max((layer == 1) & (F.col("severity") == "ERROR")).alias("_stop"))
    panels = shapes.select("panel_id").distinct().join(by, "panel_id", "left")
    empty = F.array().cast("array<string>")
    stopped = F.coalesce("_stop", F.lit(False))
    asked = F.filter(F.lit(names), lambda n: ~stopped | n.startswith("GEO"))
    kept = panels.select("panel_id", F.explode(F.array_except(asked, F.coalesce("_broken", empty))).alias("rule_id"))
    passes = kept.select("panel_id", "rule_id", F.lit("PASS").alias("severity"), F.lit(None).cast("string").alias("node"), F.lit(None).cast("double").alias("measured"))
    gates = by.select("panel_id", "_stop")
    counted = found.join(gates, "panel_id").where(~F.col("_stop") | (layer == 1)).drop("_stop")
    return counted.unionByName(passes)


def report(shapes: DataFrame, found: DataFrame) -> DataFrame:
    """One row a panel: whether each layer passed, findings by severity, and how many nodes are named in them; machining findings count where there is no geometric error."""
    one = F.col("rule_id").startswith("GEO")
    error, warning, info = (F.col("severity") == s for s in ("ERROR", "WARNING", "INFO"))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    names = {"e": error, "w": warning, "i": info}
    by = found.groupBy("panel_id").agg(*[count((one if k == 1 else ~one) & c).alias(f"{n}{k}") for n, c in names.items() for k in (1, 2)])
    cols = [f"{n}{k}" for n in names for k in (1, 2)]
    r = shapes.select("panel_id").distinct().join(by, "panel_id", "left").na.fill(0, cols)
    gate = F.col("e1") == 0
    total = lambda n: F.col(f"{n}1") + F.when(gate, F.col(f"{n}2")).otherwise(0)
    return r.select(
        "panel_id",
        gate.alias("layer1_passed"),
        (~gate | (F.col("e2") == 0)).alias("layer2_passed"),
        total("e").alias("n_error"),
        total("w").alias("n_warning"),
        total("i").alias("n_info"),
        (gate & (F.col("e2") == 0)).alias("overall_valid"),
        (total("w") > 0).alias("has_warnings"),
    )


def failed_nodes(found: DataFrame) -> DataFrame:
    """(panel_id, node) of every node that a counted finding names."""
    one = F.col("rule_id").startswith("GEO")
    stop = found.where(one & (F.col("severity") == "ERROR")).select("panel_id").distinct()
    two = found.where(~one).join(stop, "panel_id", "left_anti")
    named = found.where(one).unionByName(two).where(F.col("node").isNotNull() & (F.col("rule_id") != "MFG-009"))
    return named.select("panel_id", F.explode(F.split("node", r"\+")).alias("node")).distinct()


def constraints(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Constraint nodes of findings, and their APPLIES_TO links: (panel_id, constraint_id, rule_id, severity) and (panel_id, src, dst)."""
    key = F.concat_ws("-", F.lit("constraint"), "rule_id", F.coalesce("node", F.lit("panel"))).alias("constraint_id")
    nodes = found.select("panel_id", key, "rule_id", "severity")
    links = found.where("node is not null and rule_id <> 'MFG-009'").select("panel_id", key.alias("src"), F.explode(F.split("node", r"\+")).alias("dst"))
    return nodes, links
