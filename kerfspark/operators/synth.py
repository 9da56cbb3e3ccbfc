"""Seeded synthetic panels, generated where they are used and kept only if the rules agree with their intent.

Sample i draws from its own generator (seed + i), so any executor makes the same sample and any range of samples can be
made alone. A panel has a type, which says what features it may have; holes and milled features are drawn by weight, placed
with margins a little wider than the rules', and dropped where no place is found in a few tries. Faults are put in on
purpose; the gate then runs the same rule plans as on real panels over all samples at once and keeps those whose verdict is
the intended one, and broken ones only if the rule that their fault is made for found it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfspark.functions import geometry as g
from kerfspark.functions.layers import layer_type
from kerfspark.operators import rules
from kerfspark.runtime import cut

FEATURE = "seq:int,feature_class:string,layer:string,x:double,y:double,diameter:double,vertices:array<array<double>>,is_closed:boolean,is_approximated:boolean,depth:double,group_id:string"
SAMPLE = f"panel_id bigint, panel_type string, w double, h double, thickness double, intended_valid boolean, fault string, features array<struct<{FEATURE}>>"
# Weights of panel types; sizes and thicknesses in mm with their weights; features that a type may have; weights of
# features; mean numbers of holes by type and of milled features, and their bounds; margins of placing, in mm.
TYPES = {"generic": 0.35, "side_panel": 0.30, "shelf": 0.15, "door": 0.10, "back_panel": 0.05, "bottom_top": 0.05}
WIDTHS = {300: 0.10, 400: 0.10, 450: 0.10, 500: 0.15, 600: 0.25, 800: 0.10, 900: 0.10, 1000: 0.05, 1200: 0.05}
HEIGHTS = {300: 0.10, 600: 0.20, 720: 0.25, 900: 0.10, 1980: 0.15, 2100: 0.10, 2200: 0.10}
THICKNESSES = {12.0: 0.05, 15.0: 0.10, 16.0: 0.15, 18.0: 0.55, 22.0: 0.10, 25.0: 0.05}
ALLOWED = {
    "side_panel": ["SHELF_PIN_HOLE", "HINGE_CUP_HOLE", "DOWEL_HOLE", "CONFIRMAT_HOLE", "THROUGH_HOLE", "BLIND_HOLE", "GROOVE", "DADO", "RABBET", "POCKET"],
    "door": ["HINGE_CUP_HOLE", "THROUGH_HOLE", "POCKET", "INTERNAL_CUTOUT", "COUNTERSINK"],
    "shelf": ["THROUGH_HOLE", "DOWEL_HOLE", "GROOVE", "DADO", "RABBET", "BLIND_HOLE"],
    "back_panel": ["THROUGH_HOLE", "GROOVE", "INTERNAL_CUTOUT"],
    "bottom_top": ["DOWEL_HOLE", "CONFIRMAT_HOLE", "THROUGH_HOLE", "GROOVE", "RABBET", "OPEN_SLOT"],
}
WEIGHTS = {
    "SHELF_PIN_HOLE": 6.0, "HINGE_CUP_HOLE": 4.0, "DOWEL_HOLE": 5.0, "CONFIRMAT_HOLE": 4.0, "THROUGH_HOLE": 6.0, "BLIND_HOLE": 2.0, "COUNTERSINK": 1.5, "COUNTERBORE": 1.5,
    "POCKET": 1.4, "THROUGH_POCKET": 1.0, "GROOVE": 1.5, "DADO": 1.2, "RABBET": 1.4, "OPEN_SLOT": 1.0, "INTERNAL_CUTOUT": 1.0,
}
HOLES_MEAN, HOLES_OF, HOLES_MOST = 8.0, {"side_panel": 14.0, "door": 2.0, "shelf": 2.0, "back_panel": 0.2}, 40
MILLED_MEAN, MILLED_MOST = 1.2, 4
EDGE_MM, WALL_MM, LEAST_DIAMETER_MM = 8.5, 3.5, 3.2
BORES, BORE_BAND_MM = [5.0, 7.0, 8.0, 10.0, 15.0, 35.0], 1.05
# Sizes of milled features in mm, least and most.
SQUARES = {"POCKET": (8.0, 60.0), "THROUGH_POCKET": (20.0, 80.0), "INTERNAL_CUTOUT": (40.0, 120.0)}
CORNER_MM, ARC_STEPS = 3.0, 6
TRIES = 12


@dataclass
class Feature:
    name: str
    layer: str
    x: float
    y: float
    diameter: float | None = None
    vertices: list | None = None
    closed: bool = True
    bent: bool = False
    depth: float | None = None
    group: str | None = None


@dataclass
class Panel:
    kind: str
    w: float
    h: float
    thickness: float
    found: list[Feature] = field(default_factory=list)

    def bores(self) -> list[Feature]:
        return [f for f in self.found if f.diameter]

    def fits(self, x: float, y: float, d: float, edge: float = EDGE_MM) -> bool:
        """Whether a bore keeps its distance to the sides and to the other bores, and lies within."""
        side, r = min(x, self.w - x, y, self.h - y), d / 2
        return side >= max(edge, r) and all(math.hypot(x - f.x, y - f.y) - r - f.diameter / 2 >= WALL_MM for f in self.bores())


def rounded(cx: float, cy: float, w: float, h: float) -> list[list[float]]:
    """A clockwise rectangle whose corners are arcs that a tool can cut."""
    r = min(CORNER_MM, w / 2 - 0.01, h / 2 - 0.01)
    out = []
    for sx, sy, start in ((1, 1, 90), (1, -1, 0), (-1, -1, -90), (-1, 1, -180)):
        for k in range(ARC_STEPS + 1):
            a = math.radians(start - 90 * k / ARC_STEPS)
            out.append([round(cx + sx * (w / 2 - r) + r * math.cos(a), 4), round(cy + sy * (h / 2 - r) + r * math.sin(a), 4)])
    return out


def sharp(x0: float, y0: float, x1: float, y1: float) -> list[list[float]]:
    return [[x0, y0], [x0, y1], [x1, y1], [x1, y0]]


def choose(r: np.random.Generator, weighted: dict):
    p = np.array(list(weighted.values()), dtype=float)
    return list(weighted)[int(r.choice(len(p), p=p / p.sum()))]


def allowed(kind: str) -> dict[str, float]:
    """The features a type of panel may have, with their weights; any for a type without a list."""
    return {n: WEIGHTS[n] for n in ALLOWED.get(kind, WEIGHTS)}


def bore_size(name: str, r: np.random.Generator) -> float:
    """A diameter of a class; a plain through hole keeps away from the sizes of hardware."""
    if name in ("SHELF_PIN_HOLE", "CONFIRMAT_HOLE", "HINGE_CUP_HOLE"):
        mean, spread = {"SHELF_PIN_HOLE": (5.0, 0.05), "CONFIRMAT_HOLE": (7.0, 0.05), "HINGE_CUP_HOLE": (35.0, 0.1)}[name]
        return float(r.normal(mean, spread))
    if name == "DOWEL_HOLE":
        return float(r.choice([8.0, 10.0]))
    if name == "BLIND_HOLE":
        return float(r.uniform(11.5, 13.5))
    if name in ("COUNTERSINK", "COUNTERBORE"):
        return {"COUNTERSINK": 12.0, "COUNTERBORE": 13.0}[name]
    for _ in range(TRIES):
        d = float(r.uniform(4.0, 30.0))
        if all(abs(d - b) > BORE_BAND_MM for b in BORES):
            break
    return d


def pin_column(p: Panel, r: np.random.Generator, name: str) -> list[Feature]:
    """Three to nine pin holes in a column on the grid of 32 mm, 37 mm from a side."""
    x = 37.0 if r.random() < 0.5 else p.w - 37.0
    steps = int((p.h - 2 * 37.0) // 32)
    if steps < 2:
        return []
    n = int(r.integers(3, min(9, steps + 1) + 1))
    start, d = int(r.integers(0, steps + 2 - n)), bore_size(name, r)
    column = [Feature(name, "DRILL_5MM", x, 37.0 + 32.0 * (start + k), d, depth=float(min(12.0, p.thickness - 3))) for k in range(n)]
    fits = [f for f in column if p.fits(f.x, f.y, d)]
    return fits if len(fits) >= 3 else []


def hinge_cup(p: Panel, r: np.random.Generator, name: str) -> list[Feature]:
    d = bore_size(name, r)
    for _ in range(TRIES):
        along = float(r.uniform(60.0, max(60.1, p.h - 60.0)))
        x = 22.5 if r.random() < 0.5 else p.w - 22.5
        if p.fits(x, along, d):
            return [Feature(name, "HINGE_35", x, along, d, depth=min(13.0, p.thickness - 2))]
    return []


def screw_pair(p: Panel, r: np.random.Generator, name: str) -> list[Feature]:
    """Two screw holes 64 mm apart, near a side."""
    d = bore_size(name, r)
    for _ in range(TRIES):
        y, x = float(r.uniform(20.0, max(20.1, p.h - 84.0))), float(r.choice([12.0, p.w - 12.0]))
        if p.fits(x, y, d) and p.fits(x, y + 64.0, d):
            return [Feature(name, "CONFIRMAT_7", x, y + k, d) for k in (0.0, 64.0)]
    return []


def single_hole(p: Panel, r: np.random.Generator, name: str) -> list[Feature]:
    d = bore_size(name, r)
    depth = {"BLIND_HOLE": 0.6 * p.thickness, "DOWEL_HOLE": 0.5 * p.thickness, "COUNTERSINK": 3.0, "COUNTERBORE": 5.0}.get(name)
    for _ in range(TRIES):
        gap = max(EDGE_MM, d / 2) + 0.5
        x, y = float(r.uniform(gap, p.w - gap)), float(r.uniform(gap, p.h - gap))
        if p.fits(x, y, d):
            return [Feature(name, "DRILL", round(x, 3), round(y, 3), d, depth=None if depth is None else min(depth, 13.0))]
    return []


def milled_square(p: Panel, r: np.random.Generator, name: str) -> list[Feature]:
    low, high = SQUARES[name]
    w, h = float(r.uniform(low, high)), float(r.uniform(low, high))
    if w + 2 * EDGE_MM >= p.w or h + 2 * EDGE_MM >= p.h:
        return []
    x, y = float(r.uniform(EDGE_MM + w / 2, p.w - EDGE_MM - w / 2)), float(r.uniform(EDGE_MM + h / 2, p.h - EDGE_MM - h / 2))
    depth = float(min(r.uniform(3.0, 10.0), p.thickness - 3)) if name == "POCKET" else None
    return [Feature(name, "CUT" if name == "INTERNAL_CUTOUT" else "POCKET", x, y, vertices=rounded(x, y, w, h), bent=True, depth=depth)]


def slot(p: Panel, r: np.random.Generator, name: str) -> list[Feature]:
    """A groove along the panel's longer side, or a dado across it."""
    along_x = (p.w >= p.h) == (name == "GROOVE")
    length, across = (p.w, p.h) if along_x else (p.h, p.w)
    wide, long_ = float(r.uniform(8.0, 18.0)), length - 2 * EDGE_MM
    at = float(r.uniform(EDGE_MM + wide / 2, across - EDGE_MM - wide / 2))
    x, y, w, h = (length / 2, at, long_, wide) if along_x else (at, length / 2, wide, long_)
    return [Feature(name, "GROOVE", x, y, vertices=rounded(x, y, w, h), bent=True, depth=float(min(r.uniform(4.0, 9.0), p.thickness - 3)))]


def edge_step(p: Panel, r: np.random.Generator, name: str) -> list[Feature]:
    """A rabbet along a whole side, or an open slot that runs in from it."""
    deep = float(r.uniform(18.0, 30.0))
    wide = p.w if name == "RABBET" else float(r.uniform(10.0, 20.0))
    if name == "OPEN_SLOT" and p.w < wide + 4 * EDGE_MM:
        return []
    x0 = 0.0 if name == "RABBET" else float(r.uniform(2 * EDGE_MM, p.w - 2 * EDGE_MM - wide))
    v = sharp(x0, 0.0, x0 + wide, deep)
    return [Feature(name, "RABBET" if name == "RABBET" else "SLOT", x0 + wide / 2, deep / 2, vertices=v, depth=float(min(r.uniform(4.0, 9.0), p.thickness - 3)))]


#: How each class of feature is made.
MAKERS: dict[str, Callable[[Panel, np.random.Generator, str], list[Feature]]] = {
    "SHELF_PIN_HOLE": pin_column, "HINGE_CUP_HOLE": hinge_cup, "CONFIRMAT_HOLE": screw_pair, "DOWEL_HOLE": single_hole, "THROUGH_HOLE": single_hole, "BLIND_HOLE": single_hole, "COUNTERSINK": single_hole,
    "COUNTERBORE": single_hole, "POCKET": milled_square, "THROUGH_POCKET": milled_square, "INTERNAL_CUTOUT": milled_square, "GROOVE": slot, "DADO": slot, "RABBET": edge_step, "OPEN_SLOT": edge_step,
}
HOLES = [n for n in MAKERS if n.endswith("_HOLE") or n.startswith("COUNTER")]


def free_ring(p: Panel, r: np.random.Generator, w: float, h: float) -> tuple[float, float]:
    return float(r.uniform(EDGE_MM, max(EDGE_MM + 0.1, p.w - w - EDGE_MM))), float(r.uniform(EDGE_MM, max(EDGE_MM + 0.1, p.h - h - EDGE_MM)))


def near_edge(p: Panel, r: np.random.Generator) -> bool:
    f = _any_bore(p, r)
    if f:
        f.x = f.diameter / 2 + 0.5 if f.diameter < 14 else 7.5
    return f is not None and f.x < 8.0


def crowded(p: Panel, r: np.random.Generator) -> bool:
    f = _any_bore(p, r)
    if f:
        d, way = 6.4, 1 if f.x < p.w / 2 else -1
        p.found.append(Feature("THROUGH_HOLE", "DRILL", f.x + way * ((f.diameter + d) / 2 + 1.0), f.y, d))
    return f is not None


def undersized(p: Panel, r: np.random.Generator) -> bool:
    f = _any_bore(p, r)
    if f:
        f.diameter = 2.0
    return f is not None


def outside(p: Panel, r: np.random.Generator) -> bool:
    f = _any_bore(p, r)
    if f:
        f.x = -f.diameter
    return f is not None


def open_contour(p: Panel, r: np.random.Generator) -> bool:
    x, y = free_ring(p, r, 40.0, 30.0)
    p.found.append(Feature("POCKET", "POCKET", x + 20, y + 15, vertices=sharp(x, y, x + 40, y + 30), closed=False))
    return True


def sharp_corner(p: Panel, r: np.random.Generator) -> bool:
    x, y = free_ring(p, r, 60.0, 60.0)
    v = [[x, y], [x, y + 60], [x + 30, y + 18], [x + 60, y + 60], [x + 60, y]]
    p.found.append(Feature("POCKET", "POCKET", x + 30, y + 15, vertices=v))
    return True


def narrow_pocket(p: Panel, r: np.random.Generator) -> bool:
    x, y = free_ring(p, r, 60.0, 4.0)
    p.found.append(Feature("POCKET", "POCKET", x + 30, y + 2, vertices=sharp(x, y, x + 60, y + 4)))
    return True


def _any_bore(p: Panel, r: np.random.Generator) -> Feature | None:
    bores = p.bores()
    return bores[int(r.integers(len(bores)))] if bores else None


#: The rule that each fault is made to break, and how.
FAULTS: dict[str, tuple[str, Callable[[Panel, np.random.Generator], bool]]] = {
    "edge_clearance": ("MFG-001", near_edge), "spacing": ("MFG-002", crowded), "undersized": ("MFG-011", undersized), "outside": ("GEO-007", outside),
    "open_contour": ("GEO-001", open_contour), "sharp_corner": ("MFG-003", sharp_corner), "narrow_pocket": ("MFG-004", narrow_pocket),
}


def sample(index: int, seed: int, invalid: float) -> tuple:
    r = np.random.default_rng(seed + index)
    kind = choose(r, TYPES)
    p = Panel(kind, float(choose(r, WIDTHS)), float(choose(r, HEIGHTS)), float(choose(r, THICKNESSES)))
    may = allowed(kind)
    holes, milled = {n: w for n, w in may.items() if n in HOLES}, {n: w for n, w in may.items() if n not in HOLES}
    wanted = int(np.clip(r.poisson(HOLES_OF.get(kind, HOLES_MEAN)), 0, HOLES_MOST)) if holes else 0
    for _ in range(wanted):
        if len(p.bores()) >= wanted:
            break
        name = choose(r, holes)
        made = MAKERS[name](p, r, name)
        if len(made) > 1:
            group = f"{name.lower()}_{len(p.found)}"
            for f in made:
                f.group = group
        p.found += made
    for _ in range(int(np.clip(r.poisson(MILLED_MEAN), 0, MILLED_MOST)) if milled else 0):
        name = choose(r, milled)
        p.found += MAKERS[name](p, r, name)
    fault = None
    if r.random() < invalid:
        for name in r.permutation(list(FAULTS)):
            if FAULTS[str(name)][1](p, r):
                fault = str(name)
                break
    rows = [(i + 1, f.name, f.layer, f.x, f.y, f.diameter, f.vertices, f.closed, f.bent, f.depth, f.group) for i, f in enumerate(p.found)]
    return index, kind, p.w, p.h, p.thickness, fault is None, fault, rows


def generate(spark: SparkSession, n: int, seed: int = 0, invalid: float = 0.3, start: int = 0) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SAMPLE.split(", ")]
        keys = [x.split(":")[0] for x in FEATURE.split(",")]
        for b in batches:
            rows = [sample(int(i), seed, invalid) for i in b["id"]]
            yield pd.DataFrame([(*r[:7], [dict(zip(keys, f)) for f in r[7]]) for r in rows], columns=names)

    return spark.range(start, start + n).mapInPandas(make, SAMPLE)


def shapes(samples: DataFrame) -> DataFrame:
    """The outlines, bores and rings of samples, as the rules take them."""
    c = F.col
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    w, h = c("w"), c("h")
    ring = F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h), F.array(zero, h))
    no = F.lit(False)
    p = samples.select("panel_id", F.lit("boundary").alias("node"), F.lit("lwpolyline").alias("geometry_type"), F.lit("BORDER").alias("layer"), F.lit("border").alias("kind"), ring.alias("vertices"), (w / 2).alias("x"), (h / 2).alias("y"), none.alias("radius"), F.lit(True).alias("is_closed"), no.alias("is_approximated"), F.lit(True).alias("is_boundary"), (w * h).alias("area"), (2 * (w + h)).alias("perimeter"), zero.alias("bx0"), zero.alias("by0"), w.alias("bx1"), h.alias("by1"), none.alias("depth"))
    f = samples.select("panel_id", F.explode("features").alias("_f")).select("panel_id", "_f.*", (c("_f.diameter") / 2).alias("radius"))
    r, x, y, v = c("radius"), c("x"), c("y"), c("vertices")
    bore, box = r.isNotNull(), g.box(v)
    pi = 3.141592653589793
    pick = lambda a, b: F.when(bore, a).otherwise(b)
    node = F.concat(pick(F.lit("h"), F.lit("m")), c("seq").cast("string"))
    inner = f.select("panel_id", node.alias("node"), pick(F.lit("circle"), F.lit("lwpolyline")).alias("geometry_type"), "layer", layer_type(c("layer")).alias("kind"), "vertices", "x", "y", "radius", "is_closed", "is_approximated", no.alias("is_boundary"), pick(pi * r * r, F.when(c("is_closed"), F.abs(g.signed_area(v)))).alias("area"), pick(2 * pi * r, g.ring_length(v, c("is_closed"))).alias("perimeter"), pick(x - r, box["xmin"]).alias("bx0"), pick(y - r, box["ymin"]).alias("by0"), pick(x + r, box["xmax"]).alias("bx1"), pick(y + r, box["ymax"]).alias("by1"), "depth")
    return p.unionByName(inner)


def gated(samples: DataFrame) -> DataFrame:
    """The samples whose verdict by the rules is the intended one, with the rules they break.

    A sample that is to be broken is kept if the rule of its fault found it, be that a warning only.
    """
    s = rules.with_panel(shapes(samples))
    found = cut(rules.findings(s))
    verdict = rules.report(s, found).select("panel_id", "overall_valid")
    sets = found.groupBy("panel_id").agg(F.array_sort(F.collect_set(F.when(F.col("severity") == "ERROR", F.col("rule_id")))).alias("broken_rules"), F.collect_set("rule_id").alias("_all"))
    rule = F.element_at(F.create_map(*[F.lit(x) for n, (rule, _) in FAULTS.items() for x in (n, rule)]), F.col("fault"))
    met = samples.join(verdict, "panel_id").join(sets, "panel_id", "left")
    kept = met.where(F.when(F.col("intended_valid"), F.col("overall_valid")).otherwise(F.array_contains(F.coalesce("_all", F.array().cast("array<string>")), rule)))
    return kept.withColumn("broken_rules", F.coalesce("broken_rules", F.array().cast("array<string>"))).drop("overall_valid", "_all")


# Other names of layers that drawings use for the same.
ALIASES = {"DRILL": ["BORE", "HOLE", "PUNCH"], "POCKET": ["SLOT"], "CUT": ["PROFILE", "CONTOUR"], "GROOVE": ["DADO"]}


def jittered(samples: DataFrame, sigma: float = 0.1, copies: float = 0.05, seed: int = 0, layers: float = 0.0, degrees: float = 0.0) -> DataFrame:
    """Noise: diameters jittered around their value, a share of features delivered twice, a share of layers under another name, all turned about the panel's middle; the same for the same seed."""
    noise = lambda f, k: (F.pmod(F.xxhash64(F.lit(seed), F.col("panel_id"), f["seq"], F.lit(k)), F.lit(10_000)) + 0.5) / 10_000
    normal = lambda f: F.sqrt(-2 * F.log(noise(f, 0))) * F.cos(2 * 3.141592653589793 * noise(f, 1))
    names = F.create_map(*[x for n, of in ALIASES.items() for x in (F.lit(n), F.array(*map(F.lit, of)))])
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    cx, cy = F.col("w") / 2, F.col("h") / 2
    turn = lambda x, y: (cx + (x - cx) * cos - (y - cy) * sin, cy + (x - cx) * sin + (y - cy) * cos)

    def moved(f):
        other = F.element_at(names, f["layer"])
        alias = F.when((noise(f, 3) < layers) & other.isNotNull(), F.get(other, F.floor(noise(f, 4) * F.size(other)).cast("int"))).otherwise(f["layer"])
        x, y = turn(f["x"], f["y"])
        out = f.withField("diameter", F.when(f["diameter"].isNotNull(), F.greatest(F.lit(0.5), F.round(f["diameter"] + sigma * normal(f), 3)))).withField("layer", alias)
        if degrees:
            out = out.withField("x", x).withField("y", y).withField("vertices", F.transform(f["vertices"], lambda v: F.array(*turn(v[0], v[1]))))
        return out

    noisy = F.transform("features", moved)
    again = F.filter(noisy, lambda f: noise(f, 2) < copies)
    return samples.withColumn("features", F.concat(noisy, again))
