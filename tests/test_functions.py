import math
import random

import pytest
from pyspark.sql import functions as F

from kerfspark import runtime
from kerfspark.functions import geometry as g
from kerfspark.functions import layers
from kerfspark.operators import classify, graphs, identify, metrics, pid, rules
from kerfspark.operators.pairs import band_pairs, block_pairs, distance, near_pairs


@pytest.mark.parametrize("layer,kind,depth,thickness", [("POCKET_6MM", "pocket", 6.0, 6.0), ("GROOVE_D6", "pocket", 6.0, None), ("ENGRAVE_1.5", "engrave", None, None), ("PANEL_18MM", "unknown", None, 18.0), ("THK18", "unknown", None, 18.0), ("pocket_3P5mm", "pocket", 3.5, 3.5), ("LAYER2", "unknown", None, None), ("DRILL_DP12", "drill", 12.0, None), (" cut ", "cut", None, None), ("", "unknown", None, None), (None, "unknown", None, None), ("D500", "unknown", None, None), ("DRILL_D5_A", "drill", None, None), ("POCKET_DEPTH=6.5", "pocket", 6.5, None), ("POCKET_D6.5X", "pocket", 6.0, None), ("POCKET 12 MM deep", "pocket", 12.0, 12.0), ("POCKET_D1000", "pocket", None, None), ("CUT_ST19", "cut", None, 19.0), ("POCKET_6MM_A", "pocket", None, None), ("POCKET_.5MM", "pocket", None, None)])
def test_layers(spark, layer, kind, depth, thickness):
    k = layers.layer_type(F.col("l"))
    r = spark.createDataFrame([(layer,)], "l string").select(k.alias("k"), layers.depth_from_layer(F.col("l"), k).alias("d"), layers.thickness_from_layer(F.col("l")).alias("t")).first()
    assert (r.k, r.t) == (kind, thickness) and (r.d == depth or kind == "unknown")


def test_longest_prefix(spark):
    own = {"cut": ["CU"], "pocket": ["CUT_POCKET"]}
    r = spark.createDataFrame([("CUT_POCKET_1",)], "l string").select(layers.layer_type(F.col("l"), own).alias("a"), layers.layer_type_longest(F.col("l"), own).alias("b")).first()
    assert (r.a, r.b) == ("cut", "pocket")


def test_geometry(spark):
    v = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]]
    r = spark.createDataFrame([(v, v[::-1], [[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 4.0]], [])], "a array<array<double>>, b array<array<double>>, c array<array<double>>, e array<array<double>>").select(
        g.signed_area(F.col("a")).alias("left"), g.signed_area(F.col("b")).alias("right"), g.inner_point(F.col("a"))["y"].alias("x"), g.area_centroid(F.col("a"))["x"].alias("cx"), g.ring_length(F.col("a"), F.lit(False)).alias("open"),
        g.contains_point(F.col("a"), F.lit(1.0), F.lit(1.0)).alias("i"), g.contains_point(F.col("a"), F.lit(5.0), F.lit(1.0)).alias("o"), g.signed_area(F.col("e")).alias("none"), g.segment_distance(*map(F.lit, (0.0, 5.0, -1.0, 0.0, 1.0, 0.0))).alias("d"))
    assert tuple(r.first()) == (12.0, -12.0, 1.5, 2.0, 11.0, True, False, 0.0, 5.0)


@pytest.mark.parametrize("hot", [3, 10**9])
def test_lookup(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    rows = [(i, "a" if i % 3 else None if i % 2 else f"k{i}") for i in range(60)]
    index = [("a", 1), ("k0", 2), ("unused", 3)]
    got = runtime.lookup(spark.createDataFrame(rows, "i int, k string"), spark.createDataFrame(index, "k string, v int"), "k", "i").collect()
    want = dict(index)
    assert {(r.i, r.k, r.v) for r in got} == {(i, k, want.get(k)) for i, k in rows} and len(got) == 60


def test_cut_and_forget(spark):
    d = runtime.cut(spark.range(5).withColumn("a", F.array(F.lit(None).cast("string"))))
    assert d.count() == 5
    runtime.forget(d)
    with pytest.raises(Exception):
        spark.read.parquet(d._cut_path).count()
    assert runtime.cut(spark.range(0)).count() == 0


def test_pairs_against_all_pairs(spark):
    r = random.Random(8)
    pts = [(i % 3, i, r.choice([r.uniform(-100, 300), 37.0]), r.uniform(-50, 200)) for i in range(150)] + [(0, 999, None, 1.0)]
    d = spark.createDataFrame(pts, "p int, seq int, x double, y double")
    near = {(x.seq_a, x.seq_b) for x in near_pairs(d, "p", "seq", 20.0, distance() <= 20.0).collect()}
    ok = [q for q in pts if q[2] is not None]
    sized = d.withColumn("size", F.when(F.col("seq") % 17 == 0, 90.0 + F.col("seq")).otherwise(F.col("seq") % 7 + 0.5))
    got = {(x.seq_a, x.seq_b) for x in near_pairs(sized, "p", "seq", 3.0, distance() <= F.greatest("size_a", "size_b") + 3, ["size"], size="size", usual=8.0).collect()}
    size = lambda q: 90.0 + q[1] if q[1] % 17 == 0 else q[1] % 7 + 0.5
    assert got == {(a[1], b[1]) for a in ok for b in ok if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:], b[2:]) <= max(size(a), size(b)) + 3}
    assert near == {(a[1], b[1]) for a in ok for b in ok if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:], b[2:]) <= 20}
    assert {(x.seq_a, x.seq_b) for x in band_pairs(d, "p", "seq", "x", 1.0).collect()} == {(a[1], b[1]) for a in ok for b in ok if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 1}


def test_isotonic(spark):
    """Steps rise, hold all rows, and are the textbook fit whatever the number of ranges."""
    r = random.Random(1)
    rows = [(i / 20_000, r.random() < i / 20_000) for i in range(0, 20_001, 13)] * 2 + [(1.7, True), (-3.0, False), (None, True)]
    d = spark.createDataFrame(rows, "c double, ok boolean")
    fit = metrics.isotonic(d, "c", "ok").orderBy("x_from").collect()
    ys = [x.y for x in fit]
    assert ys == sorted(set(ys)) and sum(x.n for x in fit) == len(rows) - 1
    steps: list = []
    known = sorted((min(1.0, max(0.0, c)), ok) for c, ok in rows if c is not None)
    for c in sorted({k[0] for k in known}):
        hits = [ok for k, ok in known if k == c]
        steps.append([c, c, len(hits), sum(hits)])
        while len(steps) > 1 and steps[-2][3] / steps[-2][2] >= steps[-1][3] / steps[-1][2]:
            _, hi, n, k = steps.pop()
            steps[-1] = [steps[-1][0], hi, steps[-1][2] + n, steps[-1][3] + k]
    assert [(x.x_from, x.x_to, x.n) for x in fit] == [tuple(x[:3]) for x in steps]
    asked = spark.createDataFrame([(-1.0,), (0.5,), (2.0,)], "c double")
    got = [x.calibrated for x in metrics.calibrated(asked, metrics.isotonic(d, "c", "ok"), "c").orderBy("c").collect()]
    assert got == sorted(got) and got[0] == round(ys[0], 6) and got[-1] == round(ys[-1], 6)
    assert [x.calibrated for x in metrics.calibrated(asked, metrics.isotonic(d.limit(0), "c", "ok"), "c").orderBy("c").collect()] == [-1.0, 0.5, 2.0]


def test_ordered_and_quantiles(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice([r.random(), 0.5, 0.25])) for _ in range(500)] + [("c", 1.0), ("a", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {x.g: (x.m, x.p) for x in classify.quantiles(d, "v", {"m": 0.5, "p": 0.9}, ["g"]).collect()}
    for g in "abc":
        v = sorted(x[1] for x in rows if x[0] == g and x[1] is not None)
        at = lambda q, v=v: v[int(q * (len(v) - 1))] + (v[min(len(v) - 1, int(q * (len(v) - 1)) + 1)] - v[int(q * (len(v) - 1))]) * (q * (len(v) - 1) % 1)
        assert math.isclose(got[g][0], at(0.5)) and math.isclose(got[g][1], at(0.9))
    assert classify.describe(d.limit(0), "v").first().median is None


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "t string, g string, y boolean, s double")
    assert metrics.per_class(metrics.confusion(none, "t", "g")).count() == 0
    assert metrics.roc_auc(none, "y", "s").first().auc == 0.5
    assert metrics.roc_auc(spark.createDataFrame([(True, 0.5), (True, 0.1)], "y boolean, s double"), "y", "s").first().auc == 0.5


def test_tags_and_loops(spark):
    tags = ["FT-101", "FIC-101", "FV-101", "XYZ", "9T-101", "ÜT-101", "2-101", "TIC-205", "psv 310", None, "", "P-101", "LAH-120", "FJC-9", "FC--7", "TC- 12a", "ABCDEFG-1", "T-123456"]
    c = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "component_id int, tag string")
    got = {r.tag: r for r in pid.tags(c).collect()}
    assert {t for t, r in got.items() if r.valid} == {"FT-101", "FIC-101", "FV-101", "TIC-205", "psv 310", "P-101", "LAH-120", "TC- 12a"}
    assert got[None].valid is None and got[""].valid is None
    assert (got["FIC-101"].symbol_class, got["P-101"].symbol_class, got["LAH-120"].symbol_class, got["XYZ"].symbol_class) == ("FLOWRATE_INDICATE_CONTROL", "PRESSURE", "LEVEL_ALARM_HIGH", "UNKNOWN_INSTRUMENT")
    assert {(r.loop, r.complete) for r in pid.loops(c).collect()} == {("101", True), ("205", False), ("12", False)}
    links = spark.createDataFrame([(0, 1), (1, 2)], "src int, dst int")
    found = {(r.rule_id, r.node) for r in pid.findings(c, links).collect()}
    assert {("PID-TAG-001", "3"), ("PID-CONN-001", "7"), ("PID-LOOP-001", "7")} <= found and not {("PID-TAG-001", "9"), ("PID-LOOP-001", "1"), ("PID-CONN-001", "0")} & found


def shape_rows(panel, w, h, circles=(), rings=(), outline=None):
    """An outline, circles (node, x, y, d, depth) and rings (node, kind, vertices, approximated) as rows of shapes."""
    o = outline or [[0.0, 0.0], [w, 0.0], [w, h], [0.0, h]]
    area = lambda v: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(v, v[1:] + v[:1]))) / 2

    def ring(node, kind, v, approximated=False, boundary=False, closed=True):
        xs, ys = [p[0] for p in v], [p[1] for p in v]
        length = sum(math.dist(a, b) for a, b in zip(v, v[1:] + (v[:1] if closed else [])))
        return (panel, node, "lwpolyline", kind, v, (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, None, closed, approximated, boundary, area(v) if closed else None, length, min(xs), min(ys), max(xs), max(ys), None)

    rows = [ring("outline", "border", o, boundary=True)] + [ring(*r) for r in rings]
    return rows + [(panel, n, "circle", "drill", None, x, y, d / 2, True, False, False, math.pi * d * d / 4, math.pi * d, x - d / 2, y - d / 2, x + d / 2, y + d / 2, z) for n, x, y, d, z in circles]


def broken(spark, rows, params=None):
    s = rules.with_panel(spark.createDataFrame(rows, rules.SHAPE))
    return s, rules.findings(s, params)


def test_rule_edges(spark):
    holes = [("1", 300.0, 300.0, 2.9), ("2", 300.0, 200.0, 3.1), ("3", 300.0, 100.0, 39.5), ("4", 100.0, 300.0, 41.0), ("5", 22.5, 500.0, 35.0), ("6", 22.5, 50.0, 30.0), ("7", 0.0, 400.0, 5.0), ("8", 500.0, 500.0, 5.0)]
    s, found = broken(spark, shape_rows(1, 600.0, 600.0, [(*h, 14.0 if h[0] == "8" else None) for h in holes]))
    got = {(r.rule_id, r.node) for r in found.collect()}
    assert {("MFG-011", "1"), ("MFG-011", "4"), ("MFG-012", "7"), ("MFG-001", "7"), ("GEO-007", "7"), ("MFG-007", "8")} <= got
    assert not {("MFG-006", "5"), ("MFG-011", "2"), ("MFG-011", "3"), ("MFG-006", "6")} & got
    r = rules.report(s, found).first()
    assert (r.overall_valid, r.layer1_passed, r.layer2_passed) == (False, False, True)
    clean, none = broken(spark, shape_rows(1, 600.0, 600.0, [("1", 300.0, 300.0, 8.0, 5.0)]))
    assert rules.report(clean, none).first().overall_valid is True
    passed = rules.results(clean, none).collect()
    assert len(passed) == len(rules.RULES) and {r.severity for r in passed} == {"PASS"}
    stopped = rules.results(s, found).collect()
    assert not any(r.rule_id.startswith("MFG") for r in stopped), "machining rules don't count behind a geometric error"


def test_wide_bores(spark):
    """Pairs of bores of any width are held against each other."""
    _, found = broken(spark, shape_rows(1, 3000.0, 3000.0, [("a", 1000.0, 1000.0, 200.0, None), ("b", 1101.0, 1000.0, 4.0, None), ("c", 1000.0, 2000.0, 900.0, None), ("d", 1000.0, 2452.0, 5.0, None), ("e", 1000.0, 2900.0, 5.0, None)]), {"MFG-002": rules.RULES["MFG-002"].params})
    assert {r.node: round(r.measured, 6) for r in found.collect()} == {"a+b": -1.0, "c+d": -0.5}


def test_duplicates(spark):
    circles = [("a", 100.0, 100.0, 35.0, None), ("b", 100.05, 100.0, 35.3, None), ("c", 200.0, 100.0, 4.0, None), ("d", 200.0, 100.0, 4.09, None)]
    _, found = broken(spark, shape_rows(1, 600.0, 600.0, circles), {"GEO-006": rules.RULES["GEO-006"].params})
    assert [r.node for r in found.collect()] == ["a+b"]


RECT = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
CHEVRON = [[100.0, 100.0], [200.0, 100.0], [200.0, 200.0], [150.0, 130.0], [100.0, 200.0]]


def test_milled_rings(spark):
    rings = [("slot", "pocket", RECT(20.0, 20.0, 100.0, 4.0)), ("wide", "pocket", RECT(20.0, 40.0, 40.0, 40.0)), ("chevron", "cut", CHEVRON), ("bent", "cut", CHEVRON, True), ("drilled", "drill", RECT(20.0, 20.0, 100.0, 4.0)), ("ell", "engrave", [[20.0, 200.0], [120.0, 200.0], [120.0, 206.0], [26.0, 206.0], [26.0, 290.0], [20.0, 290.0]])]
    _, found = broken(spark, shape_rows(1, 300.0, 300.0, (), rings))
    got = {(r.rule_id, r.node): r.measured for r in found.where("rule_id in ('MFG-003', 'MFG-004')").collect()}
    assert set(got) == {("MFG-004", "slot"), ("MFG-003", "chevron"), ("MFG-004", "ell")} and got["MFG-004", "slot"] == 4.0
    assert abs(got["MFG-003", "chevron"] - 71.1) < 0.05 and 5.9 < got["MFG-004", "ell"] < 7.1


def test_simple_rings(spark):
    rings = [CHEVRON, [[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 4.0]], [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 0.0], [0.0, 4.0]], [[0.0, 0.0], [4.0, 0.0], [2.0, 0.0], [2.0, 3.0]], RECT(0.0, 0.0, 2.0, 2.0) + [[0.0, 0.0]], [[0.0, 0.0]] * 4, None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, v array<array<double>>").select("i", g.is_simple("v").alias("s")).orderBy("i")
    assert [r.s for r in d.collect()] == [True, False, False, False, True, None, None]
    many = [[math.cos(t / 500 * math.pi) * (2 + (t % 2)), math.sin(t / 500 * math.pi) * (2 + (t % 2))] for t in range(1000)]
    many_crossed = many[:400] + [[0.0, -3.5]] + many[400:]
    d = spark.createDataFrame([(0, many), (1, many_crossed)], "i int, v array<array<double>>").select("i", g.is_simple("v").alias("s")).orderBy("i")
    assert [r.s for r in d.collect()] == [True, False]


def test_winding_and_bounds(spark):
    inner, outer = RECT(50.0, 50.0, 200.0, 200.0), RECT(80.0, 80.0, 20.0, 20.0)
    rings = [("a", "cut", inner), ("b", "cut", outer[::-1]), ("c", "cut", RECT(150.0, 150.0, 20.0, 20.0)), ("over", "cut", RECT(590.0, 100.0, 20.0, 20.0)), ("beside", "cut", RECT(600.0, 300.0, 20.0, 20.0))]
    _, found = broken(spark, shape_rows(1, 600.0, 600.0, [("t", 610.0, 500.0, 20.0, None), ("o", 600.0, 550.0, 20.0, None)], rings), {k: rules.RULES[k].params for k in ("GEO-005", "GEO-007")})
    got = {(r.rule_id, r.severity, r.node) for r in found.collect()}
    assert got == {("GEO-005", "INFO", "a"), ("GEO-005", "INFO", "c"), ("GEO-007", "ERROR", "over"), ("GEO-007", "ERROR", "o")}
    ell = [[0.0, 0.0], [600.0, 0.0], [600.0, 200.0], [200.0, 200.0], [200.0, 600.0], [0.0, 600.0]]
    _, found = broken(spark, shape_rows(1, 600.0, 600.0, [("in", 100.0, 500.0, 20.0, None), ("out", 400.0, 400.0, 20.0, None), ("rim", 195.0, 400.0, 20.0, None)], [("dent", "cut", RECT(150.0, 150.0, 100.0, 100.0)), ("fine", "cut", RECT(20.0, 20.0, 100.0, 100.0))], ell), {"GEO-007": rules.RULES["GEO-007"].params})
    assert {r.node for r in found.collect()} == {"out", "rim", "dent"}


def test_settings_of_rules(spark):
    given = spark.createDataFrame([("MFG-001", False, {}), ("MFG-011", True, {"max_diameter_mm": 50.0})], "rule_id string, enabled boolean, params map<string,double>")
    p = rules.settings(given)
    assert "MFG-001" not in p and p["MFG-011"] == {"min_diameter_mm": 3.0, "max_diameter_mm": 50.0} and len(p) == len(rules.RULES) - 1
    _, found = broken(spark, shape_rows(1, 600.0, 600.0, [("a", 3.0, 300.0, 45.0, None)]), p)
    assert not {r.rule_id for r in found.collect()} & {"MFG-001", "MFG-011"}
    assert broken(spark, [])[1].count() == 0


def test_block_pairs(spark):
    pts = [(i % 2, f"n{i:02d}", float(i), 0.0) for i in range(40)] + [(5, "lone", 1.0, 1.0)]
    d = spark.createDataFrame(pts, "p int, n string, x double, y double")
    for block in (3, 100):
        got = [(r.n_a, r.n_b, r.x_b - r.x_a) for r in block_pairs(d, "p", "n", ["x"], block).collect()]
        want = [(a[1], b[1], b[2] - a[2]) for a in pts for b in pts if a[0] == b[0] and a[1] < b[1]]
        assert sorted(got) == sorted(want)


def test_carcass(spark):
    sizes = [("a", 600.0, 800.0, 18.0), ("b", 600.0, 800.0, 18.0), ("c", 500.0, 600.0, 18.0), ("d", 500.0, 600.0, 18.0), ("e", 480.0, 780.0, 6.0), ("f", 100.0, 90.0, 18.0)]
    p = spark.createDataFrame([("x", *s) for s in sizes] + [("y", "g", 1.0, 1.0, 18.0)], "project string, panel_id string, w double, h double, thickness double")
    e = spark.createDataFrame([(k, 4, 4, 0, 0) for k in "abcd"], "panel_id string, left_holes int, right_holes int, bottom_holes int, top_holes int")
    roles = identify.carcasses(p, e)
    assert {(r.panel_id, r.role) for r in roles.collect()} == {("a", "SIDE_PANEL"), ("b", "SIDE_PANEL"), ("c", "TOP_PANEL"), ("d", "BOTTOM_PANEL"), ("e", "BACK_PANEL")}
    assert [(r.project, r.solved, round(r.confidence, 2)) for r in identify.assemblies(roles).collect()] == [("x", True, 0.85)]


def test_layer_blind(spark, small):
    from kerfspark.plans import bridge

    r = classify.layer_blind(bridge.holes(spark, small)).first()
    assert 0 < r.agreeing <= r.nodes and r.blind_known <= r.nodes


def test_index_split(spark):
    d = spark.createDataFrame([("s_69",), ("s_70",), ("s_184",), ("s_85_x",), ("none",), ("s_" + "9" * 40,)], "i string")
    got = {r.i: r.split for r in graphs.index_split(d, "i").collect()}
    assert (got["s_69"], got["s_70"], got["s_184"], got["s_85_x"]) == ("train", "val", "val", "test") and got["none"] in ("train", "val", "test")
