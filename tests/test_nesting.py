import json
import random

from pyspark.sql import functions as F

from kerfspark import runtime
from kerfspark.operators import nesting
from kerfspark.plans import reference
from kerfspark.sources import export

SHAPES = "drawing string, seq int, entity_type string, layer string, vertices array<array<double>>, is_closed boolean, x double, y double"


def rect(d, seq, layer, x, y, w, h):
    return (d, seq, "LWPOLYLINE", layer, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]], True, x + w / 2, y + h / 2)


def hole(d, seq, x, y):
    return (d, seq, "CIRCLE", "DRILL", None, True, x, y)


def test_nest(spark):
    rows = [rect("n", 0, "SHEET", 0.0, 0.0, 1220.0, 800.0)] + [rect("n", 1 + i, "CUT", 10.0 + 405 * i, 10.0, 400.0, 300.0) for i in range(3)]
    rows += [hole("n", 10, 50.0, 50.0), hole("n", 11, 500.0, 50.0), hole("n", 12, 600.0, 700.0), hole("n", 13, 9000.0, 20.0), rect("n", 14, "POCKET", 20.0, 20.0, 30.0, 30.0), ("n", 15, "LINE", "0", None, False, None, None)]
    rows += [rect("single", 0, "CUT", 0.0, 0.0, 600.0, 400.0), hole("single", 1, 5.0, 5.0), rect("h", 0, "X", 0.0, 0.0, 1000.0, 500.0), rect("h", 1, "X", 0.0, 0.0, 400.0, 400.0), rect("h", 2, "X", 500.0, 0.0, 400.0, 400.0)]
    shapes = spark.createDataFrame(rows, SHAPES)
    got = {(r.drawing, r.seq): (r.panel, r.how) for r in nesting.assign(shapes).collect()}
    assert got == {("n", 1): (1, "outline"), ("n", 2): (2, "outline"), ("n", 3): (3, "outline"), ("n", 10): (1, "inside"), ("n", 11): (2, "inside"), ("n", 12): (2, "nearest"), ("n", 13): (3, "nearest"), ("n", 14): (1, "inside"), ("h", 1): (1, "outline"), ("h", 2): (2, "outline")}
    lay = {r.drawing: r for r in nesting.layouts(shapes).collect()}
    assert lay["n"].source == "sheet_layer" and lay["n"].panels == 3 and abs(lay["n"].utilisation - 360000 / 976000) < 1e-9
    assert lay["h"].source == "largest_contour" and lay["single"].source == "none" and lay["single"].panels == 1
    assert nesting.assign(shapes.limit(0)).count() == 0


def test_queries_in_any_unit(spark, tmp_path):
    rows = []
    for k, (unit, mm) in enumerate((("mm", 1.0), ("m", 1000.0), ("in", 25.4))):
        key = 100 * k
        own = [rect(unit, key, "SHEET", 0.0, 0.0, 1524.0, 1016.0), rect(unit, key + 1, "CUT", 50.8, 50.8, 609.6, 762.0), rect(unit, key + 2, "CUT", 711.2, 50.8, 508.0, 762.0), hole(unit, key + 3, 101.6, 101.6), hole(unit, key + 4, 711.2 + 50.8, 101.6), hole(unit, key + 5, 101.6, 965.2)]
        for d, seq, kind, layer, v, closed, x, y in own:
            at = [[c / mm for c in p] for p in v or [[x, y, 4.0]]]
            rows.append((seq, d, f"c-{unit}", None, kind, layer, at, closed, [x / mm, y / mm], None, None, None, None, None, None, None, None))
    names = "entity_key bigint, source_file string, config_id string, units_original string, entity_type string, layer string, coordinates array<array<double>>, is_closed boolean, centroid array<double>, bounding_box array<double>, area_mm2 double, perimeter_mm double, diameter_mm double, radius_mm double, depth_mm double, elevation_z double, size_text string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([(f"c-{u}", u) for u in ("mm", "m", "in")], "config_id string, target_units string").write.parquet(f"{tmp_path}/parser_configs.parquet")
    lay = {r.drawing: r for r in reference.QUERIES["nest_analysis"](spark, str(tmp_path)).collect()}
    assert {d: r.panels for d, r in lay.items()} == {"mm": 2, "m": 2, "in": 2}
    assert all(abs(r.panel_area - 1117.6 * 762.0) < 0.01 and abs(r.sheet_area - 1524.0 * 1016.0) < 0.01 for r in lay.values())
    split = reference.QUERIES["nest_split"](spark, str(tmp_path)).collect()
    want = {(1, 1, "outline"), (2, 2, "outline"), (3, 1, "inside"), (4, 2, "inside"), (5, 1, "nearest")}
    assert all({(r.seq % 100, r.panel % 100, r.how) for r in split if r.drawing == d} == want for d in lay)


def test_nearest_against_all_pairs(spark):
    r = random.Random(4)
    panels = [rect("d", i, "CUT", 3000.0 * (i % 5), 2500.0 * (i // 5), 400.0, 300.0) for i in range(15)]
    pts = [("d", 100 + i, r.uniform(-4000, 20000), r.uniform(-4000, 12000)) for i in range(200)]
    c = nesting.contours(spark.createDataFrame(panels, SHAPES))
    got = {x.seq: x.panel for x in nesting.nearest_panel(spark.createDataFrame(pts, "drawing string, seq int, x double, y double"), c).collect()}

    def gap(p, x, y):
        (x0, y0), (x1, y1) = p[4][0], p[4][2]
        dx, dy = max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1)
        return (dx * dx + dy * dy) ** 0.5 if dx or dy else min(x - x0, x1 - x, y - y0, y1 - y)

    assert all(abs(gap(panels[got[s]], x, y) - min(gap(p, x, y) for p in panels)) < 1e-6 for _, s, x, y in pts)


def test_no_broadcast_by_estimate(spark, monkeypatch):
    """Contours repeat over grid cells, and Spark's sizes of them are far too low: none may be sent through the driver by such a size."""
    plans, cut = [], nesting.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(nesting, "cut", seen)
    rows = [rect("n", 0, "SHEET", 0.0, 0.0, 1220.0, 800.0)] + [rect("n", 1 + i, "CUT", 10.0 + 405 * i, 10.0, 400.0, 300.0) for i in range(3)] + [hole("n", 10, 50.0, 50.0), hole("n", 11, 600.0, 700.0), hole("n", 12, 2e6, 0.0)]
    shapes = spark.createDataFrame(rows, SHAPES)
    for out in (nesting.assign(shapes), nesting.layouts(shapes)):
        out.collect()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [x for x in plans if "Broadcast" in x]


def test_drawing_with_most_shapes(spark, monkeypatch):
    """A hot drawing is dealt into parts; its sheet, panels and members are the same."""
    rows = [rect("big", i, "X", 0.0 if i == 0 else 10.0 + 90 * i, 0.0, 6000.0 if i == 0 else 400.0, 5500.0 if i == 0 else 5000.0) for i in range(60)] + [rect(f"d{i}", 0, "CUT", 0.0, 0.0, 500.0, 400.0) for i in range(5)]
    shapes = spark.createDataFrame([*rows, hole("big", 100, 500.0, 20.0), hole("big", 101, 500.0, 5400.0)], SHAPES)
    want = sorted(map(tuple, nesting.assign(shapes).collect())), sorted(map(tuple, nesting.layouts(shapes).collect()))
    monkeypatch.setattr(nesting, "HOT_ROWS", 0)
    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    assert want == (sorted(map(tuple, nesting.assign(shapes).collect())), sorted(map(tuple, nesting.layouts(shapes).collect())))
    assert [r[1:3] for r in want[1] if r[0] == "big"] == [("largest_contour", 59)]


def test_exports(spark):
    n = spark.createDataFrame([("g", "b", 2.0), ("g", "a", 1.0), ("h", "c", 1.0)], "graph_id string, node_id string, v double")
    e = spark.createDataFrame([("g", "a", "b")], "graph_id string, src string, dst string")
    docs = {r.graph_id: json.loads(r.text) for r in export.graph_json(n, e).collect()}
    assert [x["node_id"] for x in docs["g"]["nodes"]] == ["a", "b"] and docs["g"]["links"] == [{"src": "a", "dst": "b"}] and docs["h"]["links"] == []
    ann = spark.createDataFrame([(1, 1, "A", 0.9), (1, 2, "A", 0.5), (1, 3, "B", 0.2)], "panel_id int, seq int, feature_class string, confidence double")
    parts = spark.createDataFrame([(1, "DOOR"), (2, "SHELF")], "panel_id int, part_type string")
    out = {r.panel_id: json.loads(r.text) for r in export.labels_json(ann, parts).collect()}
    assert out[1]["feature_counts"] == {"A": 2, "B": 1} and out[2]["part"] == "SHELF"
    labels = spark.createDataFrame([("x", "THROUGH_HOLE", 0.4, "needs_review"), ("y", "POCKET", 0.9, "auto_accepted")], "label_id string, value string, confidence double, status string")
    assert json.loads(export.review_lines(labels).first().value)["label"]["label_id"] == "x"
    assert tuple(export.review_sheet(labels).first())[:3] == ("x", "through hole", 40)
    svg = spark.range(1).select(export.panel_svg({k: F.lit(v) for k, v in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 100.0), ("ymax", 50.0))}, F.array(F.struct(F.lit(10.0).alias("x"), F.lit(5.0).alias("y"), F.lit(2.5).alias("r"))))).first()[0]
    assert 'cx="10.0" cy="45.0" r="2.5"' in svg and svg.endswith("</svg>")


def test_exported_links_have_their_ends(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("geometry_nodes", [("g1", "G", "a.dxf", "circle", "DRILL", "drill", [1.0, 2.0], 5.0, True)] * 2, "node_id string, graph_id string, source_file string, geometry_type string, layer string, inferred_layer_type string, centroid array<double>, diameter_mm double, is_closed boolean")
    write("feature_nodes", [("f1", "G", "HOLE", 0.9, "rule", 5.0, [1.0, 2.0], ["g1"], None, None), ("f2", "H", "SLOT", 0.5, "rule", None, None, ["g9"], None, None), ("f3", "I", None, None, None, None, None, None, None, None)], "node_id string, graph_id string, feature_class string, confidence double, inference_method string, diameter_mm double, position_mm array<double>, geometry_node_ids array<string>, group_id string, deleted_at timestamp")
    write("operation_nodes", [("o1", "G", "DRILLING", 0.8, 5.0, 9.0, [" F1", "f1", None, ""]), ("o2", "H", "ROUTING", 0.8, None, None, ["f8"])], "node_id string, graph_id string, operation_type string, confidence double, tool_diameter_mm double, depth_mm double, feature_node_ids array<string>")
    docs = {r.graph_id: json.loads(r.text) for r in reference.QUERIES["graph_json"](spark, str(tmp_path)).collect()}
    kinds = {g: {n["node_id"]: n["node_type"] for n in x["nodes"]} for g, x in docs.items()}
    assert kinds == {"G": {"g1": "geometry", "f1": "feature", "o1": "operation"}, "H": {"f2": "feature", "o2": "operation", "g9": "missing", "f8": "missing"}, "I": {"f3": "feature"}}
    assert {g: {(e["src"], e["dst"]) for e in x["links"]} for g, x in docs.items()} == {"G": {("f1", "g1"), ("o1", "f1")}, "H": {("f2", "g9"), ("o2", "f8")}, "I": set()}
    elements = [(r.part, json.loads(r.element)) for r in reference.QUERIES["cytoscape"](spark, str(tmp_path)).collect()]
    ids = [x["data"]["id"] for part, x in elements if part == "nodes"]
    edges = [(x["data"]["source"], x["data"]["target"]) for part, x in elements if part == "edges"]
    assert sorted(ids) == ["f1", "f2", "f3", "f8", "g1", "g9", "o1", "o2"] and len(edges) == 4 and all(e in ids for pair in edges for e in pair)
    assert next(x for part, x in elements if x["data"].get("id") == "g1")["position"] == {"x": 1.0, "y": 2.0}


def test_links_without_nodes_stay(spark):
    n = spark.createDataFrame([("g", "a"), (None, "b")], "graph_id string, node_id string")
    e = spark.createDataFrame([("h", "a", "b"), (None, "b", "b")], "graph_id string, src string, dst string")
    docs = {r.graph_id: json.loads(r.text) for r in export.graph_json(n, e).collect()}
    assert docs["h"]["nodes"] == [] and docs["h"]["links"] == [{"src": "a", "dst": "b"}] and docs["g"]["links"] == []
    assert len(docs) == 3 and docs[None]["nodes"] == [{"node_id": "b"}] and docs[None]["links"] == [{"src": "b", "dst": "b"}]
