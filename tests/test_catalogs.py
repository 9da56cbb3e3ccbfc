import json

import pytest
from pyspark.sql import functions as F

from kerfspark import __main__ as shell
from kerfspark.functions import layers
from kerfspark.operators import benchmark, classify, dataset, graphs, identify, metrics, rules
from kerfspark.plans import analysis
from kerfspark.runtime import cut
from kerfspark.sources import catalogs, dxf, export


def test_ontology(spark, tmp_path):
    (tmp_path / "features.yaml").write_text("features:\n- {feature_id: HOLE_A, category: HOLES, operation: DRILLING}\n- {id: SLOT_B, category: MILLED, operations: [CARVING]}\n- 5\n")
    (tmp_path / "operations.yaml").write_text("operations:\n- {operation_id: DRILLING, name: drilling}\n")
    (tmp_path / "rules.yaml").write_text("rules:\n- {rule_id: R-1, layer: 1, severity: ERROR, applies_to: [HOLE_A, NO_SUCH, any]}\n")
    o = catalogs.read_ontology(spark, str(tmp_path))
    assert {tuple(r) for r in catalogs.rule_references(o).collect()} == {("R-1", "HOLE_A"), ("R-1", "NO_SUCH")}
    assert {tuple(r) for r in catalogs.ontology_problems(o).collect()} == {("rule names no feature", "R-1", "NO_SUCH"), ("feature names no operation", "SLOT_B", "CARVING")}
    assert ("category", "HOLES", 1) in {tuple(r) for r in catalogs.ontology_summary(o).collect()}
    assert catalogs.read_ontology(spark, str(tmp_path / "none"))["features"].count() == 0


def test_layer_profiles(spark, tmp_path):
    f = tmp_path / "shop.yaml"
    f.write_text("prefixes: {drill: [bohr], cut: [bohrkontur]}\n")
    own = catalogs.layer_profile(str(f))
    r = spark.createDataFrame([("BOHRKONTUR_1",), ("Bohr_5",)], "l string").select(layers.layer_type_longest(F.col("l"), own).alias("k")).collect()
    assert [x.k for x in r] == ["cut", "drill"] and catalogs.layer_profile() == catalogs.layer_profile("cabinet")
    with pytest.raises(KeyError):
        catalogs.layer_profile("nothing")
    f.write_text("prefixes: {wrong: [x]}\n")
    with pytest.raises(ValueError):
        catalogs.layer_profile(str(f))


def test_calibration_kept(spark, tmp_path):
    d = spark.createDataFrame([(i / 10, i >= 5) for i in range(11)], "c double, ok boolean")
    steps = metrics.isotonic(d, "c", "ok")
    catalogs.save_calibration(steps, str(tmp_path / "a" / "c.json"))
    again = catalogs.load_calibration(spark, str(tmp_path / "a" / "c.json"))
    assert [(r.x_from, r.y) for r in again.orderBy("x_from").collect()] == [(r.x_from, r.y) for r in steps.orderBy("x_from").collect()]
    catalogs.save_calibration(steps.limit(0), str(tmp_path / "none.json"))
    assert catalogs.load_calibration(spark, str(tmp_path / "none.json")).count() == 0


def test_labels_of_other_datasets(spark, tmp_path):
    schema = "id string, elements array<struct<id:string,label:string>>"
    rows = [{"id": "a", "elements": [{"id": "1", "label": " Hole"}, {"label": "wall"}, None]}, {"id": "b", "elements": []}]
    for name, text in (("list.json", json.dumps(rows)), ("models.json", json.dumps({"models": rows})), ("lines.jsonl", "\n".join(map(json.dumps, rows)))):
        (tmp_path / name).write_text(text)
        records = catalogs.read_records(spark, str(tmp_path / name), schema)
        got = catalogs.mapped_labels(records, "elements", {"hole": "THROUGH_HOLE"})
        assert {tuple(r) for r in got.collect()} == {("a", "1", " Hole", "THROUGH_HOLE"), ("a", "1", "wall", None)}, name
        assert tuple(catalogs.label_manifest(got).first()) == (1, 2, 1, 0.5, ["THROUGH_HOLE"], ["wall"])


def test_migrations(spark):
    steps = [("v1", "v2"), ("v2", "v3"), ("v1", "x"), ("x", "y")]
    assert catalogs.migration_path(steps, "v1", "v3") == steps[:2] and catalogs.migration_path(steps, "v1", "v1") == []
    with pytest.raises(ValueError):
        catalogs.migration_path(steps, "v3", "v1")
    d = spark.createDataFrame([("v1", 1), ("v2", 5)], "schema_version string, a int")
    out = catalogs.migrate(d, {("v1", "v2"): lambda r: r.withColumn("a", F.col("a") * 10), ("v2", "v3"): lambda r: r.withColumn("b", F.col("a") + 1)}, "v3")
    assert sorted(tuple(r) for r in out.select("schema_version", "a", "b").collect()) == [("v3", 5, 6), ("v3", 10, 11)]


def test_plain_words(spark):
    said = ["THROUGH_HOLE", "through hole", " Dowel ", "a groove, maybe", "something", ""]
    d = spark.createDataFrame([(x,) for x in said], "t string").select(catalogs.class_of_plain(F.col("t"), ["THROUGH_HOLE", "DOWEL_HOLE", "GROOVE"]).alias("c"))
    assert [r.c for r in d.collect()] == ["THROUGH_HOLE", "THROUGH_HOLE", "DOWEL_HOLE", "GROOVE", "something", ""]
    assert export.glossary({"K": ["B_X", "A_Y"]}) == [("A_Y", "a y", "K"), ("B_X", "b x", "K")]


def test_truth_joined(spark):
    nodes = spark.createDataFrame([(1, "b", None, None, None, True), (1, "n1", 10.0, 10.0, 5.0, False), (1, "n2", 20.0, 20.0, 8.0, False), (1, "n3", 50.0, 50.0, None, False), (1, "n4", 70.0, 70.0, 5.0, False), (1, "n5", 90.0, 1.0, 5.0, False)], "panel_id int, node string, x double, y double, diameter double, is_boundary boolean")
    features = spark.createDataFrame([(1, 0, "PROFILE_CUT", None, None, None, True), (1, 1, "DOWEL_HOLE", 20.0, 20.0005, 8.0, False), (1, 2, "SHELF_PIN_HOLE", 10.0, 10.0, 5.0, True), (1, 3, "HINGE_CUP_HOLE", 10.0, 10.0, 35.0, True), (1, 4, "POCKET", 50.0, 50.0, None, True)], "panel_id int, seq int, feature_class string, x double, y double, diameter double, is_valid boolean")
    got = {r.node: (r.truth, r.is_valid) for r in benchmark.joined_truth(nodes, features).collect()}
    assert got == {"b": ("PROFILE_CUT", True), "n1": ("SHELF_PIN_HOLE", True), "n2": ("DOWEL_HOLE", False), "n3": ("POCKET", True), "n4": ("HINGE_CUP_HOLE", True), "n5": ("UNKNOWN_FEATURE", True)}


def test_operations_and_scores(spark):
    d = spark.createDataFrame([(["GROOVE", "THROUGH_HOLE"],), ([],), (["UNKNOWN_FEATURE"],)], "c array<string>").select(benchmark.operations_of(F.col("c")).alias("o")).collect()
    assert [r.o for r in d] == [["CNC_ROUTING", "DRILLING", "NESTING"], [], ["NESTING"]]
    e = spark.range(1).select(benchmark.anomaly(F.lit(1), F.lit(2), F.lit(1)).alias("a"), benchmark.validity(F.lit(3)).alias("v")).first()
    assert (e.a, e.v) == (2 / 3, 0.25)


def test_graphs(spark):
    nodes = spark.createDataFrame([("g", "a", "geometry", "Circle", None, 0.9, None), ("g", "b", "geometry", "line", None, None, None), ("g", "f", "feature", None, "DOWEL_HOLE", 0.95, "grp"), ("g", "o", "operation", None, None, 2.0, None), ("g", "k", "constraint", None, None, None, None)], "graph_id string, node_id string, node_type string, geometry_type string, feature_class string, confidence double, group_id string")
    edges = spark.createDataFrame([("g", "a", "f", "COMPOSES"), ("g", "k", "f", "APPLIES_TO"), ("g", "f", "f", "CONFLICTS_WITH"), ("g", "o", "gone", "PRODUCES")], "graph_id string, src string, dst string, edge_type string")
    g = graphs.Graphs(nodes, edges)
    assert [r.node_id for r in g.geometry("circle").collect()] == ["a"] and g.features("dowel_hole", 0.99).count() == 0 and g.groups().count() == 1
    assert [tuple(r) for r in g.features_for_geometry().collect()] == [("a", "f")] and [tuple(r) for r in g.geometry_for_features().collect()] == [("f", "a")]
    assert [tuple(r) for r in g.violations().collect()] == [("f", "k")] and g.conflicts().count() == 1
    ids = nodes.where("node_id = 'f'")
    assert g.edges_to(ids).count() == 3 and g.edges_from(ids).count() == 1 and g.with_ids(ids).count() == 1
    problems = {(r.problem, r.node_id) for r in graphs.integrity(nodes, edges).collect()}
    assert problems == {("edge_without_end", "o"), ("edge_to_itself", "f"), ("confidence_out_of_range", "o")}


SHEET = [0, "SECTION", 2, "HEADER", 9, "$ACADVER", 1, "AC1024", 9, "$INSUNITS", 70, 4, 0, "ENDSEC", 0, "SECTION", 2, "ENTITIES"]


def drawing(*parts):
    return "\n".join(map(str, [*SHEET, *[x for p in parts for x in p], 0, "ENDSEC", 0, "EOF"])).encode()


def ring(layer, x, y, w, h, handle="R"):
    return [0, "LWPOLYLINE", 5, handle, 8, layer, 90, 4, 70, 1, 10, x, 20, y, 10, x + w, 20, y, 10, x + w, 20, y + h, 10, x, 20, y + h]


def circle(layer, x, y, d, handle="C"):
    return [0, "CIRCLE", 5, handle, 8, layer, 10, x, 20, y, 40, d / 2]


def test_analysis(spark):
    good = drawing(ring("PANEL_18MM", 0, 0, 600, 400), *[circle("DRILL", 37, 100 + 32 * k, 5.0) for k in range(4)], circle("HINGE", 500, 22.5, 35.0))
    bad = drawing(ring("BORDER", 0, 0, 600, 400), circle("DRILL", 3, 100, 5.0), ring("POCKET", 100, 100, 100, 4))
    loose = drawing(circle("DRILL", 100, 100, 8.0))
    files = spark.createDataFrame([("good", good), ("bad", bad), ("loose", loose), ("none", b"rubbish")], "path string, content binary")
    got = {r.source_file: r for r in analysis.analyze(dxf.parse(files)).collect()}
    assert (got["good"].overall_valid, got["good"].thickness_mm, got["good"].thickness_source, got["good"].known, got["good"].holes) == (True, 18.0, "layer_name", 6, 5)
    assert (got["bad"].overall_valid, got["bad"].layer1_passed, got["bad"].n_error >= 1, got["bad"].n_warning >= 1) == (False, True, True, True)
    assert got["loose"].has_outline is False and got["loose"].width_mm == 28.0 and got["none"].warnings == ["no_drawing"] and got["none"].overall_valid is None


def test_dataset_of_drawings(spark, tmp_path):
    files = spark.createDataFrame([(f"p_{i}", drawing(ring("BORDER", 0, 0, 600, 400), circle("DRILL", 100 + i, 100, 8.0))) for i in range(4)], "path string, content binary")
    shapes = cut(analysis.shapes(dxf.entities(dxf.parse(files))))
    found = cut(rules.findings(shapes))
    report = cut(rules.report(shapes, found))
    table = cut(dataset.labels(shapes, classify.nodes(shapes), report))
    docs = dataset.documents(table, report, rules.results(shapes, found))
    assert docs.count() == 12 and docs.select("sample_id").distinct().count() == 4
    again = dataset.documents(table, report, rules.results(shapes, found))
    assert sorted(map(str, docs.collect())) == sorted(map(str, again.collect())), "nothing depends on the clock"
    labels = docs.where("name = 'labels.json'").select("sample_id", "text")
    assert dataset.schema_problems(labels).count() == 0
    broken = spark.createDataFrame([("a", "{"), ("b", '{"sample_id": "c", "panel": 1}')], "sample_id string, text string")
    assert {r.problem for r in dataset.schema_problems(broken).collect()} >= {"no complete JSON", "names another sample", "lacks split"}
    splits = table.select("sample_id", "split").unionByName(spark.createDataFrame([("sample_p_1", "val"), ("gone", "test")], "sample_id string, split string"))
    assert {(r.sample_id, r.problem) for r in dataset.consistency_problems(table, splits).collect()} == {("sample_p_1", "in several splits"), ("gone", "listed but not there")}
    assert json.loads(dataset.metadata(table, 7).first().text)["statistics"]["split"] == '{"train":4}'
    dataset.write(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 12


def test_assemblies(spark):
    p = spark.createDataFrame([("x", "a", 18.0), ("x", "b", 18.0), ("x", "c", 6.0), ("y", "d", 18.0), ("y", "e", 18.2), ("y", "f", 6.0), ("z", "g", None)], "project string, panel_id string, thickness double")
    parts = spark.createDataFrame([("d", "DRAWER_FRONT"), ("e", "SHELF")], "panel_id string, part_type string")
    roles = spark.createDataFrame([("x", "a", "SIDE_PANEL"), ("x", "b", "SIDE_PANEL"), ("x", "c", "TOP_PANEL")], "project string, panel_id string, role string")
    g = identify.grouped(p, parts, roles)
    assert {(r.panel_id, r.assembly_id, r.how) for r in g.collect()} == {("a", "x:a", "carcass"), ("b", "x:a", "carcass"), ("c", "x:a", "carcass"), ("d", "y:d", "band"), ("e", "y:d", "band"), ("f", "y:f", "single"), ("g", "z:g", "single")}
    t = {r.assembly_id: (r.panels, r.assembly_type, round(r.confidence, 2)) for r in identify.assembly_table(g, roles).collect()}
    assert t == {"x:a": (3, "CARCASS", 0.75), "y:d": (2, "DRAWER", 0.6), "y:f": (1, "UNKNOWN_ASSEMBLY", 0.2), "z:g": (1, "UNKNOWN_ASSEMBLY", 0.2)}
    assert {(r.panel_a, r.panel_b) for r in identify.joints(g).collect()} == {("a", "c"), ("b", "c")}


def test_shell(capsys):
    assert shell.main(["list"]) == 0 and "rule_report" in capsys.readouterr().out
    assert shell.main(["profiles"]) == 0 and "drill: DRILL" in capsys.readouterr().out
    assert shell.main([]) == shell.main(["run", "nothing", "a", "b"]) == 2
