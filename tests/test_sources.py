import json
from datetime import datetime

from pyspark.sql import functions as F

from kerfspark.operators import nested, pid
from kerfspark.sources import documents as d
from kerfspark.streaming.references import OrphanMonitor, event_windows

GRAPHML = """<graphml><key id="tag"/><graph><node id="n1"><data key="tag">FT-101</data></node><node id="n2"><data key="label">FIC-101</data><data key="class">CONTROLLER</data></node>
<node id="n3"/><edge source="n1" target="n2"><data key="relation">SIGNAL</data></edge></graph></graphml>"""


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    c, e = d.read_graphml(spark, str(tmp_path))
    assert {(r.component_id, r.tag, r.symbol_class) for r in c.collect()} == {("n1", "FT-101", None), ("n2", "FIC-101", "CONTROLLER"), ("n3", None, None)}
    assert [tuple(r) for r in e.collect()] == [("n1", "n2", "SIGNAL")]
    assert [r.component_id for r in pid.isolated(c, e).collect()] == ["n3"]


def test_graphs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"graph_id": "A", "nodes": [{"id": "n", "coordinates": [1, 2, 3]}]}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    g = d.read_graphs(spark, str(tmp_path))
    assert {r.graph_id for r in g.collect()} == {"A", "b"} and nested.child_table(g).count() == 1


def test_splits(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('"a"\n{"sample_id": "b"}\n\n')
    (tmp_path / "val.jsonl").write_text('{"id": "c"}\nb\n')
    (tmp_path / "test.jsonl").write_text("d\na\n")
    assert {tuple(r) for r in d.read_splits(spark, str(tmp_path)).collect()} == {("a", "train"), ("b", "train"), ("c", "val"), ("d", "test")}


def test_reviews(spark, tmp_path):
    row = lambda i, dec, val=None: json.dumps({"label": {"label_id": i}, "decision": dec, "corrected_value": val})
    (tmp_path / "r.jsonl").write_text("\n".join([row("a", "confirm"), row("b", "reject"), row("b", "Correct ", "POCKET"), row("c", "correct", " "), row("e", ""), "rubbish"]))
    labels = spark.createDataFrame([(i, "HOLE", "needs_review") for i in "abcd"], "label_id string, value string, status string")
    got = {r.label_id: (r.value, r.status, r.is_gold) for r in d.apply_reviews(labels, d.read_reviews(spark, str(tmp_path))).collect()}
    assert got == {"a": ("HOLE", "confirmed", True), "b": ("POCKET", "corrected", True), "c": ("HOLE", "needs_review", False), "d": ("HOLE", "needs_review", False)}
    sheet = spark.createDataFrame([("Yes", None), ("no", "GROOVE"), ("N", " "), ("", "x"), (None, None)], "r string, i string")
    assert [x[0] for x in sheet.select(d.sheet_decision(F.col("r"), F.col("i"))).collect()] == ["confirm", "correct", "reject", None, None]


def test_settings(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("rules:\n- rule_id: R1\n  enabled: false\n  parameters: {x: 3, y: text}\n- {}\n")
    (tmp_path / "b.yaml").write_text(": [")
    assert [(r.rule_id, r.enabled, r.params) for r in d.rule_settings(spark, str(tmp_path)).collect()] == [("R1", False, {"x": 3.0})]
    assert d.rule_settings(spark, str(tmp_path / "none")).count() == 0


def test_stream_of_references(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n)
    m = OrphanMonitor(spark)
    refs = spark.createDataFrame([("t", "a", "feature", "x", day(2)), ("t", "b", "feature", "y", day(3))], "ref_table string, ref_id string, kind string, target_id string, seen timestamp_ntz")
    refs.write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(refs.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(m.on_references).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    m.on_parents(spark.createDataFrame([("x", day(1), None), ("y", day(5), day(9))], "target_id string, born timestamp_ntz, died timestamp_ntz").withColumn("told", F.col("died")), 0)
    m.on_references(refs, 1)  # a batch that runs again
    assert m.refs.count() == 2
    again = OrphanMonitor(spark, m.folder)
    assert again.version == m.version == 3 and sorted(map(str, again.refs.collect())) == sorted(map(str, m.refs.collect()))
    got = {r.ref_id: (r.orphaned_at, r.resolved_at, r.reopened_at) for r in m.refs.collect()}
    assert got == {"a": (None, None, None), "b": (day(3), day(5), day(9))}


def test_event_windows(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    whole = event_windows(e, "1 day")
    assert whole.agg(F.sum("n")).first()[0] == e.count()
    e.write.parquet(str(tmp_path / "in"))
    q = event_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "1 day", "4000 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").count() == whole.count()
