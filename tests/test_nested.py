import json

from kerfspark.operators import nested

DOCS = "delivery_id bigint, graph_id string, received_at string, payload string, extra string, node_id string"


def kids(spark, *docs):
    rows = [(i, g, t, p if p is None or isinstance(p, str) else json.dumps(p), "x", "clash") for i, (g, t, p) in enumerate(docs)]
    return sorted((r.graph_id, r.node_id, r.child_kind, r.child_pos) for r in nested.child_table(spark.createDataFrame(rows, DOCS)).collect())


def test_layouts(spark):
    geo = {"node_type": "geometry", "coordinates": [[1, 2], None, [3, 4]], "provenance": {"evidence": {"evidence_type": "a"}}}
    feat = {"node_type": "feature", "hypotheses": [{"feature_class": "A"}, None, {"feature_class": "B"}], "provenance": json.dumps({"evidence": [None, {"weight": 1}]})}
    want = [("evidence", "g", 0), ("vertex", "g", 0), ("vertex", "g", 2), ("hypothesis", "f", 0), ("hypothesis", "f", 2), ("evidence", "f", 1)]
    layouts = {
        "flat": {"nodes": [{"id": "g", **geo}, {"node_id": "f", **feat}]},
        "data": {"nodes": [{"id": "g", "data": geo}, {"id": "f", "data": feat}]},
        "keyed": {"nodes": {"g": geo, "f": feat}},
        "wrapped": {"export": {"rev": 1}, "mgg": {"nodes": [{"id": "g", "data": geo}, {"id": "f", "data": feat}]}},
    }
    got = kids(spark, *[(k, "2024-01-01", v) for k, v in layouts.items()])
    assert got == sorted((k, n, c, p) for k in layouts for c, n, p in want)


def test_parts(spark):
    node = lambda **f: {"nodes": [{"id": "n", **f}]}
    assert kids(spark, ("a", "1", node(node_type="geometry", coordinates=[1.0, 2.0, 3.0]))) == [("a", "n", "vertex", 0)]
    assert kids(spark, ("a", "1", node(node_type="geometry", coordinates=[1.0, None, 3.0]))) == [("a", "n", "vertex", 0)]
    assert kids(spark, ("a", "1", node(node_type="feature", hypotheses={"feature_class": "A"}))) == [("a", "n", "hypothesis", 0)]
    assert kids(spark, ("a", "1", node(node_type="geometry", coordinates=[]))) == []
    assert kids(spark, ("a", "1", node(node_type="feature", hypotheses=None, provenance="by hand", coordinates=[1.0]))) == []


def test_latest_complete(spark):
    one, two = {"nodes": [{"id": "n", "node_type": "geometry", "coordinates": [1, 2]}]}, {"nodes": [{"id": "m", "node_type": "geometry", "coordinates": [1, 2]}]}
    got = kids(spark, ("a", "2024-01-02", one), ("a", "2024-01-01", two), ("a", "2024-01-03", json.dumps(two)[:-5]), ("a", "2024-01-04", None), ("b", "1", two), ("b", "1", one), (None, "1", one), ("c", "1", ""), ("d", "1", "[1]"), ("e", "1", "NaN"))
    assert got == [("a", "n", "vertex", 0), ("b", "n", "vertex", 0)], "of two at one time the larger delivery_id"


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert nested.child_table(none).count() == nested.node_table(none).count() == 0


def test_long(spark):
    n = 20_000
    got = kids(spark, ("a", "1", {"nodes": [{"id": "n", "node_type": "geometry", "coordinates": [[i, i] for i in range(n)]}]}))
    assert len(got) == n


def test_all_containers(spark):
    node = lambda name: {"id": name, "node_type": "geometry", "coordinates": [1, 2, 3]}
    payload = {"left": {"nodes": [node("a")]}, "right": json.dumps({"part": {"nodes": {"b": node("b")}}}), "more": [{"nodes": [node("c")]}, 5]}
    assert kids(spark, ("g", "1", payload)) == [("g", x, "vertex", 0) for x in "abc"]


def test_repeats_and_lists_of_provenance(spark):
    one = {"id": "n", "node_type": "geometry", "coordinates": [[1, 2], [3, 4]], "provenance": [{"evidence": [{"weight": 1}, {"weight": 2}]}, {"evidence": {"weight": 3}}]}
    got = kids(spark, ("g", "1", {"nodes": [one, {**one, "coordinates": [[5, 6], [7, 8], [9, 9]]}]}))
    assert got == [("g", "n", "evidence", 0)] * 2 + [("g", "n", "evidence", 1)] + [("g", "n", "vertex", i) for i in range(3)]


def test_states():
    """Equal shapes have equal states whatever their values and other keys' names; other shapes have others."""
    a = nested.Automaton()

    def of(value):
        a.read(value)
        return a.at[id(value)]

    same = [{"node_type": "geometry", "coordinates": [[1, 2]], "extra": 1}, {"coordinates": [[5, 6], [7, 8]], "node_type": " Geometry ", "other": 2.5}]
    assert of(same[0]) == of(same[1])
    assert len({of({"coordinates": c}) for c in ([1, 2], [[1, 2]], {"x": 1}, None, "[[1, 2]]", [[1, None]], [])}) == 7
    assert nested.Automaton().read(same[0]) is None
    q = of({"id": "n", "data": {"node_type": "feature", "hypotheses": {"feature_class": "A"}}})
    assert (a.plan(q).subtype, a.plan(q).under_data, a.plan(q).forms["hypotheses"]) == ("feature", True, "one")


def test_routes_follow_states(spark):
    docs = [("g", "1", {"nodes": [{"id": i, "node_type": k, "coordinates": [1, 2]} for i, k in enumerate(["geometry", "feature", "operation", "geometry", None, ""])]})]
    rows = [(i, g, t, json.dumps(p), "x", "clash") for i, (g, t, p) in enumerate(docs)]
    d = spark.createDataFrame(rows, DOCS)
    v = nested.variant_table(d).collect()
    assert sorted((r.subtype, r.nodes) for r in v) == [("feature", 1), ("geometry", 1), ("geometry", 1), ("geometry", 2), ("other", 1)]
    assert len({r.variant for r in v}) == 5 and nested.geometry_table(d).count() == 4 and nested.feature_table(d).count() == nested.other_table(d).count() == 1


def test_deep(spark):
    deep = '{"nodes": [{"id": "n", "node_type": "geometry", "coordinates": [1, 2], "x": ' + "[" * 900 + "]" * 900 + "}]}"
    worse = '{"nodes": ' + "[" * 10**6 + "]" * 10**6 + "}"
    assert kids(spark, ("a", "1", deep), ("b", "1", worse)) == [("a", "n", "vertex", 0)]
