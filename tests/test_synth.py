import math

from pyspark.sql import functions as F

from kerfspark.operators import classify, model, synth


def test_samples_repeat_and_split(spark):
    whole = {r.panel_id: r for r in synth.generate(spark, 40, seed=7).collect()}
    part = {r.panel_id: r for r in synth.generate(spark.newSession(), 10, seed=7, start=20).collect()}
    assert all(whole[k] == v for k, v in part.items()) and len(part) == 10
    assert 0 < sum(not r.intended_valid for r in whole.values()) < 40


def test_gate(spark):
    s = synth.generate(spark, 120, seed=3)
    kept = synth.gated(s).collect()
    assert len(kept) >= 90
    assert all(not r.broken_rules for r in kept if r.intended_valid)
    assert {"MFG-001", "MFG-002", "MFG-011"} <= {x for r in kept for x in r.broken_rules}
    assert {r.fault for r in kept} >= {None, "narrow_pocket", "sharp_corner", "open_contour", "outside"}


def test_every_feature_is_made():
    found = {f[1] for i in range(400) for f in synth.sample(i, 11, 0.0)[7]}
    assert found == set(synth.MAKERS)
    for i in range(60):
        _, kind, w, h, _, valid, _, features = synth.sample(i, 5, 0.0)
        assert valid and {f[1] for f in features} <= set(synth.allowed(kind))
        groups = {}
        for f in features:
            if f[1] == "SHELF_PIN_HOLE":
                groups.setdefault(f[10], []).append(f[4])
        assert all(len(ys) >= 3 and all(abs((y - ys[0]) % 32) < 1e-9 for y in ys) for ys in groups.values())


def test_turned_and_renamed(spark):
    s = synth.generate(spark, 30, seed=1)
    noisy = synth.jittered(s, sigma=0.0, copies=0.0, layers=1.0, degrees=90.0).orderBy("panel_id").collect()
    for a, b in zip(s.orderBy("panel_id").collect(), noisy):
        for f, g in zip(a.features, b.features):
            assert math.isclose(g.x, a.w / 2 - (f.y - a.h / 2), abs_tol=1e-9) and (f.layer not in synth.ALIASES or g.layer in synth.ALIASES[f.layer])


def test_noise(spark):
    s = synth.generate(spark, 30, seed=1)
    a, b = (synth.jittered(s, sigma=0.5, copies=0.2).orderBy("panel_id").collect() for _ in range(2))
    plain = s.orderBy("panel_id").collect()
    assert a == b and sum(len(r.features) for r in a) > sum(len(r.features) for r in plain)
    gaps = [f.diameter - g.diameter for r, q in zip(a, plain) for f, g in zip(r.features, q.features) if g.diameter]
    assert 0.3 < math.sqrt(sum(x * x for x in gaps) / len(gaps)) < 0.7


def test_contour_classes(spark):
    rows = [(1, "LWPOLYLINE", "POCKET_1", True, 100.0, 8.0, 216.0, None), (2, "LWPOLYLINE", "POCKET_1", True, 50.0, 40.0, 180.0, None), (3, "LINE", "CUT", False, 10.0, 10.0, 14.0, 3.0), (4, "ARC", "X", False, 10.0, 10.0, 14.0, 3.0), (5, "LINE", "CUT", False, 500.0, 1.0, 500.0, 3.0), (6, "LINE", "MARK_A", False, 5.0, 5.0, 7.0, None), (7, "POLYLINE", "OUTLINE", True, 5.0, 5.0, 20.0, None), (8, "LWPOLYLINE", None, True, 5.0, 5.0, 20.0, None)]
    d = spark.createDataFrame(rows, "contour_id int, entity_type string, layer string, is_closed boolean, w double, h double, length double, edge double")
    assert [r.feature_class for r in classify.classify_contours(d).orderBy("contour_id").collect()] == ["GROOVE", "POCKET", "CHAMFER", "FILLET", "UNKNOWN_FEATURE", "ENGRAVING", "INTERNAL_CUTOUT", "UNKNOWN_FEATURE"]


def test_centroids(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [10.0, 10.0], "b"), (4, [9.0, 9.0], None)], "id int, v array<double>, label string")
    m = model.centroids(d, "label", "v")
    assert {r.label: r.centroid for r in m.collect()} == {"a": [1.0, 0.0], "b": [10.0, 10.0]}
    assert [r.predicted for r in model.predict(d, "id", "v", m).orderBy("id").collect()] == ["a", "a", "b", "b"]
    assert model.centroids(d.where(F.lit(False)), "label", "v").count() == 0


def test_centroids_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 50), float(i % 7)], i % 50) for i in range(300)]
    d = spark.createDataFrame(rows, "i int, v array<double>, label int")
    means = model.centroids(d, "label", "v")
    whole = sorted(tuple(r) for r in model.predict(d, "i", "v", means).collect())
    monkeypatch.setattr(model, "MOST_NUMBERS", 1)
    monkeypatch.setattr(model, "BLOCK", 7)
    assert sorted(tuple(r) for r in model.predict(d, "i", "v", means).collect()) == whole and len(whole) == 300
