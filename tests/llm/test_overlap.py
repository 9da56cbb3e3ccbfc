import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerfspark import runtime
from kerfspark.llm import overlap

SAMPLES = "sample_id string, dataset_id string, split string, panel struct<width_mm:double,height_mm:double,thickness_mm:double,panel_type:string>, features array<struct<feature_class:string,diameter_mm:double,position_mm:array<double>>>, content string, kind int"


def feats(n, dx=0.0, dd=0.0, first="HOLE"):
    return [(first if i == 0 else "HOLE", 5.0 + dd, [37.0 * i + dx + 15.9, 100.0 + 13 * (i % 5) + dx]) for i in range(n)]


def pairs(spark, *rows):
    df = spark.createDataFrame([(a, "src", s, p, f, "x", 1) for a, s, p, f in rows], SAMPLES)
    return sorted(tuple(r) for r in overlap.found(df).collect())


P = (800.0, 560.0, 18.0, "side")


def test_splits_and_tolerances(spark):
    got = pairs(
        spark,
        ("t1", " Training", P, feats(10)), ("v1", "VALID", P, feats(10)), ("v2", "test ", (801.0, 559.0, 18.5, "side"), feats(10, 0.9, 0.29)),
        ("v3", "val", P, feats(10, 1.2)), ("v4", "val", P, feats(10, 0, 0.4)), ("v5", "val", (802.0, 560.0, 18.0, "side"), feats(10)), ("v6", "val", (800.0, 560.0, 18.0, "door"), feats(10)),
        ("v7", "testing", P, feats(10, first="POCKET")), ("v8", "test", P, feats(9)), ("v9", "test", P, feats(8)), ("n1", None, P, feats(10)), ("n2", "other", P, feats(10)), ("t2", "TRAIN", P, feats(10)),
    )
    assert got == sorted(tuple(sorted((t, v))) for t in ("t1", "t2") for v in ("v1", "v2", "v7", "v8"))


def test_one_to_one(spark):
    near = lambda *xs: [("H", None, [x, 50.0]) for x in xs]
    assert pairs(spark, ("t", "train", P, near(100.0, 101.5)), ("v", "val", P, near(100.9, 100.9))) == [("t", "v")]
    assert pairs(spark, ("t", "train", P, near(100.0, 100.0)), ("v", "val", P, near(100.0, 102.0))) == []
    assert pairs(spark, ("t", "train", P, near(100.0, 101.0, 102.0)), ("v", "val", P, near(101.0, 100.0, 102.9))) == [("t", "v")]


def test_nulls(spark):
    odd = [(None, 5.0, [1.0, 2.0]), ("H", 5.0, None), ("H", 5.0, [None, 1.0])]
    rows = [("t", "train", P, odd), ("v", "val", P, odd), ("t2", "train", P, []), ("v2", "val", P, None), ("t3", "train", None, feats(6)), ("v3", "val", (None, 1.0, 1.0, "s"), feats(6))]
    assert pairs(spark, *rows) == [] and pairs(spark) == []
    assert pairs(spark, ("t", "train", P, [("H", float("nan"), [1.0, 1.0])]), ("v", "val", P, [("H", None, [1.0, 1.0])])) == [("t", "v")]


def test_repeats_and_hot_copies(spark):
    rows = [(f"t{i}", "train", P, feats(8)) for i in range(40)] + [(f"v{i}", "test", P, feats(8)) for i in range(5)] + [("t0", "train", P, feats(8))]
    assert len(pairs(spark, *rows)) == 200


def test_matching_of_many_features():
    """Chains of features each near two of the other sample, where every first choice has to move; and three thousand at once."""
    chain = [{"c": "H", "x": 1.5 * i, "y": 0.0, "d": None} for i in range(1500)]
    other = [{"c": "H", "x": 1.5 * i - 0.8, "y": 0.0, "d": None} for i in range(1500)]
    many = [{"c": "H", "x": float(i % 60) * 3, "y": float(i // 60) * 3, "d": 5.0} for i in range(3000)]
    far = [{**f, "x": f["x"] + 1.5} for f in many[:400]] + many[400:]
    got = overlap.alike.func(pd.Series([chain, many, many]), pd.Series([other, many[::-1], far]))
    assert list(got) == [True, True, False]


def test_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 3)
    rows = [(f"t{i}", "train", P, [*feats(8), ("X", 5.0, [500.0, 10.0 * i])]) for i in range(12)] + [(f"v{i}", "test", P, [*feats(8), ("X", 5.0, [500.0, 10.0 * i])]) for i in range(6)]
    assert pairs(spark, *rows) == sorted((f"t{i}", f"v{j}") for i in range(12) for j in range(6) if 8 >= 0.9 * 9 - 1e-9 or i == j)


@pytest.mark.parametrize("n", [6, 12, 24])
def test_recall_of_jittered_copies(spark, n):
    import random

    r = random.Random(n)
    rows = []
    for k in range(150):
        f = [(r.choice("ABC"), r.choice([None, 5.0, 8.0]), [r.uniform(0, 800), r.uniform(0, 560)]) for _ in range(n)]
        rows.append((f"t{k}", "train", (r.uniform(300, 900), 500.0, 18.0, "s"), f))
        p = rows[-1][2]
        rows.append((f"v{k}", "val", (p[0] + r.uniform(-1, 1), 500.0, 18.0, "s"), [(c, d, [x + r.uniform(-1, 1), y + r.uniform(-1, 1)]) for c, d, (x, y) in f]))
    assert pairs(spark, *rows) == sorted((f"t{k}", f"v{k}") for k in range(150))


def test_counts(spark, small):
    t = spark.read.parquet(f"{small}/generated_samples.parquet")
    assert overlap.counts(t).agg(F.sum("pairs")).first()[0] == overlap.found(t).count()
