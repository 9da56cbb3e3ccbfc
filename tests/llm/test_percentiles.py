import math
import random

import pytest
from pyspark.sql import functions as F

from kerfspark.llm import percentiles
from kerfspark.llm import queries

ROWS = "g string, v double, day int, q int, n int"


def exact(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(round(q * len(v), 9))) - 1]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    out = [(r.choice(["a", "a", "a", "b", None]), r.choice([r.lognormvariate(2, 3), -r.random(), 5.0, 5.0]), r.randrange(5), 1, 2) for _ in range(4000)]
    out += [("c", None, 0, 1, 2), ("c", float("nan"), 0, 1, 2), ("d", float("inf"), 0, 1, 2), ("e", 0.0, 0, 1, 2), ("e", -0.0, 1, 1, 2), ("a", 5e-324, 1, 1, 2), ("a", -1e300, 1, 1, 2)]
    return out, spark.createDataFrame(out, ROWS)


def groups(rows, positive=False):
    by = {}
    for g, v, *_ in rows:
        if v is not None and not math.isnan(v) and (v > 0 or not positive):
            by.setdefault(g, []).append(v)
    return by


@pytest.mark.parametrize("positive", [False, True])
def test_exact(rows, positive):
    want = {(g, q): exact(v, q) for g, v in groups(rows[0], positive).items() for q in (0.0, 0.01, 0.5, 1.0)}
    got = percentiles.percentiles(rows[1], ["g"], F.col("v"), (0.0, 0.01, 0.5, 1.0), positive=positive).collect()
    assert {(r.g, r.q): r.value for r in got} == want and len(got) == len(want)


def test_bounded_error(rows):
    by = groups(rows[0], True)
    got = percentiles.percentiles(rows[1], ["g"], F.col("v"), (0.5, 0.9), positive=True, passes=2).collect()
    assert all(0 <= exact(by[r.g], r.q) - r.value <= r.relative_error * exact(by[r.g], r.q) for r in got if r.g != "d")


def test_combined_days(rows):
    whole = percentiles.histogram(rows[1], ["g"], ["day"], F.col("v"), positive=True)
    parts = [whole.where(F.col("day") == d) for d in range(5)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    by = groups(rows[0], True)
    for r in percentiles.from_histogram(merged, ["g"], (0.5, 0.99)).collect():
        if r.g != "d":
            assert r.n == len(by[r.g]) and 0 <= exact(by[r.g], r.q) - r.value <= r.relative_error * exact(by[r.g], r.q)


def test_empty(rows):
    none = rows[1].limit(0)
    assert percentiles.percentiles(none, ["g"], F.col("v")).count() == 0
    assert percentiles.from_histogram(percentiles.histogram(none, ["g"], [], F.col("v")), ["g"]).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    key = lambda rows: sorted(str([round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else v for v in r]) for r in rows)
    assert key(df.select(*cols).collect()) == key(duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({queries.ORACLE[name]})").fetchall())
