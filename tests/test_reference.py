import math

import pytest

from kerfspark.plans import problems, reference

QUERIES = reference.QUERIES | problems.QUERIES
ORACLE = reference.ORACLE | problems.ORACLE


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    sql = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLE[name]})").fetchall()
    assert sorted(tuple(map(norm, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(norm, r)) for r in sql)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0
