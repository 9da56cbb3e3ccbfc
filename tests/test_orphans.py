from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kerfspark.operators import orphans


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n) if n is not None else None


def refs(spark, rows):
    t = spark.createDataFrame([(a, b, day(c), "clash") for a, b, c in rows], "node_id string, feature_node_ids array<string>, arrived_at timestamp_ntz, target_id string")
    return orphans.references(t, "t", "node_id", F.col("feature_node_ids"), "feature")


def parents(spark, rows):
    return orphans.parent_rows(spark.createDataFrame([(a, day(b), day(c)) for a, b, c in rows], "node_id string, arrived_at timestamp_ntz, deleted_at timestamp_ntz"), "node_id")


def found(refs_, parents_):
    return sorted((r.ref_id, r.target_id) for r in orphans.found(orphans.advance(None, refs_, parents_)[0]).collect())


def test_cases(spark):
    p = parents(spark, [("Feat-1", 1, None), ("feat-2", 5, None), ("feat-3", 1, 3), ("feat-3", 4, None), ("feat-4", 2, 9), (None, 1, None), (" ", 1, None)])
    r = refs(spark, [("a", ["feat-1 ", "FEAT-1", None, "", "  ", "feat-2", "feat-9"], 3), ("a", ["feat-1", "feat-7"], 8), ("b", ["feat-3"], 3), ("c", ["feat-3"], 2), ("d", ["feat-4"], 2), ("e", None, 1), ("f", [], 1), ("g", ["feat-1"], 0)])
    assert found(r, p) == [("a", "feat-2"), ("a", "feat-9"), ("b", "feat-3"), ("g", "feat-1")]
    none = refs(spark, [(None, ["x"], 3), (None, ["y"], 4)])
    assert sorted(r.target_id for r in orphans.found(orphans.advance(None, none, p)[0]).collect()) == ["x", "y"]


def test_deliveries_end_alike(spark):
    pr = [(f"f{i}", i % 9, (i % 9) + 3 if i % 4 == 0 else None) for i in range(30)] + [("f3", 0, 1)]
    rr = [(f"r{i}", [f"f{(i * 7) % 40}", f"F{i % 35} "], i % 10) for i in range(60)] + [("r1", ["f0"], 0)]
    whole, _ = orphans.advance(None, refs(spark, rr), parents(spark, pr))
    state = None
    for k in range(3):
        state = orphans.advance(state, refs(spark, [x for i, x in enumerate(rr) if i % 3 == k]), parents(spark, [x for i, x in enumerate(pr) if i % 3 == k]))
    key = lambda d: sorted(map(str, d.select("ref_id", "target_id", "seen", "orphaned_at", "resolved_at", "reopened_at").where("ref_id <> 'r1'").collect()))
    assert key(state[0]) == key(whole)


def test_late_deletion_reopens(spark):
    """A parent delivered alive and then, later, deleted."""
    state = orphans.advance(None, refs(spark, [("a", ["f"], 2)]), parents(spark, [("f", 1, None)]))
    assert orphans.found(state[0]).count() == 0
    state = orphans.advance(state, refs(spark, []), parents(spark, [("f", 9, 7)]))
    r = state[0].first()
    assert (r.orphaned_at, r.reopened_at) == (None, day(9))
    once, _ = orphans.advance(None, refs(spark, [("a", ["f"], 2)]), parents(spark, [("f", 1, None), ("f", 9, 7)]))
    assert once.first() == r


def test_followed(spark):
    """Deliveries by period of arrival end as one delivery does."""
    pr = [(f"f{i}", i % 9, (i % 9) + 3 if i % 4 == 0 else None) for i in range(30)]
    rr = [(f"r{i}", [f"f{(i * 7) % 40}", f"F{i % 35} "], i % 10) for i in range(60)]
    whole, _ = orphans.advance(None, refs(spark, rr), parents(spark, pr))
    key = lambda d: sorted(map(str, d.select("ref_id", "target_id", "seen", "orphaned_at", "resolved_at", "reopened_at").collect()))
    for periods in (1, 2, 5):
        assert key(orphans.followed(refs(spark, rr), parents(spark, pr), periods)) == key(whole)
    assert orphans.followed(refs(spark, []), parents(spark, []), 3).count() == 0


def test_quiet_months(spark):
    rows = [("a", ["x"], 0), ("b", ["y"], 0)]
    r, _ = orphans.advance(None, refs(spark, rows), parents(spark, [("x", 100, None)]))
    s = sorted((x.month, x.references, x.orphans, x.pending) for x in orphans.snapshots(r).collect())
    assert s == [("2024-01", 2, 2, 2), ("2024-02", 0, 0, 2), ("2024-03", 0, 0, 2), ("2024-04", 0, 0, 1)]


def test_snapshots(spark):
    r, _ = orphans.advance(None, refs(spark, [("a", ["x"], 0), ("b", ["y"], 1)]), parents(spark, [("x", 20, 25)]))
    s = orphans.snapshots(r).collect()
    assert [(x.ref_table, x.month, x.references, x.orphans, x.pending) for x in s] == [("t", "2024-01", 2, 2, 2)]


def test_empty(spark):
    assert found(refs(spark, []), parents(spark, [])) == []
    assert found(refs(spark, [("a", ["x"], 1)]), parents(spark, [])) == [("a", "x")]
