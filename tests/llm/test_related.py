import random

from kerfspark.llm import related

PANELS = "panel_id string, source_file string, assembly_id string, sample_id string, group_id string, parent int"


def panels(spark, *rows):
    return spark.createDataFrame([(*r, None, "clash", 1) for r in rows], PANELS)


def test_spelling_and_nothing(spark):
    got = related.found(panels(spark, ("a", " Jobs\\X.DXF", None), ("b", "jobs/x.dxf ", "A1"), ("c", None, " a1"), ("d", "x.dxf", "N/A"), ("e", "", "n/a"), ("f", "Unknown", " "), ("g", "jobs/y/x.dxf", None), (None, "jobs/x.dxf", "A1"), ("b", "jobs/x.dxf", "A1"), ("h", "a1", None)))
    assert sorted(tuple(r) for r in got.select("panel_id", "group_id").collect()) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_none(spark):
    assert related.found(panels(spark)).count() == 0
    assert related.found(panels(spark, ("a", "x", None), ("b", "y", None))).count() == 0


def test_against_union_find(spark):
    r = random.Random(5)
    rows = [(f"p{i:04d}", f"f{i // 2}" if i < 200 else f"f{r.randrange(400)}", f"a{(i + 1) // 2}" if i < 200 else r.choice([None, f"a{r.randrange(500)}"])) for i in range(700)]
    rows += [(f"h{i}", "hot", None) for i in range(300)]
    up = {x[0]: x[0] for x in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for p, f, a in rows:
        for k in (("f", f), ("a", a)):
            if k[1]:
                x, y = top(first.setdefault(k, p)), top(p)
                up[max(x, y)] = min(x, y)
    want = {p: top(p) for p in up}
    sizes = {}
    for g in want.values():
        sizes[g] = sizes.get(g, 0) + 1
    got = {x.panel_id: x.group_id for x in related.found(panels(spark, *rows)).collect()}
    assert got == {p: g for p, g in want.items() if sizes[g] > 1}


def test_reachable():
    assert related.reachable({5: 2, 3: 1}, 8) in ({5: 1, 3: 1},)
    assert sum(s * n for s, n in related.reachable({7: 3, 4: 2}, 10).items()) == 11
    assert related.reachable({}, 5) == {} and related.reachable({100: 1}, 10) == {}
    r = random.Random(1)
    sizes = {r.randrange(1, 90): r.randrange(1, 30) for _ in range(30)}
    got = related.reachable(sizes, 500)
    assert sum(s * n for s, n in got.items()) == 500 and all(n <= sizes[s] for s, n in got.items())


def test_split(spark):
    rows = [(f"p{i:03d}", f"f{i // 5}", None) for i in range(200)]
    samples = spark.createDataFrame([("s", "Val")], "sample_id string, split string")
    out = related.assign(panels(spark, *rows), samples).collect()
    assert len(out) == 200 and len({(r.group_id, r.split) for r in out}) == 40
    count = {s: sum(r.split == s for r in out) for s in ("train", "val", "test")}
    assert count == {"train": 140, "val": 30, "test": 30}
    assert related.assign(panels(spark), samples).count() == 0


def test_totals_far_above_the_limit():
    """A million million panels in groups of up to hundreds of thousands: both splits to the panel, in bitsets of bounded size."""
    sizes = {1: 10**9, 7: 10**8, 900_000: 10**6, 2: 5}
    total = sum(s * k for s, k in sizes.items())
    chosen = related.choose(sizes)
    assert [sum(s * k for s, k in chosen[x].items()) for x in ("val", "test")] == [round(total * 0.15)] * 2
    none = related.choose({30_000_000: 10})
    assert sum(none["val"].values()) in (1, 2) and all(k <= 10 for of in none.values() for k in of.values())


def test_coarse_steps():
    chosen = related.choose({related.EXACT_TOTAL // 3: 12, 1: 1000}, {"train": 0.5, "val": 0.25, "test": 0.25})
    assert chosen["val"][related.EXACT_TOTAL // 3] == 3 and chosen["test"][related.EXACT_TOTAL // 3] == 3


def test_exact_above_the_limit():
    """Totals above EXACT_TOTAL reach their shares too: singletons, few large groups among them, and sizes that leave a rest from the largest down."""
    n = related.EXACT_TOTAL
    for sizes in ({1: n + 1}, {1: 3 * n, 1000: 7, 3: 11}, {3: n // 2, 2: n // 2, 7: 5}, {1000: n // 500, 7: 2000, 4: 1}):
        total = sum(s * k for s, k in sizes.items())
        chosen = related.choose(sizes)
        assert all(chosen[x].get(s, 0) >= 0 for x in chosen for s in sizes) and all(sum(of.get(s, 0) for of in chosen.values()) <= k for s, k in sizes.items())
        assert [sum(s * k for s, k in chosen[x].items()) for x in ("val", "test")] == [round(total * 0.15)] * 2


def test_closest_at_any_size(monkeypatch):
    """The closest total there is, the lower of two, whatever the number of panels and wherever bitsets begin."""
    total = lambda of: sum(s * k for s, k in of.items())
    for sizes in ({9_991: 800, 10_003: 700, 9_989: 600}, {700_001: 9, 500_009: 9, 300_007: 9, 90_001: 9}, {99_991: 400, 100_003: 400, 99_989: 300}):
        target = round(total(sizes) * 0.15)
        got = related.closest(sizes, target)
        assert total(sizes) > related.EXACT_TOTAL and total(got) == total(related.reachable(sizes, target)) and all(0 < k <= sizes[s] for s, k in got.items())
    r = random.Random(2)
    for first in (4, 1 << 16):
        monkeypatch.setattr(related, "FIRST_BITS", first, raising=False)
        for _ in range(1500):
            by = r.choice([1, 1, 2, 3, 10])
            sizes = {by * r.randrange(1, 40): r.randrange(1, 6) for _ in range(r.randrange(1, 6))}
            target, sums = r.randrange(total(sizes) + 1), {0}
            for s, n in sizes.items():
                sums = {x + s * k for x in sums for k in range(n + 1)}
            got = related.closest(sizes, target)
            assert total(got) == min(sums, key=lambda x: (abs(x - target), x)) and all(0 < k <= sizes[s] for s, k in got.items())
