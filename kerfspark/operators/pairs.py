"""Pairs of points within groups of any size, as equi-joins over grid cells, bands or blocks.

A group (a panel) may hold a third of all points: cells, not the group, are the join key, so its points spread over as many
keys as it has cells. Each point is in one cell of the left side and offered to its neighbours on the right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a group that meet in one task where every pair is asked for.
BLOCK = 2_000


def _cells(points: DataFrame, reach: float, steps: list[tuple[int, int]], group: str, names: list[str], end: str) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    moved = points.withColumn("_s", around)
    return moved.select(group, (at("x") + F.col("_s.i")).alias("_cx"), (at("y") + F.col("_s.j")).alias("_cy"), ((F.col("_s.i") == 0) & (F.col("_s.j") == 0)).alias(f"_own{end}"), *[F.col(c).alias(f"{c}{end}") for c in names])


def near_pairs(points: DataFrame, group: str, ident: str, reach: float, keep: Column, extra: list[str] = (), size: str | None = None, per_size: float = 1.0, usual: float = 64.0) -> DataFrame:
    """Pairs a < b (by ``ident``) of a group within ``reach`` in x and y for which ``keep`` holds.

    With ``size``, the reach is ``reach`` and ``per_size`` times the larger of the two sizes, whatever that is: pairs of
    points of the usual size meet in cells made for it, and the few larger ones, by powers of two of their size, meet all
    others in cells of theirs. ``keep`` and the result's columns name the two sides' ``x``, ``y``, ``ident`` and ``extra``
    with the suffixes _a and _b. Points without place pair with nothing.
    """
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    names = list(dict.fromkeys([ident, "x", "y", *extra, *([size] if size else [])]))
    level = F.when(F.col(size) > usual, F.ceil(F.log2(F.col(size) / usual)).cast("int")).otherwise(0) if size else F.lit(0)
    leveled = placed.withColumn("_level", level)
    # a power of two a row: numbers of at most three digits, whatever the data
    larger = sorted(r[0] for r in leveled.where(F.col(size) > usual).select("_level").distinct().collect() if r[0] > 0) if size else []
    met = []
    for k in [0, *larger]:
        most = reach + (per_size * usual * 2**k if size else 0.0)
        own = leveled.where(F.col("_level") == k)
        left = _cells(own, most, [(0, 0)], group, names, "_l").drop("_own_l")
        if k:
            right = _cells(leveled.where(F.col("_level") <= k), most, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], group, [*names, "_level"], "_r")
            once = (F.col("_level_r") < k) | (F.col(f"{ident}_l") < F.col(f"{ident}_r"))
        else:
            right = _cells(own, most, [(0, 0), (1, 0), (1, 1), (0, 1), (-1, 1)], group, names, "_r")
            once = ~F.col("_own_r") | (F.col(f"{ident}_l") < F.col(f"{ident}_r"))
        close = (F.abs(F.col("x_l") - F.col("x_r")) <= most) & (F.abs(F.col("y_l") - F.col("y_r")) <= most)
        both = left.join(right, [group, "_cx", "_cy"]).where(once & close & (F.col(f"{ident}_l") != F.col(f"{ident}_r")))
        first = F.col(f"{ident}_l") < F.col(f"{ident}_r")
        pick = lambda c, a, b: F.when(first, F.col(c + a)).otherwise(F.col(c + b))
        met.append(both.select(group, *[pick(c, "_l", "_r").alias(f"{c}_a") for c in names], *[pick(c, "_r", "_l").alias(f"{c}_b") for c in names]).where(keep))
    out = met[0]
    for more in met[1:]:
        out = out.unionByName(more)
    return out


def band_pairs(points: DataFrame, group: str, ident: str, along: str, width: float) -> DataFrame:
    """Pairs a < b of a group whose ``along`` differs by at most ``width``: (group, ident_a, ident_b)."""
    at = F.floor(F.col(along) / width).cast("bigint")
    placed = points.where(F.col(along).isNotNull())
    left = placed.select(group, at.alias("_c"), F.col(ident).alias(f"{ident}_a"), F.col(along).alias("_va"))
    right = placed.withColumn("_s", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).select(group, (at + F.col("_s")).alias("_c"), F.col(ident).alias(f"{ident}_b"), F.col(along).alias("_vb"))
    met = left.join(right, [group, "_c"]).where((F.col(f"{ident}_a") < F.col(f"{ident}_b")) & (F.abs(F.col("_va") - F.col("_vb")) <= width))
    return met.select(group, f"{ident}_a", f"{ident}_b")


def block_pairs(points: DataFrame, group: str, ident: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """All pairs a < b of a group, for conditions without a reach: blocks of a large group meet pair by pair of blocks.

    A group of no more than ``block`` points is one block. Of a larger one each pair of blocks is a key of its own, so that
    no task has more than two blocks of it.
    """
    names = list(dict.fromkeys([ident, *columns]))
    sizes = points.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n")).where("_n > 1")
    known = points.join(sizes, group, "left").withColumns({"_n": F.coalesce("_n", F.lit(1)), "_i": F.pmod(F.xxhash64(ident), F.coalesce("_n", F.lit(1))).cast("int")})
    side = lambda end, lo, hi: known.select(group, *[F.col(c).alias(f"{c}_{end}") for c in names], F.col("_i").alias(f"_own_{end}"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o")).select("*", F.col(lo).alias("_p"), F.col(hi).alias("_q"))
    met = side("l", "_own_l", "_o").drop("_o").join(side("r", "_o", "_own_r").drop("_o"), [group, "_p", "_q"]).where((F.col("_p") < F.col("_q")) | ((F.col("_p") == F.col("_q")) & (F.col(f"{ident}_l") < F.col(f"{ident}_r"))))
    first = F.col(f"{ident}_l") < F.col(f"{ident}_r")
    pick = lambda c, a, b: F.when(first, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}"))
    return met.select(group, *[pick(c, "l", "r").alias(f"{c}_a") for c in names], *[pick(c, "r", "l").alias(f"{c}_b") for c in names])


def distance() -> Column:
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    return F.sqrt(dx * dx + dy * dy)
