"""Related records by connected components, and splits that never divide them.

Each key value (a source file, an assembly) ties its panels to the smallest of them, so the links are at most one a
panel and key. Rounds of hooking (each root to the least of its neighbours) and shortcutting (parents of parents, until
trees are stars) over tables contract the links to none; a component is named by its smallest panel_id. Links are kept
between roots only, so they shrink every round; each round is written to the shared checkpoint folder.

Keys are compared in lower case, without surrounding spaces, with one kind of slash; null, blank, ``n/a`` and
``unknown`` relate nothing. Rows without panel_id are left out; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kerfspark.llm.overlap import split_name
from kerfspark.llm.ranks import running_total
from kerfspark.runtime import cut, forget, lookup

# Stand-ins that relate nothing; the shares of the splits.
NOTHING = ["", "n/a", "unknown"]
SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
#: Bitsets begin with so many bits beyond twice what lacks, and grow until the closest total is known; no total depends on it.
FIRST_BITS = 1 << 16
#: A total that tests are measured by.
EXACT_TOTAL = 8_000_000


def relating(c: str) -> Column:
    k = F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^[\s ]+|[\s ]+$", ""))
    return F.when(~k.isin(NOTHING), k)


def links(panels: DataFrame) -> DataFrame:
    """(u, v), v < u: each panel with the smallest panel of each of its keys."""
    keys = F.array(F.concat(F.lit("f"), relating("source_file")), F.concat(F.lit("a"), relating("assembly_id")))
    held = panels.select("panel_id", F.explode(keys).alias("key")).where(F.col("panel_id").isNotNull() & F.col("key").isNotNull()).distinct()
    held = cut(held)
    first = cut(held.groupBy("key").agg(F.min("panel_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = lookup(held, first.select("key", "v"), "key", "panel_id", counts=first.select("key", "n"))
    return met.where(F.col("v") < F.col("panel_id")).select(F.col("panel_id").alias("u"), "v").distinct()


def stars(tree: DataFrame) -> DataFrame:
    """(id, parent) of a written forest, every parent a root: parents of parents, twice a round, until none is another."""
    while True:
        up = tree.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        once = lookup(tree.select("id", "parent"), up, "parent", "id", at_most=tree._cut_rows).select("id", F.col("grand").alias("parent"))
        twice = lookup(once, up, "parent", "id", at_most=tree._cut_rows)
        moved = Observation()
        jumped = cut(twice.observe(moved, F.max(F.col("grand") != F.col("parent")).alias("m")).select("id", F.col("grand").alias("parent")))
        forget(tree)
        tree = jumped
        if not moved.get.get("m"):
            return tree


def roots(u_v: DataFrame) -> DataFrame:
    """(panel_id, group_id) of every end of a link."""
    live = cut(u_v)
    labels = None
    while live._cut_rows:
        # hooking: each end to its least smaller neighbour, where it has one
        parents = F.coalesce(F.min("v"), F.col("id")).alias("parent")
        ends = live.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("v")), F.struct(F.col("v").alias("id"), F.lit(None).cast(live.schema["v"].dataType).alias("v")))).alias("_e")).select("_e.*")
        tree = stars(cut(ends.groupBy("id").agg(parents)))
        # links between the roots that are left
        at = tree.select(F.col("id").alias("u"), F.col("parent").alias("ru"))
        to = tree.select(F.col("id").alias("v"), F.col("parent").alias("rv"))
        met = lookup(lookup(live, at, "u", "v"), to, "v", "u", at_most=live._cut_rows).where(F.col("ru") != F.col("rv"))
        rest = cut(met.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct())
        forget(live)
        live = rest
        if labels is None:
            labels = tree.select(F.col("id").alias("panel_id"), F.col("parent").alias("group_id"))
            labels._cut_path, labels._cut_rows = tree._cut_path, tree._cut_rows
        else:
            up = tree.select(F.col("id").alias("group_id"), F.col("parent").alias("top"))
            fresh = cut(lookup(labels, up, "group_id", "panel_id").select("panel_id", F.coalesce("top", "group_id").alias("group_id")))
            forget(labels, tree)
            labels = fresh
    if labels is None:
        return live.select(F.col("u").alias("panel_id"), F.col("v").alias("group_id"))
    return labels


def found(panels: DataFrame) -> DataFrame:
    return roots(links(panels))


def batched(counts: dict[int, int], most: int) -> list[tuple[int, int]]:
    """(size, number) by powers of two whose sums are all multiples of each size up to ``most``."""
    batches = []
    for size in sorted(counts, reverse=True):
        left, batch = min(counts[size], most // size), 1
        while left > 0:
            batches.append((size, min(batch, left)))
            left, batch = left - batch, batch * 2
    return batches


def reachable(counts: dict[int, int], target: int, back: dict[int, int] | None = None, most: int | None = None, exact: bool = False) -> dict[int, int] | None:
    """Of groups (size: number), how many of each size to take so that their total is the closest to target; of two the lower.

    Of the groups in ``back``, already held, some may be given back (negative numbers). Taken are at most ``most`` panels
    (twice the target and one are enough if none are given back). With ``exact``, None where target itself isn't reached.

    Bitsets of reachable totals in steps of the sizes' common divisor, one a power-of-two batch of a size. Of the bitsets
    only as many are held as batches can be halved; the others are made again on the way back.
    """
    step = math.gcd(*counts, *(back or {})) or 1
    most = 2 * target + 1 if most is None else most
    mask = (1 << (most // step + 1)) - 1
    batches = batched(counts, most) + [(-size, n) for size, n in batched(back or {}, most)]

    def after(held: int, start: int, end: int) -> int:
        for size, take in batches[start:end]:
            by = size * take // step
            held = (held | held << by) & mask if by > 0 else held | held >> -by
        return held

    full = after(1, 0, len(batches))
    if exact and (target % step or not full >> target // step & 1):
        return None
    low = target // step
    below = ((full & ((1 << (low + 1)) - 1)).bit_length() - 1) * step
    above = full >> (low + 1)
    up = (low + (above & -above).bit_length()) * step if above else None
    total = up if up is not None and up - target < target - below else below
    del full, above
    chosen: dict[int, int] = {}

    def walk(held: int, start: int, end: int, total: int) -> int:
        if end - start > 1:
            middle = (start + end) // 2
            return walk(held, start, middle, walk(after(held, start, middle), middle, end, total))
        size, take = batches[start]
        if held >> total // step & 1:
            return total
        key = abs(size)
        chosen[key] = chosen.get(key, 0) + (take if size > 0 else -take)
        return total - size * take

    if batches:
        walk(1, 0, len(batches), total)
    return chosen


def closest(counts: dict[int, int], target: int) -> dict[int, int]:
    """Of groups (size: number), how many of each size to take for the total closest to the target, of two the lower; exact for all totals.

    Groups are taken from the largest down as they fit. What then lacks is made up by exchanges: groups taken for groups
    given back. With a the largest size left and b the largest taken, some a numbers up to b and b numbers up to a always
    have parts of equal sum, which needn't be exchanged. So a closest total is among the exchanges that take at most
    a * b panels and twice what lacks, nor more than the target and what lacks. Bitsets begin far shorter than that and end
    as soon as the best total that any multiple of the sizes' common divisor can be is there: the length decides the time
    only, never the total.
    """
    usable = {s: n for s, n in counts.items() if n > 0 and s <= 2 * target + 1}
    if not usable:
        return {}
    step, chosen, lacks = math.gcd(*usable), {}, target
    for size in sorted(usable, reverse=True):
        if take := min(usable[size], lacks // size):
            chosen[size] = take
            lacks -= size * take
    best = lacks // step * step
    if 2 * lacks > 2 * best + step:
        best += step
    if not best:
        return chosen
    rest = {s: left for s, n in usable.items() if (left := n - chosen.get(s, 0))}
    if not rest:
        return chosen
    enough = min(max(rest) * max(chosen, default=0) + 2 * lacks, target + lacks)
    most = FIRST_BITS * step + 2 * lacks
    while True:
        last = most >= enough
        moved = reachable(rest, lacks if last else best, chosen, min(most, enough), not last)
        if moved is not None:
            return {s: n for s in {*chosen, *moved} if (n := chosen.get(s, 0) + moved.get(s, 0))}
        most *= 16


def choose(sizes: dict[int, int], shares: dict[str, float] = SHARES) -> dict[str, dict[int, int]]:
    """For each split but the first, how many groups of each size it gets; the first gets the rest."""
    total = sum(s * n for s, n in sizes.items())
    rest, chosen = dict(sizes), {}
    for split in list(shares)[1:]:
        chosen[split] = closest(rest, round(total * shares[split]))
        for s, n in chosen[split].items():
            rest[s] -= n
    return chosen


def membership(panels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel_id, sample_id, group_id) of every panel, and (group_id, size) of every group, those of one panel included."""
    own = panels.where(F.col("panel_id").isNotNull()).groupBy("panel_id").agg(F.min("sample_id").alias("sample_id"))
    grouped = cut(own.join(found(panels), "panel_id", "left").withColumn("group_id", F.coalesce("group_id", "panel_id")))
    return grouped, cut(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")))


def sizes(panels: DataFrame) -> DataFrame:
    """(size, groups): how many groups there are of each number of panels."""
    return membership(panels)[1].groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def assign(panels: DataFrame, samples: DataFrame, shares: dict[str, float] = SHARES, seed: int = 0) -> DataFrame:
    """(panel_id, group_id, split, present_split) of every panel; present_split is that of its sample, null without one.

    To the driver go only (size, number of groups) pairs, fewer than the square root of twice the number of panels.
    """
    grouped, groups = membership(panels)
    sizes = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = choose(sizes, shares)
    ranked = running_total(groups, "size", "group_id", F.lit(1), seed, "rank")
    first = next(iter(shares))
    bounds, start = [], {s: 0 for s in sizes}
    for split, of in picked.items():
        for s, n in of.items():
            bounds.append((s, start[s], start[s] + n, split))
            start[s] += n
    table = panels.sparkSession.createDataFrame(bounds or [(-1, 0, 0, first)], "b_size bigint, b_from bigint, b_to bigint, b_split string")
    met = ranked.join(table, (F.col("size") == F.col("b_size")) & (F.col("rank") >= F.col("b_from")) & (F.col("rank") < F.col("b_to")), "left")
    dealt = met.select("group_id", F.coalesce("b_split", F.lit(first)).alias("split"))
    present = samples.where(F.col("sample_id").isNotNull()).groupBy("sample_id").agg(F.min(split_name(F.col("split"))).alias("present_split"))
    out = lookup(grouped, dealt, "group_id", "panel_id")
    return out.join(present, "sample_id", "left").select("panel_id", "group_id", "split", "present_split")


def report(assigned: DataFrame) -> DataFrame:
    """Panels and share of each split, and the panels of the present split of that name that would move."""
    total = assigned.agg(F.count(F.lit(1)).alias("_all"))
    by = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("panels"), F.countDistinct("group_id").alias("groups"), F.sum((F.col("present_split") != F.col("split")).cast("bigint")).alias("otherwise_at_present"))
    return by.join(F.broadcast(total)).select("split", "panels", "groups", F.coalesce("otherwise_at_present", F.lit(0)).alias("otherwise_at_present"), (F.col("panels") / F.col("_all")).alias("share"))
