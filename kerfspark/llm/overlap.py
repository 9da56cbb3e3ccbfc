"""Exact and near copies of evaluation samples in the training split.

Samples of equal content are one class. A class's shingles are the grid cells of its features (class and position);
minwise hashes of them, banded, with the panel's type and the cells of its size, give buckets in which training classes
meet evaluation classes only; a bucket with very many pairs of classes is dealt into parts. Cells are wide against the tolerance and each band has its own grid offset, so that a
feature near a cell's edge in one band is inside in others. Candidates that keep the tolerances of the panel and can
reach the share of features are verified exactly: features are paired one to one by augmenting paths within their
class. Confirmed classes are spread out to their samples at the end.

Samples without id, without features, without panel or with a null panel measure match nothing; a feature without class or position
pairs with nothing; diameters pair if both are null (NaN and infinite values count as null). Of a repeated sample_id one row counts (values
are the same). Unknown or null splits are no split. Empty tables give no pairs; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from kerfspark.runtime import copy_to_parts, cut, deal, hot_keys, lookup

#: Tolerances in mm: width and height, thickness, position, diameter; and the share of features that must pair.
SIZE_MM, THICKNESS_MM, POSITION_MM, DIAMETER_MM, SHARE = 1.0, 0.5, 1.0, 0.3, 0.9
#: Cells in mm of positions and of panel sizes; bands and hashes a band. With five of six cells kept a pair is missed about once in 10^5.
CELL_MM, PANEL_CELL_MM, BANDS, ROWS = 16.0, 64.0, 24, 2
SLACK = 1e-9
#: Cells of the exact matching, a little wider than the tolerance.
NEAR_MM = POSITION_MM + 1e-6


def split_name(c: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "valid", "validation"), "val").when(s.isin("test", "testing"), "test")


def samples(table: DataFrame) -> DataFrame:
    """One row a sample with features, in a known split: sample_id, split, dataset_id, content and its parts."""
    known = table.where(F.size("features") > 0).dropDuplicates(["sample_id"]).withColumn("_split", split_name(F.col("split"))).where(F.col("_split").isNotNull() & F.col("sample_id").isNotNull())
    clean = lambda x: F.when(F.abs(x) < 1e15, x)
    feature = lambda f: F.struct(f["feature_class"].alias("c"), clean(F.get(f["position_mm"], F.lit(0))).alias("x"), clean(F.get(f["position_mm"], F.lit(1))).alias("y"), clean(f["diameter_mm"]).alias("d"))
    p = known.select("sample_id", F.col("_split").alias("split"), "dataset_id", F.col("panel.panel_type").alias("kind"), F.col("panel.width_mm").alias("w"), F.col("panel.height_mm").alias("h"), F.col("panel.thickness_mm").alias("t"), F.array_sort(F.transform(F.filter("features", lambda f: f.isNotNull()), feature)).alias("f"))
    p = p.where(F.col("kind").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull() & F.col("t").isNotNull() & (F.size("f") > 0))
    return p.withColumn("content", F.unhex(F.md5(F.to_json(F.struct("kind", "w", "h", "t", "f")))))


def classes(s: DataFrame) -> DataFrame:
    train = F.col("split") == "train"
    return s.groupBy("content").agg(*[F.first(c).alias(c) for c in ("kind", "w", "h", "t", "f")], F.max(train).alias("in_train"), F.max(~train).alias("in_eval"))


def bands(c: DataFrame) -> DataFrame:
    """A row a class and band: its bucket and what the first tests need.

    Each feature's cell is hashed once a band; the band's further hash functions are that hash under fixed masks. A
    class's features stay in its partition, so that nothing is shuffled for the least hashes.
    """
    at = lambda x, cell: F.floor(x / cell + F.col("_b") / BANDS)
    own = ["_kind", "w", "h", "t", "n", "in_train", "in_eval"]
    dealt = c.withColumns({"n": F.size("f"), "_kind": F.xxhash64("kind")}).repartition("content")
    placed = dealt.select("content", *own, F.explode("f").alias("_f")).where("_f.c is not null and _f.x is not null and _f.y is not null")
    each = placed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    hashed = each.withColumn("_h", F.xxhash64("_b", "_f.c", at(F.col("_f.x"), CELL_MM), at(F.col("_f.y"), CELL_MM)))
    masks = [F.lit((r * 0x5851F42D4C957F2D) % 2**63) for r in range(ROWS)]
    least = hashed.groupBy("content", "_b", *own).agg(*[F.min(F.col("_h").bitwiseXOR(m)).alias(f"_h{r}") for r, m in enumerate(masks)])
    bucket = F.xxhash64("_b", "_kind", at(F.col("w"), PANEL_CELL_MM), at(F.col("h"), PANEL_CELL_MM), *[f"_h{r}" for r in range(ROWS)])
    return least.select("content", bucket.alias("bucket"), *own[1:])


@F.pandas_udf(BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two lists of features (class, x, y, diameter) pair one to one for the share of the larger.

    Only features of neighbouring cells are compared; the largest matching is found by augmenting paths, without recursion.
    """

    def near(p, q) -> bool:
        if abs(p["x"] - q["x"]) > POSITION_MM + SLACK or abs(p["y"] - q["y"]) > POSITION_MM + SLACK:
            return False
        if p["d"] is None or q["d"] is None:
            return p["d"] is None and q["d"] is None
        return abs(p["d"] - q["d"]) <= DIAMETER_MM + SLACK

    def cell(p) -> tuple:
        return p["c"], math.floor(p["x"] / NEAR_MM), math.floor(p["y"] / NEAR_MM)

    def choices(left, right) -> list[list[int]]:
        known = lambda p: p["c"] is not None and p["x"] is not None and p["y"] is not None
        cells: dict[tuple, list[int]] = {}
        for j, q in enumerate(right):
            if known(q):
                cells.setdefault(cell(q), []).append(j)
        out = []
        for p in left:
            c, x, y = cell(p) if known(p) else (None, 0, 0)
            out.append([j for i in (-1, 0, 1) for k in (-1, 0, 1) for j in cells.get((c, x + i, y + k), ()) if near(p, right[j])] if c is not None else [])
        return out

    def augment(start: int, options: list[list[int]], taken: dict[int, int]) -> bool:
        came: dict[int, int] = {}
        queue = deque([start])
        while queue:
            i = queue.popleft()
            for j in options[i]:
                if j not in came:
                    came[j] = i
                    if j in taken:
                        queue.append(taken[j])
                        continue
                    held = {i2: j2 for j2, i2 in taken.items()} if i != start else {}
                    while True:
                        i = came[j]
                        last, taken[j] = held.get(i), i
                        if i == start:
                            return True
                        j = last
        return False

    def one(left, right) -> bool:
        need = SHARE * max(len(left), len(right)) - SLACK
        options = choices(left, right)
        if sum(map(bool, options)) < need:
            return False
        taken: dict[int, int] = {}
        later = []
        for i, js in enumerate(options):
            free = next((j for j in js if j not in taken), None)
            if free is None:
                later.append(i)
            else:
                taken[free] = i
        found = len(taken)
        for n, i in enumerate(later):
            if found >= need or found + len(later) - n < need:
                break
            found += augment(i, options, taken)
        return found >= need

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def class_pairs(c: DataFrame) -> DataFrame:
    """(train_content, eval_content) of the classes that match, a class with itself included.

    A bucket's two sides meet in blocks: where they make very many pairs, training classes are dealt into parts by content
    and evaluation classes are copied to each.
    """
    side = cut(bands(c))
    sides = side.groupBy("bucket").agg(F.sum(F.col("in_train").cast("bigint")).alias("_t"), F.sum(F.col("in_eval").cast("bigint")).alias("_e")).where("_t > 0 and _e > 0")
    hot = hot_keys(sides.select("bucket", (F.col("_t") * F.col("_e")).alias("n")), "bucket", "n")
    named = lambda end: ["bucket", *[F.col(x).alias(f"{x}_{end}") for x in ("content", "w", "h", "t", "n")]]
    t = deal(side.where("in_train").select(named("t")), hot, "bucket", "content_t")
    e = copy_to_parts(side.where("in_eval").select(named("e")), hot, "bucket")
    gap = lambda x, most: F.abs(F.col(f"{x}_t") - F.col(f"{x}_e")) <= most + SLACK
    enough = F.least("n_t", "n_e") >= SHARE * F.greatest("n_t", "n_e") - SLACK
    candidates = cut(t.join(e, ["bucket", "_part"]).where(gap("w", SIZE_MM) & gap("h", SIZE_MM) & gap("t", THICKNESS_MM) & enough).select("content_t", "content_e").distinct())
    f = c.select("content", "f")
    met = lookup(candidates, f.select(F.col("content").alias("content_t"), F.col("f").alias("f_t")), "content_t", "content_e", how="inner")
    met = lookup(met, f.select(F.col("content").alias("content_e"), F.col("f").alias("f_e")), "content_e", "content_t", how="inner", at_most=candidates._cut_rows)
    return met.where(alike("f_t", "f_e")).select(F.col("content_t").alias("train_content"), F.col("content_e").alias("eval_content"))


def matched(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The samples, and the pairs of classes that match."""
    s = cut(samples(table))
    return s, cut(class_pairs(cut(classes(s))))


def overlaps(table: DataFrame) -> DataFrame:
    """(train_id, train_source, eval_id, eval_split, eval_source) of all pairs of samples."""
    s, pairs = matched(table)
    t = s.where("split = 'train'").select(F.col("content").alias("train_content"), F.col("sample_id").alias("train_id"), F.col("dataset_id").alias("train_source"))
    e = s.where("split <> 'train'").select(F.col("content").alias("eval_content"), F.col("sample_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("dataset_id").alias("eval_source"))
    met = cut(lookup(t, pairs, "train_content", "train_id", how="inner", at_most=s._cut_rows))
    return lookup(met, e, "eval_content", "train_id", how="inner").select("train_id", "train_source", "eval_id", "eval_split", "eval_source")


def found(table: DataFrame) -> DataFrame:
    return overlaps(table).select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b"))


def counts(table: DataFrame) -> DataFrame:
    """Pairs and touched evaluation samples by split and source of the evaluation sample.

    Sizes of classes are multiplied; no pair of samples is made.
    """
    s, pairs = matched(table)
    t = s.where("split = 'train'").groupBy(F.col("content").alias("train_content")).agg(F.count(F.lit(1)).alias("_t"))
    e = s.where("split <> 'train'").groupBy(F.col("content").alias("eval_content"), F.col("split").alias("eval_split"), F.col("dataset_id").alias("eval_source")).agg(F.count(F.lit(1)).alias("_e"))
    each = lookup(pairs, t, "train_content", "eval_content", how="inner").groupBy("eval_content").agg(F.sum("_t").alias("_t"))
    return each.join(e, "eval_content").groupBy("eval_split", "eval_source").agg(F.sum(F.col("_t") * F.col("_e")).alias("pairs"), F.sum("_e").alias("samples"))
