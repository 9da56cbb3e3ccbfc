"""References to rows that don't exist (yet, or any more), kept as keyed pending state.

State is two tables: ``parents`` (what is known of each parent's life) and ``refs`` (one row a reference, with the times at
which it became an orphan, was resolved and was orphaned again). ``advance`` moves the state by one delivery of new
references and parent rows: new references probe the parent index, arriving parents resolve the references that wait for
them, deletions reopen resolved ones, also such as come with a later copy of the parent. Only references whose parent the
delivery touches are judged anew. ``report`` runs all tables through deliveries by period of arrival; one delivery with all
rows, or any other cut, ends in the same state (tested), as every reference's times follow from its own arrival and its
parent's life. ``snapshots`` counts, a table and month, references that arrived, those that were orphans at once, and
those pending at the month's end, quiet months included.

Whether a reference is an orphan at once goes by its parent's earliest copy (its arrival, and the deletion it tells of). A
deletion told by a later copy reopens references from the time it is known and done.

Ids are compared in lower case without surrounding spaces; null and blank ids are no references; of repeated rows the
earliest copy counts (at equal times the smallest row); referring rows without own id are each kept, with a null. Rows without arrived_at count as arrived before all others.
Extra columns are ignored; empty tables have no references and resolve none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerfspark.runtime import cut, forget, lookup

DAWN = "0001-01-01 00:00:00"
IDENTITY = ["ref_table", "ref_id", "kind", "target_id"]
REFS = "ref_table string, ref_id string, kind string, target_id string, seen timestamp_ntz, orphaned_at timestamp_ntz, resolved_at timestamp_ntz, reopened_at timestamp_ntz"
PARENTS = "target_id string, born timestamp_ntz, died timestamp_ntz, told timestamp_ntz"


def key(c: str | Column) -> Column:
    """The id as it is compared, null if blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), F.lit(""))


def at(c: str) -> Column:
    return F.coalesce(F.col(c).cast("timestamp_ntz"), F.lit(DAWN).cast("timestamp_ntz"))


def merged(parents: DataFrame, *more: Column) -> DataFrame:
    """One row a parent: ``born`` and ``died`` of its earliest copy, ``told`` the first time a deletion is known and done."""
    first = F.min(F.struct("born", "died")).alias("_first")
    by = parents.groupBy("target_id").agg(first, F.min("told").alias("told"), *more)
    return by.select("target_id", "_first.*", *[c for c in by.columns if c not in ("target_id", "_first")])


def parent_rows(table: DataFrame, name: str) -> DataFrame:
    """(target_id, born, died, told) of each parent."""
    died = F.col("deleted_at").cast("timestamp_ntz")
    own = table.select(key(name).alias("target_id"), at("arrived_at").alias("born"), died.alias("died"), F.when(died.isNotNull(), F.greatest(died, at("arrived_at"))).alias("told"))
    return merged(own.where(F.col("target_id").isNotNull()))


def references(table: DataFrame, ref_table: str, ref_id: str, target: Column, kind: str) -> DataFrame:
    """(ref_table, ref_id, kind, target_id, seen) of a table's earliest rows; ``target`` is an id or a list of ids."""
    rows = table.select(F.col(ref_id).alias("ref_id"), target.alias("_targets"), at("arrived_at").alias("seen"))
    own = F.when(F.col("ref_id").isNull(), F.to_json(F.struct("seen", "_targets")))
    first = rows.groupBy("ref_id", own.alias("_own")).agg(F.min(F.struct("seen", "_targets")).alias("_first")).select("ref_id", "_first.*")
    each = first.select("ref_id", "seen", F.explode(F.array_distinct(F.transform("_targets", key))).alias("target_id"))
    return each.where(F.col("target_id").isNotNull()).select(F.lit(ref_table).alias("ref_table"), "ref_id", F.lit(kind).alias("kind"), "target_id", "seen")


def verdict() -> list[Column]:
    """When a reference became an orphan, was resolved, and was orphaned (again), by its own time and its parent's life."""
    lives = (F.col("born") <= F.col("seen")) & (F.col("died").isNull() | (F.col("died") > F.col("seen")))
    at_once = ~F.coalesce(lives, F.lit(False))
    waits = at_once & (F.col("born") > F.col("seen")) & (F.col("died").isNull() | (F.col("died") > F.col("born")))
    gone = F.coalesce("died", F.greatest("told", "seen", "born"))
    return [F.when(at_once, F.col("seen")).alias("orphaned_at"), F.when(waits, F.col("born")).alias("resolved_at"), F.when((~at_once | waits) & F.col("told").isNotNull(), gone).alias("reopened_at")]


def judged(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Probe of the parent index."""
    met = lookup(refs.select(*IDENTITY, "seen"), parents, "target_id", "ref_id")
    return met.select(*IDENTITY, "seen", *verdict())


def advance(state: tuple[DataFrame, DataFrame] | None, new_refs: DataFrame, new_parents: DataFrame, repeats: bool = True) -> tuple[DataFrame, DataFrame]:
    """The state (refs, parents) after one more delivery.

    New references probe the whole parent index; of those in the state only such are judged anew whose parent the delivery
    touches. With ``repeats``, references may come again and keep their first time. The caller cuts or writes the state
    between deliveries.
    """
    if state is None:
        return judged(new_refs, new_parents), new_parents
    old_refs, old_parents = state
    told = old_parents.withColumn("_new", F.lit(False)).unionByName(new_parents.withColumn("_new", F.lit(True)))
    both = merged(told, F.max("_new").alias("_new"))
    parents = both.drop("_new")
    new_refs = new_refs.select(*IDENTITY, "seen")
    if repeats:
        mixed = old_refs.withColumn("_fresh", F.lit(False)).unionByName(new_refs.withColumn("_fresh", F.lit(True)), allowMissingColumns=True)
        first = mixed.groupBy(*IDENTITY).agg(F.min(F.struct("seen", "_fresh", "orphaned_at", "resolved_at", "reopened_at")).alias("_first")).select(*IDENTITY, "_first.*")
        old_refs, new_refs = first.where("not _fresh").drop("_fresh"), first.where("_fresh").select(*IDENTITY, "seen")
    touched = lookup(old_refs, both.where("_new"), "target_id", "ref_id")
    times = [F.when(F.col("_new"), c).otherwise(F.col(n)).alias(n) for c, n in zip(verdict(), ("orphaned_at", "resolved_at", "reopened_at"))]
    return touched.select(*IDENTITY, "seen", *times).unionByName(judged(new_refs, parents)), parents


def found(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("orphaned_at").isNotNull()).select("ref_table", "ref_id", "target_id").distinct()


def snapshots(refs: DataFrame) -> DataFrame:
    """(ref_table, month, references, orphans, pending): of references by month of arrival, and those pending at the end of each month, from a table's first month to its last."""
    event = lambda c, n, p: F.struct(F.trunc(c, "month").alias("month"), F.lit(n).alias("n"), F.when(F.col("orphaned_at").isNotNull() & (F.lit(c) == "seen"), 1).otherwise(0).alias("o"), F.lit(p).alias("p"), F.col(c).isNotNull().alias("ok"))
    events = refs.select("ref_table", F.explode(F.array(event("seen", 1, 0), event("orphaned_at", 0, 1), event("resolved_at", 0, -1), event("reopened_at", 0, 1))).alias("e")).where("e.ok")
    months = events.groupBy("ref_table", F.col("e.month").alias("month")).agg(F.sum("e.n").alias("references"), F.sum("e.o").alias("orphans"), F.sum("e.p").alias("_change"))
    # one row a table and month from here on
    later = F.lead("month").over(Window.partitionBy("ref_table").orderBy("month"))
    whole = months.withColumn("_next", F.coalesce(F.add_months(later, -1), F.col("month")))
    filled = whole.withColumn("_m", F.explode(F.sequence("month", "_next", F.expr("interval 1 month"))))
    quiet = F.col("_m") != F.col("month")
    counted = [F.when(quiet, 0).otherwise(F.col(c)).alias(c) for c in ("references", "orphans", "_change")]
    each = filled.select("ref_table", F.date_format("_m", "yyyy-MM").alias("month"), *counted)
    return each.withColumn("pending", F.sum("_change").over(Window.partitionBy("ref_table").orderBy("month"))).drop("_change")


def all_references(operations: DataFrame, panels: DataFrame, joins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to features and references to panels of the three tables."""
    to_features = references(operations, "operation_nodes", "node_id", F.col("feature_node_ids"), "feature").unionByName(references(panels, "nested_panels", "panel_id", F.col("feature_node_ids"), "feature"))
    return to_features, references(joins, "join_hypotheses", "join_id", F.array("panel_a"), "panel")


def deliveries(refs: DataFrame, parents: DataFrame, n: int) -> list[Column]:
    """Conditions on a column ``_at`` that deal rows into so many periods of arrival, of about equally many references."""
    ranks = [k / n for k in range(1, n)]
    bounds = refs.agg(F.percentile_approx(F.col("seen").cast("timestamp").cast("double"), ranks, 1000).alias("b")).first()["b"] or []
    moments = [F.timestamp_seconds(F.lit(b)).cast("timestamp_ntz") for b in bounds]
    low = [None, *moments]
    return [reduce(lambda a, c: a & c, [c for c in ((F.col("_at") > a) if a is not None else None, (F.col("_at") <= z) if z is not None else None) if c is not None], F.lit(True)) for a, z in zip(low, [*moments, None])]


def followed(refs: DataFrame, parents: DataFrame, periods: int) -> DataFrame:
    """The reference state after deliveries of references and parents in the order of their arrival."""
    refs, parents = cut(refs), cut(parents)
    state: tuple[DataFrame, DataFrame] | None = None
    for when in deliveries(refs, parents, periods):
        new_refs = refs.withColumn("_at", F.col("seen")).where(when).drop("_at")
        new_parents = parents.withColumn("_at", F.col("born")).where(when).drop("_at")
        fresh = tuple(cut(t) for t in advance(state, new_refs, new_parents, repeats=False))
        forget(*(state or ()))
        state = fresh
    forget(refs, parents)
    return state[0]


def report(operations: DataFrame, panels: DataFrame, joins: DataFrame, features: DataFrame, panel_refs: DataFrame, periods: int = 3) -> DataFrame:
    """The reference state of all tables after so many deliveries."""
    to_features, to_panels = all_references(operations, panels, joins)
    named = lambda kind, p: p.withColumn("target_id", F.concat(F.lit(kind), "target_id"))
    refs = named("f:", to_features).unionByName(named("p:", to_panels))
    parents = named("f:", parent_rows(features, "node_id")).unionByName(named("p:", parent_rows(panel_refs, "panel_id")))
    return followed(refs, parents, periods).withColumn("target_id", F.substring("target_id", 3, 1 << 30))
