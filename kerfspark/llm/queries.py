"""Queries of the training-data operators and, where SQL can express them, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfspark.llm import encoding, mixing, overlap, percentiles, related, truncation
from kerfspark.runtime import lookup, table

QS = (0.25, 0.5, 0.9, 0.99)


def bores(s: SparkSession, d: str) -> DataFrame:
    """(feature_class, diameter_mm, day) of each feature with each of its geometry nodes once; deleted features count."""
    g = table(s, d, "geometry_nodes").groupBy("node_id").agg(F.min(F.struct("arrived_at", "diameter_mm", "source_file")).alias("_g"))
    g = g.select(F.col("node_id").alias("geometry_id"), F.col("_g.diameter_mm").alias("diameter_mm"), F.date_format("_g.arrived_at", "yyyy-MM-dd").alias("day"), F.col("_g.source_file").alias("source_file"))
    f = table(s, d, "feature_nodes").groupBy("node_id").agg(F.min(F.struct("arrived_at", "feature_class", "geometry_node_ids")).alias("_f"))
    f = f.select("node_id", F.upper(F.trim("_f.feature_class")).alias("feature_class"), F.explode(F.array_distinct("_f.geometry_node_ids")).alias("geometry_id"))
    return lookup(f, g, "geometry_id", "node_id").where(F.col("diameter_mm").isNotNull())


def widths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "generated_samples").dropDuplicates(["sample_id"]).select("dataset_id", F.col("panel.width_mm").alias("width_mm"))


def diameter(s: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(bores(s, d), ["feature_class"], F.col("diameter_mm"), QS, positive=True)


def width(s: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(widths(s, d), ["dataset_id"], F.col("width_mm"), QS, positive=True)


def combined(s: SparkSession, d: str) -> DataFrame:
    days = percentiles.histogram(bores(s, d), ["feature_class"], ["day"], F.col("diameter_mm"), positive=True)
    return percentiles.from_histogram(days, ["feature_class"], QS)


def _docs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "documents"), table(s, d, "mix_targets")


def plan(s: SparkSession, d: str) -> DataFrame:
    """What each source is to give where texts are measured in characters, which SQL can count too."""
    documents, targets = _docs(s, d)
    steps = mixing.plan(mixing.counted(documents, targets, size=F.length("text")), targets)
    return steps.select("source", "available_tokens", F.round("wanted_tokens", 3).alias("wanted_tokens"), "clamped", "passes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_diameter": diameter,
    "p3_width": width,
    "p3_combined": combined,
    "p4_found": lambda s, d: overlap.found(table(s, d, "generated_samples")),
    "p4_counts": lambda s, d: overlap.counts(table(s, d, "generated_samples")),
    "p5_found": lambda s, d: related.found(table(s, d, "panel_refs")),
    "p5_sizes": lambda s, d: related.sizes(table(s, d, "panel_refs")),
    "p5_totals": lambda s, d: related.report(related.assign(table(s, d, "panel_refs"), table(s, d, "generated_samples"))).select("split", "panels"),
    "p5_split": lambda s, d: related.assign(table(s, d, "panel_refs"), table(s, d, "generated_samples")),
    "p5_shares": lambda s, d: related.report(related.assign(table(s, d, "panel_refs"), table(s, d, "generated_samples"))),
    "p8_ids": lambda s, d: encoding.encode(table(s, d, "documents")),
    "p9_mixture": lambda s, d: mixing.mixture(*_docs(s, d)),
    "p9_shares": lambda s, d: mixing.shares(*_docs(s, d)),
    "p9_plan": plan,
    "p9_even_shares": lambda s, d: mixing.shares(*_docs(s, d), total=mixing.EVEN),
    "p10_found": lambda s, d: truncation.found(table(s, d, "documents")),
    "p10_rates": lambda s, d: truncation.rates(table(s, d, "documents")),
}

_LEVELS = "unnest([0.25, 0.5, 0.9, 0.99]) q"

_RELATED = r"""
with recursive k as (select distinct panel_id, key from (select panel_id, unnest([lower(trim(replace(source_file, '\', '/'))), lower(trim(replace(assembly_id, '\', '/')))]) w, unnest(['f', 'a']) || w as key from panel_refs) where panel_id is not null and w not in ('', 'n/a', 'unknown')),
l as (select panel_id u, min(panel_id) over (partition by key) v from k), e as (select distinct u, v from l union select distinct v, u from l),
p as (select distinct panel_id u from panel_refs where panel_id is not null),
reach as (select u, u x from p union select r.u, e.v from reach r join e on e.u = r.x)"""

_OVERLAP = """
with s as (select sample_id, dataset_id source, case when lower(trim(split)) in ('val', 'valid', 'validation') then 'val' when lower(trim(split)) in ('test', 'testing') then 'test' end as name, case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'valid', 'validation', 'test', 'testing') then 'eval' end side, panel p, features f
           from (select distinct on (sample_id) * from generated_samples) where len(features) > 0),
c as (select a.sample_id t, b.sample_id e, a.f ft, b.f fe, greatest(len(a.f), len(b.f)) n from s a join s b on a.side = 'train' and b.side = 'eval' and a.p.panel_type = b.p.panel_type
      and abs(a.p.width_mm - b.p.width_mm) <= 1.000000001 and abs(a.p.height_mm - b.p.height_mm) <= 1.000000001 and abs(a.p.thickness_mm - b.p.thickness_mm) <= 0.500000001 and least(len(a.f), len(b.f)) >= 0.9 * greatest(len(a.f), len(b.f)) - 0.000000001),
x as (select t, e, n, unnest(ft) q, generate_subscripts(ft, 1) i, fe from c), y as (select t, e, n, q, i, unnest(fe) r, generate_subscripts(fe, 1) j from x),
m as (select t, e, n, i, j from y where q.feature_class = r.feature_class and abs(q.position_mm[1] - r.position_mm[1]) <= 1.000000001 and abs(q.position_mm[2] - r.position_mm[2]) <= 1.000000001
      and (abs(q.diameter_mm - r.diameter_mm) <= 0.300000001 or (q.diameter_mm is null and r.diameter_mm is null)))"""

ORACLE: dict[str, str] = {
    "p3_diameter": f"""
with g as (select node_id, min(struct_pack(a := arrived_at, d := diameter_mm)).d diameter_mm from geometry_nodes group by 1),
f as (select node_id, feature_class, unnest(list_distinct(geometry_node_ids)) geometry_id from
      (select node_id, upper(trim(arg_min(feature_class, arrived_at))) feature_class, arg_min(geometry_node_ids, arrived_at) geometry_node_ids from feature_nodes group by 1)),
v as (select f.feature_class, g.diameter_mm from f join g on g.node_id = f.geometry_id where g.diameter_mm > 0 and not isnan(g.diameter_mm)),
o as (select *, row_number() over (partition by feature_class order by diameter_mm) r, count(*) over (partition by feature_class) n from v),
l as (select {_LEVELS})
select o.feature_class, l.q::double q, o.n, o.diameter_mm as value, 0.0::double relative_error from o join l on o.r = greatest(1, ceil(round(l.q * o.n, 9)))""",
    "p3_width": f"""
with v as (select distinct on (sample_id) dataset_id, panel.width_mm w from generated_samples),
k as (select * from v where w > 0 and not isnan(w)),
o as (select *, row_number() over (partition by dataset_id order by w) r, count(*) over (partition by dataset_id) n from k),
l as (select {_LEVELS})
select o.dataset_id, l.q::double q, o.n, o.w as value, 0.0::double relative_error from o join l on o.r = greatest(1, ceil(round(l.q * o.n, 9)))""",
    "p3_combined": f"""
with g as (select node_id, min(struct_pack(a := arrived_at, d := diameter_mm)).d diameter_mm from geometry_nodes group by 1),
f as (select node_id, feature_class, unnest(list_distinct(geometry_node_ids)) geometry_id from
      (select node_id, upper(trim(arg_min(feature_class, arrived_at))) feature_class, arg_min(geometry_node_ids, arrived_at) geometry_node_ids from feature_nodes group by 1)),
v as (select f.feature_class, g.diameter_mm from f join g on g.node_id = f.geometry_id where g.diameter_mm > 0 and not isnan(g.diameter_mm)),
o as (select *, row_number() over (partition by feature_class order by diameter_mm) r, count(*) over (partition by feature_class) n from v),
l as (select {_LEVELS}), m as (select feature_class, q, n, diameter_mm v, floor(log2(diameter_mm)) e from o join l on o.r = greatest(1, ceil(round(l.q * o.n, 9))))
select feature_class, q::double q, n, floor(v * power(2.0::double, 14 - e)) / power(2.0::double, 14 - e) as value, power(2.0::double, -14) relative_error from m""",
    "p4_counts": f"""{_OVERLAP}, q as (select t, e from m group by t, e, n having least(count(distinct i), count(distinct j)) >= 0.9 * n - 0.000000001)
select name eval_split, source eval_source, count(*) pairs, count(distinct e) samples from q join (select sample_id, name, source from s) on sample_id = e group by 1, 2""",
    "p4_found": f"""{_OVERLAP} select least(t, e) sample_id_a, greatest(t, e) sample_id_b from m group by t, e, n having least(count(distinct i), count(distinct j)) >= 0.9 * n - 0.000000001""",
    "p5_found": f"""{_RELATED} select u panel_id, min(x) group_id from reach group by 1 having count(*) > 1""",
    "p5_sizes": f"""{_RELATED}, g as (select u, count(*) size from reach group by 1) select size::bigint size, (count(*) // size)::bigint as "groups" from g group by size""",
    "p5_totals": """
with n as (select count(distinct panel_id) n, round(count(distinct panel_id) * 0.15)::bigint k from panel_refs)
select unnest(['train', 'val', 'test']) split, unnest([n - 2 * k, k, k]) panels from n""",
    "p9_plan": """
with d as (select source, sum(coalesce(length(text), 0))::bigint n from documents group by 1),
s as (select source, max(coalesce(target_share, 0)) share, max(coalesce(max_repeats, 0)) cap from mix_targets where source is not null group by 1),
k as (select s.*, coalesce(n, 0) n, (coalesce(n, 0) * cap)::double most, coalesce(n, 0) * cap / nullif(share, 0) level from s left join d using (source)),
t as (select least(sum(n), sum(most) filter (share > 0))::double total from k),
c as (select *, share > 0 and (select sum(most) from k x where x.share > 0 and x.level <= k.level) + level * coalesce((select sum(share) from k x where x.level > k.level), 0) <= (select total from t) + 0.0000001 clamped from k),
w as (select *, case when clamped then most when share = 0 then 0 else ((select total from t) - coalesce((select sum(most) from c x where x.clamped), 0)) * share / (select sum(share) from c x where not x.clamped) end wanted from c)
select source, n::bigint available_tokens, round(wanted, 3) wanted_tokens, clamped, (case when n > 0 then least(floor(wanted / n), cap) else 0 end)::bigint passes from w""",
}
