"""Queries of the general data problems: common units, nested records, small files, orphan references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfspark.operators import nested, orphans, packing, units
from kerfspark.runtime import cut, table


def _blocks(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "sample_files")
    return packing.blocks(files, cut(packing.index(files)))


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    """Every file out of the containers beside what it was."""
    files = table(s, d, "sample_files")
    places = cut(packing.index(files))
    back = packing.rebuild(packing.blocks(files, places), places)
    was = files.where("content is not null").select("file_id", F.md5("content").alias("_was"))
    return back.join(was, "file_id", "full").select("file_id", "path", F.md5("content").alias("md5"), F.coalesce(F.col("intact") & (F.md5("content") == F.col("_was")), F.lit(False)).alias("equal"))


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return orphans.report(*[table(s, d, t) for t in ("operation_nodes", "nested_panels", "join_hypotheses", "feature_nodes", "panel_refs")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: units.unit_cases(table(s, d, "entities"), table(s, d, "parser_configs")),
    "p1_millimetres": lambda s, d: units.to_millimetres(table(s, d, "entities"), table(s, d, "parser_configs")).select("entity_key", "entity_type", "coordinates", "diameter_mm", "depth_mm", "unique"),
    "p2_found": lambda s, d: nested.child_table(table(s, d, "graph_docs")).select("graph_id", "node_id", "child_kind", "child_pos"),
    "p2_nodes": lambda s, d: nested.node_table(table(s, d, "graph_docs")),
    "p2_vertices": lambda s, d: nested.vertices(table(s, d, "graph_docs")),
    "p2_hypotheses": lambda s, d: nested.hypotheses(table(s, d, "graph_docs")),
    "p2_evidence": lambda s, d: nested.evidence(table(s, d, "graph_docs")),
    "p2_geometry": lambda s, d: nested.geometry_table(table(s, d, "graph_docs")),
    "p2_features": lambda s, d: nested.feature_table(table(s, d, "graph_docs")),
    "p2_variants": lambda s, d: nested.variant_table(table(s, d, "graph_docs")),
    "p6_found": lambda s, d: packing.surplus_records(table(s, d, "sample_files")),
    "p6_index": lambda s, d: packing.index(table(s, d, "sample_files")),
    "p6_blocks": _blocks,
    "p6_rebuilt": _rebuilt,
    "p6_broken": lambda s, d: packing.broken_lines(table(s, d, "sample_files")).select("file_id", "line_no", "length"),
    "p7_found": lambda s, d: orphans.found(_orphans(s, d)),
    "p7_months": lambda s, d: orphans.snapshots(_orphans(s, d)),
}

_REFERENCES = """
with refs as (
  select 'operation_nodes' ref_table, node_id ref_id, lower(trim(x)) target_id, arrived_at seen, 'f' kind
  from (select node_id, arrived_at, unnest(feature_node_ids) x from (select node_id, min(arrived_at) arrived_at, arg_min(feature_node_ids, arrived_at) feature_node_ids from operation_nodes group by 1))
  union select 'nested_panels', panel_id, lower(trim(x)), arrived_at, 'f'
  from (select panel_id, arrived_at, unnest(feature_node_ids) x from (select panel_id, min(arrived_at) arrived_at, arg_min(feature_node_ids, arrived_at) feature_node_ids from nested_panels group by 1))
  union select 'join_hypotheses', join_id, lower(trim(panel_a)), arrived_at, 'p'
  from (select join_id, min(arrived_at) arrived_at, arg_min(panel_a, arrived_at) panel_a from join_hypotheses where panel_a is not null group by 1)),
parents as (
  select kind, lower(trim(id)) target_id, min(arrived_at) born, min(struct_pack(a := arrived_at, d := deleted_at)).d died, min(greatest(deleted_at, arrived_at)) filter (deleted_at is not null) told
  from (select 'f' kind, node_id id, arrived_at, deleted_at from feature_nodes union all select 'p', panel_id, arrived_at, deleted_at from panel_refs) group by 1, 2),
judged as (
  select r.*, born, died, told, coalesce(p.born <= r.seen and (p.died is null or p.died > r.seen), false) live
  from refs r left join parents p using (kind, target_id) where r.target_id <> '')
"""

_LINES = r"""
with l as (select file_id, ltrim(unnest(string_split(content, chr(10))), chr(65279)) line, generate_subscripts(string_split(content, chr(10)), 1) - 1 line_no from sample_files where content is not null),
v as (select * from l where json_valid(line)),
t as (select file_id, line_no, j.fullkey k, case when j.type in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') then 'NUMBER' else j.type end kind, case when j.type in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') then (j.atom::varchar)::double::varchar else coalesce(j.atom ->> '$', '') end val from v, json_tree(v.line) j),
r as (select file_id, line_no, string_agg(k || chr(1) || kind || chr(1) || val, chr(2) order by k, kind, val) record from t group by 1, 2),
o as (select *, row_number() over (partition by record order by file_id, line_no) n from r)"""

ORACLE: dict[str, str] = {
    "p6_found": _LINES + " select file_id, line_no from o where n > 1",
    "p6_broken": _LINES + " select file_id, line_no, strlen(line) length from l where not json_valid(line) and trim(line) <> ''",
    "p7_found": _REFERENCES + "select distinct ref_table, ref_id, target_id from judged where not live",
    "p7_months": _REFERENCES
    + """, t as (select *, not live and born > seen and (died is null or died > born) waits from judged),
e as (select ref_table, date_trunc('month', seen) m, 1 n, (not live)::int o, (not live)::int c from t union all select ref_table, date_trunc('month', born), 0, 0, -1 from t where waits
  union all select ref_table, date_trunc('month', coalesce(died, greatest(told, seen, born))), 0, 0, 1 from t where (live or waits) and told is not null),
b as (select ref_table, unnest(generate_series(min(m), max(m), interval 1 month)) m from e group by 1),
s as (select b.ref_table, b.m, coalesce(sum(n), 0)::bigint n, coalesce(sum(o), 0)::bigint o, coalesce(sum(c), 0)::bigint c from b left join e on b.ref_table = e.ref_table and b.m = e.m group by 1, 2)
select ref_table, strftime(m, '%Y-%m') as "month", n as "references", o orphans, sum(c) over (partition by ref_table order by m)::bigint pending from s""",
}
