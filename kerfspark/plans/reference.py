"""Queries of the domain operators over the bridged test tables and the drawings' own, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfspark.functions import geometry as g
from kerfspark.functions import layers
from kerfspark.operators import classify as c
from kerfspark.operators import benchmark, corpus, dataset, graphs, identify, metrics, model, nesting, pid, rules, synth, units
from kerfspark.operators.pairs import band_pairs, distance, near_pairs
from kerfspark.plans import analysis, bridge
from kerfspark.plans.bridge import SQL_CONTOURS, SQL_HOLES, SQL_NESTS, SQL_PANELS, SQL_PID, SQL_SHAPES
from kerfspark.runtime import cut, table
from kerfspark.sources import documents, dxf, export
from kerfspark.streaming.references import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    if sql:
        ORACLE[name] = sql


def over_holes(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(bridge.holes(s, d))


def over_panels(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(bridge.panels(s, d))


EDGE = "least(x - xmin, xmax - x, y - ymin, ymax - y)"


def rule_sql(source: str, rule: str, severity: str, node: str, measured: str, where: str) -> str:
    return f"select panel_id, '{rule}' rule_id, '{severity}' severity, {node} node, round(({measured})::double, 6) measured from {source} where {where}"


PAIRS = "(select a.panel_id, a.seq sa, b.seq sb, a.diameter da, b.diameter db, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) dist, a.x xa, a.y ya, b.x xb, b.y yb from holes a join holes b on a.panel_id = b.panel_id and a.seq < b.seq)"
_DISCS = "(select a.panel_id, a.node || '+' || b.node pair, a.r ra, b.r rb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) dist from discs a join discs b on a.panel_id = b.panel_id and a.node < b.node)"
OFF = "least(dist % 32, 32 - dist % 32)"
_LINE = "least(abs(x - xmin), abs(x - xmax), abs(y - ymin), abs(y - ymax))"
_OVER = "greatest(xmin - bx0, bx1 - xmax, ymin - by0, by1 - ymax)"
_SIMPLE = "(panel_id, node) not in (select (panel_id, node) from crossed)"
_MILLED = "kind in ('pocket', 'cut', 'engrave') and is_closed and not is_boundary"
_APEX = "(select *, degrees(acos((px * rx + py * ry) / (sqrt(px * px + py * py) * sqrt(rx * rx + ry * ry)))) angle from (select *, vertices[3][1] - vertices[4][1] px, vertices[3][2] - vertices[4][2] py, vertices[5][1] - vertices[4][1] rx, vertices[5][2] - vertices[4][2] ry from rings where len(vertices) = 5))"
_AROUND = "(select i.panel_id, i.node, i.turn, o.turn around, row_number() over (partition by i.panel_id, i.node order by o.area, o.node) r from (select *, case when len(vertices) = 5 then bx0 + (bx1 - bx0) / 6 else (bx0 + bx1) / 2 end ix, (by0 + by1) / 2 iy from rings where not is_boundary and is_closed and area > 0 and (panel_id, node) not in (select (panel_id, node) from crossed)) i join rings o on i.panel_id = o.panel_id and o.is_closed and o.area > i.area and (o.panel_id, o.node) not in (select (panel_id, node) from crossed) and ix > o.bx0 and ix < o.bx1 and iy > o.by0 and iy < o.by1)"

RULES = {
    "geo001_open": rule_sql("(select *, sqrt(power(vertices[-1][1] - vertices[1][1], 2) + power(vertices[-1][2] - vertices[1][2], 2)) gap from rings where not is_closed)", "GEO-001", "ERROR", "node", "gap", "gap > 0.01"),
    "geo002_crossing": rule_sql("crossed", "GEO-002", "ERROR", "node", "null", "true"),
    "geo003_degenerate": rule_sql("(select *, case when geometry_type = 'circle' then case when r < 0.001 then r end when perimeter < 0.001 then perimeter when is_closed and area < 0.001 then area end size from shapes)", "GEO-003", "ERROR", "node", "size", "size is not null"),
    "geo004_range": rule_sql("shapes", "GEO-004", "ERROR", "node", "case when least(bx0, by0) < -100 then least(bx0, by0) else greatest(bx1, by1) end", "least(bx0, by0) < -100 or greatest(bx1, by1) > 5000"),
    "geo005_winding": rule_sql("rings", "GEO-005", "WARNING", "node", "null", "is_boundary and turn < 0") + " union all " + rule_sql(_AROUND, "GEO-005", "INFO", "node", "null", "r = 1 and (turn > 0) = (around > 0)"),
    "geo006_duplicates": rule_sql(_DISCS, "GEO-006", "WARNING", "pair", "dist", "dist <= 0.1 and abs(ra - rb) / ((ra + rb) / 2) <= 0.01"),
    "geo007_bounds": rule_sql("(select *, greatest(xmin - bx0, bx1 - xmax, 0) ox, greatest(ymin - by0, by1 - ymax, 0) oy, greatest(xmin - x, x - xmax, 0) cx, greatest(ymin - y, y - ymax, 0) cy from shapes)", "GEO-007", "ERROR", "node", _OVER, "not is_boundary and case when geometry_type = 'circle' then greatest(ox, oy) > 0.1 and abs(sqrt(cx * cx + cy * cy) - r) > 1e-9 else sqrt(ox * ox + oy * oy) > 0.1 and not ((bx0 = xmax or bx1 = xmin or by0 = ymax or by1 = ymin) and bx0 <= xmax and bx1 >= xmin and by0 <= ymax and by1 >= ymin) end"),
    "geo008_zero_area": rule_sql("rings", "GEO-008", "ERROR", "node", "area", "is_closed and not is_boundary and area < 1"),
    "mfg001_edge_clearance": rule_sql("shapes", "MFG-001", "ERROR", "node", EDGE, f"geometry_type = 'circle' and {EDGE} < 8"),
    "mfg002_spacing": rule_sql(_DISCS, "MFG-002", "ERROR", "pair", "dist - ra - rb", "dist - ra - rb < 3"),
    "mfg003_sharp_corner": rule_sql(_APEX, "MFG-003", "WARNING", "node", "round(angle, 1)", f"{_MILLED} and not is_approximated and angle < 90"),
    "mfg004_pocket_width": rule_sql("rings", "MFG-004", "WARNING", "node", "round(least(bx1 - bx0, by1 - by0), 3)", f"{_MILLED} and area > 0 and {_SIMPLE} and len(vertices) = 4 and least(bx1 - bx0, by1 - by0) < 6.0::double * 1.2::double"),
    "mfg005_shelf_grid": rule_sql(_DISCS, "MFG-005", "WARNING", "pair", "dist", f"abs(2 * ra - 5) <= 0.5 and abs(2 * rb - 5) <= 0.5 and dist >= 16 and {OFF} > 0.5"),
    "mfg006_hinge_edge": rule_sql("shapes", "MFG-006", "WARNING", "node", EDGE, f"geometry_type = 'circle' and abs(2 * r - 35) <= 1 and abs({EDGE} - 22.5) > 1"),
    "mfg007_blind_depth": rule_sql("shapes", "MFG-007", "WARNING", "node", "depth", "depth > 13.5"),
    "mfg008_density": "select panel_id, 'MFG-008' rule_id, 'WARNING' severity, null::varchar node, round(share, 6) measured from (select panel_id, sum(round(area * 10000)::bigint) / 10000.0::double / ((any_value(xmax) - any_value(xmin)) * (any_value(ymax) - any_value(ymin))) share from shapes where not is_boundary and area > 0 group by 1) where share > 0.3::double",
    "mfg009_panel_dims": "select panel_id, 'MFG-009' rule_id, 'WARNING' severity, node, measured from (select panel_id, 'width' node, w measured, w < 50 or w > 3600 bad from panels union all select panel_id, 'height', h, h < 50 or h > 3600 from panels union all select panel_id, 'area', w * h, w * h < 5000 from panels) where bad",
    "mfg011_drill_range": rule_sql("discs", "MFG-011", "ERROR", "node", "2 * r", "2 * r < 3 or 2 * r > 40"),
    "mfg012_on_edge": rule_sql("shapes", "MFG-012", "ERROR", "node", _LINE, f"not is_boundary and {_LINE} <= 0.1"),
}
LAYER1 = [n for n in RULES if n.startswith("geo")]


def shapes_of(s: SparkSession, d: str) -> DataFrame:
    """The shapes with their panels, written once for all rules that read them."""
    return cut(rules.with_panel(bridge.shapes(s, d)))


def one_rule(rule: str) -> Query:
    params = {rule: rules.RULES[rule].params}
    return lambda s, d: rules.findings(rules.with_panel(bridge.shapes(s, d)), params)


for _name, _sql in RULES.items():
    add(_name, one_rule(f"{_name[:3].upper()}-{_name[3:6]}"), f"with {SQL_SHAPES} {_sql}")

_FOUND = "".join(f", {n}_ as ({q})" for n, q in RULES.items())
_ALL = " union all ".join(f"select * from {n}_" for n in RULES)
_JUDGED = f"""with {SQL_SHAPES}{_FOUND}, found as ({_ALL}),
r as (select panel_id, coalesce(e1, 0) e1, coalesce(e2, 0) e2, coalesce(w1, 0) w1, coalesce(w2, 0) w2, coalesce(i1, 0) i1 from panels left join (
  select panel_id, count(*) filter (g and severity = 'ERROR') e1, count(*) filter (not g and severity = 'ERROR') e2, count(*) filter (g and severity = 'WARNING') w1, count(*) filter (not g and severity = 'WARNING') w2, count(*) filter (severity = 'INFO') i1 from (select *, starts_with(rule_id, 'GEO') g from found) group by 1) using (panel_id))"""
REPORT = _JUDGED + """select panel_id, e1 = 0 layer1_passed, e1 > 0 or e2 = 0 layer2_passed, (e1 + case when e1 = 0 then e2 else 0 end)::bigint n_error, (w1 + case when e1 = 0 then w2 else 0 end)::bigint n_warning, i1::bigint n_info, e1 = 0 and e2 = 0 overall_valid, w1 + case when e1 = 0 then w2 else 0 end > 0 has_warnings from r"""


def rule_report(s: SparkSession, d: str) -> DataFrame:
    shapes = shapes_of(s, d)
    return rules.report(shapes, rules.findings(shapes))


def judged_shapes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shapes = shapes_of(s, d)
    return shapes, cut(rules.findings(shapes))


add("rule_report", rule_report, REPORT)
add(
    "rule_results",
    lambda s, d: rules.results(*judged_shapes(s, d)),
    _JUDGED + f""", ids as (select unnest({sorted(rules.RULES)}) rule_id), counted as (select f.* from found f join r using (panel_id) where r.e1 = 0 or starts_with(rule_id, 'GEO'))
    select * from counted union all select panel_id, rule_id, 'PASS', null, null from r, ids where (r.e1 = 0 or starts_with(rule_id, 'GEO')) and (panel_id, rule_id) not in (select (panel_id, rule_id) from found)""",
)
_NODES = _JUDGED + ", counted as (select f.* from found f join r using (panel_id) where r.e1 = 0 or starts_with(rule_id, 'GEO'))"
add("failed_nodes", lambda s, d: rules.failed_nodes(judged_shapes(s, d)[1]), _NODES + " select distinct panel_id, unnest(string_split(node, '+')) node from counted where node is not null and rule_id <> 'MFG-009'")
add("constraint_links", lambda s, d: rules.constraints(judged_shapes(s, d)[1])[1], _JUDGED + " select panel_id, 'constraint-' || rule_id || '-' || node src, unnest(string_split(node, '+')) dst from found where node is not null and rule_id <> 'MFG-009'")

# contours
_CORNERS = "(list_transform(range(1, len(vertices) + 1), lambda i: {'a': vertices[i], 'b': vertices[case when i = len(vertices) then 1 else i + 1 end]}))"
_AREA = f"(list_sum(list_transform({_CORNERS}, lambda e: e.a[1] * e.b[2] - e.b[1] * e.a[2])) / 2)"
_LENGTH = f"list_sum(list_transform({_CORNERS}, lambda e: sqrt((e.b[1] - e.a[1]) * (e.b[1] - e.a[1]) + (e.b[2] - e.a[2]) * (e.b[2] - e.a[2]))))"


def contour_measures(s: SparkSession, d: str) -> DataFrame:
    v = F.col("vertices")
    return bridge.contours(s, d).select("contour_id", "layer", F.abs(g.signed_area(v)).alias("area"), (g.signed_area(v) < 0).alias("clockwise"), g.ring_length(v, F.lit(True)).alias("perimeter"), g.box(v)["xmax"].alias("xmax"), g.box(v)["ymax"].alias("ymax"))


add(
    "contour_measures",
    contour_measures,
    f"with {SQL_CONTOURS} select contour_id, layer, round(abs({_AREA}), 6) area, {_AREA} < 0 clockwise, round({_LENGTH}, 6) perimeter, w xmax, h ymax from contours",
)
# pairs
add("edges_adjacent", over_holes(lambda h: near_pairs(h, "panel_id", "seq", 10.0, distance() <= 2 * F.greatest("diameter_a", "diameter_b") + 10, ["diameter"], size="diameter", per_size=2.0, usual=36.0).select("panel_id", "seq_a", "seq_b", distance().alias("distance"))), f"with {SQL_HOLES} select panel_id, sa seq_a, sb seq_b, round(dist, 6) distance from {PAIRS} where dist <= 2 * greatest(da, db) + 10")
add("edges_same_row", over_holes(lambda h: band_pairs(h, "panel_id", "seq", "y", 1.0)), f"with {SQL_HOLES} select panel_id, sa seq_a, sb seq_b from {PAIRS} where abs(ya - yb) <= 1")
add("edges_same_column", over_holes(lambda h: band_pairs(h, "panel_id", "seq", "x", 1.0)), f"with {SQL_HOLES} select panel_id, sa seq_a, sb seq_b from {PAIRS} where abs(xa - xb) <= 1")
add(
    "edges_contains",
    over_holes(lambda h: h.where(g.edge_distance(F.col("x"), F.col("y")) >= 1.0).select("panel_id", "seq")),
    f"with {SQL_HOLES} select panel_id, seq from holes where {EDGE} >= 1",
)
add("nearest_spacing", over_holes(c.nearest_spacing), f"with {SQL_HOLES}, n as (select * from {PAIRS} where abs(da - db) <= 0.6 and dist > 0.1 and dist <= 200) select panel_id, seq, round(min(dist), 6) spacing from (select panel_id, sa seq, dist from n union all select panel_id, sb, dist from n) group by 1, 2")
add("congruent_panels", over_panels(c.congruent), f"with {SQL_PANELS}, q as (select project, panel_id, greatest(w, h) l, least(w, h) s from panels), n as (select a.project, a.panel_id, count(*) - 1 links from q a join q b on a.project = b.project and abs(a.l - b.l) <= 3 and abs(a.s - b.s) <= 3 group by 1, 2) select project, panel_id, min(panel_id) over (partition by project, l, s) class_id, links from q join n using (project, panel_id)")

# classification
_PEERS = f"peers as (select panel_id, seq, count(*) peers from (select panel_id, sa seq, da d, db e, dist from {PAIRS} union all select panel_id, sb, db, da, dist from {PAIRS}) where abs(d - 5) <= 0.5 and abs(e - d) <= 0.5 and dist >= 1 and (dist % 32 < 1 or dist % 32 > 31) group by 1, 2)"
_KIND = "case when regexp_matches(layer, '^(DRILL)') then 'drill' when regexp_matches(layer, '^(POCKET)') then 'pocket' else 'unknown' end"
_HOLE = lambda to, tol, ceil, bonus: f"least(1.0::double, greatest(0.0::double, 1 - abs(diameter - {to}::double) / {tol}::double) + {bonus}::double, {ceil}::double)"
_THROUGH = lambda ceil: f"{ceil}::double * greatest(0.0::double, 1 - (case when diameter < 3 then 3 - diameter when diameter > 30 then diameter - 30 else 0 end) / 4)"
_CLASSES = f"""{SQL_HOLES}, {_PEERS}, k as (select h.*, p.peers, {EDGE} edge, {_KIND} kind from holes h left join peers p using (panel_id, seq)),
p as (select *, case when abs(diameter - 35) <= 1 and contains(layer, 'HINGE') then 'P1' when abs(diameter - 35) <= 1 and abs(edge - 22.5) <= 2 then 'P2' when abs(diameter - 5) <= 0.5 and peers >= 2 then 'P3'
  when abs(diameter - 7) <= 0.5 and contains(layer, 'CONFIRMAT') then 'P4' when abs(diameter - 7) <= 0.3::double then 'P4b' when abs(diameter - 6) <= 0.2::double or abs(diameter - 8) <= 0.2::double or abs(diameter - 10) <= 0.2::double then 'P5'
  when diameter between 20 and 50 and kind in ('drill', 'cut', 'unknown') then 'P5b' when kind = 'drill' or contains(layer, 'DRILL') then 'P6' else 'P7' end priority from k),
classes as (select panel_id, seq, priority, case priority when 'P1' then {_HOLE(35, 1, 0.9, 0.05)} when 'P2' then {_HOLE(35, 1, 0.9, 0.05)} when 'P3' then {_HOLE(5, 0.5, 0.95, 0.13)} when 'P4' then {_HOLE(7, 0.5, 0.9, 0.05)} when 'P4b' then {_HOLE(7, 0.3, 0.7, 0)}
  when 'P5' then case when abs(diameter - 6) <= 0.2::double then {_HOLE(6, 0.2, 0.7, 0)} when abs(diameter - 8) <= 0.2::double then {_HOLE(8, 0.2, 0.7, 0)} else {_HOLE(10, 0.2, 0.7, 0)} end when 'P5b' then 0.68::double when 'P6' then {_THROUGH(0.75)} else {_THROUGH(0.7)} end confidence,
  case priority when 'P1' then 'HINGE_CUP_HOLE' when 'P2' then 'HINGE_CUP_HOLE' when 'P3' then 'SHELF_PIN_HOLE' when 'P4' then 'CONFIRMAT_HOLE' when 'P4b' then 'CONFIRMAT_HOLE' when 'P5' then 'DOWEL_HOLE' when 'P5b' then 'HARDWARE_HOLE'
  when 'P6' then case when {_THROUGH(0.75)} >= 0.3 then 'THROUGH_HOLE' else 'UNKNOWN_FEATURE' end else case when {_THROUGH(0.7)} >= 0.3 then 'THROUGH_HOLE' else 'UNKNOWN_FEATURE' end end feature_class from p)"""
add("classify_features", over_holes(c.classify), f"with {_CLASSES} select panel_id, seq, feature_class, round(confidence, 6) confidence, priority from classes")
add("infer_operations", over_holes(lambda h: c.operations(c.classify(h))), f"with {_CLASSES} select panel_id, 'DRILLING' operation_type, count(*) nodes, round(sum(round(confidence * 10000)::bigint) / count(*) / 10000, 6) confidence from classes where feature_class <> 'UNKNOWN_FEATURE' group by 1")
add(
    "layer_blind",
    over_holes(c.layer_blind),
    f"""with {_CLASSES}, b as (select panel_id, seq, case when abs(diameter - 35) <= 1 and abs(edge - 22.5) <= 2 then 'HINGE_CUP_HOLE' when abs(diameter - 5) <= 0.5 and peers >= 2 then 'SHELF_PIN_HOLE' when abs(diameter - 7) <= 0.3::double then 'CONFIRMAT_HOLE'
    when abs(diameter - 6) <= 0.2::double or abs(diameter - 8) <= 0.2::double or abs(diameter - 10) <= 0.2::double then 'DOWEL_HOLE' when diameter between 20 and 50 then 'HARDWARE_HOLE' when {_THROUGH(0.7)} >= 0.3 then 'THROUGH_HOLE' else 'UNKNOWN_FEATURE' end blind from k)
    select count(*) nodes, count(*) filter (feature_class = blind) agreeing, count(*) filter (feature_class <> 'UNKNOWN_FEATURE') aware_known, count(*) filter (blind <> 'UNKNOWN_FEATURE') blind_known from classes join b using (panel_id, seq)""",
)
_BORE = "list_min(list_transform([5.0, 6.0, 7.0, 8.0, 10.0, 15.0, 35.0]::double[], lambda b: {'gap': abs(%s - b), 'bore': b})).bore"
add("hole_clusters", over_holes(c.bore_clusters), f"with {SQL_HOLES} select {_BORE % 'diameter'} bore, count(*) n, round(count(*) / (select count(*) from holes), 6) share, round(avg(diameter), 6) mean, round(stddev_pop(diameter), 6) deviation from holes group by 1")
add("dialect_reliance", over_holes(c.dialect_reliance), f"with {SQL_HOLES}, b as (select project, round(diameter, 1) dominant, count(*) n from holes group by 1, 2), m as (select *, sum(n) over (partition by project)::bigint holes, row_number() over (partition by project order by n desc, dominant) r from b) select project, holes, dominant, round(n / holes, 6) share, n / holes >= 0.6 and abs(dominant - {_BORE % 'dominant'}) > 0.6 relies_on_layers from m where r = 1")
add("edge_hole_counts", over_holes(c.edge_hole_counts), f"with {SQL_HOLES} select panel_id, sum((abs(x - xmin) <= 50)::int)::bigint left_holes, sum((abs(x - xmax) <= 50)::int)::bigint right_holes, sum((abs(y - ymin) <= 50)::int)::bigint bottom_holes, sum((abs(y - ymax) <= 50)::int)::bigint top_holes from holes group by 1")
add("assembly_bands", over_panels(c.thickness_bands), f"with {SQL_PANELS} select project, thickness band, count(*) panels, min(panel_id) first_panel from panels group by 1, 2 having count(*) >= 2")
add("node_features", over_holes(graphs.node_features), f"with {SQL_HOLES} select panel_id, seq, round(diameter * diameter / max(diameter * diameter) over (partition by panel_id), 6) area_share, round(diameter / max(diameter) over (partition by panel_id), 6) perimeter_share, round(least(diameter / 100, 2), 6) size, round(least(greatest((x - xmin) / (xmax - xmin), 0), 1), 6) px, round(least(greatest((y - ymin) / (ymax - ymin), 0), 1), 6) py, 0.0::double is_cut, ({_KIND} = 'drill')::int::double is_drill, ({_KIND} = 'pocket')::int::double is_pocket, ({_KIND} = 'unknown')::int::double is_other, round(least(greatest({EDGE}, 0) / greatest(xmax - xmin, ymax - ymin), 1), 6) edge_share from holes")

_EDGE_HOLES = "eh as (select panel_id, sum((abs(x - xmin) <= 50)::int + (abs(x - xmax) <= 50)::int + (abs(y - ymin) <= 50)::int + (abs(y - ymax) <= 50)::int)::bigint joinery from holes group by 1)"
_PARTS = f"""{_CLASSES}, n as (select panel_id, count(*) filter (feature_class = 'HINGE_CUP_HOLE') cups, count(*) filter (feature_class = 'SHELF_PIN_HOLE') pins, count(*) filter (feature_class = 'CONFIRMAT_HOLE') screws, count(*) filter (feature_class = 'DOWEL_HOLE') dowels, count(*) filter (feature_class = 'HARDWARE_HOLE') fittings from classes group by 1),
f as (select p.panel_id, w * h area, greatest(w, h) / least(w, h) aspect, thickness, coalesce(cups, 0) cups, coalesce(pins, 0) pins, coalesce(screws, 0) screws, coalesce(dowels, 0) dowels, coalesce(fittings, 0) fittings from panels p left join n using (panel_id)),
cand as (select panel_id, 'DOOR' part_type, case when cups >= 2 then 0.9 else 0.75 end::double confidence, 0 i from f where cups >= 1 union all select panel_id, 'SIDE_PANEL', case when screws + dowels > 0 then 0.85 else 0.72 end, 1 from f where pins >= 4
  union all select panel_id, 'BACK_PANEL', 0.7, 2 from f where thickness <= 8 and area >= 80000 and cups + pins + screws = 0 union all select panel_id, 'SHELF', 0.62, 3 from f where aspect >= 3 and screws + dowels >= 1 and pins < 4
  union all select panel_id, 'DRAWER_FRONT', 0.55, 4 from f where fittings >= 1 and cups = 0 and area >= 32000),
ranked as (select *, row_number() over (partition by panel_id order by confidence desc, i) r from cand),
parts as (select panel_id, coalesce(max(part_type) filter (r = 1), 'UNKNOWN_PART') part_type, coalesce(max(confidence) filter (r = 1), 0) confidence, coalesce(string_agg(part_type, ',' order by r) filter (r between 2 and 4), '') alternatives from panels left join ranked using (panel_id) group by 1)"""


def annotated(s: SparkSession, d: str) -> DataFrame:
    return c.classify(bridge.holes(s, d))


add("part_identify", lambda s, d: identify.parts(bridge.panels(s, d), annotated(s, d)), f"with {_PARTS} select panel_id, part_type, round(confidence, 6) confidence, alternatives from parts")
add(
    "labels",
    lambda s, d: identify.labels(identify.parts(bridge.panels(s, d), annotated(s, d)), annotated(s, d)),
    f"with {_PARTS}, l as (select 'f:' || panel_id || ':' || seq label_id, 'feature' kind, feature_class as value, confidence from classes union all select 'p:' || panel_id, 'part', part_type, confidence from parts) select label_id, kind, value, round(confidence, 6) confidence, case when confidence >= 0.75 then 'auto_accepted' else 'needs_review' end status from l",
)
_ROLES = f"""{SQL_HOLES}, {_EDGE_HOLES}, u as (select project, panel_id, greatest(w, h) l, least(w, h) s, w * h area, thickness, coalesce(joinery, 0) j from panels left join eh using (panel_id) where project in (select project from panels group by 1 having count(*) >= 3)),
cp as (select a.project, a.panel_id a, b.panel_id b, a.s depth, row_number() over (partition by a.project order by a.j + b.j desc, a.panel_id, b.panel_id) r from u a join u b on a.project = b.project and a.panel_id < b.panel_id and abs(a.l - b.l) <= 3 and abs(a.s - b.s) <= 3),
sides as (select * from cp where r = 1), rest as (select u.*, a, b, depth from u join sides using (project) where panel_id <> a and panel_id <> b),
caps as (select *, row_number() over (partition by project order by area desc, panel_id) k from rest where j > 0 and (abs(l - depth) <= 3 or abs(s - depth) <= 3)),
roles as (select project, unnest([a, b]) panel_id, 'SIDE_PANEL' as role from sides union all select project, panel_id, case k when 1 then 'TOP_PANEL' when 2 then 'BOTTOM_PANEL' else 'SHELF' end from caps
  union all select project, panel_id, 'BACK_PANEL' from rest where thickness <= 8 and j = 0)"""


def carcass_roles(s: SparkSession, d: str) -> DataFrame:
    return identify.carcasses(bridge.panels(s, d), c.edge_hole_counts(bridge.holes(s, d)))


add("carcass_roles", carcass_roles, f"with {_ROLES} select project, panel_id, role from roles")
add(
    "carcass_assemblies",
    lambda s, d: identify.assemblies(carcass_roles(s, d)),
    f"with {_ROLES}, b as (select project, count(*) panels, count(*) filter (role = 'SIDE_PANEL') = 2 and count(*) filter (role in ('TOP_PANEL', 'BOTTOM_PANEL', 'SHELF')) > 0 solved from roles group by 1) select project, panels, solved, round(case when solved then least(0.85, 0.4 + 0.1 * panels + 0.05) else 0 end::double, 6) confidence from b",
)
add("complexity", lambda s, d: identify.complexity(annotated(s, d)), f"with {_CLASSES}, b as (select panel_id, count(distinct feature_class) kinds, count(*) features from classes group by 1) select panel_id, kinds, features, case when kinds > 5 or features > 15 then 'complex' when kinds <= 3 and features <= 5 then 'simple' else 'medium' end complexity from b")
_CATALOGUE = "cat(bore, feature_class, tol, setback, stol) as (values (5.0::double, 'SHELF_PIN_HOLE', 0.2::double, 37.0::double, 1.0::double), (6.0, 'DOWEL_HOLE', 0.2, null, null), (7.0, 'CONFIRMAT_HOLE', 0.3, 12.0, 5.0), (8.0, 'DOWEL_HOLE', 0.2, null, null), (10.0, 'DOWEL_HOLE', 0.2, null, null), (15.0, 'HARDWARE_HOLE', 0.3, null, null), (35.0, 'HINGE_CUP_HOLE', 0.5, 22.5, 1.5))"
add(
    "catalog_validation",
    lambda s, d: corpus.conformance(bridge.holes(s, d).withColumn("edge", g.edge_distance(F.col("x"), F.col("y"))), c.nearest_spacing(bridge.holes(s, d))),
    f"""with {SQL_HOLES}, {_CATALOGUE}, h as (select *, {EDGE} edge, {_BORE % 'diameter'} bore from holes), n as (select * from {PAIRS} where abs(da - db) <= 0.6 and dist > 0.1 and dist <= 200),
    sp as (select min(dist) spacing from (select panel_id, sa seq, dist from n union all select panel_id, sb, dist from n) group by panel_id, seq), so as (select abs(spacing - greatest(1, round_even(spacing / 32, 0)) * 32) o from sp where spacing between 20 and 200),
    dm as (select bore, count(*) n, avg(diameter) m from h group by 1 having count(*) >= 3), se as (select bore, count(*) n, quantile_cont(edge, 0.5) m from h where abs(round(diameter, 0) - bore) < 0.51 group by 1 having count(*) >= 3),
    r as (select 'diameter' metric, feature_class, bore, m measured, bore expected, abs(m - bore) deviation, n support, abs(m - bore) <= tol passed from dm join cat using (bore) union all select 'edge_setback', feature_class, bore, m, setback, abs(m - setback), n, abs(m - setback) <= stol from se join cat using (bore) where setback is not null
    union all select 'grid_spacing', 'SHELF_PIN_HOLE', 5.0, avg(o), 0.0, avg(o), count(*), avg((o <= 0.5)::int) >= 0.5 from so having count(*) >= 3) select metric, feature_class, bore, round(measured, 6) measured, expected, round(deviation, 6) deviation, support, passed from r""",
)
add(
    "tune_ruleset",
    lambda s, d: corpus.tuned(bridge.holes(s, d), bridge.panels(s, d), c.nearest_spacing(bridge.holes(s, d))),
    f"""with {SQL_HOLES}, b as (select {_BORE % 'diameter'} bore, diameter from holes), k as (select bore, count(*) n, avg(diameter) m, stddev_pop(diameter) s, case bore when 5 then 'shelf_pin' when 7 then 'confirmat' when 35 then 'hinge_cup' end p from b where abs(diameter - bore) <= 1 and bore in (5, 7, 35) group by 1),
    n as (select * from {PAIRS} where abs(da - db) <= 0.6 and dist > 0.1 and dist <= 200), sp as (select min(dist) spacing from (select panel_id, sa seq, dist from n union all select panel_id, sb, dist from n) group by panel_id, seq), g as (select round_even(spacing, 0) g, count(*) n from sp group by 1 order by 2 desc, 1 limit 1)
    select p || '_diameter_mm' "parameter", round(m, 2) as value, 'measured' as source, n from k union all select p || '_tolerance_mm', round(greatest(0.2, 3 * s), 2), 'measured', n from k union all select 'panel_thickness_mm', round(quantile_cont(thickness, 0.5), 2), 'measured', count(*) from panels
    union all select 'shelf_pin_spacing_mm', g, 'measured', (select count(*) from sp where abs(spacing - g) <= 1) from g""",
)


def contour_shapes(s: SparkSession, d: str) -> DataFrame:
    v, b = F.col("vertices"), g.box(F.col("vertices"))
    return bridge.contours(s, d).select("contour_id", F.lit("LWPOLYLINE").alias("entity_type"), "layer", "is_closed", (b["xmax"] - b["xmin"]).alias("w"), (b["ymax"] - b["ymin"]).alias("h"), g.ring_length(v, F.col("is_closed")).alias("length"), F.lit(None).cast("double").alias("edge"))


add(
    "classify_contours",
    lambda s, d: c.classify_contours(contour_shapes(s, d)),
    f"""with {SQL_CONTOURS}, p as (select contour_id, case when layer = 'ENGRAVE' then 'P7b' when is_closed and layer = 'POCKET' and greatest(w, h) / least(w, h) >= 5 and least(w, h) between 2 and 20 then 'P8a' when is_closed and layer = 'POCKET' then 'P8' when is_closed and layer in ('CUT', 'SHEET') then 'P10' else 'P11' end priority from contours)
    select contour_id, case priority when 'P7b' then 'ENGRAVING' when 'P8a' then 'GROOVE' when 'P8' then 'POCKET' when 'P10' then 'INTERNAL_CUTOUT' else 'UNKNOWN_FEATURE' end feature_class, case priority when 'P7b' then 0.75 when 'P8a' then 0.68 when 'P8' then 0.65 when 'P10' then 0.8 else 0 end::double confidence, priority from p""",
)


def nearest_centroid(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return model.predict(e, "vec_id", "embedding", cut(model.centroids(e, "label", "embedding")))


add(
    "nearest_centroid",
    nearest_centroid,
    """with m as (select label, i, avg(v::double) m from (select label, unnest(embedding) v, generate_subscripts(embedding, 1) i from embeddings where label is not null) group by 1, 2), e as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings),
    g as (select vec_id, label, sqrt(sum((v - m) * (v - m))) dist from e join m using (i) group by 1, 2) select vec_id, arg_min(label, dist) predicted, round(min(dist), 6) distance from g group by 1""",
)
add("synthetic_gate", lambda s, d: synth.gated(synth.generate(s, table(s, d, "generated_samples").count(), seed=42)).groupBy("intended_valid", "fault").agg(F.count(F.lit(1)).alias("samples")))


def nest_shapes(s: SparkSession, d: str) -> DataFrame:
    """The drawings' own shapes in millimetres; one copy of each entity."""
    e = units.to_millimetres(table(s, d, "entities").where("source_file is not null"), table(s, d, "parser_configs"))
    ring = F.col("entity_type").isin("LWPOLYLINE", "POLYLINE")
    return cut(e.select(F.col("source_file").alias("drawing"), F.col("entity_key").alias("seq"), "entity_type", "layer", F.when(ring, F.col("coordinates")).alias("vertices"), "is_closed", F.get("centroid", F.lit(0)).alias("x"), F.get("centroid", F.lit(1)).alias("y")))


add(
    "nest_sheets",
    lambda s, d: nesting.layouts(cut(bridge.nests(s, d))),
    f"with {SQL_NESTS}, a as (select drawing, count(*) n, sum(area) area from pl group by 1) select drawing, source, case when source = 'none' then 1 else coalesce(n, 0) end panels, case when source = 'none' then sheet else coalesce(area, 0) end panel_area, case when source <> 'none' then sheet end sheet_area, round(case when source <> 'none' then area / sheet end, 6) utilisation from sc left join a using (drawing)",
)
add(
    "nest_members",
    lambda s, d: nesting.assign(cut(bridge.nests(s, d))),
    f"""with {SQL_NESTS}, two as (select drawing from pl group by 1 having count(*) >= 2), hs as (select drawing, 100 * (slot + 1) + seq seq, x0 + x - px x, y from holes join sl using (panel_id) where drawing in (select drawing from two)),
    m as (select hs.drawing, seq, panel, x >= x0 and x < x0 + w and y >= 0 and y < h held, sqrt(power(greatest(x0 - x, x - x0 - w, 0), 2) + power(greatest(-y, y - h, 0), 2)) gap from hs join pl using (drawing))
    select drawing, panel::bigint seq, panel::bigint panel, 'outline' how from pl where drawing in (select drawing from two) union all select drawing, seq::bigint, min(panel) filter (held)::bigint, 'inside' from m group by 1, 2 having bool_or(held) union all select drawing, seq::bigint, arg_min(panel, gap)::bigint, 'nearest' from m group by 1, 2 having not bool_or(held)""",
)
add("nest_analysis", lambda s, d: nesting.layouts(nest_shapes(s, d)))
add("nest_split", lambda s, d: nesting.assign(nest_shapes(s, d)))
add(
    "panel_svg",
    lambda s, d: bridge.holes(s, d).groupBy("panel_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", (F.col("diameter") / 2).alias("r")))).alias("_h"), *[F.first(n).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]).select("panel_id", export.panel_svg({n: F.col(n) for n in ("xmin", "ymin", "xmax", "ymax")}, F.col("_h")).alias("svg")),
)
add("labels_json", lambda s, d: export.labels_json(annotated(s, d), identify.parts(bridge.panels(s, d), annotated(s, d))))


def graph_links(s: SparkSession, d: str) -> DataFrame:
    """(graph_id, src, dst) from features to their geometry and from operations to their features; ids of features in one spelling."""
    f = table(s, d, "feature_nodes").select("graph_id", F.col("node_id").alias("src"), F.explode("geometry_node_ids").alias("dst"))
    o = table(s, d, "operation_nodes").select("graph_id", F.col("node_id").alias("src"), F.explode("feature_node_ids").alias("dst")).withColumn("dst", F.lower(F.trim("dst")))
    return f.unionByName(o).where("src is not null and trim(dst) <> ''").distinct()


def graph_nodes(s: SparkSession, d: str, links: DataFrame) -> DataFrame:
    """Every node once, with its table's fields; an end of a link that stands in no table is a node of type ``missing``."""
    once = lambda name, kind, *fields: table(s, d, name).where("node_id is not null").dropDuplicates(["node_id"]).select("graph_id", "node_id", F.lit(kind).alias("node_type"), *fields)
    g = once("geometry_nodes", "geometry", "geometry_type", "layer", "inferred_layer_type", "source_file", "centroid", "diameter_mm", "is_closed")
    f = once("feature_nodes", "feature", "feature_class", "confidence", "inference_method", "diameter_mm", "position_mm", "group_id", "deleted_at")
    o = once("operation_nodes", "operation", "operation_type", "confidence", "tool_diameter_mm", "depth_mm")
    known = g.unionByName(f, allowMissingColumns=True).unionByName(o, allowMissingColumns=True)
    ends = links.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.min("graph_id").alias("graph_id"))
    return known.unionByName(ends.join(known.select("node_id"), "node_id", "left_anti").withColumn("node_type", F.lit("missing")), allowMissingColumns=True)


def exported(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A query over the nodes and links of all graphs."""

    def query(s: SparkSession, d: str) -> DataFrame:
        links = cut(graph_links(s, d))
        return f(graph_nodes(s, d, links), links)

    return query


add("graph_json", exported(export.graph_json))

# statistics
add("diameter_describe", over_holes(lambda h: c.describe(h, "diameter")), f"with {SQL_HOLES} select count(*) n, min(diameter) min, max(diameter) max, round(avg(diameter), 6) mean, round(stddev_pop(diameter), 6) deviation, round(quantile_cont(diameter, 0.5), 6) median, round(quantile_cont(diameter, 0.05), 6) p05, round(quantile_cont(diameter, 0.95), 6) p95 from holes")
add("diameter_histogram", over_holes(lambda h: h.groupBy(F.floor(F.col("diameter") / 2.0).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))), f"with {SQL_HOLES} select floor(diameter / 2)::bigint bucket, count(*) n from holes group by 1")
add("width_weights", over_panels(lambda p: c.value_weights(p, "w")), f"with {SQL_PANELS} select w as value, count(*) n, round(count(*) / (select count(*) from panels), 4) share from panels group by 1")

# layers of drawings
_ENDS = lambda t: f"({t} is null or not regexp_matches({t}, '^[A-Z0-9_]'))"
_WORDS = lambda ws: ", ".join(f"'{w}'" for w in ws)
_FIRST_KIND = "case " + " ".join(f"when regexp_matches(upper(trim(layer)), '^({'|'.join(of)})') then '{k}'" for k, of in layers.LAYER_PREFIXES.items()) + " else 'unknown' end"
_LONGEST_KIND = "coalesce((select k from (values " + ", ".join(f"('{k}', '{w}')" for k, of in layers.LAYER_PREFIXES.items() for w in of) + ") x(k, w) where starts_with(upper(trim(layer)), w) order by len(w) desc limit 1), 'unknown')"
_SIZE = lambda kind, words, lo, hi: f"(select {kind} from w where w.layer is not distinct from l.layer and {words} and {kind} between {lo} and {hi} order by i limit 1)"
_MARKED = lambda words: f"case when regexp_matches(p1, '^[ \\t\\n\\r_=:-]+$') then p2 else p1 end in ({_WORDS(words)})"
_UNIT = f"case when regexp_matches(n1, '^[ \\t\\n\\r]+$') then n2 = 'MM' and {_ENDS('n3')} else n1 = 'MM' and {_ENDS('n2')} end and not coalesce(ends_with(p1, '.'), false)"
_DEPTH = f"coalesce({_SIZE('v', _MARKED(layers.DEPTH_WORDS), *layers.DEPTH_MM)}, case when kind in ({_WORDS(layers.DEPTH_TYPES)}) then {_SIZE('tok::double', _UNIT, *layers.DEPTH_MM)} end)"
add(
    "layer_parse",
    lambda s, d: table(s, d, "entities").select("layer").distinct().select("layer", layers.layer_type(F.col("layer")).alias("kind"), layers.layer_type_longest(F.col("layer")).alias("kind_longest"), layers.depth_from_layer(F.col("layer"), layers.layer_type(F.col("layer"))).alias("depth"), layers.thickness_from_layer(F.col("layer")).alias("thickness")),
    rf"""with d as (select distinct layer from entities), t as (select layer, regexp_extract_all(regexp_replace(upper(layer), '([0-9])[PV]([0-9])', '\1.\2', 'g'), '[A-Z]+|[0-9]+(?:[.][0-9]+)?|[^A-Z0-9]+') k from d),
    u as (select layer, unnest(k) tok, generate_subscripts(k, 1) i from t), x as (select *, lag(tok) over z p1, lag(tok, 2) over z p2, lead(tok) over z n1, lead(tok, 2) over z n2, lead(tok, 3) over z n3 from u window z as (partition by layer order by i)),
    w as (select *, case when {_ENDS('n1')} then tok::double when contains(tok, '.') then split_part(tok, '.', 1)::double end v from x where regexp_matches(tok, '^[0-9]') and len(split_part(tok, '.', 1)) <= 3),
    l as (select layer, {_FIRST_KIND} kind, {_LONGEST_KIND} kind_longest from d)
    select layer, kind, kind_longest, {_DEPTH} depth, coalesce({_SIZE('v', _MARKED(layers.THICKNESS_WORDS), *layers.THICKNESS_MM)}, {_SIZE('tok::double', _UNIT, *layers.THICKNESS_MM)}) thickness from l""",
)

# drawing files, written and read again


def drawings(s: SparkSession, d: str) -> DataFrame:
    """(path, content) of every panel with its holes."""
    hole = F.struct("x", "y", (F.col("diameter") / 2).alias("r"), "layer")
    by = bridge.holes(s, d).groupBy("panel_id").agg(F.array_sort(F.collect_list(F.struct("seq", hole.alias("h")))).alias("_h"), *[F.first(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    text = dxf.render({c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}, F.transform("_h", lambda x: x["h"]))
    return by.select(F.concat(F.lit("panel_"), "panel_id").alias("path"), F.encode(text, "UTF-8").alias("content"))


add(
    "dxf_entities",
    lambda s, d: dxf.entities(dxf.parse(drawings(s, d))).select("source_file", "seq", "entity_type", "layer", "layer_type", "diameter_mm", "depth_mm", F.round("area_mm2", 2).alias("area_mm2"), F.col("box.xmin").alias("xmin"), F.col("box.ymax").alias("ymax")),
    f"""with {SQL_HOLES} select 'panel_' || panel_id source_file, seq, 'CIRCLE' entity_type, layer, {_KIND.replace("'unknown'", "'unknown'")} layer_type, round(2 * (diameter / 2), 6) diameter_mm,
    case layer when 'DRILL_D5' then 5.0 when 'POCKET_D6' then 6.0 end::double depth_mm, round(round(3.141592653589793::double * (diameter / 2) * (diameter / 2), 4), 2) area_mm2, round(x - diameter / 2, 6) xmin, round(y + diameter / 2, 6) ymax from holes
    union all select 'panel_' || panel_id, 0, 'LWPOLYLINE', 'BORDER', 'border', null, null, w * h, xmin, ymax from panels where panel_id in (select panel_id from holes)""",
)
def drawn_parts(s: SparkSession, d: str) -> DataFrame:
    """(path, content) of a drawing a part, in inches for every fifth: a line, an arc, a closed and an open polyline, an old polyline, and a block placed twice as large."""
    k, w, h = F.col("p_partkey"), F.col("p_size").cast("double"), (4 + F.col("p_partkey") % 120).cast("double")
    text = lambda *xs: F.concat_ws("\n", *[x.cast("string") if not isinstance(x, (int, str)) else F.lit(str(x)) for x in xs])
    unit = F.when(k % 5 == 0, 1).otherwise(4)
    sweep = (30 * (1 + k % 9)).cast("double")
    box = (10, 0, 20, 0, 10, w, 20, 0, 10, w, 20, h, 10, 0, 20, h)
    content = text(
        0, "SECTION", 2, "HEADER", 9, "$INSUNITS", 70, unit, 0, "ENDSEC", 0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "B", 10, 0, 20, 0, 0, "CIRCLE", 5, "Q", 8, "0", 10, 1, 20, 0, 40, w, 0, "ENDBLK", 0, "ENDSEC", 0, "SECTION", 2, "ENTITIES",
        0, "LINE", 5, "L", 8, "CUT_A", 10, 0, 20, 0, 11, w, 21, h, 0, "ARC", 5, "A", 8, "ENGRAVE", 10, 0, 20, 0, 40, w, 50, 15, 51, 15 + sweep, 0, "LWPOLYLINE", 5, "P", 8, "POCKET_D6", 70, 1, *box, 0, "LWPOLYLINE", 5, "O", 8, "GROOVE", 38, -3, 70, 0, *box,
        0, "POLYLINE", 5, "V", 8, "HOLE_X", 70, 1, 0, "VERTEX", 10, 0, 20, 0, 0, "VERTEX", 10, w, 20, 0, 0, "VERTEX", 10, w, 20, h, 0, "SEQEND", 0, "INSERT", 5, "I", 8, "DRILL", 2, "B", 10, 100, 20, 0, 41, 2, 42, 2, 0, "ENDSEC", 0, "EOF")
    return table(s, d, "part").select(F.concat(F.lit("part_"), k.cast("string")).alias("path"), F.encode(content, "UTF-8").alias("content"))


add(
    "dxf_shapes",
    lambda s, d: dxf.entities(dxf.parse(drawn_parts(s, d))).select("source_file", "seq", "entity_type", "layer", "layer_type", F.col("area_mm2").alias("area"), F.col("perimeter_mm").alias("perimeter"), F.round("diameter_mm", 6).alias("diameter"), "depth_mm", "depth_source"),
    """with p as (select 'part_' || p_partkey f, p_size::double w, (4 + p_partkey % 120)::double h, (30 * (1 + p_partkey % 9))::double sweep, case when p_partkey % 5 = 0 then 25.4 else 1 end::double u from part),
    e as (select f, u, 0 seq, 'LINE' entity_type, 'CUT_A' layer, 'cut' layer_type, null::double area, sqrt(w * w + h * h) perimeter, null::double diameter, null::double depth, null depth_source from p union all select f, u, 1, 'ARC', 'ENGRAVE', 'engrave', null, radians(sweep) * w, 2 * w, null, null from p
      union all select f, u, 2, 'LWPOLYLINE', 'POCKET_D6', 'pocket', w * h, 2 * (w + h), null, 6.0, 'layer_name' from p union all select f, u, 3, 'LWPOLYLINE', 'GROOVE', 'pocket', null, 2 * w + h, null, 3.0 * u, 'z_elevation' from p
      union all select f, u, 4, 'POLYLINE', 'HOLE_X', 'drill', w * h / 2, w + h + sqrt(w * w + h * h), null, null, null from p union all select f, u, 5, 'CIRCLE', 'DRILL', 'drill', 3.141592653589793::double * 4 * w * w, 4 * 3.141592653589793::double * w, 4 * w, null, null from p)
    select f source_file, seq, entity_type, layer, layer_type, round(area * u * u, 4) area, round(perimeter * u, 4) perimeter, round(diameter * u, 6) diameter, depth depth_mm, depth_source from e""",
)
add(
    "panel_boundaries",
    lambda s, d: dxf.boundaries(dxf.entities(dxf.parse(drawings(s, d)))).select("source_file", "inferred", "seq", "xmin", "ymin", "xmax", "ymax"),
    f"with {SQL_HOLES} select 'panel_' || panel_id source_file, false inferred, 0 seq, xmin, ymin, xmax, ymax from panels where panel_id in (select panel_id from holes)",
)
add("event_windows", lambda s, d: event_windows(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total")), "select strftime(date_trunc('day', ts), '%Y-%m-%d') as \"day\", event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2")

# metrics, over the text's language and length as labels and scores
_TRUTH = "t as (select doc_id, lang is not null and lower(lang) like 'en%' y, (n_chars % 101) / 100.0::double score, source truth, case when doc_id % 5 = 0 then 'job_tickets' else source end guess from documents where n_chars is not null and source is not null)"


def truth(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("n_chars is not null and source is not null")
    return t.select("doc_id", F.coalesce(F.lower("lang").startswith("en"), F.lit(False)).alias("y"), ((F.col("n_chars") % 101) / 100.0).alias("score"), F.col("source").alias("truth"), F.when(F.col("doc_id") % 5 == 0, "job_tickets").otherwise(F.col("source")).alias("guess"))


_MATRIX = f"{_TRUTH}, m as (select truth, guess, count(*) n from t group by 1, 2)"
_PRF = f"""{_MATRIX}, l as (select truth label from m union select guess from m), k as (select label, coalesce((select sum(n) from m where truth = label), 0) support, coalesce((select sum(n) from m where guess = label), 0) said, coalesce((select sum(n) from m where truth = label and guess = label), 0) hit from l), f as (select label, support::bigint support, case when said > 0 then hit / said else 0 end::double as "precision", case when support > 0 then hit / support else 0 end::double recall from k), r as (select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0 end f1 from f)"""
add("confusion_matrix", lambda s, d: metrics.confusion(truth(s, d), "truth", "guess"), f"with {_MATRIX} select * from m")
add("prf_per_class", lambda s, d: metrics.per_class(metrics.confusion(truth(s, d), "truth", "guess")), f"""with {_PRF} select label, support, round("precision", 6) as "precision", round(recall, 6) recall, round(f1, 6) f1 from r""")
add("f1_summary", lambda s, d: metrics.summary(metrics.confusion(truth(s, d), "truth", "guess")), f"with {_PRF}, a as (select (sum(n) filter (truth = guess)) / sum(n) accuracy from m) select round(avg(f1), 6) macro_f1, round(avg(f1) filter (support > 0), 6) macro_f1_present, round(any_value(accuracy), 6) micro_f1, round(any_value(accuracy), 6) accuracy from r, a")
add("binary_rates", lambda s, d: metrics.binary_rates(truth(s, d).withColumn("said", F.col("score") >= 0.5), "y", "said"), f"""with {_TRUTH}, c as (select count(*) filter (y and score >= 0.5) tp, count(*) filter (not y and score >= 0.5) fp, count(*) filter (y and score < 0.5) fn, count(*) filter (not y and score < 0.5) tn from t) select tp, fp, fn, tn, round(tp / (tp + fp), 6) as "precision", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1, round(fp / (fp + tn), 6) fpr, round(fn / (tp + fn), 6) fnr, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy from c""")
add("roc_auc", lambda s, d: metrics.roc_auc(truth(s, d), "y", "score"), f"with {_TRUTH}, b as (select score, count(*) filter (y) p, count(*) filter (not y) n from t group by 1), u as (select p, n, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) below from b) select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) auc from u")
add("best_f1_threshold", lambda s, d: metrics.best_threshold(truth(s, d), "y", "score"), f"with {_TRUTH}, g as (select k / 100.0::double threshold, (select count(*) from t where y and score >= k / 100.0::double) tp, (select count(*) from t where not y and score >= k / 100.0::double) fp, (select count(*) from t where y) p from range(101) r(k)), f as (select threshold, 2 * tp / (tp + fp + p) f1 from g) select threshold, round(f1, 6) f1 from f order by f1 desc, threshold limit 1")
add("reliability_curve", lambda s, d: metrics.reliability(truth(s, d).withColumn("score", F.col("score")), "score", "y"), f"with {_TRUTH}, b as (select least(floor(score * 10), 9)::int bin, count(*) n, avg(score) mean_confidence, avg(y::int) accuracy from t group by 1) select bin, n, round(mean_confidence, 6) mean_confidence, round(accuracy, 6) accuracy from b")
add("ece", lambda s, d: metrics.calibration_error(metrics.reliability(truth(s, d), "score", "y")), f"with {_TRUTH}, b as (select least(floor(score * 10), 9)::int bin, count(*) n, avg(score) c, avg(y::int) a from t group by 1) select round(sum(n * abs(c - a)) / sum(n), 6) ece from b")
_STEPS = f"{_TRUTH}, b as (select score x, count(*) n, count(*) filter (y) k from t group by 1), o as (select *, row_number() over (order by x) i, sum(n) over (order by x) cn, sum(k) over (order by x) ck from b), v as (select a.i i, z.i j, (z.ck - a.ck + a.k)::double / (z.cn - a.cn + a.n) m from o a join o z on z.i >= a.i), f as (select o.i, x, n, (select max(low) from (select p.i, min(p.m) low from v p where p.i <= o.i and p.j >= o.i group by p.i)) y from o)"
add("isotonic_fit", lambda s, d: metrics.isotonic(truth(s, d), "score", "y"), f"with {_STEPS} select min(x) x_from, max(x) x_to, sum(n)::bigint n, round(y, 6) y from f group by round(y, 9), round(y, 6)")
add("calibrated", lambda s, d: metrics.calibrated(truth(s, d).select("doc_id", "score"), metrics.isotonic(truth(s, d), "score", "y"), "score"), f"with {_STEPS} select doc_id, score, round(f.y, 6) calibrated from t join f on t.score = f.x")
add("class_weights", lambda s, d: metrics.class_weights(truth(s, d), "truth"), f"with {_TRUTH}, b as (select truth as label, count(*) n from t group by 1) select label, n, round((select sum(n) from b) / ((select count(*) from b) * n), 6) weight from b")
_SETS = "s as (select node_id, list_distinct(list_filter(feature_node_ids, lambda x: x is not null)) a from operation_nodes where feature_node_ids is not null)"
add("set_agreement", lambda s, d: metrics.set_agreement(_sets(s, d), "a", "b", 21), f"with {_SETS}, o as (select (node_id like '%0')::int * len(a) off from s) select round(sum(off) / (count(*) * 21), 6) hamming_loss, round(avg((off = 0)::int), 6) subset_accuracy from o")
add("iou", lambda s, d: metrics.iou(_sets(s, d), "a", "b"), f"with {_SETS} select round(avg(case when len(a) = 0 then 1 when node_id like '%0' then 0 else 1 end), 6) mean_iou from s")


def _sets(s: SparkSession, d: str) -> DataFrame:
    a = F.array_distinct(F.filter("feature_node_ids", lambda x: x.isNotNull()))
    return table(s, d, "operation_nodes").where("feature_node_ids is not null").select(a.alias("a"), F.when(F.col("node_id").endswith("0"), F.array().cast("array<string>")).otherwise(a).alias("b"))


# splits and integrity
add("split_assign", lambda s, d: graphs.index_split(table(s, d, "documents").select(F.concat(F.lit("sample_"), "doc_id").alias("sample_id")), "sample_id"), "select 'sample_' || doc_id sample_id, case when doc_id % 100 < 70 then 'train' when doc_id % 100 < 85 then 'val' else 'test' end split from documents")
add("split_clashes", lambda s, d: graphs.split_clashes(table(s, d, "generated_samples"), "sample_id", "split"), "select sample_id, count(distinct split) splits from generated_samples where split is not null group by 1 having count(distinct split) > 1")


def feature_edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feature_nodes").select(F.col("node_id").alias("src"), F.explode("geometry_node_ids").alias("dst")).distinct()


def all_nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "feature_nodes").select("node_id").unionByName(table(s, d, "geometry_nodes").select("node_id")).distinct()


_EDGES = "e as (select distinct node_id src, dst from (select node_id, unnest(geometry_node_ids) dst from feature_nodes)), n as (select node_id from feature_nodes union select node_id from geometry_nodes)"
add("dangling_edges", lambda s, d: graphs.dangling(feature_edges(s, d), all_nodes(s, d)), f"with {_EDGES} select src, dst, src not in (select node_id from n) src_missing, dst not in (select node_id from n) dst_missing from e where src not in (select node_id from n) or dst not in (select node_id from n)")
add("orphan_nodes", lambda s, d: graphs.orphans(table(s, d, "geometry_nodes"), table(s, d, "feature_nodes")), f"with {_EDGES} select distinct node_id, graph_id from geometry_nodes where node_id not in (select dst from e)")
add("out_of_range", lambda s, d: graphs.out_of_range(table(s, d, "feature_nodes")), "select distinct node_id, coalesce(not (confidence between 0 and 1), false) bad_confidence, coalesce(diameter_mm <= 0, false) bad_diameter from feature_nodes where not (confidence between 0 and 1) or diameter_mm <= 0")
add("neighbours", lambda s, d: graphs.neighbours(feature_edges(s, d)), f"with {_EDGES} select src node_id, dst neighbour, 'out' direction from e union all select dst, src, 'in' from e")
add("degrees", lambda s, d: graphs.degrees(feature_edges(s, d)), f"with {_EDGES} select node_id, sum(o)::bigint out_degree, sum(i)::bigint in_degree from (select src node_id, 1 o, 0 i from e union all select dst, 0, 1 from e) group by 1")
add("nest_layouts", lambda s, d: graphs.nest_layouts(table(s, d, "nested_panels")), "with p as (select distinct on (panel_id) * from nested_panels where len(bounding_box) = 4) select layout_id, count(*) panels, round(sum(area_mm2), 6) used, round(sum(area_mm2) / ((max(bounding_box[3]) - min(bounding_box[1])) * (max(bounding_box[4]) - min(bounding_box[2]))), 6) utilisation from p group by 1")
add("nest_overlaps", lambda s, d: graphs.nest_overlaps(table(s, d, "nested_panels")), "with p as (select distinct on (panel_id) layout_id, panel_id, bounding_box b from nested_panels where len(bounding_box) = 4), m as (select x.layout_id, x.panel_id panel_a, y.panel_id panel_b, least(x.b[3], y.b[3]) - greatest(x.b[1], y.b[1]) w, least(x.b[4], y.b[4]) - greatest(x.b[2], y.b[2]) h from p x join p y on x.layout_id = y.layout_id and x.panel_id < y.panel_id) select layout_id, panel_a, panel_b, round(w * h, 6) overlap from m where w > 0 and h > 0")
add("cytoscape", exported(graphs.to_cytoscape))

# process diagrams
_NAMES = lambda table: "map {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"
_TAGS = f"""p as (select component_id, tag, left(tag, 1) variable, substr(regexp_extract(tag, '^([A-Z]+)', 1), 2) functions, regexp_extract(tag, '([0-9]+)', 1) loop from components),
t as (select *, regexp_full_match(functions, '[ABCEGHIKLMNOPRSTUVWYZ]*') valid from p),
u as (select *, case when valid then concat_ws('_', {_NAMES(pid.VARIABLES)}[variable], nullif(array_to_string(list_transform(list_filter(string_split(functions, ''), lambda x: x <> ''), lambda x: {_NAMES(pid.MODIFIERS | pid.FUNCTIONS)}[x]), '_'), '')) else 'UNKNOWN_INSTRUMENT' end symbol_class from t)"""
_LOOPS = "b as (select loop, count(*) components, bool_or(contains(functions, 'C')) c, bool_or(contains(functions, 'T')) t, bool_or(regexp_matches(functions, '[VZ]')) z from t where valid group by 1)"
add("pid_tags", lambda s, d: pid.tags(bridge.components(s, d)), f"with {SQL_PID}, {_TAGS} select component_id, tag, variable, functions, loop, valid, symbol_class from u")
add("pid_isolated", lambda s, d: pid.isolated(bridge.components(s, d), bridge.connections(s, d)), f"with {SQL_PID} select component_id, tag from components where component_id not in (select src from connections union select dst from connections)")
add("pid_loops", lambda s, d: pid.loops(bridge.components(s, d)), f"with {SQL_PID}, {_TAGS}, {_LOOPS} select loop, components, t has_transmitter, z has_final_element, t and z complete from b where c")
add(
    "pid_findings",
    lambda s, d: pid.findings(bridge.components(s, d), bridge.connections(s, d)),
    f"""with {SQL_PID}, {_TAGS}, {_LOOPS} select 'PID-TAG-001' rule_id, 'ERROR' severity, component_id::varchar node from t where not valid union all select 'PID-CONN-001', 'ERROR', component_id::varchar from components where component_id not in (select src from connections union select dst from connections)
    union all select 'PID-LOOP-001', 'WARNING', component_id::varchar from t where valid and contains(functions, 'C') and loop in (select loop from b where c and not (t and z))""",
)


def symbols(s: SparkSession, d: str) -> DataFrame:
    """Components with the symbol class a person gave: that of the tag, but for every ninth."""
    own = pid.tags(bridge.components(s, d))
    return own.select("component_id", "tag", F.when(F.col("component_id") % 9 == 0, "OTHER").otherwise(F.col("symbol_class")).alias("human"))


add(
    "pid_symbols",
    lambda s, d: pid.symbol_scores(symbols(s, d), "human"),
    f"""with {SQL_PID}, {_TAGS}, m as (select case when component_id % 9 = 0 then 'OTHER' else symbol_class end truth, symbol_class guess, count(*) n from u group by 1, 2), l as (select truth label from m union select guess from m),
    k as (select label, coalesce((select sum(n) from m where truth = label), 0) support, coalesce((select sum(n) from m where guess = label), 0) said, coalesce((select sum(n) from m where truth = label and guess = label), 0) hit from l), f as (select support, case when support + said > 0 then 2 * hit / (support + said) else 0 end f1 from k),
    a as (select (sum(n) filter (truth = guess)) / sum(n) accuracy from m) select round(avg(f1), 6) macro_f1, round(avg(f1) filter (support > 0), 6) macro_f1_present, round(any_value(accuracy), 6) micro_f1, round(any_value(accuracy), 6) accuracy, avg(f1) filter (support > 0) >= 0.80 passed from f, a""",
)

# graphs of all tables


def all_graphs(s: SparkSession, d: str) -> graphs.Graphs:
    links = cut(graph_links(s, d))
    kinds = graph_nodes(s, d, links)
    typed = links.join(kinds.select(F.col("node_id").alias("src"), "node_type").dropDuplicates(["src"]), "src", "left")
    return graphs.Graphs(kinds, typed.select("graph_id", "src", "dst", F.when(F.col("node_type") == "feature", "COMPOSES").when(F.col("node_type") == "operation", "PRODUCES").alias("edge_type")))


_LINKS = """f as (select graph_id, node_id src, unnest(geometry_node_ids) dst from feature_nodes), o as (select graph_id, node_id src, lower(trim(x)) dst from (select graph_id, node_id, unnest(feature_node_ids) x from operation_nodes)),
links as (select distinct graph_id, src, dst, kind from (select *, 'COMPOSES' kind from f union all select *, 'PRODUCES' from o) where src is not null and trim(dst) <> ''),
known as (select node_id, any_value(graph_id) graph_id, node_type from (select node_id, graph_id, 'geometry' node_type from geometry_nodes union all select node_id, graph_id, 'feature' from feature_nodes union all select node_id, graph_id, 'operation' from operation_nodes) where node_id is not null group by node_id, node_type),
missing as (select node_id, min(graph_id) graph_id, 'missing' node_type from (select graph_id, src node_id from links union all select graph_id, dst from links) where node_id not in (select node_id from known) group by 1), nodes as (from known union all select node_id, graph_id, node_type from missing)"""
add("graph_summary", lambda s, d: all_graphs(s, d).summary(), f"with {_LINKS} select node_type, count(*) nodes, count(distinct graph_id) graphs from nodes group by 1")
add("features_for_geometry", lambda s, d: all_graphs(s, d).features_for_geometry(), f"with {_LINKS} select distinct dst node_id, src linked_id from links where kind = 'COMPOSES' and dst in (select node_id from known where node_type = 'geometry') and src in (select node_id from known where node_type = 'feature')")
add("features_of_operations", lambda s, d: all_graphs(s, d).linked("PRODUCES", "operation", "feature"), f"with {_LINKS} select distinct src node_id, dst linked_id from links where kind = 'PRODUCES' and src in (select node_id from known where node_type = 'operation') and dst in (select node_id from known where node_type = 'feature')")
add("sure_features", lambda s, d: all_graphs(s, d).features(least_confidence=0.9).select("graph_id", "node_id", "confidence"), "select any_value(graph_id) graph_id, node_id, round(any_value(confidence), 6) confidence from feature_nodes where node_id is not null group by node_id having any_value(confidence) >= 0.9")
add("features_of_class", lambda s, d: all_graphs(s, d).features("dowel_hole").select("graph_id", "node_id"), "select any_value(graph_id) graph_id, node_id from feature_nodes where node_id is not null group by node_id having any_value(upper(trim(feature_class))) = 'DOWEL_HOLE'")
add("circles", lambda s, d: all_graphs(s, d).geometry("CIRCLE").select("graph_id", "node_id"), "select any_value(graph_id) graph_id, node_id from geometry_nodes where node_id is not null group by node_id having any_value(lower(geometry_type)) = 'circle'")
add("feature_groups", lambda s, d: all_graphs(s, d).groups(), "select any_value(graph_id) graph_id, any_value(group_id) group_id, node_id from feature_nodes where node_id is not null group by node_id having any_value(group_id) is not null")
add("node_edges", lambda s, d: (lambda g: g.edges_from(g.features("dowel_hole")).select("src", "dst", "edge_type").distinct())(all_graphs(s, d)), f"with {_LINKS} select distinct src, dst, kind edge_type from links where src in (select node_id from feature_nodes where upper(trim(feature_class)) = 'DOWEL_HOLE') and src in (select node_id from known where node_type = 'feature')")


def graph_integrity(s: SparkSession, d: str) -> DataFrame:
    g = all_graphs(s, d)
    return graphs.integrity(g.nodes.where("node_type <> 'missing'"), g.edges)


add(
    "graph_integrity",
    graph_integrity,
    f"""with {_LINKS} select 'edge_without_end' problem, src node_id, dst other from links where src not in (select node_id from known) or dst not in (select node_id from known) union select 'edge_to_itself', src, dst from links where src = dst
    union select 'confidence_out_of_range', node_id, null from (select node_id, any_value(confidence) c from (select node_id, confidence from feature_nodes union all select node_id, confidence from operation_nodes) where node_id is not null group by 1) where not c between 0 and 1
    union select 'node_given_twice', node_id, null from (select node_id from known group by 1 having count(*) > 1)
    union select 'feature_without_geometry', node_id, null from known where node_type = 'feature' and node_id not in (select src from links) union select 'operation_without_feature', node_id, null from known where node_type = 'operation' and node_id not in (select src from links)""",
)

# whole panels: classes of all shapes, benchmark tasks, datasets, analysis of files


def panel_classes(s: SparkSession, d: str) -> DataFrame:
    return c.nodes(shapes_of(s, d))


_ALLDISCS = "(select a.panel_id, a.node na, b.node nb, 2 * a.r da, 2 * b.r db, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) dist from discs a join discs b on a.panel_id = b.panel_id and a.node < b.node)"
_NODE_CLASSES = f"""{SQL_SHAPES}, np as (select panel_id, node, count(*) peers from (select panel_id, na node, da d, db e, dist from {_ALLDISCS} union all select panel_id, nb, db, da, dist from {_ALLDISCS}) where abs(d - 5) <= 0.5 and abs(e - d) <= 0.5 and dist >= 1 and (dist % 32 < 1 or dist % 32 > 31) group by 1, 2),
nk as (select s.*, 2 * r diameter, peers, {EDGE} edge from shapes s left join np using (panel_id, node)),
nq as (select *, case when is_boundary then 'P9' when geometry_type = 'circle' then case when abs(diameter - 35) <= 1 and contains(layer, 'HINGE') then 'P1' when abs(diameter - 35) <= 1 and abs(edge - 22.5) <= 2 then 'P2' when abs(diameter - 5) <= 0.5 and peers >= 2 then 'P3'
    when abs(diameter - 7) <= 0.5 and contains(layer, 'CONFIRMAT') then 'P4' when abs(diameter - 7) <= 0.3::double then 'P4b' when abs(diameter - 6) <= 0.2::double or abs(diameter - 8) <= 0.2::double or abs(diameter - 10) <= 0.2::double then 'P5'
    when diameter between 20 and 50 and kind in ('drill', 'cut', 'unknown') then 'P5b' when kind = 'drill' or contains(layer, 'DRILL') then 'P6' else 'P7' end
    when kind = 'engrave' then 'P7b' when is_closed and kind = 'pocket' and least(bx1 - bx0, by1 - by0) > 0.000001 and greatest(bx1 - bx0, by1 - by0) / nullif(least(bx1 - bx0, by1 - by0), 0) >= 5 and least(bx1 - bx0, by1 - by0) between 2 and 20 then 'P8a' when is_closed and kind = 'pocket' then 'P8' when is_closed and kind in ('cut', 'border') then 'P10' else 'P11' end priority from nk),
nc as (select panel_id, node, priority, case priority when 'P1' then 'HINGE_CUP_HOLE' when 'P2' then 'HINGE_CUP_HOLE' when 'P3' then 'SHELF_PIN_HOLE' when 'P4' then 'CONFIRMAT_HOLE' when 'P4b' then 'CONFIRMAT_HOLE' when 'P5' then 'DOWEL_HOLE' when 'P5b' then 'HARDWARE_HOLE' when 'P9' then 'PROFILE_CUT' when 'P7b' then 'ENGRAVING' when 'P8a' then 'GROOVE' when 'P8' then 'POCKET' when 'P10' then 'INTERNAL_CUTOUT' when 'P11' then 'UNKNOWN_FEATURE'
    when 'P6' then case when {_THROUGH(0.75)} >= 0.3 then 'THROUGH_HOLE' else 'UNKNOWN_FEATURE' end else case when {_THROUGH(0.7)} >= 0.3 then 'THROUGH_HOLE' else 'UNKNOWN_FEATURE' end end feature_class from nq)"""
add("classify_nodes", lambda s, d: panel_classes(s, d).select("panel_id", "node", "feature_class", "priority"), f"with {_NODE_CLASSES} select panel_id, node, feature_class, priority from nc")
add("coverage", lambda s, d: c.coverage(panel_classes(s, d)), f"""with {_NODE_CLASSES} select panel_id, count(*) nodes, count(*) filter (feature_class <> 'UNKNOWN_FEATURE') known, round(count(*) filter (feature_class <> 'UNKNOWN_FEATURE') / count(*), 6) coverage, count(*) filter (feature_class like '%_HOLE') holes,
    count(*) filter (feature_class in ('POCKET', 'GROOVE', 'ENGRAVING')) milled, count(*) filter (feature_class in ('PROFILE_CUT', 'INTERNAL_CUTOUT')) profiles from nc group by 1""")


def node_truth(s: SparkSession, d: str) -> DataFrame:
    """The classes of a panel's shapes: truth by the nearest bore (what isn't a bore is what it is taken for), guess by the classifier."""
    shapes = shapes_of(s, d)
    bore = c.nearest_bore(2 * F.col("radius"))
    names = F.create_map(*[F.lit(x) for b, n, *_ in corpus.CATALOGUE for x in (b, n)])
    met = c.nodes(shapes).join(shapes.select("panel_id", "node", "geometry_type", "radius"), ["panel_id", "node"])
    return met.select("panel_id", "node", F.when(F.col("geometry_type") == "circle", F.element_at(names, bore)).otherwise(F.col("feature_class")).alias("truth"), F.col("feature_class").alias("guess"))


def benchmark_tasks(s: SparkSession, d: str) -> DataFrame:
    shapes, found = judged_shapes(s, d)
    nodes = cut(node_truth(s, d))
    sets = nodes.groupBy("panel_id").agg(*[F.collect_set(n).alias(n) for n in ("truth", "guess")], F.sum((F.col("guess") == "UNKNOWN_FEATURE").cast("bigint")).alias("unknown"))
    failed = rules.failed_nodes(found).groupBy("panel_id").agg(F.collect_set("node").alias("guess_nodes"))
    none = F.array().cast("array<string>")
    panels = cut(rules.report(shapes, found).join(sets, "panel_id").join(failed, "panel_id", "left").withColumns({"is_valid": F.col("panel_id") % 7 != 0, "guess_nodes": F.coalesce("guess_nodes", none)}))
    truly = F.when(F.col("is_valid"), none).otherwise(F.array(F.lit("h1")))
    validity = panels.select(F.col("is_valid").alias("truth"), F.col("overall_valid").alias("guess"), benchmark.validity(F.col("n_error")).alias("confidence"), truly.alias("truth_nodes"), "guess_nodes")
    operations = panels.select(benchmark.operations_of(F.col("truth")).alias("truth"), benchmark.operations_of(F.col("guess")).alias("guess"))
    anomalies = panels.select((~F.col("is_valid")).alias("truth"), benchmark.anomaly(F.col("n_error"), F.col("n_warning"), F.col("unknown")).alias("score"))
    return benchmark.run(nodes, validity, operations, anomalies)


_LABELS = ", ".join(f"'{x}'" for x in benchmark.FEATURE_CLASSES)
_OPS = lambda col: "list_sort(list_filter([" + ", ".join(f"case when list_has_any({col}, {of}) then '{name}' end" for name, of in benchmark.OPERATIONS.items()) + f", case when len({col}) > 0 then 'NESTING' end], lambda x: x is not null))"
_AUC = lambda table, flag, score: f"(select sum(p * (below + n / 2)) / (sum(p) * sum(n)) from (select p, n, coalesce(sum(n) over (order by z rows between unbounded preceding and 1 preceding), 0) below from (select {score} z, count(*) filter ({flag}) p, count(*) filter (not {flag}) n from {table} group by 1)))"
add(
    "benchmark_tasks",
    benchmark_tasks,
    _JUDGED.replace(f"with {SQL_SHAPES}", f"with {_NODE_CLASSES}")
    + f""", nt as (select panel_id, node, case when geometry_type = 'circle' then case {_BORE % '(2 * r)'} when 5 then 'SHELF_PIN_HOLE' when 7 then 'CONFIRMAT_HOLE' when 15 then 'HARDWARE_HOLE' when 35 then 'HINGE_CUP_HOLE' else 'DOWEL_HOLE' end else feature_class end truth, feature_class guess from nc join shapes using (panel_id, node)),
    m as (select truth, guess, count(*) n from nt group by 1, 2), l as (select unnest([{_LABELS}]) label), mi as (select * from m where truth in ({_LABELS}) and guess in ({_LABELS})),
    k as (select label, coalesce((select sum(n) from mi where truth = label), 0) support, coalesce((select sum(n) from mi where guess = label), 0) said, coalesce((select sum(n) from mi where truth = label and guess = label), 0) hit from l),
    f as (select support, case when support + said > 0 then 2 * hit / (support + said) else 0 end f1 from k),
    t1 as (select avg(f1) macro_f1, avg(f1) filter (support > 0) macro_f1_present, (select sum(n) filter (truth = guess) / sum(n) from mi) micro_f1, (select sum(n) filter (truth = guess) / sum(n) from m) accuracy, (select sum(n) from m) units from f),
    fn as (select panel_id, list(distinct node) nodes from (select panel_id, unnest(string_split(node, '+')) node from found join r using (panel_id) where node is not null and rule_id <> 'MFG-009' and (e1 = 0 or starts_with(rule_id, 'GEO'))) group by 1),
    st as (select panel_id, list(distinct truth) ts, list(distinct guess) gs, count(*) filter (guess = 'UNKNOWN_FEATURE') unknown from nt group by 1),
    pn as (select panel_id, panel_id % 7 <> 0 good, e1 = 0 and e2 = 0 said, e1 + case when e1 = 0 then e2 else 0 end ne, w1 + case when e1 = 0 then w2 else 0 end nw, unknown, coalesce(nodes, []) nodes, {_OPS('ts')} ot, {_OPS('gs')} og from r join st using (panel_id) left join fn using (panel_id)),
    sc as (select *, 1 / (1 + ne) conf, (ne + 0.25::double * nw + 0.5::double * unknown) / (1 + ne + 0.25::double * nw + 0.5::double * unknown) score from pn),
    cf as (select count(*) filter (good and said) tp, count(*) filter (not good and said) fp, count(*) filter (good and not said) fn, count(*) filter (not good and not said) tn, count(*) n from sc),
    t2 as (select case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end binary_f1, (tp + tn) / n accuracy, case when fn + tp > 0 then fn / (fn + tp) else 0 end fpr, case when fp + tn > 0 then fp / (fp + tn) else 0 end fnr, {_AUC('sc', 'good', 'conf')} auroc, (select avg(case when list_contains(nodes, 'h1') then 1 / len(nodes) else 0 end) from sc where not good) iou, n units from cf),
    ol as (select unnest({benchmark.OPERATION_LABELS}) label), ok as (select label, (select count(*) from sc where list_contains(ot, label)) support, (select count(*) from sc where list_contains(og, label)) said, (select count(*) from sc where list_contains(ot, label) and list_contains(og, label)) hit from ol),
    t3 as (select avg(case when support + said > 0 then 2 * hit / (support + said) else 0 end) macro_f1, 2 * sum(hit) / (sum(support) + sum(said)) micro_f1, (select sum(len(list_filter(ot, lambda x: not list_contains(og, x))) + len(list_filter(og, lambda x: not list_contains(ot, x)))) / (count(*) * 4) from sc) hamming_loss, (select avg((ot = og)::int) from sc) subset_accuracy, (select count(*) from sc) units from ok),
    th as (select q / 100.0::double thr, (select count(*) from sc where not good and round(score * 100, 6) >= q) tp, (select count(*) from sc where good and round(score * 100, 6) >= q) fp, (select count(*) from sc where not good) p from range(101) x(q)), bt as (select thr, case when tp > 0 then 2 * tp / (tp + fp + p) else 0 end f1 from th order by f1 desc, thr limit 1),
    t4 as (select {_AUC('sc', '(not good)', 'score')} auroc, f1, case when f1 > 0 then thr else 0 end thr, (select count(*) from sc where not good) bad, (select count(*) from sc where good) fine, (select count(*) from sc) units from bt),
    rows as (select 'BENCH-001' task_id, units, macro_f1 >= 0.8 passed, unnest(['macro_f1', 'macro_f1_present', 'micro_f1', 'accuracy']) metric, unnest([macro_f1, macro_f1_present, micro_f1, accuracy]) v from t1
      union all select 'BENCH-002', units, binary_f1 >= 0.85 and fnr <= 0.1, unnest(['binary_f1', 'accuracy', 'fpr', 'fnr', 'auroc', 'violation_localization_iou']), unnest([binary_f1, accuracy, fpr, fnr, auroc, iou]) from t2
      union all select 'BENCH-003', units, macro_f1 >= 0.85, unnest(['macro_f1', 'micro_f1', 'hamming_loss', 'subset_accuracy']), unnest([macro_f1, micro_f1, hamming_loss, subset_accuracy]) from t3
      union all select 'BENCH-004', units, auroc >= 0.8, unnest(['auroc', 'f1_optimal', 'f1_optimal_threshold', 'n_anomalous', 'n_normal']), unnest([auroc, f1, thr, bad, fine]::double[]) from t4)
    select task_id, units::bigint units, passed, metric, round(v::double, 6) as value, (task_id, metric) in (('BENCH-001', 'macro_f1'), ('BENCH-002', 'binary_f1'), ('BENCH-003', 'macro_f1'), ('BENCH-004', 'auroc')) is_primary from rows""",
)


def labelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    shapes, found = judged_shapes(s, d)
    report = cut(rules.report(shapes, found))
    return cut(dataset.labels(shapes, c.nodes(shapes), report)), report, rules.results(shapes, found)


add("dataset_documents", lambda s, d: dataset.documents(*labelled(s, d)))
add(
    "dataset_statistics",
    lambda s, d: dataset.statistics(labelled(s, d)[0]),
    _JUDGED.replace(f"with {SQL_SHAPES}", f"with {_NODE_CLASSES}")
    + """, fc as (select panel_id, feature_class from nc where priority <> 'P9'), pk as (select r.panel_id, e1 = 0 and e2 = 0 good, count(distinct feature_class) k, count(feature_class) n, coalesce(bool_or(feature_class in ('GROOVE', 'POCKET', 'ENGRAVING', 'INTERNAL_CUTOUT')), false) mi, coalesce(bool_or(feature_class like '%_HOLE'), false) dr from r left join fc using (panel_id) group by 1, 2)
    select 'split' what, case when panel_id % 100 < 70 then 'train' when panel_id % 100 < 85 then 'val' else 'test' end as value, count(*) n from pk group by 2 union all select 'is_valid', good::varchar, count(*) from pk group by 2
    union all select 'complexity', case when k > 5 or n > 15 or (mi and dr) then 'complex' when k <= 3 and n <= 5 and not mi then 'simple' else 'medium' end, count(*) from pk group by 2 union all select 'feature_class', feature_class, count(*) from fc group by 2""",
)
add("analyze", lambda s, d: analysis.analyze(dxf.parse(drawings(s, d))))
add("ingest_counts", lambda s, d: dxf.corpus(dxf.parse(drawn_parts(s, d).unionByName(drawings(s, d)))), f"with {SQL_HOLES}, b as (select count(*) n, count(distinct panel_id) p from holes), q as (select count(*) n from part) select (q.n + p)::bigint files, (q.n + p)::bigint with_shapes, 0::bigint without_shapes, 0::bigint unreadable, (6 * q.n + b.n + p)::bigint shapes, 0::bigint warnings from b, q")
add("corpus_summary", lambda s, d: corpus.summary(bridge.holes(s, d), bridge.panels(s, d), c.nearest_spacing(bridge.holes(s, d))), f"with {SQL_HOLES}, n as (select * from {PAIRS} where abs(da - db) <= 0.6 and dist > 0.1 and dist <= 200), sp as (select min(dist) spacing from (select panel_id, sa seq, dist from n union all select panel_id, sb, dist from n) group by panel_id, seq) select (select count(*) from panels) panels, (select count(distinct project) from panels) projects, (select round(avg(w), 6) from panels) mean_width, (select round(avg(h), 6) from panels) mean_height, count(*) holes, count(distinct panel_id) drilled_panels, count(distinct layer) layers, (select count(*) from sp) spacings from holes")
add("hole_rate", lambda s, d: corpus.hole_rate(bridge.holes(s, d), bridge.panels(s, d)), f"with {SQL_HOLES} select (select count(*) from panels) panels, count(*) holes, round(count(*) / (select count(*) from panels), 6) rate from holes")
add("dominant_spacing", lambda s, d: corpus.dominant_spacing(c.nearest_spacing(bridge.holes(s, d))), f"with {SQL_HOLES}, n as (select * from {PAIRS} where abs(da - db) <= 0.6 and dist > 0.1 and dist <= 200), sp as (select round_even(min(dist), 0) spacing from (select panel_id, sa seq, dist from n union all select panel_id, sb, dist from n) group by panel_id, seq), b as (select spacing, count(*) n from sp group by 1) select spacing, n, round(n / (select sum(n) from b), 6) share from b order by n desc, spacing limit 1")


def grouped_panels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    roles = cut(carcass_roles(s, d))
    return cut(identify.grouped(bridge.panels(s, d), identify.parts(bridge.panels(s, d), annotated(s, d)), roles)), roles


_GROUPS = f"""{_PARTS}, {_ROLES.replace(SQL_HOLES + ', ', '')}, sv as (select project, count(*) n from roles group by 1 having count(*) filter (role = 'SIDE_PANEL') = 2 and count(*) filter (role in ('TOP_PANEL', 'BOTTOM_PANEL', 'SHELF')) > 0),
gp as (select p.project, p.panel_id, sv.n is not null solved, thickness, coalesce(role, part_type) named, part_type, count(*) over (partition by p.project, thickness) n, min(p.panel_id) over (partition by p.project, thickness) f, min(p.panel_id) over (partition by p.project) least from panels p left join parts using (panel_id) left join sv on sv.project = p.project left join roles r on r.panel_id = p.panel_id),
gr as (select project, panel_id, project || ':' || case when solved then least when n >= 2 then f else panel_id end assembly_id, case when solved then named else part_type end part_type, case when solved then 'carcass' when n >= 2 then 'band' else 'single' end how from gp),
asm as (select project, assembly_id, how, count(*) panels, list(distinct part_type) ps from gr group by 1, 2, 3),
kinds as (select project, assembly_id, panels, how, case when how = 'carcass' then 'CARCASS' when list_has_any(ps, {identify.DRAWER_PARTS}) then 'DRAWER' when len(list_intersect(ps, {identify.CARCASS_PARTS})) >= 2 then 'CARCASS' else 'UNKNOWN_ASSEMBLY' end assembly_type,
  case when how = 'carcass' then least(0.85, 0.4 + 0.1 * sv.n + 0.05) when list_has_any(ps, {identify.DRAWER_PARTS}) then 0.6 when len(list_intersect(ps, {identify.CARCASS_PARTS})) >= 2 then 0.7 when panels >= 2 then 0.4 else 0.2 end::double confidence from asm left join sv using (project))"""
add("assembly_members", lambda s, d: grouped_panels(s, d)[0], f"with {_GROUPS} select project, panel_id, assembly_id, part_type, how from gr")
add("assembly_table", lambda s, d: identify.assembly_table(*grouped_panels(s, d)), f"with {_GROUPS} select project, assembly_id, panels, assembly_type, round(confidence, 6) confidence, how from kinds")
add("joints", lambda s, d: identify.joints(grouped_panels(s, d)[0]), f"with {_GROUPS} select a.project, a.assembly_id, a.panel_id panel_a, b.panel_id panel_b, 0.5::double confidence from gr a join gr b using (project, assembly_id) where a.how = 'carcass' and a.part_type = 'SIDE_PANEL' and b.part_type in ('TOP_PANEL', 'BOTTOM_PANEL', 'SHELF')")
add("projects", lambda s, d: identify.projects(identify.assembly_table(*grouped_panels(s, d))), f"with {_GROUPS} select project, sum((panels >= 2)::int)::bigint assemblies, sum(panels)::bigint panels, sum((panels < 2)::int)::bigint ungrouped from kinds group by 1")
add("project_labels", lambda s, d: identify.project_labels(identify.assembly_table(*grouped_panels(s, d))), f"""with {_GROUPS}, pj as (select project, sum((panels >= 2)::int)::bigint a, sum(panels)::bigint n from kinds group by 1) select project || ':asm:' || assembly_id label_id, 'assembly' kind, assembly_type as value, round(confidence, 6) confidence, case when confidence >= 0.75 then 'auto_accepted' else 'needs_review' end status from kinds where panels >= 2
union all select project || ':project', 'project', a || '_assemblies_' || n || '_panels', case when a > 0 then 0.6 else 0.3 end::double, 'needs_review' from pj""")
add(
    "corpus_profile",
    lambda s, d: corpus.profile(bridge.holes(s, d), bridge.panels(s, d), c.nearest_spacing(bridge.holes(s, d))).withColumn("name", F.regexp_replace("name", "[.]0$", "")),
    f"""with {SQL_HOLES}, bc as (select {_BORE % 'diameter'} bore, count(*) n, avg(diameter) m from holes group by 1), n as (select * from {PAIRS} where abs(da - db) <= 0.6 and dist > 0.1 and dist <= 200),
    sp as (select round_even(min(dist), 0) spacing, count(*) over () k from (select panel_id, sa seq, dist from n union all select panel_id, sb, dist from n) group by panel_id, seq), ds as (select spacing, count(*) n from sp group by 1 order by 2 desc, 1 limit 1),
    sz as (select unnest(['width', 'height', 'thickness']) section, unnest([w, h, thickness]) v from panels)
    select 'bore_share' section, bore::int::varchar as "name", round(n / (select count(*) from holes), 6) as value from bc union all select 'bore_mean', bore::int::varchar, round(m, 6) from bc
    union all select section, round_even(v, 0)::int::varchar, round(count(*) / (select count(*) from panels), 4) from sz group by 1, 2 union all select 'holes', 'rate', round((select count(*) from holes) / (select count(*) from panels), 6) union all select 'spacing', 'dominant', spacing from ds""",
)
add("review_sheet", lambda s, d: export.review_sheet(identify.labels(identify.parts(bridge.panels(s, d), annotated(s, d)), annotated(s, d))), f"with {_PARTS}, l as (select 'f:' || panel_id || ':' || seq id, feature_class v, confidence from classes union all select 'p:' || panel_id, part_type, confidence from parts) select id row_id, lower(replace(v, '_', ' ')) thought_to_be, round(confidence * 100, 0)::int sure_percent, '' other_guesses, '' is_it_right, '' if_not_what, '' notes from l where confidence < 0.75")


def reviewed(s: SparkSession, d: str) -> DataFrame:
    """Labels of parts with decisions on some of them: confirmed, corrected, corrected without a value, rejected."""
    labels = identify.labels(identify.parts(bridge.panels(s, d), annotated(s, d)), annotated(s, d)).where("kind = 'part'")
    k = bridge.panels(s, d).select("panel_id").withColumn("_k", F.col("panel_id") % 10).where("_k < 4")
    said = F.element_at(F.array(*map(F.lit, ("confirm", "correct", "reject", "correct"))), (F.col("_k") + 1).cast("int"))
    decisions = k.select(F.concat(F.lit("p:"), F.col("panel_id").cast("string")).alias("label_id"), said.alias("decision"), F.when(F.col("_k") == 1, "CABINET_BACK").alias("corrected_value"))
    return documents.apply_reviews(labels, decisions).select("label_id", "value", "status", "is_gold")


add("reviewed_labels", reviewed, f"with {_PARTS}, l as (select panel_id k, 'p:' || panel_id label_id, part_type v, case when confidence >= 0.75 then 'auto_accepted' else 'needs_review' end status from parts) select label_id, case when k % 10 = 1 then 'CABINET_BACK' else v end as value, case k % 10 when 0 then 'confirmed' when 1 then 'corrected' when 2 then 'rejected' else status end status, k % 10 < 2 is_gold from l")
add("annotation_status", lambda s, d: c.statuses(annotated(s, d)).groupBy("status", "maybe_unknown").agg(F.count(F.lit(1)).alias("n")), f"with {_CLASSES} select case when confidence < 0.3 or feature_class = 'UNKNOWN_FEATURE' then 'unknown' when confidence < 0.6 then 'uncertain' else 'accepted' end status, confidence < 0.75 maybe_unknown, count(*) n from classes group by 1, 2")
_CUT = lambda x, lo="0.0::double", hi="1.0::double": f"least(greatest({x}, {lo}), {hi})"
add(
    "shape_features",
    lambda s, d: graphs.shape_features(shapes_of(s, d)).withColumns({n: F.col(n) + 1e-9 for n in ("area_share", "perimeter_share")}),  # no ties of rounding
    f"""with {SQL_SHAPES}, q as (select *, max(area) over (partition by panel_id) ma, max(perimeter) over (partition by panel_id) mp, bx1 - bx0 bw, by1 - by0 bh, xmax - xmin w, ymax - ymin h from shapes)
    select panel_id, node, round(coalesce(area, 0) / ma + 1e-9::double, 6) area_share, round(perimeter / mp + 1e-9::double, 6) perimeter_share, round(case when bw > 0 and bh > 0 then {_CUT('log10(bw / nullif(bh, 0))', '-2.0::double', '2.0::double')} else 0 end, 6) log_aspect,
    round(case when perimeter > 0 then {_CUT('4 * 3.141592653589793::double * coalesce(area, 0) / nullif(perimeter * perimeter, 0)')} else 0 end, 6) roundness, round(case when geometry_type = 'circle' then least(2 * r / 100, 2) else 0 end, 6) size, (geometry_type = 'circle')::int::double is_circle, is_closed::int::double is_closed, is_boundary::int::double is_outer,
    round({_CUT('(x - xmin) / w')}, 6) px, round({_CUT('(y - ymin) / h')}, 6) py, (kind in ('cut', 'border'))::int::double is_cut, (kind = 'drill')::int::double is_drill, (kind = 'pocket')::int::double is_pocket, (kind not in ('cut', 'border', 'drill', 'pocket'))::int::double is_other, 0.0::double contained, round({_CUT(f'greatest(0, {EDGE}) / greatest(w, h)')}, 6) edge_share from q""",
)


def model_edges(s: SparkSession, d: str) -> DataFrame:
    shapes = shapes_of(s, d)
    near = near_pairs(shapes.where("geometry_type = 'circle'").withColumn("_d", 2 * F.col("radius")), "panel_id", "node", 10.0, distance() <= 2 * F.greatest("_d_a", "_d_b") + 10, size="_d", per_size=2.0, usual=36.0)
    return graphs.edge_index(shapes, near.select("panel_id", F.col("node_a").alias("a"), F.col("node_b").alias("b")))


add("edge_index", model_edges, f"with {SQL_SHAPES}, n as (select a.panel_id, a.node a, b.node b from discs a join discs b on a.panel_id = b.panel_id and a.node <> b.node and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2 * greatest(2 * a.r, 2 * b.r) + 10) select panel_id, node src, node dst from shapes union select panel_id, a, b from n")
