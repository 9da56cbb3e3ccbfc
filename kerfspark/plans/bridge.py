"""Domain tables made of the star schema: panels of orders, holes of line items, contours and components of parts.

All values derive from integers, so that other engines find the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerfspark.functions import geometry as g
from kerfspark.functions.layers import layer_type
from kerfspark.runtime import table

# Layers of holes and contours; function letters of tags.
HOLE_LAYERS = ["DRILL", "DRILL_D5", "HINGE_35", "CONFIRMAT", "MISC", "POCKET_D6"]
CONTOUR_LAYERS = {"PROMO": "POCKET", "ECONOMY": "CUT", "MEDIUM": "ENGRAVE", "SMALL": "DRILL", "STANDARD": "SHEET", "LARGE": "MISC"}
RING_LAYERS = {"PROMO": "POCKET_D6", "ECONOMY": "CUT_OUTER", "MEDIUM": "ENGRAVE_A", "SMALL": "DRILL", "STANDARD": "SHEET", "LARGE": "MISC"}
TAG_LETTERS = ["T", "IC", "V", "AH", "XX", "C", ""]
PI = 3.141592653589793


def panels(s: SparkSession, d: str) -> DataFrame:
    """One row an order: panel_id, project, box, size, thickness."""
    o = table(s, d, "orders")
    k, w = F.col("o_orderkey"), (300 + 100 * (F.col("o_custkey") % 10)).cast("double")
    h = F.when(k % 97 == 0, 40).otherwise(300 + 60 * (k % 25)).cast("double")
    x = F.when(k % 101 == 0, 6000.0).otherwise(0.0)
    cols = o.select(k.alias("panel_id"), F.col("o_custkey").alias("project"), x.alias("xmin"), F.lit(0.0).alias("ymin"), w.alias("w"), h.alias("h"), F.when(k % 13 == 0, 6).otherwise(16 + k % 4).cast("double").alias("thickness"))
    return cols.select("panel_id", "project", "xmin", "ymin", (F.col("xmin") + F.col("w")).alias("xmax"), F.col("h").alias("ymax"), "w", "h", "thickness")


def holes(s: SparkSession, d: str) -> DataFrame:
    """One row a line item: panel_id, seq, x, y, diameter, depth, layer, and its panel's box."""
    li = table(s, d, "lineitem")
    rest = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    q, dd, t = F.col("l_quantity").cast("int") % 10, F.round(100 * F.col("l_discount")).cast("int"), F.round(100 * F.col("l_tax")).cast("int")
    tenths = F.when(q <= 3, 50).when(q == 4, 60).when(q == 5, 70).when(q == 6, 80).when(q == 7, 350).when(q == 8, 150).otherwise(F.when(t == 8, 410).otherwise(20 + 4 * t))
    numbered = li.withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*rest)))
    met = numbered.join(panels(s, d), F.col("l_orderkey") == F.col("panel_id"))
    x = F.when(q < 4, 37.0).otherwise(((F.col("l_partkey") * 53) % F.col("w").cast("bigint")).cast("double"))
    y = F.when(q < 4, 37.0 + 32 * F.col("seq")).otherwise(((F.col("l_partkey") * 29 + F.col("l_suppkey") * 17) % F.col("h").cast("bigint")).cast("double"))
    layer = F.element_at(F.array(*map(F.lit, HOLE_LAYERS)), (F.col("l_partkey") % 6 + 1).cast("int"))
    return met.select("panel_id", "project", "seq", (F.col("xmin") + x).alias("x"), y.alias("y"), ((tenths + F.when(dd <= 6, 0).otherwise(dd - 8)) / 10.0).alias("diameter"), (F.col("l_suppkey") % 20).cast("double").alias("depth"), layer.alias("layer"), "xmin", "ymin", "xmax", "ymax")


def contours(s: SparkSession, d: str) -> DataFrame:
    """One row a part: contour_id, layer and vertices: a rectangle, a chevron, a bow tie, or an open or reversed rectangle."""
    k, w, h = F.col("p_partkey"), F.col("p_size").cast("double"), (4 + F.col("p_partkey") % 120).cast("double")
    z = F.lit(0.0)
    pt = lambda a, b: F.array(a, b)
    shape = (
        F.when(k % 7 == 1, F.array(pt(z, z), pt(w, z), pt(w, h), pt(w / 2, h / 4), pt(z, h)))
        .when(k % 7 == 2, F.array(pt(z, z), pt(w, h), pt(w, z), pt(z, h)))
        .when(k % 7 == 3, F.array(pt(z, z), pt(z, h), pt(w, h), pt(w, z)))
        .otherwise(F.array(pt(z, z), pt(w, z), pt(w, h), pt(z, h)))
    )
    names = F.create_map(*[F.lit(x) for p in CONTOUR_LAYERS.items() for x in p])
    return table(s, d, "part").select(k.alias("contour_id"), F.element_at(names, F.split("p_type", " ")[0]).alias("layer"), shape.alias("vertices"), (k % 7 != 4).alias("is_closed"))


def placed_rings(s: SparkSession, d: str) -> DataFrame:
    """Rings within panels: panel_id, node, layer, vertices, is_closed, is_approximated; each of eleven kinds of part, right and wrong."""
    k, w, h = F.col("p_partkey"), F.col("p_size").cast("double"), (4 + F.col("p_partkey") % 120).cast("double")
    kind = k % 11
    ox, oy = F.col("xmin") + 40.0 + 60.0 * (k % 5), 50.0 + 40.0 * (k % 3)

    def ring(*points):
        return F.array(*[F.array(ox + x, oy + y) for x, y in points])

    zero = F.lit(0.0)
    box = lambda height: ring((zero, zero), (w, zero), (w, height), (zero, height))
    turned = lambda a, b, c, e: ring((a, b), (a, e), (c, e), (c, b))
    wide, high = 4 * w + 100, h + 100
    shape = (
        F.when(kind == 1, ring((zero, zero), (wide, zero), (wide, high), (wide / 2, high / 4), (zero, high)))
        .when(kind == 2, ring((zero, zero), (w, h), (w, zero), (zero, h)))
        .when(kind == 3, turned(zero, zero, w, h))
        .when(kind == 5, ring((zero, zero), (w, zero), (w, h), (w / 2, zero), (zero, h)))
        .when(kind == 6, ring((zero, zero), (zero, zero), (zero, zero)))
        .when(kind == 7, box(F.lit(0.00001)))
        .when(kind == 8, box(F.lit(0.015)))
        .otherwise(box(h))
    )
    inner = F.when(k % 2 == 1, turned(w / 4, h / 4, 3 * w / 4, 3 * h / 4)).otherwise(ring((w / 4, h / 4), (3 * w / 4, h / 4), (3 * w / 4, 3 * h / 4), (w / 4, 3 * h / 4)))
    names = F.create_map(*[F.lit(x) for p in RING_LAYERS.items() for x in p])
    p = table(s, d, "part").join(panels(s, d).select("panel_id", "xmin"), F.col("panel_id") == 7 * k)
    both = F.array(F.struct(F.concat(F.lit("c"), k.cast("string")).alias("node"), shape.alias("vertices")), F.when(kind == 9, F.struct(F.concat(F.lit("i"), k.cast("string")).alias("node"), inner.alias("vertices"))))
    each = p.select("panel_id", F.element_at(names, F.split("p_type", " ")[0]).alias("layer"), (kind != 4).alias("is_closed"), (k % 13 == 0).alias("is_approximated"), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("_r"))
    return each.select("panel_id", "_r.node", "layer", "_r.vertices", "is_closed", "is_approximated")


def shapes(s: SparkSession, d: str) -> DataFrame:
    """All shapes of all panels, as the rules take them: outlines, bores (with planted doubles, wide and tiny ones) and rings."""
    p = panels(s, d)
    x0, x1, y0, y1 = (F.col(c) for c in ("xmin", "xmax", "ymin", "ymax"))
    pt = lambda a, b: F.array(a, b)
    outline = F.when(F.col("panel_id") % 103 == 0, F.array(pt(x0, y0), pt(x0, y1), pt(x1, y1), pt(x1, y0))).otherwise(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1)))
    rings = placed_rings(s, d).withColumn("is_boundary", F.lit(False)).unionByName(p.select("panel_id", F.lit("boundary").alias("node"), F.lit("BORDER").alias("layer"), outline.alias("vertices"), F.lit(True).alias("is_closed"), F.lit(False).alias("is_approximated"), F.lit(True).alias("is_boundary")))
    v, b, none = F.col("vertices"), g.box(F.col("vertices")), F.lit(None).cast("double")
    polylines = rings.select(
        "panel_id", "node", F.lit("lwpolyline").alias("geometry_type"), "layer", layer_type(F.col("layer")).alias("kind"), "vertices", ((b["xmin"] + b["xmax"]) / 2).alias("x"), ((b["ymin"] + b["ymax"]) / 2).alias("y"), none.alias("radius"), "is_closed", "is_approximated", "is_boundary",
        F.when(F.col("is_closed"), F.abs(g.signed_area(v))).alias("area"), g.ring_length(v, F.col("is_closed")).alias("perimeter"), b["xmin"].alias("bx0"), b["ymin"].alias("by0"), b["xmax"].alias("bx1"), b["ymax"].alias("by1"), none.alias("depth"))
    h = holes(s, d)
    name, first = F.concat(F.lit("h"), F.col("seq").cast("string")), F.col("seq") == 1
    bore = lambda node, x, diameter: F.struct(node.alias("node"), x.alias("x"), diameter.alias("diameter"))
    bores = F.array(bore(name, F.col("x"), F.col("diameter")), F.when(first & (F.col("panel_id") % 89 == 0), bore(F.concat(name, F.lit("d")), F.col("x") + 0.0625, F.col("diameter") * 1.0078125)), F.when(first & (F.col("panel_id") % 83 == 0), bore(F.concat(name, F.lit("w")), F.col("x") + 102.0, F.lit(200.0))))
    planted = h.select("panel_id", "layer", "y", "depth", F.explode(F.filter(bores, lambda x: x.isNotNull())).alias("_b")).select("panel_id", "_b.node", "layer", "_b.x", "y", "_b.diameter", "depth")
    tiny = p.where("panel_id % 101 = 5").select("panel_id", F.lit("tiny").alias("node"), F.lit("MISC").alias("layer"), (F.col("xmin") + 50).alias("x"), F.lit(20.0).alias("y"), F.lit(0.001).alias("diameter"), F.lit(1.0).alias("depth"))
    r = F.col("diameter") / 2
    circles = planted.unionByName(tiny).select(
        "panel_id", "node", F.lit("circle").alias("geometry_type"), "layer", layer_type(F.col("layer")).alias("kind"), F.lit(None).cast("array<array<double>>").alias("vertices"), "x", "y", r.alias("radius"), F.lit(True).alias("is_closed"), F.lit(False).alias("is_approximated"), F.lit(False).alias("is_boundary"),
        (PI * r * r).alias("area"), (2 * PI * r).alias("perimeter"), (F.col("x") - r).alias("bx0"), (F.col("y") - r).alias("by0"), (F.col("x") + r).alias("bx1"), (F.col("y") + r).alias("by1"), "depth")
    return polylines.unionByName(circles)


def nests(s: SparkSession, d: str) -> DataFrame:
    """Sheets with two panels of a project each, and their holes, as ``nesting`` takes them; every third sheet lies on a layer that doesn't say so."""
    order = Window.partitionBy("project").orderBy("panel_id")
    p = panels(s, d).withColumn("_n", F.row_number().over(order) - 1)
    p = p.select("panel_id", (F.col("project") * 1000 + F.floor(F.col("_n") / 2)).alias("drawing"), (F.col("_n") % 2).cast("int").alias("slot"), "xmin", "w", "h")
    pt = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    box = lambda x0, y0, x1, y1: F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))
    n = lambda v: F.lit(float(v))
    x0 = F.col("slot") * 1300.0
    row = lambda d, seq, kind, layer, v, x, y: d.select("drawing", seq.cast("bigint").alias("seq"), F.lit(kind).alias("entity_type"), layer.alias("layer"), v.alias("vertices"), F.lit(True).alias("is_closed"), x.alias("x"), y.alias("y"))
    sheets = p.select("drawing").distinct()
    sheet = row(sheets, F.lit(0), "LWPOLYLINE", F.when(F.col("drawing") % 3 == 0, "MISC").otherwise("SHEET_1"), box(n(-10), n(-10), n(2600), n(1790)), n(1295), n(890))
    outline = row(p, F.col("slot") + 1, "LWPOLYLINE", F.lit("CUT"), box(x0, n(0), x0 + F.col("w"), F.col("h")), x0 + F.col("w") / 2, F.col("h") / 2)
    h = holes(s, d).select("panel_id", F.col("seq").alias("k"), "x", "y").join(p, "panel_id")
    bore = row(h, 100 * (F.col("slot") + 1) + F.col("k"), "CIRCLE", F.lit("DRILL"), F.lit(None).cast("array<array<double>>"), x0 + F.col("x") - F.col("xmin"), F.col("y"))
    return sheet.unionByName(outline).unionByName(bore)


def components(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    letters = F.element_at(F.array(*map(F.lit, TAG_LETTERS)), (F.floor(k / 26) % 7 + 1).cast("int"))
    tag = F.concat(F.char(65 + k % 26), letters, F.lit("-"), (100 + k % 700).cast("string"))
    return table(s, d, "part").select(k.alias("component_id"), tag.alias("tag"))


def connections(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("_n")))
    return p.where(F.col("p_partkey") % 3 == 0).join(n).select(F.col("p_partkey").alias("src"), ((7 * F.col("p_partkey") + 3) % F.col("_n")).alias("dst"))


SQL_PANELS = """panels as (
  select panel_id, project, xmin, 0.0::double ymin, xmin + w xmax, h ymax, w, h, thickness from (
    select o_orderkey panel_id, o_custkey project, (case when o_orderkey % 101 = 0 then 6000 else 0 end)::double xmin, (300 + 100 * (o_custkey % 10))::double w,
           (case when o_orderkey % 97 = 0 then 40 else 300 + 60 * (o_orderkey % 25) end)::double h, (case when o_orderkey % 13 = 0 then 6 else 16 + o_orderkey % 4 end)::double thickness from orders))"""

SQL_HOLES = (
    SQL_PANELS
    + """, lines as (
  select *, (l_quantity::int) % 10 q, round(100 * l_discount)::int dd, round(100 * l_tax)::int t,
         row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) seq from lineitem),
holes as (
  select p.panel_id, p.project, seq::int seq, p.xmin + (case when q < 4 then 37.0 else ((l_partkey * 53) % w::bigint)::double end) x,
         (case when q < 4 then 37.0 + 32 * seq else ((l_partkey * 29 + l_suppkey * 17) % h::bigint)::double end)::double y,
         ((case when q <= 3 then 50 when q = 4 then 60 when q = 5 then 70 when q = 6 then 80 when q = 7 then 350 when q = 8 then 150
          else (case when t = 8 then 410 else 20 + 4 * t end) end + case when dd <= 6 then 0 else dd - 8 end)::double / 10.0::double) diameter,
         (l_suppkey % 20)::double depth, (['DRILL','DRILL_D5','HINGE_35','CONFIRMAT','MISC','POCKET_D6'])[(l_partkey % 6 + 1)::int] layer, xmin, ymin, xmax, ymax
  from lines join panels p on l_orderkey = p.panel_id)"""
)

SQL_CONTOURS = """contours as (
  select *, case k when 1 then [[0, 0], [w, 0], [w, h], [w / 2, h / 4], [0, h]] when 2 then [[0, 0], [w, h], [w, 0], [0, h]]
           when 3 then [[0, 0], [0, h], [w, h], [w, 0]] else [[0, 0], [w, 0], [w, h], [0, h]] end::double[][] vertices from (
    select p_partkey contour_id, case split_part(p_type, ' ', 1) when 'PROMO' then 'POCKET' when 'ECONOMY' then 'CUT' when 'MEDIUM' then 'ENGRAVE' when 'SMALL' then 'DRILL' when 'STANDARD' then 'SHEET' when 'LARGE' then 'MISC' end layer,
           p_size::double w, (4 + p_partkey % 120)::double h, p_partkey % 7 k, (p_partkey % 7 <> 4) is_closed from part))"""

SQL_PID = """components as (select p_partkey component_id, chr((65 + p_partkey % 26)::int) || (['T','IC','V','AH','XX','C',''])[((p_partkey // 26) % 7 + 1)::int] || '-' || (100 + p_partkey % 700) tag from part),
connections as (select p_partkey src, (7 * p_partkey + 3) % (select count(*) from part) dst from part where p_partkey % 3 = 0)"""

_CORNERS = "(list_transform(range(1, len(vertices) + 1), lambda i: {'a': vertices[i], 'b': vertices[case when i = len(vertices) then 1 else i + 1 end]}))"
SQL_AREA = f"(list_sum(list_transform({_CORNERS}, lambda e: e.a[1] * e.b[2] - e.b[1] * e.a[2])) / 2)"
_STEP = "sqrt((e.b[1] - e.a[1]) * (e.b[1] - e.a[1]) + (e.b[2] - e.a[2]) * (e.b[2] - e.a[2]))"
SQL_LENGTH = f"list_sum(list_transform({_CORNERS}, lambda e: {_STEP}))"
_KIND = lambda c: f"case when regexp_matches({c}, '^CUT') then 'cut' when regexp_matches({c}, '^DRILL') then 'drill' when regexp_matches({c}, '^POCKET') then 'pocket' when regexp_matches({c}, '^(BORDER|SHEET)') then 'border' when regexp_matches({c}, '^ENGRAVE') then 'engrave' else 'unknown' end"
SQL_SHAPES = f"""{SQL_HOLES}, sized as (
  select p_partkey pk, p_partkey % 11 k, 7 * p_partkey panel_id, p_size::double w, (4 + p_partkey % 120)::double h, xmin + 40 + 60 * (p_partkey % 5) ox, (50 + 40 * (p_partkey % 3))::double oy,
    case split_part(p_type, ' ', 1) when 'PROMO' then 'POCKET_D6' when 'ECONOMY' then 'CUT_OUTER' when 'MEDIUM' then 'ENGRAVE_A' when 'SMALL' then 'DRILL' when 'STANDARD' then 'SHEET' when 'LARGE' then 'MISC' end layer
  from part join panels on panel_id = 7 * p_partkey),
loose as (
  select *, 'c' || pk node, case k when 1 then [[0, 0], [4 * w + 100, 0], [4 * w + 100, h + 100], [2 * w + 50, (h + 100) / 4], [0, h + 100]] when 2 then [[0, 0], [w, h], [w, 0], [0, h]] when 3 then [[0, 0], [0, h], [w, h], [w, 0]]
    when 5 then [[0, 0], [w, 0], [w, h], [w / 2, 0], [0, h]] when 6 then [[0, 0], [0, 0], [0, 0]] when 7 then [[0, 0], [w, 0], [w, 0.00001::double], [0, 0.00001::double]] when 8 then [[0, 0], [w, 0], [w, 0.015::double], [0, 0.015::double]] else [[0, 0], [w, 0], [w, h], [0, h]] end::double[][] v0 from sized
  union all select *, 'i' || pk, case when pk % 2 = 1 then [[w / 4, h / 4], [w / 4, 3 * h / 4], [3 * w / 4, 3 * h / 4], [3 * w / 4, h / 4]] else [[w / 4, h / 4], [3 * w / 4, h / 4], [3 * w / 4, 3 * h / 4], [w / 4, 3 * h / 4]] end::double[][] from sized where k = 9),
placed as (
  select panel_id, node, layer, list_transform(v0, lambda q: [ox + q[1], oy + q[2]]) vertices, k <> 4 is_closed, pk % 13 = 0 is_approximated, false is_boundary from loose
  union all select panel_id, 'boundary', 'BORDER', case when panel_id % 103 = 0 then [[xmin, ymin], [xmin, ymax], [xmax, ymax], [xmax, ymin]] else [[xmin, ymin], [xmax, ymin], [xmax, ymax], [xmin, ymax]] end, true, false, true from panels),
rings as (
  select panel_id, node, layer, {_KIND('layer')} kind, vertices, is_closed, is_approximated, is_boundary, case when is_closed then abs({SQL_AREA}) end area,
    list_sum(list_transform({_CORNERS}[:case when is_closed then len(vertices) else len(vertices) - 1 end], lambda e: {_STEP})) perimeter, {SQL_AREA} turn,
    list_min(list_transform(vertices, lambda q: q[1])) bx0, list_min(list_transform(vertices, lambda q: q[2])) by0, list_max(list_transform(vertices, lambda q: q[1])) bx1, list_max(list_transform(vertices, lambda q: q[2])) by1 from placed),
bores as (
  select panel_id, 'h' || seq node, layer, x, y, diameter, depth from holes union all select panel_id, 'h1d', layer, x + 0.0625, y, diameter * 1.0078125::double, depth from holes where seq = 1 and panel_id % 89 = 0
  union all select panel_id, 'h1w', layer, x + 102, y, 200, depth from holes where seq = 1 and panel_id % 83 = 0 union all select panel_id, 'tiny', 'MISC', xmin + 50, 20, 0.001::double, 1 from panels where panel_id % 101 = 5),
discs as (select panel_id, node, layer, {_KIND('layer')} kind, x, y, diameter / 2 r, depth from bores),
shapes as (
  select s.*, xmin, ymin, xmax, ymax from (
    select panel_id, node, 'lwpolyline' geometry_type, kind, vertices, (bx0 + bx1) / 2 x, (by0 + by1) / 2 y, null::double r, is_closed, is_approximated, is_boundary, area, perimeter, turn, bx0, by0, bx1, by1, null::double depth, layer from rings
    union all select panel_id, node, 'circle', kind, null, x, y, r, true, false, false, 3.141592653589793::double * r * r, 2 * 3.141592653589793::double * r, null, x - r, y - r, x + r, y + r, depth, layer from discs) s join panels using (panel_id)),
sides as (select panel_id, node, len(vertices) n, unnest({_CORNERS}) e, generate_subscripts(vertices, 1) i from rings where len(vertices) >= 4),
crossed as (
  select distinct panel_id, node from (
    select s.panel_id, s.node, s.n, s.i, t.i j, s.e.a[1] ax, s.e.a[2] ay, s.e.b[1] bx, s.e.b[2] by_, t.e.a[1] cx, t.e.a[2] cy, t.e.b[1] dx, t.e.b[2] dy,
      sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) s1, sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) s2, sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) s3, sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) s4
    from sides s join sides t on s.panel_id = t.panel_id and s.node = t.node and s.i + 1 < t.i and not (s.i = 1 and t.i = s.n))
  where (s1 * s2 < 0 and s3 * s4 < 0) or (s1 = 0 and cx between least(ax, bx) and greatest(ax, bx) and cy between least(ay, by_) and greatest(ay, by_)) or (s2 = 0 and dx between least(ax, bx) and greatest(ax, bx) and dy between least(ay, by_) and greatest(ay, by_))
    or (s3 = 0 and ax between least(cx, dx) and greatest(cx, dx) and ay between least(cy, dy) and greatest(cy, dy)) or (s4 = 0 and bx between least(cx, dx) and greatest(cx, dx) and by_ between least(cy, dy) and greatest(cy, dy)))"""

SQL_NESTS = f"""{SQL_HOLES}, pn as (select *, (row_number() over (partition by project order by panel_id) - 1) n from panels), sl as (select panel_id, (project * 1000 + n // 2)::bigint drawing, (n % 2)::int slot, xmin px, w, h, (n % 2) * 1300.0::double x0 from pn),
sd as (select drawing, count(*) k, drawing % 3 <> 0 named, max(w * h) most from sl group by 1), sc as (select *, case when named then 'sheet_layer' when k >= 2 then 'largest_contour' else 'none' end as source, 2610 * 1800::double sheet from sd),
pl as (select drawing, slot + 1 panel, x0, w, h, w * h area from sl join sc using (drawing) where source <> 'none' and w * h >= greatest(1000, 0.05 * sheet))"""
