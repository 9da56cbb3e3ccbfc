import math

import pytest
from pyspark.sql import functions as F

from kerfspark.sources import dxf


def text(*body, units=4, blocks=()):
    head = [0, "SECTION", 2, "HEADER", 9, "$ACADVER", 1, "AC1024", 9, "$INSUNITS", 70, units, 0, "ENDSEC"]
    b = [0, "SECTION", 2, "BLOCKS", *blocks, 0, "ENDSEC"] if blocks else []
    return "\n".join(map(str, [*head, *b, 0, "SECTION", 2, "ENTITIES", *body, 0, "ENDSEC", 0, "EOF"])).encode()


CIRCLE = (0, "CIRCLE", 5, "A1", 8, "DRILL_D5", 10, 10.0, 20, 20.0, 40, 2.5)
RECT = (0, "LWPOLYLINE", 5, "A2", 8, "CUT", 90, 4, 70, 1, 10, 0, 20, 0, 10, 100, 20, 0, 10, 100, 20, 50, 10, 0, 20, 50)


def read(spark, *contents):
    return dxf.parse(spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content binary"))


def test_shapes_and_measures(spark):
    e = {r.handle: r for r in dxf.entities(read(spark, text(*CIRCLE, *RECT, 0, "LINE", 5, "L", 8, "0", 10, 0, 20, 0, 11, 3, 21, 4, 0, "ARC", 5, "R", 8, "0", 10, 0, 20, 0, 40, 2, 50, 0, 51, 90))).collect()}
    assert e["A1"].diameter_mm == 5.0 and e["A1"].depth_mm == 5.0 and math.isclose(e["A1"].area_mm2, 19.635, abs_tol=1e-3)
    assert e["A2"].area_mm2 == 5000.0 and e["A2"].perimeter_mm == 300.0 and e["A2"].layer_type == "cut"
    assert e["L"].perimeter_mm == 5.0 and math.isclose(e["R"].perimeter_mm, math.pi, abs_tol=1e-3)


def test_inches_bulge_polyline_spline_ellipse(spark):
    body = (*CIRCLE, 0, "LWPOLYLINE", 5, "B", 8, "0", 70, 1, 10, 0, 20, 0, 42, 1, 10, 10, 20, 0, 42, 1, 0, "POLYLINE", 5, "P", 8, "0", 70, 1, 0, "VERTEX", 10, 0, 20, 0, 0, "VERTEX", 10, 4, 20, 0, 0, "VERTEX", 10, 4, 20, 3, 0, "SEQEND")
    body += (0, "ELLIPSE", 5, "E", 8, "0", 10, 0, 20, 0, 11, 4, 21, 0, 40, 0.5, 41, 0, 42, 2 * math.pi, 0, "SPLINE", 5, "S", 8, "0", 70, 0, 71, 1, 40, 0, 40, 0, 40, 1, 40, 2, 40, 2, 10, 0, 20, 0, 10, 1, 20, 0, 10, 1, 20, 1)
    e = {r.handle: r for r in dxf.entities(read(spark, text(*body))).collect()}
    assert e["B"].is_approximated and math.isclose(e["B"].area_mm2, math.pi * 25, rel_tol=0.03)
    assert e["P"].area_mm2 == 6.0 and e["P"].entity_type == "POLYLINE"
    assert e["E"].is_closed and math.isclose(e["E"].area_mm2, math.pi * 8, rel_tol=0.01)
    assert math.isclose(e["S"].perimeter_mm, 2.0, rel_tol=1e-6) and e["S"].is_approximated
    inch = dxf.entities(read(spark, text(*CIRCLE, units=1))).first()
    assert math.isclose(inch.diameter_mm, 127.0)


def test_blocks(spark):
    block = (0, "BLOCK", 2, "K", 10, 0, 20, 0, 0, "CIRCLE", 5, "Q", 8, "0", 10, 1, 20, 0, 40, 1, 0, "INSERT", 5, "N", 8, "0", 2, "K", 10, 0, 20, 0, 0, "ENDBLK")
    rows = read(spark, text(0, "INSERT", 5, "I", 8, "HOLES", 2, "K", 10, 100, 20, 0, 41, 2, 42, 2, 50, 90, blocks=block)).collect()
    first = next(r for r in rows if r.kind == "entity")
    assert first.layer == "HOLES" and [round(x, 6) for x in first.numbers] == [100, 2, 2] and first.handle.startswith("Q-iI-0")
    assert any(r.warning == "insert_not_exploded" for r in rows), "a block within itself ends at the depth limit"


def test_damaged(spark):
    rows = read(spark, b"", None, b"rubbish", text(), text(0, "CIRCLE", 5, "X", 10, 1, 20, 1, 40, 0), text(*CIRCLE)[:-14], text(0, "TEXT", 1, "hi"), b"0\nSECTION\nx\ny\n").collect()
    assert {r.source_file: r.warning for r in rows if r.kind == "warning"}.keys() == {"f0", "f1", "f2", "f3", "f4", "f6", "f7"}
    assert [r.entity_type for r in rows if r.source_file == "f5"] == ["CIRCLE"]
    whole = read(spark, b"", text(*CIRCLE), text(0, "CIRCLE", 5, "X", 10, 1, 20, 1, 40, 0), b"0\nSECTION\nx\ny\n")
    assert tuple(dxf.corpus(whole).first()) == (4, 1, 3, 2, 1, 4) and tuple(dxf.corpus(whole.limit(0)).first()) == (0,) * 6
    assert read(spark).count() == 0


def test_boundary_and_depth(spark):
    low = (0, "CIRCLE", 5, "Z", 8, "X", 10, 1, 20, 1, 30, -6, 40, 1)
    e = dxf.entities(read(spark, text(*CIRCLE, *RECT, *low), text(*CIRCLE)))
    assert e.where("handle = 'Z'").first().depth_mm == 6.0
    b = {r.source_file: r for r in dxf.boundaries(e).collect()}
    assert not b["f0"].inferred and b["f0"].xmax == 100.0 and b["f1"].inferred and b["f1"].xmin == -2.5


def test_round_trip(spark, tmp_path):
    panels = spark.range(12).select("id", *[F.lit(v).alias(c) for c, v in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 600.0), ("ymax", 400.5))], F.transform(F.sequence(F.lit(1), (F.col("id") + 1).cast("int")), lambda i: F.struct((i * 32.0).alias("x"), F.lit(37.25).alias("y"), F.lit(2.5).alias("r"), F.lit("DRILL").alias("layer"))).alias("c"))
    for r in panels.select("id", dxf.render({k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}, F.col("c")).alias("t")).collect():
        (tmp_path / f"p{r.id}.{'DXF' if r.id % 2 else 'dxf'}").write_text(r.t)
    e = dxf.entities(dxf.read_dxf(spark, str(tmp_path)))
    assert e.where("entity_type = 'CIRCLE'").count() == sum(range(1, 13)) and e.where("entity_type = 'LWPOLYLINE' and area_mm2 = 240300").count() == 12


@pytest.mark.parametrize("limit", [10])
def test_size_guard(spark, limit):
    f = spark.createDataFrame([("a", text(*CIRCLE))], "path string, content binary")
    assert dxf.parse(f, max_bytes=limit).first().warning == "too_large"
