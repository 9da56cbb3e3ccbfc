import math

import pytest
from pyspark.sql import functions as F

from kerfspark.operators import units

SCHEMA = "entity_key bigint, source_file string, config_id string, units_original string, entity_type string, coordinates array<array<double>>, diameter_mm double, depth_mm double, size_text string, layer string"
CONFIGS = "config_id string, target_units string"


def circles(first, file, config, header, unit, n=20, r=3.5):
    """A file's circles, drawn on a 0.1 mm grid and written in a unit."""
    k = units.MILLIMETRES[unit]
    rows = []
    for i in range(n):
        x, y = 13.1 * (3 + i) + 0.3 * i * i, 1200.7 - 31.3 * i
        c = [round(x / k, 5), round(y / k, 5), round(r / k, 5)]
        rows.append((first + i, file, config, header, "CIRCLE", [c], round(2 * r / k, 5), round(9 / k, 5), None, "DRILL"))
    return rows


@pytest.fixture(scope="module")
def cases(spark):
    rows = circles(0, "a", "c-mm", None, "mm") + circles(100, "b", "c-in", "mm", "in") + circles(200, "c", None, "6", "m") + circles(300, "d", "c-mm", "mm", "in") + circles(400, "e", "c-mil", None, "mil")
    rows += circles(500, "f", "c-blank", " ", "mm") + circles(600, "g", "c-mm", None, "mm")
    rows += [
        (900, "a", "c-mm", None, "CIRCLE", [[10.0, 20.0, 9.52]], None, None, 'drill 3/4"', ""),
        (901, "a", "c-mm", None, "CIRCLE", [[10.0, 20.0, 4.0]], 0.8, None, "dia 0,8 cm", ""),
        (902, "a", "c-mm", None, "CIRCLE", [[10.0, 20.0, 4.0]], 8.0, 0.3, "0.3 cm deep", ""),
        (903, "a", "c-mm", None, "CIRCLE", [[10.0, 20.0, 4.0]], 0.008, None, None, ""),
        (904, "b", "c-in", None, "CIRCLE", [[0.4, 0.8, 0.09843]], 5.0, None, "5 mm (0.197 in)", ""),
        (905, "a", "c-mm", None, "CIRCLE", [[10.0, 20.0, 4.0]], float("nan"), float("nan"), "row 17 of 9", ""),
        (906, "a", "c-mm", None, "LINE", [], None, None, "inch-nut no. 27", ""),
        (907, None, None, None, "LWPOLYLINE", None, None, None, "", ""),
        (908, None, "nowhere", "furlong", "LINE", [[1.0, 2.0], None, [3.0, 4.0]], None, 4.0, "x" * 100_000, None),
        (900, "a", "c-mm", None, "CIRCLE", [[10.0, 20.0, 9.52]], None, None, 'drill 3/4"', ""),
    ]
    e = spark.createDataFrame(rows, SCHEMA).withColumn("declared", F.lit("x")).withColumn("unit", F.lit(1))
    c = spark.createDataFrame([("c-mm", "MM"), ("c-in", '"'), ("c-mil", "thou"), ("c-blank", " ")], CONFIGS)
    return e, c


def test_cases(cases):
    got = {}
    for r in units.unit_cases(*cases).collect():
        assert (r.entity_key, r.field_name) not in got
        got[r.entity_key, r.field_name] = r.unit_code
    assert all(got.get((100 + i, f)) == "in" for i in range(20) for f in ("coordinates", "diameter_mm", "depth_mm"))
    assert all(got.get((200 + i, "coordinates")) == "m" for i in range(20))
    assert all(got.get((300 + i, "diameter_mm")) == "in" for i in range(20)), "a wrong declaration"
    assert all(got.get((400 + i, "depth_mm")) == "mil" for i in range(20))
    assert not [k for k in got if k[0] < 100 or 500 <= k[0] < 900]
    assert {k: v for k, v in got.items() if k[0] >= 900} == {
        (900, "diameter_mm"): "in",
        (901, "diameter_mm"): "cm",
        (902, "depth_mm"): "cm",
        (903, "diameter_mm"): "m",
        (904, "coordinates"): "in",
    }


def test_millimetres(cases):
    rows = {r.entity_key: r for r in units.to_millimetres(*cases).collect()} if set(cases[0].columns) >= {"bounding_box"} else None
    e = cases[0].drop("declared", "unit").withColumns({"bounding_box": F.lit(None).cast("array<double>"), "centroid": F.array(F.lit(1.0)), **{c: F.lit(1.0) for c in ("area_mm2", "perimeter_mm", "radius_mm", "elevation_z")}})
    rows = {r.entity_key: r for r in units.to_millimetres(e, cases[1]).collect()}
    assert math.isclose(rows[300].diameter_mm, 7.0, abs_tol=1e-3) and math.isclose(rows[300].coordinates[0][2], 3.5, abs_tol=1e-3)
    assert math.isclose(rows[900].diameter_mm, 19.05) and math.isclose(rows[902].depth_mm, 3.0)
    assert rows[907].coordinates is None and rows[904].diameter_mm == 5.0


def test_small_file_of_cups(spark, cases):
    rows = [r for i in range(30) for r in circles(i * 100, f"f{i}", "c-mm", None, "mm", n=12)] + circles(9000, "cups", "c-in", None, "in", n=2, r=17.5)
    got = units.unit_cases(spark.createDataFrame([(*r[:9], "") for r in rows], SCHEMA), cases[1]).collect()
    assert {(r.entity_key, r.field_name, r.unit_code) for r in got} == {(k, f, "in") for k in (9000, 9001) for f in ("coordinates", "diameter_mm", "depth_mm")}


def test_empty(spark, cases):
    assert units.unit_cases(cases[0].limit(0), cases[1]).count() == 0
    assert units.unit_cases(cases[0], cases[1].limit(0)).where("entity_key between 400 and 419").count() == 60, "magnitudes alone tell the unit"


@pytest.mark.parametrize("text,unit,value,depth", [("Ø5/16\"", "in", 0.3125, False), ('dia. 1 1/4"', "in", 1.25, False), ("1-1/2 in hole", "in", 1.5, False), ("Tiefe 12 mm", "mm", 12.0, True), ("0,31496in. bore", "in", 0.31496, False), ("Bohrung 0.008 Meter", "m", 0.008, False), ("10 mm (0.394 in)", "mm", 10.0, False), ("M6x5", None, None, False), ("rev 29", None, None, False), ("3 in place", None, None, False), ("", None, None, False)])
def test_text(spark, text, unit, value, depth):
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in units.text_size(F.col("t")).items()]).first()
    assert got.text_unit == unit and (unit is None or math.isclose(got.text_value, value)) and got.text_is_depth == depth
