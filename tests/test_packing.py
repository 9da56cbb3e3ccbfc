import json

from kerfspark.operators import packing
from kerfspark.runtime import cut

FILES = "file_id bigint, folder string, file_name string, content string, sample_id string, line_no string"


def files(spark, *contents):
    return spark.createDataFrame([(i, "d", f"f{i}.json", c, None, "clash") for i, c in enumerate(contents)], FILES)


def surplus(spark, *contents):
    return sorted((r.file_id, r.line_no) for r in packing.surplus_records(files(spark, *contents)).collect())


def test_equal_spellings(spark):
    a = '{"sample_id": "s", "w": 15.0, "o": {"x": [1, 2.50], "y": null}, "t": "ü"}'
    b = ' {"o":{"y":null,"x":[1.0,25e-1]},"t":"\\u00fc","w":1.5E1,"sample_id":"s"} '
    assert surplus(spark, a, b + "\n", "x\n" + a) == [(1, 0), (2, 1)]


def test_different(spark):
    assert surplus(spark, '{"a": 1}', '{"a": true}', '{"a": "1"}', '{"a": null}', "{}", '{"a": 1.0000000000000001}', '{"a": [1]}', '{"a": -1}', '{"a": 10}') == []
    assert surplus(spark, '{"a": 0}', '{"a": -0.0}', '{"a": 0e5}') == [(1, 0), (2, 0)]


def test_broken_null_empty(spark):
    assert surplus(spark, None, "", "\n\n", '{"a": 1', '{"a": 1', '{"a": NaN}', '{"a": NaN}') == []
    assert packing.broken_lines(files(spark, None, "", "\n \n", '{"a": 1', "zz\n")).count() == 2
    assert packing.surplus_records(spark.createDataFrame([], FILES)).count() == 0


def test_round_trip(spark):
    """Files come back byte for byte, each record once, and every line by a ranged read; copies point at the kept record."""
    texts = [json.dumps({"sample_id": f"s{i % 7}", "v": "é" * (i % 5)}) for i in range(60)] + [json.dumps({"long": "x" * 300_000})]
    odd = ["", None, "\r\n\r\n", '{"half": ', texts[0].replace(": ", ":"), texts[3] + "\n", "  \n" + texts[5] + "\r\n\ttrailing"]
    contents = ["\n".join(texts[i : i + 3]) for i in range(0, 61, 3)] + odd
    f = files(spark, *contents)
    places = cut(packing.index(f, block_bytes=2_000))
    packed = cut(packing.blocks(f, places))
    back = packing.unpack(packed, places).collect()
    assert all(r.intact for r in back) and sorted(r.record for r in back) == sorted([*{t for t in texts}])
    again = {r.file_id: (r.content, r.intact) for r in packing.rebuild(packed, places).collect()}
    assert again == {i: (c, True) for i, c in enumerate(contents) if c is not None}
    rows = {(r.file_id, r.line_no): r for r in places.collect()}
    assert len(rows) == sum(len(c.split("\n")) for c in contents if c is not None)
    kept = {k for k, r in rows.items() if r.role == "record"}
    assert all((r.kept_file_id, r.kept_line_no) in kept for r in rows.values() if r.role == "surplus")
    other = next(r for k, r in rows.items() if k == (25, 0))
    assert other.role == "surplus" and other.kind == "rest", "another spelling keeps its own bytes"
    total = sum(r.bytes for r in packed.collect())
    assert packed.where("kind = 'records'").count() > 1 and total == sum(r.length for k, r in rows.items() if r.role != "surplus" or r.kind == "rest")


def test_write(spark, tmp_path):
    f = files(spark, '{"a": 1}\n{"a": 2}', '{"a":1}', "junk")
    packing.write(f, str(tmp_path))
    packed, places = spark.read.parquet(f"{tmp_path}/blocks"), spark.read.parquet(f"{tmp_path}/index")
    assert {r.file_id: r.content for r in packing.rebuild(packed, places).collect()} == {0: '{"a": 1}\n{"a": 2}', 1: '{"a":1}', 2: "junk"}


def test_deep(spark):
    deep = lambda n: '{"a":' + "[" * n + "]" * n + "}"
    assert surplus(spark, deep(600), deep(600), deep(3000), deep(10**6)) in ([(1, 0)],)


def test_empty_index(spark):
    none = spark.createDataFrame([], FILES)
    places = packing.index(none)
    assert places.count() == 0 and packing.blocks(none, places).count() == 0


def test_hot_record(spark):
    assert len(surplus(spark, *['{"a": 1}'] * 500)) == 499
