"""Many tiny files into few large blocks: indexed archive containers.

``index`` has a row for every line of every file: its file's path, its role, the block, offset and length of its bytes and
their checksum. Blocks of kind ``records`` hold each record once, the first by (file_id, line_no): a record is a line that
is complete JSON, and records with equal values (whatever the order of keys, spacing, escapes or spelling of numbers) are
equal. The other copies are surplus: their rows point at the kept record (``kept_file_id``, ``kept_line_no``) and, where
they are spelled as it is, at its very bytes. Bytes that are no record or spelled otherwise go to blocks of kind ``rest``,
so that nothing is lost: ``rebuild`` gives every file back byte for byte, ``unpack`` the records, ``fetch`` any single line
by one ranged read. Blocks are filled to about ``block_bytes`` each and can be read in parallel.

Roles: ``record``, ``surplus``, ``broken`` (holds something, but no complete JSON), ``blank``. A null content is a file
without lines, an empty one a file with one blank line. Records nested deeper than the JSON reader goes (some ten thousand
levels) are broken lines. Ties can't occur as (file_id, line_no) is unique; were a file_id repeated, its equal lines
would be equal records of which one stays. An empty table gives an empty index and no block. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerfspark.runtime import cut, lookup

PLACE = "file_id bigint, path string, line_no bigint, n_lines bigint, length bigint, crc32 bigint, record_hash binary, byte_hash binary, is_blank boolean"
BLOCK_BYTES, HELD_BYTES = 64 << 20, 16 << 20


def spelled(number) -> str:
    """One spelling of all equal numbers."""
    d = Decimal(number)
    if not d:
        return "0"
    sign, digits, exponent = d.as_tuple()
    bare = "".join(map(str, digits)).lstrip("0")
    short = bare.rstrip("0")
    return f"{'-' * sign}{short}e{exponent + len(bare) - len(short)}"


def canonical(value) -> str:
    """One spelling for all equal values, without recursion; strings, numbers, flags and null never mix."""
    out: list[str] = []
    work: list = [value]
    plain: list = [False]
    while work:
        value, is_text = work.pop(), plain.pop()
        if is_text:
            out.append(value)
        elif isinstance(value, dict):
            out.append("{")
            work.append("}")
            plain.append(True)
            for k in sorted(value, reverse=True):
                work += [",", value[k], f"{json.dumps(k)}:"]
                plain += [True, False, True]
        elif isinstance(value, list):
            out.append("[")
            work.append("]")
            plain.append(True)
            for v in reversed(value):
                work += [",", v]
                plain += [True, False]
        elif isinstance(value, (Decimal, int)) and not isinstance(value, bool):
            out.append(spelled(value))
        else:
            out.append(json.dumps(value))
    return "".join(out)


def record_hash(line: str) -> bytes | None:
    """Hash of the values of a line, or None if it isn't complete JSON."""

    def refuse(word):
        raise ValueError(word)

    try:
        value = json.loads(line, parse_float=Decimal, parse_int=Decimal, parse_constant=refuse)
        spelling = canonical(value)
    except (ValueError, RecursionError, ArithmeticError):
        return None
    return hashlib.blake2b(spelling.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def pieces(columns: str, row_of):
    """A function of batches of files that hands on a row a line, in pieces of bounded bytes."""
    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for file_id, path, content in zip(batch["file_id"], batch["path"], batch["content"]):
                lines = content.split("\n")
                for i, line in enumerate(lines):
                    rows.append(row_of(file_id, path, i, len(lines), line))
                    held += len(line) + 200
                    if held > HELD_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    return run


def place(file_id, path, i: int, n: int, line: str) -> tuple:
    raw = line.encode("utf-8")
    return file_id, path, i, n, len(raw), zlib.crc32(raw), record_hash(line.removeprefix("﻿")), hashlib.blake2b(raw, digest_size=16).digest(), not line.strip()


def content_of(files: DataFrame) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("folder", F.lit("")), F.coalesce("file_name", F.lit("")))
    return files.select("file_id", path.alias("path"), "content").where(F.col("content").isNotNull())


def index(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a line: file_id, path, line_no, n_lines, role, kept_file_id, kept_line_no, kind, block_id, offset, length, crc32.

    No bytes are shuffled for it. The first of equal records is found by an aggregation, and comes back to its copies by a
    join that stands a record written over and over; offsets are running sums within a block.
    """
    every = cut(content_of(files).mapInPandas(pieces(PLACE, place), PLACE))
    records = every.where(F.col("record_hash").isNotNull())
    first = F.min(F.struct("file_id", "line_no", "byte_hash")).alias("_first")
    firsts = cut(records.groupBy("record_hash").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = lookup(every, firsts.select("record_hash", "_first"), "record_hash", "file_id", counts=firsts.select("record_hash", "n"))
    kept = (F.col("_first").isNull()) | ((F.col("_first.file_id") == F.col("file_id")) & (F.col("_first.line_no") == F.col("line_no")))
    role = F.when(F.col("record_hash").isNotNull(), F.when(kept, "record").otherwise("surplus")).when(F.col("is_blank"), "blank").otherwise("broken")
    same = (role == "surplus") & (F.col("_first.byte_hash") == F.col("byte_hash"))
    judged = cut(met.select(*[c for c in every.columns if c not in ("record_hash", "byte_hash", "is_blank")], role.alias("role"), F.when(role == "surplus", F.col("_first.file_id")).alias("kept_file_id"), F.when(role == "surplus", F.col("_first.line_no")).alias("kept_line_no"), same.alias("_same")))
    stored = judged.where((F.col("length") > 0) & ~F.col("_same")).select("file_id", "line_no", "length", F.when(F.col("role") == "record", "records").otherwise("rest").alias("kind"))
    sizes = {r["kind"]: r["b"] for r in stored.groupBy("kind").agg(F.sum("length").alias("b")).collect()}
    n = F.when(F.col("kind") == "records", max(1, -(-sizes.get("records", 0) // block_bytes))).otherwise(max(1, -(-sizes.get("rest", 0) // block_bytes)))
    dealt = stored.withColumn("block_id", F.pmod(F.xxhash64("file_id"), n))
    before = Window.partitionBy("kind", "block_id").orderBy("file_id", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = cut(dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("length"))
    own = judged.join(at, ["file_id", "line_no"], "left")
    # surplus lines spelled as the kept record have its bytes
    there = at.select(F.col("file_id").alias("kept_file_id"), F.col("line_no").alias("kept_line_no"), F.col("kind").alias("_k"), F.col("block_id").alias("_b"), F.col("offset").alias("_o"))
    copies = judged.where("_same").groupBy("kept_file_id", "kept_line_no").agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws(":", "kept_file_id", "kept_line_no").alias("_key")
    there = there.join(copies, ["kept_file_id", "kept_line_no"]).select(key, "_k", "_b", "_o", "n")
    shared = lookup(own.where("_same").withColumn("_key", key), there.drop("n"), "_key", "file_id", counts=there.select("_key", "n"))
    lone = own.where(~F.col("_same")).select("*", F.lit(None).cast("string").alias("_k"), F.lit(None).cast("bigint").alias("_b"), F.lit(None).cast("bigint").alias("_o"))
    both = lone.unionByName(shared.drop("_key"))
    return both.select("file_id", "path", "line_no", "n_lines", "role", "kept_file_id", "kept_line_no", F.coalesce("kind", "_k").alias("kind"), F.coalesce("block_id", "_b").alias("block_id"), F.coalesce("offset", "_o").alias("offset"), "length", "crc32")


def surplus_records(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of the records left out, from the index of the containers."""
    return index(files).where("role = 'surplus'").select("file_id", "line_no")


def broken_lines(files: DataFrame) -> DataFrame:
    """Lines that hold something but no complete record, and where their bytes are."""
    return index(files).where("role = 'broken'").select("file_id", "line_no", "length", "crc32", "kind", "block_id", "offset")


def blocks(files: DataFrame, places: DataFrame) -> DataFrame:
    """(kind, block_id, records, bytes, crc32, data): the containers of an ``index``, each put together in one task from its lines' bytes."""
    line = "file_id bigint, line_no bigint, bytes binary"
    raw = content_of(files).mapInPandas(pieces(line, lambda file_id, path, i, n, text: (file_id, i, text.encode("utf-8"))), line)
    own = places.where("kind is not null and (role <> 'surplus' or kind = 'rest')").select("file_id", "line_no", "kind", "block_id", "offset")

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(batch.sort_values("offset")["bytes"])
        return pd.DataFrame([(batch["kind"].iloc[0], int(batch["block_id"].iloc[0]), len(batch), len(data), zlib.crc32(data), data)], columns=["kind", "block_id", "records", "bytes", "crc32", "data"])

    return raw.join(own, ["file_id", "line_no"]).groupBy("kind", "block_id").applyInPandas(pack, "kind string, block_id bigint, records bigint, bytes bigint, crc32 bigint, data binary")


def write(files: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> None:
    """The containers and their index as tables under a folder: a file a block."""
    places = cut(index(files, block_bytes))
    packed = blocks(files, places)
    packed.write.mode("errorifexists").partitionBy("kind").parquet(f"{folder}/blocks")
    places.write.mode("errorifexists").parquet(f"{folder}/index")


def fetch(packed: DataFrame, places: DataFrame) -> DataFrame:
    """(file_id, path, line_no, n_lines, role, line, intact): ranged reads of the index's rows, with the checksum looked at again."""
    raw = F.when(F.col("length") == 0, F.lit(b"")).otherwise(F.expr("substring(data, cast(offset as int) + 1, cast(length as int))"))
    met = places.join(packed.select("kind", "block_id", "data"), ["kind", "block_id"], "left")
    return met.select("file_id", "path", "line_no", "n_lines", "role", raw.alias("line"), (F.crc32(raw) == F.col("crc32")).alias("intact"))


def unpack(packed: DataFrame, places: DataFrame) -> DataFrame:
    """Each record once."""
    return fetch(packed, places.where("role = 'record'")).select("file_id", "path", "line_no", F.col("line").cast("string").alias("record"), "intact")


def rebuild(packed: DataFrame, places: DataFrame) -> DataFrame:
    """(file_id, path, content, intact): every file with content, byte for byte. A file's lines meet in one row, as they did in the file."""
    each = fetch(packed, places)
    by = each.groupBy("file_id").agg(F.first("path").alias("path"), F.sort_array(F.collect_list(F.struct("line_no", F.col("line").cast("string").alias("t")))).alias("_l"), F.min("intact").alias("intact"), F.first("n_lines").alias("_n"))
    return by.select("file_id", "path", F.array_join(F.col("_l")["t"], "\n").alias("content"), (F.col("intact") & (F.size("_l") == F.col("_n"))).alias("intact"))
