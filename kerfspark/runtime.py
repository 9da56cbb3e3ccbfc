"""Session helpers shared by all operators: tables, lineage cuts and joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key may have so many rows, or this part of all rows if that is more, in one task; what has more is hot and dealt into parts.
#: As the parts of hot keys have so many rows each, there are at most HOT_PARTS hot keys and twice as many parts.
HOT_ROWS, HOT_PARTS = 500_000, 65_536
#: Parts among which rows without key are dealt.
NULL_PARTS = 256

_local: str | None = None


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` or the folder given to ``setCheckpointDir``; a temporary folder only on one machine.

    A cluster without either is an error: its executors would each write to a disk of their own.
    """
    global _local
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        given = sc._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="kerfspark-")
    return f"file://{_local}"


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from that table: no lineage, and sizes that Spark knows.

    A plain checkpoint would keep the size estimates of the plan before it, which multiply join by join in a loop. The
    table goes when the session's process ends, or with ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kerfspark-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    fs, where = _filesystem(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path, out._cut_rows = path, seen.get.get("n")
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete cut tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            fs, where = _filesystem(df.sparkSession, path)
            fs.delete(where, True)


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """(key, _parts) of the hot keys, or None if there is none; at most HOT_PARTS rows, whatever the data."""
    spark = counts.sparkSession
    known = counts.where(F.col(key).isNotNull())
    size = known.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    most_rows = max(HOT_ROWS, (size["all"] or 0) // HOT_PARTS)
    if (size["most"] or 0) <= most_rows:
        return None
    rows = known.where(F.col(n) > most_rows).select(key, F.ceil(F.col(n) / most_rows).cast("int").alias("_parts"))
    return spark.createDataFrame(rows.collect(), rows.schema)


def deal(rows: DataFrame, hot: DataFrame | None, key: str, spread: str | Column) -> DataFrame:
    """Adds ``_part``: for rows of a hot key, and those without key, a part by the hash of ``spread``; 0 for all others."""
    by = F.xxhash64(spread)
    if hot is None:
        return rows.withColumn("_part", F.when(F.col(key).isNull(), F.pmod(by, F.lit(NULL_PARTS)).cast("int")).otherwise(0))
    part = F.when(F.col(key).isNull(), F.pmod(by, F.lit(NULL_PARTS))).otherwise(F.coalesce(F.pmod(by, F.col("_parts")), F.lit(0)))
    return rows.join(F.broadcast(hot), key, "left").withColumn("_part", part.cast("int")).drop("_parts")


def copy_to_parts(rows: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """Adds ``_part``: every part of a hot key gets a copy of its rows."""
    if hot is None:
        return rows.withColumn("_part", F.lit(0))
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(parts)).drop("_parts")


def lookup(rows: DataFrame, index: DataFrame, key: str, spread: str, counts: DataFrame | None = None, how: str = "left", at_most: int | None = None) -> DataFrame:
    """Join of ``rows`` with the few ``index`` rows of their key, where one key may hold a third of the rows.

    Rows of a hot key, and rows without key, are dealt into parts by ``spread``; of a hot key's entries every part has a
    copy. ``counts`` (key, n) spares a counting pass where the caller has it, and there is none where ``rows`` is known
    to be too short for hot keys: a cut table, or of ``at_most`` so many rows.
    """
    known, hot = getattr(rows, "_cut_rows", at_most), None
    if known is None or known > HOT_ROWS:
        hot = hot_keys(counts if counts is not None else rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n")
    names = [c for c in index.columns if c != key]
    return deal(rows, hot, key, spread).join(copy_to_parts(index, hot, key), [key, "_part"], how).select(*rows.columns, *names)
