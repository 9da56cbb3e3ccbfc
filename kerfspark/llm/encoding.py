"""Ids of every text in a public byte-level vocabulary, by a table of distinct words.

Texts are split in Spark by the vocabulary's own word pattern into a written table; each distinct word is encoded once; the ids come back to their places by a join. Words with at least 1/FREQUENT of all places (so at most FREQUENT words,
of at most LONGEST characters: a bounded table) are broadcast, which serves nearly all places without a shuffle; the rest
meet the word table in a shuffled join, whose frequent words are dealt into parts.

Null and empty texts have an empty list. Texts of any length are encoded whole. Special tokens' names in a text are
ordinary text. Every row is a text of its own: rows with a null or a repeated doc_id come out once each, with that doc_id.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.runtime import cut, lookup

VOCABULARY = os.environ.get("KERFSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
FREQUENT, LONGEST = 65536, 64
# The word pattern of the vocabulary, with Unicode's white space spelled out for Java.
SPACE = r"\t-\r\x{85}\p{Z}"
WORD = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("kerfspark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(documents: DataFrame) -> DataFrame:
    """(_row, doc_id, text, words): a written table, so that a row's number stays what it is when a task runs again."""
    return cut(documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text", words().alias("words")))


def words() -> Column:
    return F.regexp_extract_all("text", F.lit(WORD), F.lit(0))


def word_table(places: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(word, n, ids) of each distinct word."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            b["ids"] = [e.encode_ordinary(w) for w in b["word"]]
            yield b

    return places.groupBy("word").agg(F.count(F.lit(1)).alias("n")).mapInPandas(encode, "word string, n bigint, ids array<int>")


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids)

    The texts are dealt by row once (whole: they are a third of the size of their words); the frequent words' ids then come to their places and back into their text
    without another shuffle, and only the places of the rest are shuffled.
    """
    texts = split(documents)
    distinct = cut(word_table(texts.select(F.explode("words").alias("word")), path))
    total = F.broadcast(distinct.agg(F.sum("n").alias("_total")))
    common = cut(distinct.join(total, F.col("n") * FREQUENT >= F.col("_total")).where(F.length("word") <= LONGEST).select("word", "ids"))
    frequent = F.broadcast(common)
    spots = texts.select("_row", "doc_id", "text").repartition("_row").select("_row", "doc_id", F.posexplode_outer(words()).alias("pos", "word"))
    near = spots.join(frequent, "word", "left").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids"))).alias("_near"))
    rare = cut(distinct.join(F.broadcast(common.select("word")), "word", "left_anti"))
    missed = texts.select("_row", F.posexplode("words").alias("pos", "word")).join(F.broadcast(common.select("word")), "word", "left_anti")
    far = lookup(missed, rare.select("word", "ids"), "word", "_row", counts=rare.select("word", "n")).groupBy("_row").agg(F.collect_list(F.struct("pos", "ids")).alias("_far"))
    every = F.sort_array(F.when(F.col("_far").isNull(), F.col("_near")).otherwise(F.concat("_near", "_far")))
    return near.join(far, "_row", "left").select("doc_id", F.flatten(every["ids"]).alias("ids"))


def pieces(path: str = VOCABULARY) -> list[tuple[int, bytes]]:
    with open(path, "rb") as lines:
        return [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines)]


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text), a row for each row, by a join with the id-to-piece table (as many rows as the vocabulary has ids)."""
    spark = encoded.sparkSession
    table = F.broadcast(spark.createDataFrame(pieces(path), "id int, piece binary"))
    rows = cut(encoded.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "ids"))
    each = rows.repartition("_row").select("_row", "doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(table, "id", "left")
    joined = each.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", F.hex("piece").alias("h"))))).alias("_p"))
    return joined.select("doc_id", F.decode(F.unhex(F.concat_ws("", F.col("_p")["h"])), "UTF-8").alias("text"))


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The documents' other columns with ``tokens`` for ``text``; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for t in texts:
            yield pd.Series([len(e.encode_ordinary(x)) if x else 0 for x in t], dtype="int64")

    return documents.select(*[c for c in documents.columns if c != "text"], size("text").alias("tokens"))
