"""Texts that stop before their end, by a backward character n-gram model.

For the last characters of a text (contexts of several lengths, with letters of codes and digits folded) the model knows
from all texts how often that context occurs and how often a text, line or sentence could end right there. A text cut
at a random place has a context that occurs anywhere; a whole text one that stands before ends. Ends of texts count by
their chance to be no cut, estimated over a few rounds, and never for the text itself. The log-odds of the two is compared with a threshold per source, language and whether the text
has exactly the length of a field limit of its source (a length at which far more texts end than at lengths around it).
The thresholds come from the shares of cut texts, found by expectation maximisation over the log-odds of all texts. A mark
that was added at a cut and white space are taken off before the context is read; an unambiguous mark, and markup or JSON
that is opened at the start and not closed at the end, count in favour of a cut.

Only contexts that some text ends in are counted: their hashes are set in a bit field of bounded size that the counting
tasks hold, and what passes it by chance finds no partner in the join. A text shorter than the longest context is judged
by the contexts it has, its beginning being part of them; it needs more evidence, as such short cuts are rare, and other
texts of the very same words speak for a whole one.

Null, empty and blank texts, and rows without doc_id, are never cut. Repeated texts train the model once (short ones without a mark each time) and are each judged. Null sources and
languages form groups of their own; languages are compared by their first two letters. Very long texts are read whole. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from kerfspark.runtime import cut, forget, lookup

#: Lengths of contexts; characters that are counted at a time, and hashed at a time (what the processor's cache holds).
ORDERS, CHUNK, BLOCK = (1, 2, 3, 4, 6, 9), 2_000_000, 1 << 15
#: Weight of the shorter context in the estimate of the next longer one.
BACKOFF = 2.0
#: Log-odds of an unambiguous mark, of unclosed markup, and of a mark that authors also write themselves.
MARK, OPEN, DOTS = 8.0, 8.0, 1.0
#: Log-odds against a cut that leaves less than the longest context: a limit or a broken transfer seldom leaves so little.
SHORT = 8.0
#: A field limit: so many texts of a source at one length, so many times the mean number around it (within so many lengths), and so large a share of the source.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_AROUND, LIMIT_SHARE = 5, 8.0, 12, 0.004
#: Share of cut texts to begin with, at a limit and elsewhere; weight in texts of the shares of the larger group; rounds.
FIRST, SMOOTH, ROUNDS = (0.5, 0.03), 20.0, 3
#: Bits of the field of contexts asked for: so many a context, at most so many, which bounds it at 32 MB.
FIELD_BITS, MOST_BITS = 16, 1 << 28
#: Bounds of the shares: even at a limit, a text may be whole.
LEAST, MOST = 0.0005, 0.95

# Marks added at a cut, ends of sentences, characters that may follow them.
MARKS = r"(?:\[\s*(?:\.\.\.|…|truncated|cut|more|gekürzt|abgeschnitten|tronqué|cortado)\s*\]|\((?:\.\.\.|…|truncated|cut|more)\)|<(?:truncated|cut|snip)>|�+|(?i:\bread more)|\[\+\d+ (?:chars|more)\])"
MARK_ENDS = "])>�eE"
WHITE = r"[\s\x{85}\p{Z}\x{feff}]"
WHITES = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
STOPS = ".!?。！？"
CLOSERS = ")]\"'”’»<"
SPACES = " \t\n\r  　"


def fold(text: np.ndarray) -> np.ndarray:
    """Code points with capital letters as A, digits as 0."""
    out = text.copy()
    out[(text >= 65) & (text <= 90)] = 65
    out[(text >= 48) & (text <= 57)] = 48
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@lru_cache
def among(characters: str) -> np.ndarray:
    """A table that tells of each code point whether it is one of these."""
    out = np.zeros(0x110000, dtype=bool)
    out[codes(characters)] = True
    return out


def _mix(x: np.ndarray, order: int) -> np.ndarray:
    x = x ^ np.uint64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def contexts(folded: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the context that ends at each place; the sequence begins with enough zeros."""
    base, out = np.uint64(0x100000001B3), []
    folded = folded.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(folded), dtype=np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            h[n - 1 :] += folded[: len(folded) - n + 1] * power
            h[: n - 1] += power
            power = power * base
            if n in ORDERS:
                out.append(_mix(h, n))
    return out


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts one after another (runs of digits as one, zeros between texts), and whether an end could follow each place.

    A text's own end is no such place: it counts apart, by how likely it is no cut.
    """
    gap = "\0" * max(ORDERS)
    raw = codes(gap + gap.join(texts) + gap)
    f = fold(raw)
    after, later = np.append(raw[1:], 0), np.append(raw[2:], [0, 0])
    stop = among(STOPS)[raw]
    space, closer = among(SPACES)[after], among(CLOSERS)[after]
    ends_here = (stop | (among(CLOSERS)[raw] & np.append(False, stop[:-1]))) & (space | closer)
    stop_next = among(STOPS)[after] & among(SPACES + CLOSERS + "\0")[later] & ~stop
    wide_stop = among("。！？")[raw] | among("。！？")[after]
    end = (among("\n\r")[after] | ends_here | stop_next | wide_stop) & (after != 0)
    keep = ~((f == 48) & (np.append(f[1:], 0) == 48))
    return f[keep], end[keep]


def bit_field(asked: DataFrame, about: int):
    """(bits, field): one bit a hash of ``asked.context``; OR-ed together in tasks, so that only set bytes of one field reach the driver."""
    size = 1 << min(max(about * FIELD_BITS, 1 << 16).bit_length(), MOST_BITS.bit_length() - 1)
    bit = F.col("context").bitwiseAND(F.lit(size - 1))
    words = asked.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(context & 63L as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(size >> 6, dtype=np.uint64)
    field[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return size, field


def counter(size: int, shared):
    """A function of batches of bodies that gives (context, n, ends) of chunks of texts, for contexts in the bit field."""

    def chunk(texts: list[str]) -> Iterator[pd.DataFrame]:
        f, e = places(texts)
        field, reach = shared.value, max(ORDERS) - 1
        every, final = [], []
        for start in range(0, len(f), BLOCK):
            before = min(start, reach)
            real, ends = f[start : start + BLOCK] != 0, e[start : start + BLOCK]
            for h in contexts(f[start - before : start + BLOCK]):
                h = h[before:]
                bit = h & np.int64(size - 1)
                hit = real & ((field[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0)
                every.append(h[hit])
                final.append(h[hit & ends])
        keys, n = np.unique(np.concatenate(every), return_counts=True)
        ended, times = np.unique(np.concatenate(final), return_counts=True)
        ends = np.zeros(len(keys), dtype="int64")
        ends[np.searchsorted(keys, ended)] = times
        yield pd.DataFrame({"context": keys, "n": n, "ends": ends})

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        size_held = 0
        for batch in batches:
            for text in batch["body"]:
                if text:
                    held.append(text)
                    size_held += len(text)
                    if size_held >= CHUNK:
                        yield from chunk(held)
                        held, size_held = [], 0
        if held:
            yield from chunk(held)

    return counts


@F.pandas_udf(ArrayType(LongType()))
def last_contexts(bodies: pd.Series) -> pd.Series:
    """The contexts, by order, at the end of each text."""
    most = max(ORDERS)
    gap = np.zeros(most, dtype="<u4")
    ends, known = [], []
    for text in bodies:
        text = text or ""
        for reach in (64, len(text)):
            f = fold(codes(text[-reach:])) if text else gap[:0]
            f = f[~((f == 48) & (np.append(f[1:], 0) == 48))]
            if reach >= len(text) or len(f) >= most:
                break
        known.append(len(f) > 0)
        if len(f):
            ends.append(f[-most:] if len(f) >= most else np.concatenate([gap, f])[-most:])
    if not ends:
        return pd.Series([[] for _ in known])
    # no context reaches beyond its text's last characters, so all are hashed as one sequence
    rows = iter(np.stack([h[most - 1 :: most] for h in contexts(np.concatenate(ends))], axis=1).tolist())
    return pd.Series([next(rows) if k else [] for k in known])


def bodies(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, body (text without white space and marks at its end), extra (log-odds of marks and markup), chars and bytes."""
    last = lambda c: F.right(c, F.lit(1))
    trimmed = lambda c: F.rtrim(c, F.lit(WHITES))
    text = trimmed(F.col("text"))
    # a pattern is tried only on texts that end in a character in which its matches end
    bare = F.when(last(text).isin(list(MARK_ENDS)), F.regexp_replace(text, f"(?:{WHITE}*{MARKS})+$", "")).otherwise(text)
    dots = F.when(last(bare).isin(".", "…"), F.regexp_replace(bare, WHITE + r"*(?:\.{3,}|…)$", "")).otherwise(bare)
    marked = F.when(F.length(bare) < F.length(text), MARK).otherwise(0.0)
    dotted = F.when(F.length(dots) < F.length(bare), DOTS).otherwise(0.0)
    start, end = F.substring(F.ltrim("text", F.lit(WHITES)), 1, 2), last(text)
    opened = (start.rlike(r"^\{") & (end != "}")) | (start.rlike(r"^<[a-z]") & (end != ">"))
    body = trimmed(dots)
    d = documents.select("doc_id", "source", F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang"), "text", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    d = d.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length(text) > 0))
    return d.select("doc_id", "source", "lang", "chars", "bytes", body.alias("body"), (marked + dotted + F.when(opened, OPEN).otherwise(0.0) - F.when(F.length(body) < max(ORDERS), SHORT).otherwise(0.0)).alias("extra"))


def limits(b: DataFrame) -> DataFrame:
    """(source, unit, length) of the field limits of distinct texts. One row a source and length goes through the window."""
    by = b.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("_l")).select("source", "_l.*").groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    whole = Window.partitionBy("source", "unit")
    around = (F.sum("n").over(near) - F.col("n")) / (2 * LIMIT_AROUND)
    l = by.withColumns({"_around": around, "_all": F.sum("n").over(whole)})
    return l.where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.col("_around")) & (F.col("n") >= LIMIT_SHARE * F.col("_all"))).select("source", "unit", "length")


def log_odds(levels: DataFrame, whole: DataFrame, base: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, log_odds), and the written table behind it: ``levels`` has each text's contexts with n and inner ends, ``whole`` each text's chance to be no cut."""
    w = levels.join(whole, "doc_id")
    finals = cut(w.where("trains").groupBy("context").agg(F.sum("whole").alias("finals"), F.count(F.lit(1)).alias("_texts")))
    met = lookup(w, finals.drop("_texts"), "context", "doc_id", counts=finals.select("context", F.col("_texts").alias("n"))).withColumn("_others", F.col("ends") + F.greatest(F.col("finals") - F.col("whole"), F.lit(0.0)))
    steps = met.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("order", "n", "_others"))).alias("_steps"))
    chance = F.aggregate("_steps", F.lit(base), lambda p, x: (x["_others"] + BACKOFF * p) / (F.greatest(x["n"] - 1, F.lit(0)) + BACKOFF))
    return steps.select("doc_id", (F.log(F.lit(base)) - F.log(F.least(F.greatest(chance, F.lit(1e-9)), F.lit(1.0)))).alias("log_odds")), finals


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, at_limit, log_odds of a cut before any prior, cut_chance and is_cut."""
    b = cut(bodies(documents))
    spark = documents.sparkSession
    first = b.groupBy(F.md5("body").alias("_m")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("trains"))
    asked = b.select("doc_id", ((F.length("body") < max(ORDERS)) & (F.col("extra") < 0)).alias("_short"), F.posexplode(last_contexts("body")).alias("order", "context")).join(first, "doc_id", "left").withColumn("trains", F.coalesce("trains", F.lit(False)) | F.col("_short")).drop("_short")
    # half of all texts may end in one character: the contexts of one place are hot keys
    asked = cut(asked)
    each = asked.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    size, field = bit_field(asked.select("context"), asked._cut_rows)
    count = counter(size, spark.sparkContext.broadcast(field))
    model = b.select("body").distinct().mapInPandas(count, "context bigint, n bigint, ends bigint").groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    levels = cut(lookup(asked, model, "context", "doc_id", counts=each))
    forget(asked)
    # the rate of ends at large, as the contexts of one character have it
    rate = levels.where("order = 0").groupBy("context").agg(F.first("n").alias("n"), F.first("ends").alias("ends"), F.sum(F.col("trains").cast("bigint")).alias("f")).agg(((F.sum("ends") + F.sum("f")) / F.sum("n")).alias("r")).first()["r"]
    base = min(max(rate or 0.01, 1e-6), 0.5)

    l = limits(b.join(first, "doc_id", "left_semi"))
    at = l.groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("_c"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("_b")).withColumnRenamed("source", "_s")
    at = cut(at)  # Spark then knows its size, and whether to broadcast it
    on = F.coalesce(F.array_contains("_c", F.col("chars")), F.lit(False)) | F.coalesce(F.exists("_b", lambda x: (F.col("bytes") <= x) & (F.col("bytes") > x - 4)), F.lit(False))
    facts = cut(b.join(at, F.col("source").eqNullSafe(F.col("_s")), "left").select("doc_id", "source", "lang", on.alias("at_limit"), "extra"))

    odds = lambda p: F.log(p / (1 - p))
    clamp = lambda x, a, z: F.least(F.greatest(x, F.lit(a)), F.lit(z))
    now = facts.withColumn("_share", F.when(F.col("at_limit"), FIRST[0]).otherwise(FIRST[1])).withColumn("cut_chance", F.col("_share"))
    for _ in range(ROUNDS):
        fresh, finals = log_odds(levels, now.select("doc_id", (1 - F.col("cut_chance")).alias("whole")), base)
        scored = now.drop("cut_chance", "log_odds").join(fresh, "doc_id", "left").withColumn("log_odds", F.coalesce("log_odds", F.lit(0.0)) + F.col("extra"))
        p = 1 / (1 + F.exp(-clamp(F.col("log_odds") + odds(F.col("_share")), -50.0, 50.0)))
        scored = cut(scored.withColumn("_p", p))
        fine = scored.groupBy(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("at_limit").alias("_a")).agg(F.sum("_p").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        broad = fine.groupBy("_s", "_a").agg(((F.sum("_sum") + 0.2) / (F.sum("_n") + 2)).alias("_whole")).select(F.col("_s").alias("_s2"), F.col("_a").alias("_a2"), "_whole")
        share = clamp((F.col("_sum") + SMOOTH * F.col("_whole")) / (F.col("_n") + SMOOTH), LEAST, MOST)
        shares = fine.join(broad, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_a") == F.col("_a2"))).select("_s", "_l", "_a", share.alias("_new"))
        shares = cut(shares)
        met = scored.join(shares, scored["source"].eqNullSafe(F.col("_s")) & scored["lang"].eqNullSafe(F.col("_l")) & (scored["at_limit"] == F.col("_a")))
        p = 1 / (1 + F.exp(-clamp(F.col("log_odds") + odds(F.col("_new")), -50.0, 50.0)))
        last = now
        now = cut(met.select("doc_id", "source", "lang", "at_limit", "extra", "log_odds", p.alias("cut_chance"), F.col("_new").alias("_share")))
        forget(scored, shares, last, finals)
    forget(levels)
    return now.select("doc_id", "source", "lang", "at_limit", "log_odds", "cut_chance", (F.col("cut_chance") > 0.5).alias("is_cut"))


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).where("is_cut").select("doc_id")


def rates(documents: DataFrame) -> DataFrame:
    """Texts, cut texts and their share by source (all texts of a source count, empty ones too)."""
    flagged = judged(documents).where("is_cut").select("doc_id", F.lit(1).alias("_cut"))
    met = documents.select("doc_id", "source").join(flagged, "doc_id", "left")
    by = met.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count("_cut").alias("cut_texts"))
    return by.withColumn("rate", F.col("cut_texts") / F.col("texts"))
