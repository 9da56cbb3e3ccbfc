"""Mixing sources to target shares of the tokens, with a cap on repeats.

Capped water-filling: with a total to reach, every source wants its share; a source that can't give that even at its
most repeats is clamped to what it has, and its want is dealt to the others in proportion, until nothing changes. Without
a given total, as many tokens are asked for as the mixed sources have; ``EVEN`` asks for the largest total at which nothing
is clamped, which may be a small part of the data. Each source's epochs are then whole passes over its documents plus a seeded
fraction: in an order shuffled by the seed, documents are taken once more as long as the middle of each still lies within
the fraction's tokens. What is reached is within half a document of what was wanted.

Sources are compared as written; a source without target, and null sources, aren't mixed; a source without documents or
tokens reaches 0 and is clamped. Null and empty texts have no tokens and come along in whole passes. Shares that don't
sum to 1 are scaled. A target row that comes twice counts once. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.llm.encoding import VOCABULARY, token_counts
from kerfspark.llm.ranks import running_total
from kerfspark.runtime import cut

EVEN = -1


def fill(share: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """Tokens to take of each source."""
    out: dict[str, float] = {}
    free = {s for s in share if share[s] > 0}
    left = min(total, sum(most[s] for s in free))
    out.update({s: 0.0 for s in share})
    while free:
        weight = sum(share[s] for s in free)
        full = {s for s in free if most[s] <= left * share[s] / weight}
        if not full:
            out.update({s: left * share[s] / weight for s in free})
            break
        out.update({s: most[s] for s in full})
        left -= sum(most[s] for s in full)
        free -= full
    return out


def counted(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents of mixed sources; ``size`` measures a text by a column in place of tokens."""
    mixed = documents.select("doc_id", "source", "text").join(F.broadcast(settings(targets).select("source")), "source", "left_semi")
    return cut(token_counts(mixed, path) if size is None else mixed.select("doc_id", "source", F.coalesce(size, F.lit(0)).cast("bigint").alias("tokens")))


def settings(targets: DataFrame) -> DataFrame:
    """One row a source."""
    known = targets.where(F.col("source").isNotNull()).groupBy("source")
    return known.agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))


def plan(tokens: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, wanted_tokens, clamped, passes, fraction), a row a source of the targets.

    One row a source of the targets goes to the driver, a table of settings.
    """
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("n"))
    known = settings(targets).join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n", F.lit(0)).alias("n")).collect()
    share = {r["source"]: r["target_share"] for r in known}
    most = {r["source"]: float(r["n"] * r["max_repeats"]) for r in known}
    if total is None:
        total = sum(r["n"] for r in known)
    elif total == EVEN:
        given = sum(w for s, w in share.items() if most[s])
        total = min((most[s] / w * given for s, w in share.items() if w > 0 and most[s]), default=0.0)
    goal = fill(share, most, total)
    rows = []
    for r in known:
        s, n, cap = r["source"], r["n"], r["max_repeats"]
        passes = min(int(goal[s] // n), cap) if n else 0
        rows.append((s, share[s], cap, n, goal[s], share[s] > 0 and goal[s] >= most[s], passes, goal[s] - passes * n if passes < cap else 0.0))
    return tokens.sparkSession.createDataFrame(rows, PLAN)


PLAN = "source string, target_share double, max_repeats bigint, available_tokens bigint, wanted_tokens double, clamped boolean, passes bigint, fraction double"


def drawn(tokens: DataFrame, steps: DataFrame, seed: int) -> DataFrame:
    placed = running_total(tokens, "source", "doc_id", F.col("tokens"), seed, "_before").join(F.broadcast(steps), "source")
    more = (F.col("tokens") > 0) & (F.col("_before") + F.col("tokens") / 2 <= F.col("fraction")) & (F.col("passes") < F.col("max_repeats"))
    return placed.select("doc_id", "source", "tokens", (F.col("passes") + more.cast("bigint")).alias("copies")).where("copies > 0")


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, path: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document that is used."""
    tokens = counted(documents, targets, path, size)
    return drawn(tokens, plan(tokens, targets, total), seed)


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, path: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """What each source of the targets has, was to give and has given, and whether it was clamped to what it has."""
    tokens = counted(documents, targets, path, size)
    steps = plan(tokens, targets, total)
    used = cut(drawn(tokens, steps, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")))
    whole = F.broadcast(used.agg(F.sum("mixed_tokens").alias("_all")))
    out = steps.join(used, "source", "left").join(whole)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "most_copies", "mixed_tokens")]
    return out.select("source", "target_share", "max_repeats", "available_tokens", "wanted_tokens", "clamped", *counts, F.coalesce(F.col("mixed_tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"))
