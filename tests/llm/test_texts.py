import pytest
from pyspark.sql import functions as F

from kerfspark.llm import encoding, mixing, truncation

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, pos int, word string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y", 2) for i, (t, s) in enumerate(rows)], DOCS)


TEXTS = [None, "", " ", "ok", "  two  spaces \n\n tabs\t\tend  ", "don't we'll I'VE", "naïve Größe 漢字かな 👍🏽 é", "<|endoftext|> a", "x" * 5000, "1234567890 ½ ٣٤٥ Ⅻ", "a b c　d​e﻿f\u0085g", "'s 'S ''", "\r\n\r\n x", "ﬁxture ſharp ＡＢＣ", "the the the the " * 500, "\x1c\x1d᠎ z", "a" * 200_000 + " b"]


def test_ids(spark):
    e = encoding.encoder(encoding.VOCABULARY)
    got = {r.doc_id: list(r.ids) for r in encoding.encode(docs(spark, [(t, "s") for t in TEXTS])).collect()}
    assert got == {i: e.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_ids_beyond_the_broadcast_words(spark, monkeypatch):
    monkeypatch.setattr(encoding, "FREQUENT", 2)
    test_ids(spark)


def test_round_trip(spark):
    encoded = encoding.encode(docs(spark, [(t, "s") for t in TEXTS]))
    assert {r.doc_id: r.text for r in encoding.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_no_texts(spark):
    odd = spark.createDataFrame([(None, "a quokka"), (None, "a b"), (3, "a b"), (3, "a b"), (None, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in encoding.encode(odd).collect())
    assert got == [(0, []), (0, [64, 275]), (0, [64, 627, 482, 4914]), (3, [64, 275]), (3, [64, 275])]
    assert sorted(r.text for r in encoding.decode(encoding.encode(odd)).collect()) == ["", "a b", "a b", "a b", "a quokka"]
    assert encoding.encode(docs(spark, [])).count() == 0
    assert [list(r.ids) for r in encoding.encode(docs(spark, [(None, None)])).collect()] == [[]]


TARGETS = "source string, target_share double, max_repeats bigint"


def test_fill():
    assert mixing.fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, 60) == {"a": 10, "b": 50}
    assert mixing.fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}, 100) == {"a": 10, "b": 20}
    assert mixing.fill({"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 5, "b": 30, "c": 1000}, 200) == pytest.approx({"a": 5, "b": 30, "c": 165})
    assert mixing.fill({"a": 0.0}, {"a": 5}, 10) == {"a": 0.0}


@pytest.fixture(scope="module")
def mix(spark):
    rows = [("some words of a text " * (1 + i % 5), "big") for i in range(600)] + [("few words here", "small")] * 40 + [(None, "small"), ("", "big"), ("not mixed", None), ("not mixed", "other")]
    return docs(spark, rows), spark.createDataFrame([("big", 0.7, 2), ("small", 0.3, 5), ("absent", 0.0, 3), (None, 0.5, 1)], TARGETS)


def test_shares(mix):
    got = {r.source: r for r in mixing.shares(*mix, total=mixing.EVEN).collect()}
    assert got["big"].reached_share == pytest.approx(0.7, abs=0.02) and got["small"].reached_share == pytest.approx(0.3, abs=0.02)
    assert got["absent"].mixed_tokens == 0 and set(got) == {"big", "small", "absent"}


def test_clamped(mix):
    """As many tokens as there are: the small source gives all its repeats, the big one the rest, more than its share."""
    got = {r.source: r for r in mixing.shares(*mix).collect()}
    small, big = got["small"], got["big"]
    assert small.clamped and small.mixed_tokens == 5 * small.available_tokens and small.most_copies == 5
    assert not big.clamped and big.reached_share > 0.7 and big.most_copies <= 2
    assert abs(big.mixed_tokens + small.mixed_tokens - big.available_tokens - small.available_tokens) <= 25
    letters = {r.source: r for r in mixing.shares(*mix, size=F.length("text")).collect()}
    assert letters["small"].available_tokens == 40 * len("few words here") and letters["small"].clamped


def test_caps_and_seeds(mix):
    a = {(r.doc_id, r.copies) for r in mixing.mixture(*mix).collect()}
    assert a == {(r.doc_id, r.copies) for r in mixing.mixture(*mix).collect()} != {(r.doc_id, r.copies) for r in mixing.mixture(*mix, seed=1).collect()}
    full = mixing.mixture(*mix, total=10**9).collect()
    assert {(r.source, r.copies) for r in full} == {("big", 2), ("small", 5)} and len(full) == 642


def test_mix_of_nothing(spark, mix):
    assert mixing.mixture(mix[0].limit(0), mix[1]).count() == 0 and mixing.mixture(mix[0], mix[1].limit(0)).count() == 0


SENTENCES = ["The left panel has been checked against the front edge.", "During the night shift the spindle ran at 9000 rpm.", "The outer contour needs a clearance of at least 12 mm!", "Groove 7 was drawn twice, so the operator stopped the run."]


def corpus(n=900):
    import random

    r = random.Random(3)
    rows, cut_at = [], {}
    for i in range(n):
        t = " ".join(r.choice(SENTENCES) for _ in range(r.randrange(2, 9)))
        if i % 9 == 0:
            t += r.choice(["\nShift 4 / AB", "\nShift 11 / CD", " Regards,\nAB"])
        if i % 10 == 3:
            end = t.find(" ", len(t) * 2 // 3)
            k = end - 2 if t[end - 3 : end].isalpha() else end + 3
            cut_at[i] = t = t[:k] + (" [...]" if i % 20 == 3 else "")
        rows.append((t, "notes"))
    return rows, set(cut_at)


def test_cuts(spark):
    rows, cuts = corpus()
    found = {r.doc_id for r in truncation.found(docs(spark, rows)).collect()}
    assert len(found & cuts) >= 0.9 * len(cuts) and len(found - cuts) <= 0.05 * len(cuts)


def test_limit(spark):
    rows, _ = corpus(400)
    rows = [(t, "notes") for t, _ in rows] + [(" ".join(SENTENCES * 2)[:k], "short") for k in (160,) * 40] + [(" ".join(SENTENCES[: 1 + k % 3]), "short") for k in range(60)]
    found = {r.doc_id for r in truncation.found(docs(spark, rows)).collect()}
    assert set(range(400, 440)) <= found and not set(range(440, 500)) & found


def test_open_markup(spark):
    rows = [("<p>Note " + "abcdefgh"[k % 8] * (k // 8 + 1) + ". " + " ".join(SENTENCES[: 1 + k % 4]) + ("" if k in (5, 9) else "</p>"), "web") for k in range(80)]
    assert {r.doc_id for r in truncation.found(docs(spark, rows)).collect()} == {5, 9}


def test_short_texts(spark):
    """A short text with a mark of a cut is one; short whole texts aren't."""
    rows, _ = corpus(400)
    short = ["Bore 7 [truncated]", "Bore 7 [...]", "ok", "12", "AB", "done."]
    d = docs(spark, [(t, "notes") for t in short] + [(t, "notes") for t, _ in rows])
    assert {r.doc_id for r in truncation.found(d).where("doc_id < 6").collect()} == {0, 1}


def test_odd_texts(spark):
    rows, _ = corpus(100)
    odd = [None, "", "  \n", "👍", "ok", "z" * 100_000, "…", "\u0000a\u0000bcdefghijk."]
    d = docs(spark, [(t, None) for t in odd] + rows)
    assert truncation.judged(d).where("doc_id < 5 and is_cut").count() == 0
    assert truncation.rates(d).count() == 2
    assert truncation.found(docs(spark, [])).count() == 0
