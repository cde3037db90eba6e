"""Toxicity: the lattice decoder against brute force, the counts, held-out accuracy, odd rows."""

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulant.llm import toxicity as tx
from tabulant.llm.queries import QUERIES, toxicity_model

from .conftest import frame, words


def tiny_model():
    text = "you idiot stupid person this is a clown and a loser with trash " * 20
    counts = np.zeros((tx.SYMBOLS,) * 3)
    s = [0, 0, *[tx.symbol(c) for c in text], 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        counts[a, b, c] += 1
    return tx.language_model(counts)


def brute_decode(stretch, logp):
    best = None
    for choice in product(*tx.lattice(stretch)):
        s = [0, 0, *[tx.symbol(p) for p, _ in choice if p], 0]
        score = sum(float(logp[a, b, c]) for a, b, c in zip(s, s[1:], s[2:])) - sum(c for _, c in choice)
        if best is None or score > best[0]:
            best = (score, "".join(p for p, _ in choice))
    return best


def score_of(text, stretch, logp):
    """The best score among ways through the lattice that spell ``text``."""
    return max((sum(float(logp[a, b, c]) for a, b, c in zip(s, s[1:], s[2:])) - cost) for s, cost in (
        ([0, 0, *[tx.symbol(p) for p, _ in ch if p], 0], sum(c for _, c in ch)) for ch in product(*tx.lattice(stretch))
        if "".join(p for p, _ in ch) == text))


@pytest.mark.parametrize("stretch", ["1d10t", "i d i o t", "cl0wn", "l0sssser", "tr4sh", "$tup1d", "a.b.c", "i*iot"])
def test_viterbi_is_the_best_path(stretch):
    logp = tiny_model()
    assert score_of(tx.decode(stretch, logp), stretch, logp) == pytest.approx(brute_decode(stretch, logp)[0], abs=1e-4)


def test_disguises_are_undone():
    logp = tiny_model()
    for token, word in [("1d10t!", "idiot"), ("i.d.i.o.t", "idiot"), ("IDIOOOOOOT", "idiot"), ("$tup1d", "stupid"), ("l0s3r,", "loser"),
                        ("(cl0wn)", "clown"), ("person", "person"), ("7", "7")]:
        assert tx.restore_token(token, logp) == [word], token
    assert "idiot" in tx.Words(logp).of_text("you I D I O T there")
    assert tx.Words(logp).of_text(None) == tx.Words(logp).of_text("  \n") == set()
    assert tx.restore_token("id.io.t", logp) == ["idiot"] and tx.restore_token("st_up-id", logp) == ["stupid"]
    assert tx.restore_token("12.03.24", logp) == ["12.03.24"] and tx.restore_token("well-known", logp) == ["well-known"]


def test_long_disguises_are_undone():
    """Texts of several hundred letters, spelt in three ways, with the toxic word over letter 64."""
    logp = tiny_model()
    clean = "this is a person and this is a person with a person and a person with a person and a person".split()
    before, n = [], 0
    while n + len(clean[len(before)]) <= 62:
        n += len(clean[len(before)])
        before.append(clean[len(before)])
    text = [*before, "idiot", *clean * 4]
    letters = "".join(text)
    assert 59 < letters.index("idiot") < 64 and len(letters) > 300
    assert "idiot" in tx.restore_token(".".join(letters), logp)
    assert "idiot" in tx.restore_token("_".join(text).replace("i", "1"), logp)
    assert "idiot" in tx.restore_token("x1" * 50 + "-" + ".".join(letters), logp)
    assert "idiot" in tx.Words(logp).of_text(" ".join(letters))
    assert "idiot" in tx.restore_token(".".join(letters * 100), logp)


def test_long_parts_without_a_separator_are_decoded():
    """However long a token: its signs are undone, in time and memory in proportion to it."""
    logp = tiny_model()
    assert tx.restore_token("1d10t" * 20, logp) == ["idiot" * 20]
    assert tx.restore_token("x" * 100 + "1d10t" * 20, logp) == ["xxx" + "idiot" * 20] or "idiot" * 20 in tx.restore_token(
        "x" * 100 + "1d10t" * 20, logp)[0]
    long = tx.restore_token("1d10t" * 20_000, logp)
    assert long == ["idiot" * 20_000]


def test_scores_do_not_depend_on_what_was_read_before():
    """Tokens set aside or remembered, and tables emptied in between, leave every score as it is."""
    logp = tiny_model()
    model = tx.Model(logp, {"idiot": [(1, 0)], "clow^": [(1, 1), (2, 2)]}, np.array([3.0, 1.0, 2.0]), -2.0)
    texts = ["an 1d10t", "a person", "clown clowns", "cl0wn", "i d i o t", None, "", "x 1d10t x", "a b c", "idiot Idiot! IDIOT", "1d10t" * 30]
    fresh = [model.scorer()(t) for t in texts]
    of = model.scorer()
    assert [of(t) for t in texts] == fresh == [of(t) for t in texts]
    assert fresh[0] == fresh[4] == fresh[7] == fresh[9] > 0.5 > fresh[1] == fresh[5]
    assert fresh[2] > fresh[3] > fresh[1]


def test_all_scripts_are_counted_as_they_are_decoded(spark):
    """Characters beyond U+3000 have the symbols of letters in the counts too."""
    text = "漢字 한국어 ｆｕｌｌ 𐐷x"
    s = [0, 0, *[tx.symbol(c) for c in text], 0]
    got = tx.count_trigrams(frame(spark, [(1, text)]))
    assert {tuple(map(int, i)): int(got[tuple(i)]) for i in np.argwhere(got)} == dict(Counter(zip(s, s[1:], s[2:])))
    assert tx.symbol("漢") > 26 and tx.symbol("한") > 26


def test_trigram_counts(spark, messy):
    want = Counter()
    for r in messy.collect():
        s = [0, 0, *[tx.symbol(c) for c in r.text or ""], 0]
        if r.text:
            want.update(zip(s, s[1:], s[2:]))
    got = tx.count_trigrams(messy)
    assert {tuple(map(int, i)): int(got[tuple(i)]) for i in np.argwhere(got)} == dict(want)
    assert tx.count_trigrams(messy.limit(0)).sum() == 0


def _accuracy(spark, sf):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    hit = sum(p == t == 1 for p, t in held)
    return hit / max(1, sum(p for p, _ in held)), hit / max(1, sum(t for _, t in held))


def test_held_out_accuracy(spark):
    precision, recall = _accuracy(spark, "/root/testdata/sf0.1")
    assert precision >= 0.95 and recall >= 0.85


def test_held_out_labels_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a = toxicity_model(docs, labels)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = toxicity_model(docs, flipped)
    assert a.index == b.index and np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_messy_rows_and_labels(spark, messy):
    rng = random.Random(1)
    rows = [(100 + i, words(rng, 9) + (" 1diot and l0ser " if i % 2 else " idiot and loser ") + words(rng, 9))
            for i in range(40)] + [
        (200 + i, words(rng, 20)) for i in range(80)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows] + [(None, 1), (7, None), (8, 5)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    of = model.scorer()
    assert of("such an idiot, a loser") > 0.5 > of("a fine person") and of(None) == of("") < 0.5
    assert of("such an 1d10t, and L O S E R") > 0.5
    out = tx.score(messy, model)
    assert out.count() == messy.count() and all(r.score < 0.5 for r in out.collect())
    kept = tx.keep_clean(messy.unionByName(messy.limit(1).withColumn("text", F.lit("idiot loser"))), model)
    assert kept.schema == messy.schema and kept.count() == messy.count()
    assert tx.score(messy.limit(0), model).count() == 0 and tx.keep_clean(messy.limit(0), model).count() == 0
    for some in (labels.filter("toxic = 0"), labels.limit(0)):
        assert tx.fit(docs, some).scorer()("idiot") < 0.5
    assert tx.fit(docs, labels.filter("toxic = 1")).scorer()("fine") > 0.5
