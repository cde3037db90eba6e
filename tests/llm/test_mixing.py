"""Mixing against brute force and DuckDB."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulant.llm import mixing
from tabulant.llm.queries import ORACLE_SQL, QUERIES

from .conftest import frame, words

def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def brute_share(children, budget):
    """children: {path: (weight, cap)}."""
    left, open_, got = budget, dict(children), {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [p for p, (w, cap) in open_.items() if cap <= Fraction(w * left, total)]
        if not full:
            break
        for p in full:
            got[p] = open_.pop(p)[1]
        left = budget - sum(got.values())
    cum, total = 0, sum(w for w, _ in open_.values())
    for p in sorted(open_):
        w = open_[p][0]
        got[p] = left * (cum + w) // total - left * cum // total
        cum += w
    return got


def brute_mix(docs, weights, budget, epochs, seed):
    """docs: (id, path, tokens)."""
    leaves = defaultdict(int)
    for _, path, t in docs:
        leaves[path] += t
    weight = lambda p: weights.get("/".join(p), 1)

    def cap(prefix, depth):
        return sum(t * epochs for p, t in leaves.items() if p[:len(prefix)] == prefix and t
                   and all(weight(p[:k]) for k in range(1, depth + 1)))

    depth = len(next(iter(leaves))) if leaves else 0
    budgets = {(): min(budget, cap((), depth))}
    for k in range(1, depth + 1):
        step = {}
        for parent, b in budgets.items():
            kids = {p[:k] for p in leaves if p[:k - 1] == parent}
            kids = {"/".join(p): (weight(p), cap(p, depth)) for p in kids if weight(p) and cap(p, depth)}
            step |= {tuple(p.split("/")): g for p, g in brute_share(kids, b).items()}
        budgets = step
    taken = []
    for path, b in budgets.items():
        mine = [(i, t) for i, p, t in docs if p == path]
        whole, rest = divmod(b, leaves[path])
        taken += [(i, e) for i, _ in mine for e in range(whole)]
        if rest:
            key = lambda d: (hashlib.md5(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[1])
            total = 0
            for i, t in sorted(mine, key=key):
                total += t
                if total > rest:
                    break
                taken.append((i, whole))
    return sorted(taken, key=str)


@pytest.mark.parametrize("percent,epochs", [(30, 1), (80, 2), (100, 3), (1000, 2)])
def test_against_brute_force(spark, percent, epochs):
    rng = random.Random(percent)
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "de", "fr"]), f"s{rng.choice([0, 0, 0, 0, 1, 2, 3])}"
        t = words(rng, rng.randint(0, 30))
        rows.append((i, t, lang, source, len(t)))
    weights = {"en": 5, "de": 2, "en/s0": 1, "en/s1": 7, "fr": 3, "fr/s2": 0, "de/s3": 4}
    w = mixing.node_weights(spark, {tuple(p.split("/")): x for p, x in weights.items()})
    docs = [(i, (lang, s), len(t.split())) for i, t, lang, s, _ in rows]
    budget = sum(d[2] for d in docs) * percent // 100
    got = mixing.mix(frame(spark, rows), levels(), w, budget_percent=percent, max_epochs=epochs, seed=9)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "epoch"]
    assert sorted([(r.doc_id, r.epoch) for r in got.collect()], key=str) == brute_mix(docs, weights, budget, epochs, 9)


def test_budget_is_kept_and_shortage_goes_to_siblings(spark):
    """German has a small and a large source: what the small one cannot use goes to its sibling, not to English."""
    rows = [(i, "a b c d e f g h i j", "en", "s0", 1) for i in range(100)]
    rows += [(200, "a b c d e f g h i j", "de", "small", 1)] + [(300 + i, "a b c d e f g h i j", "de", "big", 1) for i in range(99)]
    got = mixing.mix(frame(spark, rows), levels(), budget=800, max_epochs=1)
    tokens = {(r.lang, r.source): r.tokens for r in mixing.mix_report(got, levels(), mixing.count_tokens(F.col("text"))).collect()}
    assert tokens == {("en", "s0"): 400, ("de", "small"): 10, ("de", "big"): 390}


def test_hot_leaf_without_one_window(spark):
    """Nearly all rows in one leaf: only rows of one key range are ordered."""
    rows = [(i, "x y", "en", "s0", 3) for i in range(6000)] + [(9000, "z", "de", "s1", 1)]
    docs = [(i, (lang, s), len(t.split())) for i, t, lang, s, _ in rows]
    got = mixing.mix(frame(spark, rows), levels(), budget=5001, max_epochs=1, seed=3)
    assert sorted([(r.doc_id, r.epoch) for r in got.collect()], key=str) == brute_mix(docs, {}, 5001, 1, 3)


def test_ranges_are_divided_until_they_are_short(spark, monkeypatch):
    """Several rounds of ranges, each by one more digit: the same documents, and few of them ordered in a window."""
    monkeypatch.setattr(mixing, "DIGITS", 1)
    monkeypatch.setattr(mixing, "RANGES", 16)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    rows = [(i, "x y" if i % 4 else "x y z", "en", f"s{i % 2}", 3) for i in range(1500)] + [(None, "one", "en", "s0", 3)] * 40
    docs = [(i, (lang, s), len(t.split())) for i, t, lang, s, _ in rows]
    for budget in (1, 777, 2500):
        got = mixing.mix(frame(spark, rows), levels(), budget=budget, max_epochs=1, seed=3)
        assert sorted([(r.doc_id, r.epoch) for r in got.collect()], key=str) == brute_mix(docs, {}, budget, 1, 3)


def test_messy_rows(spark, messy):
    docs = [(r.doc_id, (r.lang or "(null)", r.source or "(null)"), len((r.text or "").split())) for r in messy.collect()]
    total = sum(d[2] for d in docs)
    got = mixing.mix(messy, levels(), budget_percent=50, max_epochs=2, seed=1)
    assert sorted([(r.doc_id, r.epoch) for r in got.collect()], key=str) == brute_mix(docs, {}, total // 2, 2, 1)
    nulls = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang for r in mixing.mix(nulls, levels()).collect()} == {None}
    assert mixing.mix(messy.limit(0), levels()).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    res = con.execute(ORACLE_SQL["op10_mixing"])
    cols = [d[0] for d in res.description]
    got = QUERIES["op10_mixing"](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(res.fetchall())
