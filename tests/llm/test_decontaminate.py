"""Decontamination against a plain search for every window in every text."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulant.llm import decontaminate, queries
from .conftest import frame, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window=10):
    """(n_words, hit word numbers, items) of one text."""
    own = WORD.findall((text or "").translate(LOW))
    hit, who = set(), set()
    for item, body in items:
        ws = WORD.findall((body or "").translate(LOW))
        size = min(window, len(ws))
        spots = [i for w in {tuple(ws[k:k + size]) for k in range(len(ws) - size + 1)} if size
                 for i in range(len(own) - size + 1) if tuple(own[i:i + size]) == w]
        hit |= {i + k for i in spots for k in range(size)}
        who |= {item} if spots else set()
    return len(own), hit, sorted(str(i) for i in who if i is not None)


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, tuple(k for x in r.runs for k in range(x["first"], x["last"] + 1)),
                   tuple(r["items"])) for r in df.collect())


def wanted(rows, items, window=10):
    out = []
    for key, text in rows:
        n, hit, who = brute(text, items, window)
        out.append((key is not None, key or 0, n, tuple(sorted(hit)), tuple(who)))
    return sorted(out)


@pytest.fixture()
def case():
    rng = random.Random(2)
    bodies = [words(rng, n) for n in (30, 12, 10, 9, 3, 1, 25)]
    items = list(enumerate(bodies)) + [(7, None), (8, ""), (9, "?!"), (10, bodies[0]), (0, bodies[0]), (0, words(rng, 11)),
                                       (None, "nameless item of no more than ten words"), (11, "Größe é über straße"), (12, "a a a a a a a a a a a a")]
    texts = [words(rng, 60), None, "", " \n ", bodies[3], f"{words(rng, 5)} {bodies[1].upper()} {words(rng, 5)}",
             ", ".join(bodies[0].split()[4:20]), " ".join(bodies[0].split()[4:12]), f"x{bodies[5]}", f"die Größe É über/straße  größe é über-straße!",
             "a " * 30, "nameless item of no more than ten words!", f"{bodies[6]}\n{bodies[6]}", "--".join(bodies[2].split()) + "\x00" + bodies[4]]
    return items, list(enumerate(texts)) + [(None, bodies[0]), (5, bodies[0]), (5, bodies[0])]


@pytest.mark.parametrize("automaton_words", [1 << 20, 64, 7])
def test_against_brute_force(spark, case, automaton_words):
    """One automaton, and several passes with pieces of items spread over them."""
    items, rows = case
    got = decontaminate.scan(frame(spark, rows), table(spark, items), automaton_words=automaton_words)
    assert found(got) == wanted(rows, items)


@pytest.mark.parametrize("window", [1, 3])
def test_other_windows(spark, case, window):
    items, rows = case
    assert found(decontaminate.scan(frame(spark, rows), table(spark, items), window=window)) == wanted(rows, items, window)


def test_spans_are_offsets_of_the_original(spark):
    item = "one two three four five six seven eight nine ten"
    text = "Ärger — ONE, two\tthree: four/five six (seven) eight nine Ten! eleven 🎉 One Two Three Four Five Six Seven Eight Nine TEN"
    got = decontaminate.hit_spans(decontaminate.scan(frame(spark, [(1, text), (2, "none"), (3, None)]), table(spark, [(1, item)])))
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.passage) for r in rows] == [(1, text[8:61].rstrip("! ")), (1, text[text.index("One Two"):])]
    assert all(text[r.start:r.end] == r.passage for r in rows)
    kept = decontaminate.clean(decontaminate.scan(frame(spark, [(1, text), (2, "none"), (3, None)]), table(spark, [(1, item)])))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_long_text_in_slices(spark, monkeypatch):
    """Occurrences across the slices of a long text, and words longer than a slice."""
    monkeypatch.setattr(decontaminate, "SLICE", 64)
    rng = random.Random(9)
    items = [(1, words(rng, 14)), (2, words(rng, 4))]
    text = " ".join([words(rng, 40), items[0][1], "q" * 300, items[1][1], words(rng, 200), items[0][1], items[1][1]])
    matcher = decontaminate.Matcher([(str(i), t.split()) for i, t in items], 10)
    n, hits, who = matcher.scan(text.encode().translate(decontaminate.NORMAL))
    expected = brute(text, items)
    assert (n, {k for a, b in hits for k in range(a, b + 1)}, sorted(who)) == expected


def test_messy_and_empty_tables(spark, messy, case):
    items = [(i, t) for i, t in case[0]] + [(50, " ".join(f"w{k}" for k in range(40)))]
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert found(decontaminate.scan(messy, table(spark, items))) == wanted(rows, items)
    assert decontaminate.scan(frame(spark, []), table(spark, items)).count() == 0
    assert {len(r.runs) for r in decontaminate.scan(messy, table(spark, [])).collect()} == {0}


def test_hot_item_and_hot_text(spark):
    """A third of all rows hold the same passage, and many items share it."""
    passage = " ".join(f"hot{k}" for k in range(20))
    rows = [(i, passage if i % 3 == 0 else f"own {i}") for i in range(300)]
    items = [(i, passage) for i in range(40)] + [(99, "other words that nobody has")]
    got = {r.doc_id: (len(r["items"]), len(r.runs)) for r in decontaminate.scan(frame(spark, rows), table(spark, items)).collect()}
    assert all(got[i] == ((40, 1) if i % 3 == 0 else (0, 0)) for i in range(300))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(tuple(r) for r in queries.op12_decontamination(spark, sf).select(cols).collect())
    assert got == sorted(con.sql(queries.ORACLE_SQL["op12_decontamination"]).select(*cols).fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for r in docs[:40]:
        n, hit, who = brute(r.text, items)
        row = next(g for g in got if g[0] == r.doc_id)
        assert row == (r.doc_id, n, len(hit), len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), bool(hit))
    assert any(g[5] for g in got) and not all(g[5] for g in got)
