"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabulant.llm import simhash as sh
from tabulant.llm.graph import components


def brute_print(text, k=4):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace(
        "\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute_components(prints, bits):
    """Smallest id reachable, by comparing all pairs."""
    low = {i: i for i in prints}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = list(prints)
    for x in ids:
        for y in ids:
            if x < y and bin(prints[x] ^ prints[y]).count("1") <= bits:
                a, b = find(x), find(y)
                low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_of_texts():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "Ab", "a b c", "A b\tc\x0bd", "É é É é", "x y z w " * 30,
                 " ".join(rng.choice("abc") for _ in range(500))]:
        assert sh.simhash(text) == brute_print(text), text


def _planted(rng, groups, bits=4):
    """Random fingerprints, and around each a cluster and a chain within reach."""
    out = []
    for _ in range(groups):
        center = rng.getrandbits(64)
        out.append(center)
        for _ in range(6):
            x = center
            for j in rng.sample(range(64), rng.randint(0, bits + 2)):
                x ^= 1 << j
            out.append(x)
            center = x if rng.random() < 0.5 else center
    return out


def test_links_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    for bits in (1, 3, 4, 7):
        fps = sorted(set(_planted(rng, 60, bits)))
        want = brute_components(dict(enumerate(fps)), bits)
        df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
        got = {r.node: r.component for r in components(sh.links(df, bits)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_hot_group_is_split_into_blocks(spark, monkeypatch):
    """A dense group of near copies: many rows on the same keys, block squares, the same components."""
    monkeypatch.setattr(sh, "CELL", 32)
    monkeypatch.setattr(sh, "HEAVY", 8)
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 400:
        x = center
        for j in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << j
        fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(100)})
    want = brute_components(dict(enumerate(fps)), 4)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
    links = sh.links(df, 4).collect()
    assert len(links) < 20 * len(fps)  # forests, not all pairs
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates_of_messy_rows(spark, messy):
    out = sh.near_duplicates(messy).collect()
    texts = {r.doc_id: r.text for r in messy.collect() if r.doc_id is not None}
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_components(prints, 4)
    assert len(out) == messy.count()
    for r in out:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], want[r.doc_id])
        else:
            assert r.component_id in want.values()
    assert sh.near_duplicates(messy.limit(0)).count() == 0


def test_a_row_without_an_id_is_a_bridge(spark, monkeypatch):
    """A and C are both near B, whose id is NULL, and far from each other: one component; NULL ids alone have none."""
    prints = {1: 0b0, None: 0b1111, 2: 0b11111111, 9: 0xFFFF << 40}
    rows = [(i, f) for i, f in prints.items()] + [(None, 0xFF << 20)]
    monkeypatch.setattr(sh, "fingerprints", lambda *a: spark.createDataFrame(rows, "id long, fp long"))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in sh.near_duplicates(spark.range(1).select(F.col("id").alias("doc_id"))).collect()}
    assert {got[i, f"{prints[i]:016x}"] for i in (1, None, 2)} == {1} and got[9, f"{0xFFFF << 40:016x}"] == 9
    assert got[None, f"{0xFF << 20:016x}"] is None and len(got) == 5


def test_small_lots_of_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(sh, "HELD", 16)
    fps = sorted(set(_planted(random.Random(8), 50)))
    want = brute_components(dict(enumerate(fps)), 4)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in components(sh.links(df, 4)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_query_on_the_small_table(spark):
    from tabulant.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    want = brute_components(prints, 4)
    got = QUERIES["op1_simhash"](spark, sf).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], want[i]) for i in docs}
    assert len(got) == len(docs)


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 900)] + [(3, 3), (900, 7)]
    rng = random.Random(4)
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(500, 901)}}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
