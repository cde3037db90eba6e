"""Multiset fingerprints against brute force: order, insertion, deletion, likeness, and the edited texts."""

import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tabulant.llm import fingerprint as fp
from tabulant.llm.common import successor_blocks

from .conftest import frame, words


def brute_units(paragraph):
    s = re.split(r"(?<=[.!?]) ", paragraph)
    return [paragraph, *s] if len(s) > 1 else [paragraph]


def spark_hash(seed, text):
    """Spark's xxhash64 of (int seed, string): the hash of the int seeds that of the string."""
    first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    return xxhash.xxh64_intdigest(text.encode(), first)


def brute_lanes(text):
    sums = [0] * fp.LANES
    for p in (text or "").split("\n"):
        for u in brute_units(p):
            for j in range(fp.LANES // 8):
                h = spark_hash(j, u)
                for k in range(8):
                    b = h >> 8 * k & 255
                    sums[8 * j + k] += b - 256 if b > 127 else b
    return [x % fp.MODULUS for x in sums]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    s = lambda v: [x - fp.MODULUS if x >= fp.MODULUS // 2 else x for x in v]
    a, b = s(a), s(b)
    dot = lambda x, y: float(sum(p * q for p, q in zip(x, y)))
    norm = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return min(1.0, max(0.0, dot(a, b) / norm)) if norm else 0.0


def test_lanes_match_brute_force(spark, messy):
    df = messy.withColumn("row", F.monotonically_increasing_id())
    texts = {r.row: r.text for r in df.collect()}
    got = {r.row: r.lanes for r in fp.fingerprint(df, ["row"]).collect()}
    assert got == {i: brute_lanes(t) for i, t in texts.items()}
    assert fp.fingerprint(df.limit(0), ["row"]).count() == 0


def test_order_does_not_matter_but_content_does(spark):
    rng = random.Random(1)
    paragraphs = [words(rng, 8) + ". " + words(rng, 5) + "." for _ in range(6)]
    texts = ["\n".join(paragraphs), "\n".join(paragraphs[::-1]), "\n".join(paragraphs[:5]), "\n".join([*paragraphs, paragraphs[0]])]
    got = {r.doc_id: r.lanes for r in fp.fingerprint(frame(spark, list(enumerate(texts))), ["doc_id"]).collect()}
    assert got[0] == got[1] and len({tuple(v) for v in got.values()}) == 3


def test_insert_and_delete_are_inverse(spark):
    base, more = "one. two.\nthree", "four is here. And more."
    df = frame(spark, [(1, base), (2, base + "\n" + more)])
    df = fp.fingerprint(df, ["doc_id"]).withColumn("p", F.lit(more))
    r = {x.doc_id: x for x in df.select("doc_id", "lanes", fp.insert(F.col("lanes"), F.col("p")).alias("plus"),
                                        fp.delete(F.col("lanes"), F.col("p")).alias("minus")).collect()}
    assert r[1].plus == r[2].lanes and r[2].minus == r[1].lanes


def test_likeness(spark):
    rng = random.Random(2)
    lines = [words(rng, 8) for _ in range(40)]
    near, far = "\n".join(lines[:30] + [words(rng, 8) for _ in range(10)]), "\n".join(words(rng, 8) for _ in range(40))
    df = fp.fingerprint(frame(spark, [(0, "\n".join(lines)), (1, near), (2, far)]), ["doc_id"])
    v = {r.doc_id: r.lanes for r in df.collect()}
    pairs = spark.createDataFrame([(v[0], v[0]), (v[0], v[1]), (v[0], v[2])], "a array<long>, b array<long>")
    same, close, apart = [r[0] for r in pairs.select(fp.likeness(F.col("a"), F.col("b"))).collect()]
    assert same == 1.0 and close > 0.5 and apart < 0.4
    assert close == pytest.approx(brute_likeness(v[0], v[1]))


def test_successors(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10 ** 12), 300)
    df = frame(spark, [(i, f"text {i}") for i in ids])
    for blocks in (None, 1, 7, 1024):
        got = successor_blocks(df, "doc_id", "text", "nxt", blocks).filter("__tail = 0").collect()
        order = sorted(ids)
        assert {r.doc_id: r.nxt for r in got} == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1])}


def test_successors_of_messy_rows(spark, messy):
    got = successor_blocks(messy, "doc_id", "text", "nxt").filter("__tail = 0").collect()
    assert len(got) == messy.count()
    assert {r.nxt for r in got if r.doc_id == 1} == {""}
    assert successor_blocks(messy.limit(0), "doc_id", "text", "nxt").count() == 0
    alone = successor_blocks(frame(spark, [(5, "x")]), "doc_id", "text", "nxt").filter("__tail = 0").collect()
    assert [(r.doc_id, r.nxt) for r in alone] == [(5, "x")]


def _in_order(rows):
    """(id, text) and the next text, NULL ids first, equal ids by the texts' XXH64 as a signed number, then by text."""
    signed = lambda t: 42 if t is None else (h - (1 << 64) if (h := xxhash.xxh64_intdigest(t.encode(), 42)) >> 63 else h)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1] is not None, r[1] or ""))
    first = next((t for i, t in order if i is not None), None)
    return sorted(((i, t, n) for (i, t), n in zip(order, [t for _, t in order[1:]] + [first])), key=repr)


@pytest.mark.parametrize("blocks", [None, 1, 5, 40])
def test_hot_and_missing_ids_are_subdivided(spark, blocks):
    """A third of all rows share an id, a sixth have none: the successors are those of one sorted list, no block holds a hot id whole."""
    rows = [(7 if k % 3 == 0 else None if k % 6 == 1 else k, f"text {k}") for k in range(600)] + [(7, "text 0"), (9, None), (None, None)]
    df = successor_blocks(frame(spark, rows), "doc_id", "text", "nxt", blocks)
    got = df.filter("__tail = 0").collect()
    assert sorted(((r.doc_id, r.text, r.nxt) for r in got), key=repr) == _in_order(rows)
    if blocks == 40:
        sizes = {}
        for r in got:
            sizes[r["__block"]] = sizes.get(r["__block"], 0) + 1
        assert max(sizes.values()) < 60 and len(sizes) > 30


def test_successors_where_only_missing_ids_exist(spark):
    got = successor_blocks(frame(spark, [(None, "a"), (None, "b"), (None, "c")]), "doc_id", "text", "nxt", 4).filter("__tail = 0").collect()
    assert sorted(((r.doc_id, r.text, r.nxt) for r in got), key=repr) == _in_order([(None, "a"), (None, "b"), (None, "c")])


def test_query_on_the_small_table(spark):
    from tabulant.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    out = {r.doc_id: r for r in QUERIES["op6_document_fingerprints"](spark, sf).collect()}
    assert len(out) == len(docs)
    prints = {i: brute_lanes(t) for i, t in docs}
    hexed = lambda v: "".join(f"{x:08x}" for x in v)
    for (i, t), (j, n) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 4
        edited = t[:len(t) - k] + n[:k]
        lanes = brute_lanes(edited)
        assert out[i].n_chars == len(t)
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i].fingerprint == hexed(prints[i]) and out[i].edited_fingerprint == hexed(lanes)
        assert out[i].near_edited == pytest.approx(brute_likeness(prints[i], lanes))
        assert out[i].near_next == pytest.approx(brute_likeness(prints[i], prints[j]))
