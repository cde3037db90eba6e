"""Sharding: one shard and slot for every row, near equal bytes, equal texts together, hot texts spread."""

import zlib
from collections import defaultdict

from tabulant.llm import sharding

from .conftest import frame, words


def check(rows, docs, shards, slack):
    """``rows`` of the result against ``docs`` (id, text)."""
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    even = sum(r.size for r in rows) / shards
    largest = max(r.size for r in rows)
    for s in range(shards):
        assert abs(sum(r.size for r in by[s]) - even) <= largest + slack * even


def test_near_equal_bytes_and_small_groups_whole(spark):
    import random
    rng = random.Random(1)
    docs = [(i, words(rng, rng.randint(1, 60))) for i in range(3000)]
    docs += [(10_000 + i, docs[i % 40][1]) for i in range(120)]     # groups of four
    docs += [(20_000 + i, "hot text " * 30) for i in range(1500)]        # a third of all rows
    rows = sharding.assign_shards(frame(spark, docs), shards=12).collect()
    check(rows, docs, 12, 0.06)
    shard = {r.doc_id: r.shard for r in rows}
    assert sum(len({shard[i], *[shard[10_000 + j] for j in range(i, 120, 40)]}) == 1 for i in range(40)) == 40
    assert len({shard[20_000 + i] for i in range(1500)}) > 1


def test_order_and_partitions_do_not_matter(spark):
    docs = [(i, f"text {i % 50} " * (i % 7 + 1)) for i in range(400)]
    a = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(frame(spark, docs), shards=5).collect()}
    b = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(frame(spark, docs[::-1]).repartition(7), shards=5).collect()}
    assert a == b


def test_messy_rows(spark, messy):
    rows = sharding.assign_shards(messy, shards=4).collect()
    check(rows, [(r.doc_id, r.text) for r in messy.collect()], 4, 0.1)
    assert sharding.assign_shards(messy.limit(0), shards=4).count() == 0
    one = sharding.assign_shards(frame(spark, [(1, "a")]), shards=40).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_query_on_the_small_table(spark):
    from tabulant.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op9_sharding"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(out, docs, 40, 0.06)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}


def test_written_shards(spark, tmp_path):
    docs = frame(spark, [(i, f"t{i}") for i in range(100)])
    assigned = sharding.assign_shards(docs, shards=3)
    sharding.write_shards(docs, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in assigned.collect()}
