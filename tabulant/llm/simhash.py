"""SimHash near-duplicates, found by pigeonring filtering.

A 64-bit fingerprint is cut into ``max_bits + 1`` segments on a ring.  If two
fingerprints differ in at most ``max_bits`` bits, some segment starts a chain
whose differences stay within the proportional budget at every length: none in
its first segment, at most one bit in the first two, and so on.  The first two
links of the chain are found by hashing (one segment exact, the next with at
most one bit flipped); the longer chains prune the pairs that meet, and what is
left is checked in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.join import forget_partitioning
from .common import runs, stage
from .graph import components, local_forest

BITS = 64
CELL = 1024        # rows of one side that meet in one task's cell; larger groups are split into blocks
HEAVY = 64         # index rows of a key that make it heavy
CHUNK = 1 << 20    # pairs held at once
HELD = 1 << 20     # rows that a task holds at once, in whole cells
SHINGLES = 1 << 16  # hashes held at once


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text: bit j is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (ends - size)[:len(words) - k + 1], ends[k - 1:]
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES):
        spans = zip(starts[at:at + SHINGLES].tolist(), ends[at:at + SHINGLES].tolist())
        hashes = np.array([digest(line[a:b], seed) for a, b in spans], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 seed: int = 42) -> DataFrame:
    """(``id``, ``fp``) of every row; NULL and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the ``max_bits + 1`` segments around the ring."""
    m = max_bits + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _cells(prints: DataFrame, max_bits: int) -> DataFrame:
    """Rows (cell, ring, role, fp, rep): fingerprints by the first two links of every chain they can start.

    Role 1 (index): the chain as it is; role 2 (probe): also with one bit of
    the second segment set.  Of two fingerprints that differ in that bit, the
    one without it finds the other.
    """
    ring = segments(max_bits)
    m = len(ring)
    bit = lambda n: F.shiftleft(F.lit(1).cast("long"), n)
    part = lambda i: F.shiftrightunsigned("fp", ring[i][0]).bitwiseAND((1 << ring[i][1]) - 1)
    key = lambda i, second: F.xxhash64(F.lit(i), part(i), second)
    chains = []
    for i in range(m):
        second, width = part((i + 1) % m), ring[(i + 1) % m][1]
        entry = lambda k, role, i=i: F.struct(k.alias("key"), F.lit(i).cast("byte").alias("ring"),
                                              F.lit(role).cast("byte").alias("role"))
        chains.append(entry(key(i, second), 3))
        chains += [F.when(second.bitwiseAND(bit(j)) == 0, entry(key(i, second.bitwiseOR(bit(j))), 2))
                   for j in range(width)]
    rows = prints.select("fp", "rep", F.inline(F.filter(F.array(*chains), lambda c: c.isNotNull())))

    # Keys on which many rows meet: from the index rows alone, of which heavy keys have HEAVY or more.
    own = [F.struct(F.lit(i).alias("i"), part(i).alias("first"), part((i + 1) % m).alias("second")) for i in range(m)]
    heavy = (prints.select(F.inline(F.array(*own))).groupBy("i", "first", "second")
             .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HEAVY))
    near = F.filter(F.array(F.lit(0).cast("long"), *[bit(j) for j in range(max(w for _, w in ring))]),
                    lambda x: F.col("second").bitwiseAND(x) == 0)
    hot = (heavy.withColumn("flip", F.explode(near))
           .groupBy(F.xxhash64("i", "first", F.col("second").bitwiseOR(F.col("flip"))).alias("key"))
           .agg(F.ceil(F.sum("n") / CELL).cast("int").alias("blocks")).filter("blocks > 1"))
    hot = stage(hot, "simhash-hot")

    # A hot key becomes a square of blocks: index rows of block x meet probe rows of block y in cell (x, y).
    rows = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64(F.lit(7), "fp"), "blocks").cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda x, y, role: F.struct(x.alias("x"), y.alias("y"), F.lit(role).cast("byte").alias("as"))
    as_index = F.transform(every, lambda y: place(mine, y, 1))
    as_probe = F.transform(every, lambda x: place(x, mine, 2))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("role").alias("as")))
    places = (F.when(F.col("blocks") == 1, alone).when(F.col("role") == 2, as_probe)
              .otherwise(F.concat(as_index, as_probe)))
    rows = rows.select("key", "ring", "fp", "rep", F.inline(places))
    return rows.select(F.xxhash64("key", "x", "y").alias("cell"), "ring", F.col("as").alias("role"), "fp", "rep")


def chain_pairs(cell, ring, role, fp, max_bits: int):
    """Index pairs of rows that meet in a cell and are within ``max_bits`` bits, in chunks."""
    parts, m = segments(max_bits), max_bits + 1
    masks = np.array([((1 << w) - 1) << o for o, w in parts], np.uint64)
    index = np.flatnonzero(role & 1)
    index = index[np.argsort(cell[index], kind="stable")]
    probe = np.flatnonzero(role & 2)
    low = np.searchsorted(cell[index], cell[probe], "left")
    count = np.searchsorted(cell[index], cell[probe], "right") - low
    met = count > 0
    probe, low, count = probe[met], low[met], count[met]
    upto = np.cumsum(count)
    at = 0
    while at < len(probe):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        c = count[at:end]
        p = np.repeat(probe[at:end], c)
        q = index[np.repeat(low[at:end] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
        at = end
        keep = fp[p] != fp[q]
        p, q = p[keep], q[keep]
        total = np.zeros(len(p), np.int64)
        for length in range(1, m + 1):  # chains from the ring position on: differences within length * max_bits / m
            seg = masks[(ring[q] + length - 1) % m]
            total += np.bitwise_count((fp[p] ^ fp[q]) & seg)
            keep = total * m <= length * max_bits
            p, q, total = p[keep], q[keep], total[keep]
        yield p, q


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect all representatives of fingerprints within ``max_bits`` bits.

    ``prints``: distinct ``fp`` and ``rep``.  A task holds whole cells of about
    ``HELD`` rows at a time and returns a spanning forest of their links, never
    more rows than they have fingerprints.
    """
    if not 1 <= max_bits <= 15:
        raise ValueError("max_bits must be 1 to 15")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, ring, role, fp, rep in runs(batches, HELD):
            reps, node = np.unique(rep, return_inverse=True)
            root = local_forest(len(reps), ((node[p], node[q]) for p, q in chain_pairs(
                cell, ring.astype(np.int64), role, fp.view(np.uint64), max_bits)))
            linked = np.flatnonzero(root != np.arange(len(reps)))
            yield pa.record_batch([pa.array(reps[linked]), pa.array(reps[root[linked]])], ["a", "b"])

    return _cells(prints, max_bits).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4, seed: int = 42) -> DataFrame:
    """Per row: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Rows with equal fingerprints are one node (a large group of copies is
    aggregated before anything is joined).  NULL and blank texts have
    fingerprint 0 and link like any other; repeated rows stay; a row with a
    NULL id links like any other too and takes the smallest id that its
    component has (NULL if it has none).  An empty table gives an empty result.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-prints")
    prints = stage(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    # The planner would read a short table in few tasks; each row becomes dozens.
    nodes = prints.select("fp", F.col("fp").alias("rep")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = components(links(nodes, max_bits), "simhash-components")
    linked = prints.join(found, prints["fp"] == found["node"], "left").select(
        F.col("fp").alias("__fp"), F.coalesce("component", "fp").alias("__c"), "id")
    smallest = linked.groupBy("__c").agg(F.min("id").alias("component_id"))
    label = linked.select("__fp", "__c").join(forget_partitioning(smallest), "__c").select("__fp", "component_id")
    return rows.join(label, rows["fp"] == label["__fp"], "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
