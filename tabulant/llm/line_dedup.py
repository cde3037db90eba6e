"""Line dedup by a segment-partition edit join.

Lines that differ in at most ``max_edits`` characters share a whole segment if one of
them is cut into ``max_edits + 1`` segments.  So every line is indexed under
its segments by length and number, probes the segments of lines of its own
and slightly smaller lengths with the substrings that can match them, and
the lines that meet are verified by a banded bit-parallel edit distance.  Lines
too short for two edits to mean much are compared for equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.join import forget_partitioning
from .common import runs, stage
from .editdistance import INDEX, PROBE, key_plan, within
from .graph import components, local_forest

CELL = 512          # rows of one side that meet in one task's cell; larger groups are split into blocks
CHUNK = 1 << 20     # pairs screened at once
VERIFY = 1 << 13    # pairs verified at once, between looks at which lines are already connected
SCREEN = 1 << 24    # pairs of one cell up to which its rows are screened before their lines are fetched
SEED = 42           # of Spark's xxhash64
BLANKS = " \t\n\x0b\f\r"
GATHER = 1 << 12    # rows of one role and cell that are screened together; larger cells are split before
SAMPLE = 16         # of so many lines one is looked at to find such cells
HELD = 1 << 20      # keys that a task holds at once, in whole cells
HELD_LINES = 1 << 14  # lines that a task holds at once, in whole cells
REMEMBER = 1 << 18  # lines a task remembers, so that it gives a line that many documents have but once


def _blank(line: Column) -> Column:
    """Whether a line has no visible sign."""
    return F.length(F.rtrim(line, F.lit(" \t\n\x0b\f\r"))) == 0


def _line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``doc``, ``pos``, ``line``) of every line that is not blank."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias(
        "pos", "line"))
    return lines.filter(F.col("doc").isNotNull() & ~_blank(F.col("line")))


def _signatures(lines: list[str]) -> np.ndarray:
    """64 bits for each line: which characters, modulo 64, occur an odd number of times.  An edit changes two at most."""
    data = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *map(len, lines[:-1])])
    return np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), (data & 63).astype(np.uint64)), starts)


def _keys(docs: DataFrame, text_col: str, min_chars: int, max_edits: int, one_in: int = 1) -> DataFrame:
    """(``cell``, ``h``, ``sig``, ``role``): the segments and substrings of each task's distinct lines.

    A task gives a line again only after ``REMEMBER`` others.  With ``one_in``
    only that share of the lines is taken, drawn by their hashes.
    """
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}  # plans by length, of lines short enough to have many of their length
        given: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what is held besides the batch
                lines = {x for t in batch.column(0).slice(at, 256) if t.is_valid
                         for x in t.as_py().split("\n") if len(x) >= min_chars and x.strip(BLANKS)}
                fresh = {i: x for x in lines if (i := digest(x, SEED)) % one_in == 0 and i not in given}
                if not fresh:
                    continue
                if len(given) + len(fresh) > REMEMBER:
                    given.clear()
                given.update(fresh)
                lines = list(fresh.values())
                for n in {len(x) for x in lines if len(x) <= 4096} - known.keys():
                    known[n] = key_plan(n, max_edits)
                plans = [known.get(len(x)) or key_plan(len(x), max_edits) for x in lines]
                cells = [digest(x[a:b], seed) for x, plan in zip(lines, plans) for a, b, seed, _ in plan]
                roles = [role for plan in plans for *_, role in plan]
                times = [len(p) for p in plans]
                ids = np.array(list(fresh), np.uint64)
                yield pa.record_batch([
                    pa.array(np.array(cells, np.uint64).view(np.int64)), pa.array(np.repeat(ids, times).view(np.int64)),
                    pa.array(np.repeat(_signatures(lines), times).view(np.int64)),
                    pa.array(np.array(roles, np.int8))], ["cell", "h", "sig", "role"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "cell long, h long, sig long, role byte")


def _spread(keys: DataFrame, sample: DataFrame) -> DataFrame:
    """``keys`` with hot cells split into rectangles of blocks, so that no task gathers a large cell whole.

    Index rows of block x meet probe rows of block y in cell (x, y).  Which
    cells are hot is estimated from ``sample``, the keys of one in ``SAMPLE``
    lines, whose distinct rows are counted in partial sums; an estimate that
    is off changes the size of blocks, not what meets.
    """
    blocks = lambda role: F.ceil(F.sum((F.col("role").bitwiseAND(role) > 0).cast("int")) * SAMPLE / GATHER)
    hot = sample.select("cell", "h", "role").distinct().groupBy("cell").agg(
        F.greatest(blocks(INDEX), F.lit(1)).cast("int").alias("nx"), F.greatest(blocks(PROBE), F.lit(1)).cast("int").alias("ny"))
    rows = keys.join(stage(hot.filter("ny > 1"), "lines-large"), "cell", "left")
    mine = lambda n: F.pmod(F.xxhash64(F.lit(11), "h"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda x, y, role: F.struct(F.xxhash64("cell", x, y).alias("cell"), F.lit(role).cast("byte").alias("role"))
    as_index = F.when(F.col("role").bitwiseAND(INDEX) > 0, F.transform(every("ny"), lambda y: place(mine("nx"), y, INDEX)))
    as_probe = F.when(F.col("role").bitwiseAND(PROBE) > 0, F.transform(every("nx"), lambda x: place(x, mine("ny"), PROBE)))
    none = F.array().cast("array<struct<cell: bigint, role: tinyint>>")
    places = F.when(F.col("ny").isNull(), F.array(F.struct("cell", "role"))).otherwise(
        F.concat(F.coalesce(as_index, none), F.coalesce(as_probe, none)))
    return rows.select("h", "sig", F.inline(places)).select("cell", "h", "sig", "role")


def _meetings(cell: np.ndarray, role: np.ndarray):
    """For every cell: its index rows and its probe rows (positions)."""
    order = np.argsort(cell, kind="stable")
    edges = np.flatnonzero(np.diff(cell[order])) + 1
    several = [g for g in np.split(order, edges) if len(g) > 1]
    for group in several:
        r = role[group]
        yield group[(r & INDEX) > 0], group[(r & PROBE) > 0]


def _screen(keys: DataFrame, max_edits: int) -> DataFrame:
    """The rows (``cell``, ``h``, ``role``) that meet a row whose signature is near enough, at most one for each given."""

    def screened(cell, h, sig, role) -> pa.RecordBatch:
        first = _distinct(cell, h, role)
        cell, h, sig, role = cell[first], h[first], sig[first].view(np.uint64), role[first]
        kept = np.zeros(len(cell), bool)
        index = np.flatnonzero(role & INDEX)
        index = index[np.argsort(cell[index], kind="stable")]
        probe = np.flatnonzero(role & PROBE)
        low = np.searchsorted(cell[index], cell[probe], "left")
        count = np.searchsorted(cell[index], cell[probe], "right") - low
        _, inverse, sizes = np.unique(cell[probe], return_inverse=True, return_counts=True)
        large = count * sizes[inverse] > SCREEN  # so many that screening would cost more than it saves
        kept[probe[large]] = True
        kept[index[np.isin(cell[index], cell[probe[large]])]] = True
        todo = (count > 0) & ~large
        probe, low, count = probe[todo], low[todo], count[todo]
        upto = np.cumsum(count)
        at = 0
        while at < len(probe):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
            c = count[at:end]
            p = np.repeat(probe[at:end], c)
            q = index[np.repeat(low[at:end] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
            near = (h[p] != h[q]) & (np.bitwise_count(sig[p] ^ sig[q]) <= 2 * max_edits)
            kept[p[near]] = kept[q[near]] = True
            at = end
        return pa.record_batch([pa.array(cell[kept]), pa.array(h[kept]), pa.array(role[kept])], ["cell", "h", "role"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs(batches, HELD):
            yield screened(*columns)

    return keys.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, h long, role byte")


def _distinct(cell: np.ndarray, h: np.ndarray, role: np.ndarray) -> np.ndarray:
    """Positions of one of each set of equal rows."""
    order = np.lexsort((role, h, cell))
    c, x, r = cell[order], h[order], role[order]
    return order[np.concatenate([[True], (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (r[1:] != r[:-1])])]


def _verify(rows: DataFrame, max_edits: int) -> DataFrame:
    """Links (a, b) of lines within ``max_edits``: of the links of cells held together a spanning forest."""

    def pairs(cell, role, node, lines, connected):
        for index, probe in _meetings(cell, role):
            for q in index:  # one line against all others, so that a group of copies is connected at once
                p = probe[(node[probe] != node[q]) & ~connected(node[probe], node[q])]
                for at in range(0, len(p), VERIFY):
                    part = p[at:at + VERIFY]
                    near = part[within([lines[i] for i in part], [lines[q]] * len(part), max_edits)]
                    yield node[near], np.full(len(near), node[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, h, role, lines in runs(batches, HELD_LINES):
            ids, node = np.unique(h, return_inverse=True)
            forest = Forest(len(ids))
            for u, v in pairs(cell, role, node, lines, forest.connected):
                forest.add(u, v)
            linked = np.flatnonzero(forest.root != np.arange(len(ids)))
            yield pa.record_batch([pa.array(ids[linked]), pa.array(ids[forest.root[linked]])], ["a", "b"])

    return rows.select("cell", "h", "role", "line").repartition("cell").sortWithinPartitions("cell").mapInArrow(
        run, "a long, b long")


class Forest:
    """Components of nodes under links that are added in small lots."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def connected(self, u: np.ndarray, v) -> np.ndarray:
        return self.root[u] == self.root[v]

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            nodes, local = np.unique(np.concatenate([self.root[u], self.root[v]]), return_inverse=True)
            root = local_forest(len(nodes), [(local[:len(u)], local[len(u):])])
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            for old, new in zip(nodes[moved], nodes[root[moved]]):
                self.root[self.root == old] = new


def _square(rows: DataFrame) -> DataFrame:
    """Cells of more than ``CELL`` rows become squares of blocks, so that no task gets a large group whole."""
    hot = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks")).filter("blocks > 1")
    rows = rows.join(stage(hot, "lines-hot"), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64(F.lit(7), "h"), "blocks").cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda x, y, role: F.struct(x.alias("x"), y.alias("y"), F.lit(role).cast("byte").alias("as"))
    as_index = F.when(F.col("role").bitwiseAND(INDEX) > 0, F.transform(every, lambda y: place(mine, y, INDEX)))
    as_probe = F.when(F.col("role").bitwiseAND(PROBE) > 0, F.transform(every, lambda x: place(x, mine, PROBE)))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("role").alias("as")))
    none = F.array().cast("array<struct<x: int, y: int, as: tinyint>>")
    places = F.when(F.col("blocks") == 1, alone).otherwise(
        F.concat(F.coalesce(as_index, none), F.coalesce(as_probe, none)))
    return rows.select("cell", "h", F.inline(places)).select(
        F.xxhash64("cell", "x", "y").alias("cell"), "h", F.col("as").alias("role"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2,
                    min_chars: int = 24) -> DataFrame:
    """(id, ``line``, ``first_doc``, ``first_line``) of every line that repeats an earlier one, lines counted from 0.

    Equal lines are linked, and lines of at least ``min_chars`` characters (code
    points) that are at most ``max_edits`` characters apart; a class is what links
    connect, and its first occurrence (smallest id, then line) is not
    reported.  Blank lines (no sign but white space) are out.  Line feeds
    alone end lines.  NULL and empty texts have no such line; a row with a
    NULL id takes no part; rows that share an id count as one document, whose
    equal positions are one occurrence.
    """
    if not 1 <= max_edits <= 31 or min_chars <= max_edits * 2:
        raise ValueError("max_edits must be 1 to 31 and min_chars over twice as much")
    wanted = docs.filter(F.col(id_col).isNotNull())
    line = F.col("line")
    seen = stage(_line_rows(wanted, id_col, text_col).select(
        "doc", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), line).alias("h2")), "lines-seen")
    keys = _spread(_keys(wanted, text_col, min_chars, max_edits), _keys(wanted, text_col, min_chars, max_edits, SAMPLE))
    near = stage(_screen(keys, max_edits), "lines-near")

    # The text of each line that met another, read at its first occurrence.
    first = (seen.join(near.select("h").distinct(), "h", "left_semi").groupBy("h")
             .agg(F.min(F.struct("doc", "pos")).alias("at")).groupBy(F.col("at.doc").alias("doc"))
             .agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "h")).alias("ask")))
    texts = (wanted.select(F.col(id_col).cast("long").alias("doc"), F.split(F.col(text_col), "\n", -1).alias("lines"))
             .join(first, "doc").select(F.inline(F.transform("ask", lambda a: F.struct(
                 a["h"].alias("h"), F.get(F.col("lines"), a["pos"]).alias("line")))))
             .filter(F.xxhash64("line") == F.col("h")))
    links = _verify(_square(near).join(texts, "h"), max_edits)
    classes = components(links, "lines-components")

    classed = seen.join(classes, seen["h"] == classes["node"], "left").select(
        "doc", "pos", F.coalesce("component", "h").alias("c"), F.when(F.col("component").isNull(), F.col("h2")).alias("c2"))
    classed = classed.withColumn("c2", F.coalesce("c2", F.lit(0)))
    firsts = (classed.groupBy("c", "c2").agg(F.min(F.struct("doc", "pos")).alias("at"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("c", "c2", F.col("at.doc").alias("d0"), F.col("at.pos").alias("p0")))
    # The firsts are shuffled again, so that the line a third of all documents have can be split over tasks.
    return (classed.join(forget_partitioning(firsts), ["c", "c2"]).filter("doc <> d0 or pos <> p0")
            .select(F.col("doc").alias(id_col), F.col("pos").alias("line"), F.col("d0").alias("first_doc"),
                    F.col("p0").alias("first_line")).distinct())


def drop_lines(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               chars_col: str | None = "n_chars", min_chars: int = 24) -> DataFrame:
    """``docs`` without the lines in ``repeats`` of at least ``min_chars`` characters, and without what is no document of its own.

    Shorter lines that repeat others (a heading, a word of dialogue) stay where
    they are.  A document of which every line is a repeat or blank goes.
    Documents that lose nothing stay as they are, NULL and empty ones too.
    ``chars_col``, where the table has it, is counted anew for changed texts.
    """
    gone = repeats.groupBy(F.col(id_col).alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    docs = docs.join(gone, docs[id_col].cast("long") == gone["__doc"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    own = F.filter(F.array_except(numbers, F.col("__gone")), lambda i: ~_blank(F.get(lines, i)))   # lines of its own
    long = F.filter(F.col("__gone"), lambda i: F.char_length(F.get(lines, i)) >= min_chars)
    kept = F.transform(F.array_except(numbers, long), lambda i: F.get(lines, i))
    repeated, changed = F.col("__gone").isNotNull(), F.col("__changed")
    docs = docs.filter(~repeated | (F.size(own) > 0)).withColumn("__changed", repeated & (F.size(long) > 0))
    docs = docs.withColumn(text_col, F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        docs = docs.withColumn(chars_col, F.when(changed, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
                               .otherwise(F.col(chars_col)))
    return docs.drop("__doc", "__gone", "__changed")
