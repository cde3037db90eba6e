"""Benchmark decontamination: one Aho-Corasick automaton over the test items, texts scanned once.

Items and texts are normalised alike (A-Z lower-cased, words of letters,
digits and characters beyond ASCII).  The automaton's symbols are words, its
patterns the windows of consecutive item words, so the scan of a text costs one
step a word however many items there are; what it finds is mapped back to
offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# Fixed value: what a word is made of once A-Z are lower-cased: digits, a-z and all beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
NORMAL = bytes(b if IN_WORD[b] else 32 for b in bytes(range(256)).lower())  # of UTF-8 bytes; other signs are spaces

SLICE = 4 << 20          # bytes of a text whose words are held at a time
AUTOMATON_WORDS = 1 << 20  # words of items that one automaton holds; more items are scanned in several passes
HITS = "array<struct<first:long,last:long>>"


def item_pieces(items: DataFrame, item_col: str, text_col: str, window: int, piece_words: int) -> DataFrame:
    """(item, words) pieces that hold each window of each item exactly once.

    A piece is at most ``piece_words + window - 1`` words, so a long item is
    spread over pieces and blocks; an item of fewer words than a window is one
    piece, an item without words has none.
    """
    low = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(item_col).cast("string").alias("item"),
                         F.regexp_extract_all(low, F.lit(f"({ITEM_WORD})"), F.lit(1)).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(piece_words))
    pieces = F.transform(starts, lambda i: F.slice(F.col("words"), i + 1, F.lit(piece_words + window - 1)))
    return words.select("item", F.explode(pieces).alias("words")).distinct()


class Matcher:
    """The automaton of a block of item pieces."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], window: int):
        self.window, self.ids, owners = window, {}, {}
        for item, words in pieces:
            row = tuple(self.ids.setdefault(w.encode(), len(self.ids) + 1) for w in words)
            for at in range(max(1, len(row) - window + 1)):
                owners.setdefault(row[at:at + window], set()).add(item)
        self.owners = [(len(key), who) for key, who in owners.items()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, key in enumerate(owners):
            self.automaton.add_word(key, n)
        self.automaton.make_automaton()

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words of normalised bytes, (first, last) word of each occurrence, and the items they belong to."""
        total, kept, found, who, at = 0, (), [], set(), 0
        while at < len(data):
            end = len(data) if len(data) - at <= SLICE else data.rfind(b" ", at, at + SLICE) + 1
            if end <= at:  # a word longer than a slice
                end = data.find(b" ", at + SLICE) + 1 or len(data)
            words = data[at:end].split()
            row = (*kept, *[self.ids.get(w, 0) for w in words])
            base = total - len(kept)
            for last, n in self.automaton.iter(row) if self.owners else ():
                size, items = self.owners[n]
                found.append((base + last - size + 1, base + last))
                who |= items
            total, at = total + len(words), end
            kept = row[len(row) - self.window + 1:] if self.window > 1 else ()
        return total, found, who


def runs_of(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of the words that any occurrence covers."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def word_offsets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (code points, end exclusive) in the original text of every word of its UTF-8 bytes, normalised."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], raw != 32, [False]]).astype(np.int8)))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[edge[::2]], points[edge[1::2]]


def _pass(docs: DataFrame, pieces: list, window: int) -> DataFrame:
    """One scan of ``text`` with the automaton of ``pieces``, what earlier passes found included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(pieces, window)
        for batch in batches:
            counts, runs, items = [], [], []
            for text, before, have in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("text", "runs", "items"))):
                n, found, who = matcher.scan((text.as_py() or "").encode("utf-8", "replace").translate(NORMAL))
                counts.append(n)
                runs.append([{"first": a, "last": b} for a, b in runs_of(
                    found + [(r["first"], r["last"]) for r in before.as_py()])] if found or len(before) else [])
                items.append(sorted({i for i in who if i is not None} | set(have.as_py())))
            arrays = dict(n_words=pa.array(counts, pa.int64()), items=pa.array(items, pa.list_(pa.string())),
                          runs=pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))))
            yield pa.record_batch([arrays.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = 10, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(id, ``n_words``, ``runs``, ``items``, ``text``) of every row of ``docs``.

    ``runs`` are the maximal runs (first and last word, from 0) of words that
    lie in an occurrence of ``window`` consecutive words of an item, or of a
    whole shorter item; ``items`` the ids, as sorted strings, of the items whose
    windows occur.

    Items are brought to the driver in blocks of about ``automaton_words``
    words (a long item is spread over blocks), one block and one automaton at
    a time, so neither the driver nor a task holds more; with several blocks the
    rows are staged between passes.  No row is dropped: NULL and empty texts
    have no words, repeated rows are answered each; items without words match
    nothing, and an item with a NULL id marks words but is named nowhere.
    """
    pieces = stage(item_pieces(items, item_col, item_text_col, window, max(1, automaton_words // 64)), "decontaminate-items")
    size = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-size // automaton_words)
    block = F.pmod(F.xxhash64("item", "words"), F.lit(max(blocks, 1)))
    none = lambda kind: F.array().cast(kind)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
                      none(HITS).alias("runs"), none("array<string>").alias("items"))
    for b in range(max(blocks, 1)):
        part = [(r.item, r.words) for r in pieces.filter(block == b).collect()]
        out = _pass(out, part, window)
        if b + 1 < blocks:
            out = stage(out, "decontaminate-pass")
    return out.withColumnRenamed("id", id_col)


def count_hits(runs: Column) -> Column:
    """Number of words in runs."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def hit_spans(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ``start``, ``end``, ``passage``): the runs of ``scan`` as offsets and text of the original (code points, end exclusive)."""
    kind = scanned.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {"id": [], "start": [], "end": [], "passage": []}
            for key, text, runs in zip(*batch.columns):
                text = text.as_py()
                starts, ends = word_offsets(text.encode("utf-8", "replace").translate(NORMAL))
                for r in runs.as_py():
                    start, end = int(starts[r["first"]]), int(ends[r["last"]])
                    for k, x in zip(out, (key.as_py(), start, end, text[start:end])):
                        out[k].append(x)
            yield pa.record_batch([pa.array(out["id"], batch.column(0).type), pa.array(out["start"], pa.int64()),
                                   pa.array(out["end"], pa.int64()), pa.array(out["passage"], pa.string())], list(out))

    found = scanned.filter(F.size("runs") > 0).select(F.col(id_col), "text", "runs")
    return found.mapInArrow(run, f"id {kind}, start long, end long, passage string").withColumnRenamed("id", id_col)


def clean(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of the rows of ``scan`` in which no item occurs."""
    return scanned.filter(F.size("runs") == 0).select(id_col, "text")
