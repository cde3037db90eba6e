"""Alignment of two tokenizers' tokens on the same bytes, by interval coalescing.

All tokens of both sides are intervals of bytes.  Sorted by start, with the
running maximum of ends, they fall into groups wherever a start reaches that
maximum: the smallest stretches that both sides cut alike.  Within a group the
overlapping pairs are expanded.

Neither tokenizer's tokens reach across a space between two visible signs, so a
text is the sum of its units between such spaces; each distinct unit is encoded
and coalesced once while a task remembers it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

LOT = 2 << 20        # characters of the documents whose pairs are numbered together (a longer document is alone)
REMEMBER = 1 << 23   # characters of distinct units that a task remembers
JOINED = 1 << 16     # characters of units that are encoded in one call
MARK = "▁"
# Signs beside which a space is no cut: all that any rule counts as white space, controls, joiners, and the mark itself.
BLANK = r"[\s\x00-\x20\x7F-\xA0\u1680\u180E\u2000-\u200F\u2028-\u202F\u205F-\u206F\u2581\u3000\uFEFF]"
EDGE = re.compile(f"^{BLANK}|{BLANK}$|{MARK}|^$")
CUT = re.compile(f"(?<=[^{BLANK[1:]}) (?=[^{BLANK[1:]})")


@dataclass
class ByteLevel:
    """A byte-level BPE tokenizer file; its spelling of bytes as characters is undone by rule."""

    file: str

    @staticmethod
    def load(path: str | None = None) -> "ByteLevel":
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:  # read on the driver
            return ByteLevel(f.read())

    def open(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.file)
        self.tokenizer.encode_special_tokens = True   # their strings in a text are plain text
        vocabulary = {**json.loads(self.file)["model"]["vocab"], **self.tokenizer.get_vocab()}
        # Visible Latin-1 signs stand for their own byte, the other bytes in turn for the characters from 256 on.
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        byte_of = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if set(token) <= byte_of.keys() else token.encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of each text, a space put before it."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


@dataclass
class Pieces:
    """A SentencePiece model file that puts a space before the text."""

    model: bytes

    @staticmethod
    def load(path: str | None = None) -> "Pieces":
        import public_tokenizers

        with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            return Pieces(f.read())

    def open(self) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        n = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace(MARK, " ").encode()
                      for i, p in enumerate(pieces)]

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.processor.encode(units, num_threads=1)


def units_of(words: list[str], unsafe: set[str]) -> list[str]:
    """``words`` (a text split at spaces), joined again across every space that is no cut; a space goes before each unit."""
    if unsafe.isdisjoint(words):
        return words
    units: list[str] = []
    for w in words:
        if units and (w in unsafe or units[-1].rpartition(" ")[2] in unsafe):
            units[-1] += " " + w
        else:
            units.append(w)
    return units


def coalesce(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray):
    """Group of each token of A and of B, and the overlapping pairs (index in A, index in B).

    Both sides are sorted and free of overlaps, as tokens are.
    """
    start, end = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    side = np.repeat([0, 1], [len(starts_a), len(starts_b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(start[order][1:] >= reach[:-1])]) if len(order) else 0
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    count = last - first
    left = np.repeat(np.arange(len(starts_a)), count)
    right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return group[:len(starts_a)], group[len(starts_a):], left, right


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum(lengths)
    return end - lengths, end


def gather(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the flat items of the lists ``which``, and how many each has; ``offsets`` cut the flat items into lists."""
    count = offsets[which + 1] - offsets[which]
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return at + np.repeat(offsets[which], count), count


class UnitTable:
    """What is known of distinct units: tokens, groups, the groups' text, and linked pairs (id of A << 32 | id of B)."""

    def __init__(self, a: ByteLevel, b: Pieces):
        a.open(), b.open()
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(t) for t in s.bytes]) for s in (a, b))
        # A token's text with the sign that follows it: inside its side of a group, at the side's end.
        self.text_a = [[f"{i}{sign}".encode() for i in range(len(a.bytes))] for sign in ",|"]
        self.text_b = [[f"{i}{sign}".encode() for i in range(len(b.bytes))] for sign in ",;"]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.held, self.unsafe = 0, set()   # of words that start or end with a blank sign
        self.counts, self.valid = np.zeros((0, 3), np.int64), np.zeros(0, bool)
        self.text: list[bytes] = []
        self.pairs, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, units: list[str]) -> None:
        """Encode and coalesce units that are not known yet."""
        lone, safe, lots, ids_a, ids_b = [], [], [[]], [], []
        size = 0
        for u in units:
            if u in self.unsafe or " " in u and EDGE.search(u):
                lone.append(u)
                continue
            if size >= JOINED:
                lots.append([])
                size = 0
            lots[-1].append(u)
            size += len(u) + 1
        for lot in filter(None, lots):
            a, b = (side.encode([" ".join(lot)])[0] for side in (self.a, self.b))
            line = [(" " + u).encode("utf-8", "replace") for u in lot]
            ends, line = np.cumsum([*map(len, line)]), b"".join(line)
            if all(b"".join(map(side.bytes.__getitem__, ids)) == line and np.isin(ends, np.cumsum(sizes[np.array(ids)])).all()
                   for side, sizes, ids in ((self.a, self.size_a, a), (self.b, self.size_b, b))):
                safe += lot
                ids_a.append(a)
                ids_b.append(b)
            else:  # some sign that a tokenizer treats as no other does: each unit on its own
                lone += lot
        joined = len(ids_a)
        ids_a += self.a.encode(lone)
        ids_b += self.b.encode(lone)
        flat_a, flat_b = (np.array(list(chain.from_iterable(x)), np.int64) for x in (ids_a, ids_b))
        units = safe + lone
        raw = [(" " + u).encode("utf-8", "replace") for u in units]
        size = np.array([len(x) for x in raw], np.int64)
        good = np.ones(len(units), bool)
        for n, (x, ia, ib) in enumerate(zip(raw[len(safe):], ids_a[joined:], ids_b[joined:])):
            good[len(safe) + n] = (b"".join(map(self.a.bytes.__getitem__, ia)) == x
                                   == b"".join(map(self.b.bytes.__getitem__, ib)))
        if not good.all():  # their tokens go: what is left covers the bytes of good units, and only those
            keep = np.concatenate([np.ones(joined, bool), good[len(safe):]])
            flat_a, flat_b = (np.array(list(chain.from_iterable(x for x, k in zip(y, keep) if k)), np.int64) for y in (ids_a, ids_b))
        unit_end = np.cumsum(np.where(good, size, 0))
        starts_a, ends_a = spans(self.size_a[flat_a])
        starts_b, ends_b = spans(self.size_b[flat_b])
        own_a, own_b = (np.searchsorted(unit_end, s, "right") for s in (starts_a, starts_b))
        group_a, group_b, left, right = coalesce(starts_a, ends_a, starts_b, ends_b)
        many = len(units)
        groups = np.zeros(many, np.int64)
        if len(group_a):
            np.add.at(groups, own_a[np.flatnonzero(np.diff(group_a, prepend=-1))], 1)
        # The text of all groups: each group's tokens of A, then of B, each followed by its sign.
        order = np.lexsort((np.repeat([0, 1], [len(group_a), len(group_b)]), np.concatenate([group_a, group_b])))
        texts = ([self.text_a[e][i] for e, i in zip((np.diff(group_a, append=-1) != 0).tolist(), flat_a.tolist())]
                 + [self.text_b[e][i] for e, i in zip((np.diff(group_b, append=-1) != 0).tolist(), flat_b.tolist())])
        texts = [texts[i] for i in order.tolist()]
        longs = np.cumsum([0, *map(len, texts)])
        ends = longs[np.searchsorted(np.concatenate([own_a, own_b])[order], np.arange(many), "right")]
        whole = b"".join(texts)
        base = len(self.index)
        self.index.update(zip(units, range(base, base + many)))
        self.held += sum(map(len, units))
        self.text += [whole[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        self.valid = np.concatenate([self.valid, good])
        counts = np.stack([np.bincount(own_a, minlength=many), np.bincount(own_b, minlength=many), groups], 1) if many else self.counts[:0]
        self.counts = np.concatenate([self.counts, counts])
        links = np.bincount(own_a[left], minlength=many) if many else np.zeros(0, np.int64)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(links)])
        self.pairs = np.concatenate([self.pairs, flat_a[left] << 32 | flat_b[right]])


def slices(text: str) -> Iterator[str]:
    """The text with a space before it, less the space at the start of each slice; slices end at cuts, after about ``LOT`` signs."""
    at = 0
    while len(text) - at > LOT:
        cut = CUT.search(text, at + LOT)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:]


def lots_of(work: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Slices together up to ``LOT`` characters."""
    part, size = [], 0
    for n, s in work:
        if part and size + len(s) > LOT:
            yield part
            part, size = [], 0
        part.append((n, s))
        size += len(s)
    if part:
        yield part


def new_units(split: list[list[str]], table: UnitTable) -> list[str]:
    """The distinct units that ``table`` lacks; ``split`` (words of each slice) becomes units in place."""
    seen = set(chain.from_iterable(split))
    table.unsafe.update(w for w in seen if w not in table.index and EDGE.search(w))
    if not table.unsafe.isdisjoint(seen):
        split[:] = [units_of(words, table.unsafe) for words in split]
    return [u for u in dict.fromkeys(chain.from_iterable(split)) if u not in table.index]


def align_lot(texts: list[str | None], table: UnitTable):
    """Per text (n_a, n_b, n_groups, n_links, groups' SHA-256, pair numbers, how often each), the lot's pairs and their sums."""
    total = np.zeros((len(texts), 4), np.int64)
    valid, hashes = [bool(t) for t in texts], [hashlib.sha256() for _ in texts]
    begun, found = [False] * len(texts), []
    for part in lots_of((n, s) for n, t in enumerate(texts) if t for s in slices(t)):
        split = [s.split(" ") for _, s in part]
        fresh = new_units(split, table)
        if table.held + sum(map(len, fresh)) > REMEMBER:
            table.clear()
            fresh = new_units(split, table)
        table.add(fresh)
        units = np.fromiter(map(table.index.__getitem__, chain.from_iterable(split)), np.int64)
        at, links = gather(table.offsets, units)
        owner = np.repeat([n for n, _ in part], [len(x) for x in split])
        np.add.at(total, owner, np.column_stack([table.counts[units], links]))
        for n in np.unique(owner[~table.valid[units]]).tolist():
            valid[n] = False
        bounds = np.cumsum([0, *map(len, split)]).tolist()
        listed = units.tolist()
        for k, (n, _) in enumerate(part):
            joined = b"".join([table.text[u] for u in listed[bounds[k]:bounds[k + 1]]])
            hashes[n].update((b";" if begun[n] else b"") + joined[:-1])
            begun[n] = True
        codes, place = np.unique(table.pairs[at], return_inverse=True)
        cell, often = np.unique(np.repeat(owner, links) * len(codes) + place, return_counts=True)
        found.append((cell // max(len(codes), 1), codes[cell % max(len(codes), 1)], often))
    doc, code, often = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((),) * 3))
    keep = np.array(valid, bool)[doc.astype(np.int64)]
    doc, code, often = doc[keep], code[keep], often[keep]
    pairs, place = np.unique(code, return_inverse=True)
    if len(found) > 1:  # a text of several slices: its pairs are summed
        cell, back = np.unique(doc * max(len(pairs), 1) + place, return_inverse=True)
        often = np.bincount(back, often).astype(np.int64)
        doc, place = cell // max(len(pairs), 1), cell % max(len(pairs), 1)
    sums = np.bincount(place, often, len(pairs)).astype(np.int64)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    total[~np.array(valid, bool)] = 0
    return total, [h.hexdigest() if v else "" for h, v in zip(hashes, valid)], cuts, place, often, pairs, sums


def _encoded(docs: DataFrame, id_col: str, text_col: str, a: ByteLevel, b: Pieces) -> DataFrame:
    """Rows of documents (``pairs`` NULL) with their pairs by number, and one row for each lot with its pairs by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, lots = UnitTable(a, b), 0
        part = TaskContext.get().partitionId() << 40

        def answer(keys: pa.Array, texts: list) -> pa.RecordBatch:
            total, hashes, cuts, place, often, pairs, sums = align_lot(texts, table)
            n = len(texts)
            lists = lambda cut, flat, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, kind))
            ends = np.append(cuts, cuts[-1])
            of_lot = [0] * (n + 1) + [len(pairs)]
            columns = [pa.array([part + lots] * (n + 1), pa.int64()), pa.concat_arrays([keys, pa.nulls(1, keys.type)]),
                       *[pa.array(np.append(total[:, i], 0), pa.int64()) for i in range(4)], pa.array([*hashes, None]),
                       lists(ends, place, pa.int32()), lists(ends, often, pa.int64()),
                       lists(of_lot, pairs, pa.int64()), lists(of_lot, sums, pa.int64())]
            return pa.record_batch(columns, ["lot", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "often",
                                             "pairs", "sums"])

        for batch in batches:
            at = size = 0
            texts: list = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                texts.append(text)
                size += len(text or "") + 1
                if size >= LOT or i == batch.num_rows - 1:
                    yield answer(batch.column(0).slice(at, i + 1 - at), texts)
                    at, size, texts, lots = i + 1, 0, [], lots + 1

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"lot long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
             " place array<int>, often array<long>, pairs array<long>, sums array<long>")


def pair_counts(pairs: DataFrame, code: str = "code", n: str = "n") -> DataFrame:
    """(code, ``total``, ``best``): links of each pair of ids in the whole corpus, and whether no pair of its B id has more."""
    counts = pairs.groupBy(F.col(code).alias("code")).agg(F.sum(n).alias("total"))
    b_id: Column = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b_id.alias("__b")).agg(F.max("total").alias("__top"))
    return counts.withColumn("__b", b_id).join(top, "__b").select("code", "total", (F.col("total") == F.col("__top")).alias("best"))


def align(docs: DataFrame, a: ByteLevel, b: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``) of every row.

    Tokens of both sides cover a space and the text.  Groups lie between byte
    offsets at which tokens of both sides end; links are all pairs of tokens
    that share a byte.  A pair of ids counts as many links as the corpus has of
    it: ``n_best`` counts the links whose pair no other pair of the same B id
    exceeds, ``count_sum`` adds the counts.  Rows are never dropped: NULL and
    empty texts, and texts that either side does not give back byte by byte
    (the mark U+2581), have zeros and an empty ``groups_sha256``; repeated rows
    all count.

    Whole texts are read, in lots of about ``LOT`` characters; a lot's pairs
    are numbered, so that one row for each pair and lot, not for each document,
    meets the corpus counts.
    """
    encoded = stage(_encoded(docs, id_col, text_col, a, b), "align-encoded")
    of_lots = encoded.filter("pairs is not null and size(pairs) > 0").select(F.col("lot").alias("of_lot"), F.posexplode(F.arrays_zip("pairs", "sums")))
    of_lots = of_lots.select("of_lot", F.col("pos").alias("place"), F.col("col.pairs").alias("code"), F.col("col.sums").alias("n"))
    counted = stage(pair_counts(of_lots), "align-counts")
    known = of_lots.join(counted, "code").select("of_lot", "place", "total", "best")
    rows = encoded.filter("groups_sha256 is not null")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["place"].to_numpy()
        total[at], best[at] = right["total"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for place, often in zip(left["place"].combine_chunks(), left["often"].combine_chunks()):
            place, often = (np.asarray(x.values) for x in (place, often))
            sums.append(int((total[place] * often).sum()))
            bests.append(int((best[place] * often).sum()))
        return left.drop_columns(["lot", "place", "often"]).append_column("n_best", pa.array(bests, pa.int64())).append_column(
            "count_sum", pa.array(sums, pa.int64()))

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.drop("pairs", "sums").groupBy("lot").cogroup(known.groupBy("of_lot")).applyInArrow(
        add_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.withColumnRenamed("id", id_col)
