"""Conversation structure repair with Four-Russians block tables.

A repair is a cheapest path through the few states of the turn grammar
``(system? (user assistant)+)?``.  The vector of costs to go from each state,
less its minimum, takes few values; so the step over every block of ``BLOCK``
row symbols is tabled for each of them, blocks are passed by lookup from the
last to the first, and a block is expanded into rows only when its edits are
read off, with all ties still in view.

Rows of a conversation lie in chunks of a global order, so a conversation of
any length is many bounded pieces: a chunk is reduced to a 4 x 4 matrix of costs
between states, and one row for each chunk, not for each turn, links them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

# Fixed values of the task: costs, and the grammar as states 0 start, 1 after system, 2 after user, 3 after assistant.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})   # the state after a kept row, by its role's initial
NEXT_ROLE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))  # of an inserted or re-roled row, and the state after it
ACCEPTED = (0, 3)
LEGAL = {"su", "ua", "au"}

INITIALS = "sua"        # symbols 0 to 2; 3 is any other role; 4 more where the row is truncated
MUST_GO, PAD = 8, 9     # a row that has to be deleted; no row
SYMBOLS, BLOCK = 10, 4
CHUNK_BITS = 12         # rows of a chunk: 4096
FAR = 1 << 30           # no path


def closed(cost) -> tuple[int, ...]:
    """Costs to go when rows may be inserted first."""
    cost = list(cost)
    for _ in range(3):
        cost = [min(c, INSERT + cost[to]) for c, (_, to) in zip(cost, NEXT_ROLE)]
    return tuple(min(c, FAR) for c in cost)


def options(symbol: int, state: int, after) -> dict[str, tuple[int, int]]:
    """(cost with what follows, state after) of each edit of a row that consumes it."""
    out = {"D": (DELETE + after[state], state)}
    if symbol < MUST_GO:
        extra = TRUNCATED if symbol > 3 else 0
        to = FOLLOW[state].get(INITIALS[symbol % 4]) if symbol % 4 < 3 else None
        if to is not None:
            out["K"] = (extra + after[to], to)
        out["R"] = (REROLE + extra + after[NEXT_ROLE[state][1]], NEXT_ROLE[state][1])
    return out


def before(symbol: int, after) -> tuple[int, ...]:
    """Costs to go before a row of those after it."""
    return tuple(after) if symbol == PAD else closed(min(c for c, _ in options(symbol, q, after).values()) for q in range(4))


END = closed(0 if q in ACCEPTED else FAR for q in range(4))
UNITS = tuple(closed(0 if q == to else FAR for q in range(4)) for to in range(4))


class Tables:
    """Every vector of costs to go that can arise, less its minimum, and the step over every block of symbols."""

    def __init__(self):
        self.vectors, self.index, steps = [], {}, []
        for v in (END, *UNITS):
            self.number(v)
        at = 0
        while at < len(self.vectors):
            steps.append([self.number(before(s, self.vectors[at])) for s in range(SYMBOLS)])
            at += 1
        one = np.array(steps)                       # vector, symbol -> vector, cost added
        self.to, self.add = one[:, :, 0], one[:, :, 1]
        for _ in range(BLOCK - 1):                  # one more symbol in front of every block
            n = self.to.shape[1]
            front = np.repeat(np.arange(SYMBOLS), n)
            rest_to, rest_add = np.tile(self.to, SYMBOLS), np.tile(self.add, SYMBOLS)
            self.to, self.add = one[rest_to, front, 0], rest_add + one[rest_to, front, 1]
        self.known: dict[tuple[int, int, int], tuple] = {}   # blocks expanded before

    def number(self, vector) -> tuple[int, int]:
        """Number of a vector less its minimum, and that minimum."""
        least = min(vector)
        key = tuple(FAR if c >= FAR else c - least for c in vector)
        if key not in self.index:
            self.index[key] = len(self.vectors)
            self.vectors.append(key)
        return self.index[key], least

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """Block numbers of a row of symbols; the first block is filled up in front."""
        whole = np.concatenate([np.full(-len(symbols) % BLOCK, PAD), symbols]).reshape(-1, BLOCK)
        return whole @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    def matrices(self, segments: list[np.ndarray]) -> np.ndarray:
        """Least cost from each state before each segment to each state after it: (segment, 4, 4)."""
        blocks = [self.blocks(s) for s in segments]
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        sizes = np.array([len(blocks[i]) for i in order])
        ends, flat = np.cumsum(sizes), np.concatenate([blocks[i] for i in order])
        at = np.tile([self.number(u)[0] for u in UNITS], (len(segments), 1))
        cost = np.zeros(at.shape, np.int64)
        for k in range(sizes.max(initial=0)):       # the k-th block from the end, of all segments that have it
            active = np.searchsorted(-sizes, -k, "left")
            block = flat[ends[:active] - 1 - k][:, None]
            cost[:active] += self.add[at[:active], block]
            at[:active] = self.to[at[:active], block]
        vectors = np.array(self.vectors, np.int64)[at]              # segment, state after, state before
        out = np.empty_like(vectors)
        out[order] = np.where(vectors >= FAR, FAR, vectors + cost[:, :, None])
        return out.transpose(0, 2, 1)

    def trace(self, symbols: np.ndarray, togo, state: int):
        """Edits of each row for the ASCII-least of the cheapest repairs, and the state after the last."""
        blocks, at, stack = self.blocks(symbols).tolist(), self.number(togo)[0], []
        for block in reversed(blocks):
            stack.append(at)
            at = int(self.to[at, block])
        edits: list = []
        for block in blocks:
            key = block, stack.pop(), state
            if key not in self.known:
                self.known[key] = self.expand(*key)
            rows, state = self.known[key]
            edits += rows
        return edits, state

    def expand(self, block: int, after: int, state: int):
        """Edits of the rows of a block: (letters, roles inserted before it, its new role or '' if kept or None if deleted, cost)."""
        symbols = [block // SYMBOLS ** k % SYMBOLS for k in range(BLOCK - 1, -1, -1)]
        vectors = [self.vectors[after]]
        for s in reversed(symbols):
            vectors.append(before(s, vectors[-1]))
        rows = []
        for n, s in enumerate(symbols):
            if s == PAD:
                continue
            here, there = vectors[BLOCK - n], vectors[BLOCK - n - 1]
            letters, inserted, spent = "", [], 0
            while True:
                ways = options(s, state, there)
                letter = min([x for x, (c, _) in ways.items() if c == here[state]]
                             + ["I"] * (INSERT + here[NEXT_ROLE[state][1]] == here[state]))
                letters += letter
                if letter != "I":
                    break
                role, state = NEXT_ROLE[state]
                inserted.append(role)
                spent += INSERT
            role = {"D": None, "K": "", "R": NEXT_ROLE[state][0]}[letter]
            spent += {"D": DELETE, "K": 0, "R": REROLE}[letter] + (TRUNCATED if letter != "D" and s > 3 else 0)
            state = ways[letter][1]
            rows.append((letters, inserted, role, spent))
        return rows, state


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults by the crc32 of ``conv:turn`` (NULL: a space) modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it the user's.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(part(text_col), "[.!?]", "")).otherwise(part(text_col))
    copies = F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(F.col(conv_col), F.col(turn_col), F.when(fault == 4, "user").otherwise(part(role_col)).alias(role_col),
                                text.alias(text_col), F.explode(copies).alias("__copy")).drop("__copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, digest, symbol) with ``rid``, by which rows of a conversation are in order of their turns.

    Rows go to ranges of (conversation, turn, ...), so a long conversation lies
    in several; equal rows are told apart by where they were read.
    """
    visible = F.expr(r"rtrim(' \t\n\u000B\f\r', text)")
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    kind = F.when(initial.isin(0, 1, 2) & (F.col("role") != ""), initial).otherwise(3)
    ends_well = F.substring(visible, -1, 1).isin(".", "!", "?")
    symbol = F.when(visible == "", MUST_GO).otherwise(kind + F.when(ends_well, 0).otherwise(4)).cast("int")
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = rows.withColumns({"symbol": symbol, "digest": digest, "__read": F.monotonically_increasing_id()})
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "__read"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__read").withColumn(
        "rid", F.monotonically_increasing_id())


def _segments(entries: DataFrame, conv_type: str) -> DataFrame:
    """Per chunk and conversation: symbols, cost matrix, and how many rows are blank or repeat an earlier one."""

    def answer(table: pa.Table, tables: Tables) -> pa.RecordBatch:
        kind, rid = table["kind"].to_numpy(), table["rid"].to_numpy()
        row = np.flatnonzero(kind == 1)
        first = np.zeros(len(rid), bool)
        first[1:] = (kind[:-1] == 0) & (rid[1:] == rid[:-1])        # its marker stands right before it
        table, symbol = table.take(row), table["symbol"].to_numpy()[row].astype(np.int64)
        blank = symbol == MUST_GO
        copy = ~blank & ~first[row]
        symbol[copy] = MUST_GO
        conv = table["conv"].combine_chunks()
        same = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
        chunk = rid[row] >> CHUNK_BITS
        start = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]) | (chunk[1:] != chunk[:-1])])) if len(row) else row
        cuts = [*start.tolist(), len(row)]
        segments = [symbol[s:e] for s, e in zip(cuts, cuts[1:])]
        matrix = tables.matrices(segments) if segments else np.zeros((0, 4, 4), np.int64)
        count = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), start) if len(start) else [], pa.int64())
        return pa.record_batch([conv.take(pa.array(start)), pa.array(rid[row][start], pa.int64()),
                                pa.array([s.astype(np.uint8).tobytes() for s in segments], pa.binary()),
                                pa.array(matrix.reshape(-1, 16).tolist(), pa.list_(pa.int64())), count(blank), count(copy)],
                               ["conv", "rid", "symbols", "matrix", "blank", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = Tables(), []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            chunk = batch.column("rid").to_numpy() >> CHUNK_BITS
            cut = int(np.searchsorted(chunk, chunk[-1]))            # the last chunk may go on in the next batch
            begun = held[0].column("rid")[0].as_py() >> CHUNK_BITS
            if begun != chunk[-1]:
                yield answer(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]), tables)
                held = [batch.slice(cut)]
        if held:
            yield answer(pa.Table.from_batches(held), tables)

    return entries.mapInArrow(run, f"conv {conv_type}, rid long, symbols binary, matrix array<long>, blank long, copies long")


def _costs_to_go(segments: DataFrame, conv_type: str) -> DataFrame:
    """Each segment with ``togo``, the costs to go after it; segments of a conversation come last first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, togo = object(), END
        for batch in batches:
            out = []
            for key, matrix in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist()):
                if key != conv:
                    conv, togo = key, END
                out.append(list(togo))
                togo = tuple(min(matrix[4 * q + to] + togo[to] for to in range(4)) for q in range(4))
            yield pa.record_batch([*[batch.column(c) for c in ("conv", "rid", "symbols", "blank", "copies")],
                                   pa.array(out, pa.list_(pa.int64()))], ["conv", "rid", "symbols", "blank", "copies", "togo"])

    return segments.mapInArrow(run, f"conv {conv_type}, rid long, symbols binary, blank long, copies long, togo array<long>")


class Repair:
    """What is known of one conversation while its rows pass in order."""

    def __init__(self, tables: Tables):
        self.tables, self.state, self.edits = tables, 0, iter(())
        self.blank = self.copies = self.truncated = self.illegal = self.cost = self.turns = 0
        self.least = self.last = self.initial = None
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.begun = True

    def segment(self, symbols: bytes, blank: int, copies: int, togo: list[int]) -> None:
        symbols = np.frombuffer(symbols, np.uint8).astype(np.int64)
        edits, self.state = self.tables.trace(symbols, togo, self.state)
        self.edits = iter(edits)
        self.blank += blank
        self.copies += copies
        self.truncated += int(((symbols > 3) & (symbols < MUST_GO)).sum())

    def row(self, turn, role: str, text: str) -> None:
        letters, inserted, new, cost = next(self.edits)
        self.audit.append(letters)
        self.cost += cost
        for r in inserted:
            self.write(r, "")
        if new is not None:
            self.write(new or role, text)
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last
            self.last = turn

    def answer(self) -> tuple:
        while self.state not in ACCEPTED:
            role, self.state = NEXT_ROLE[self.state]
            self.write(role, "")
            self.audit.append("I")
            self.cost += INSERT
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return (gaps, self.blank, self.copies, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _read_off(entries: DataFrame, conv_type: str) -> DataFrame:
    """One result for each conversation, whose segments and rows come in order, each segment before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        conv, now, names = None, None, [c.split()[0] for c in RESULT.split(", ")]

        def rows_of(done: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            return pa.record_batch([pa.array([k for k, _ in done], key_type)] + [
                pa.array([r[i] for _, r in done], t) for i, t in enumerate(kinds)], ["conv", *names])

        for batch in batches:
            key_type, done = batch.column("conv").type, []
            for key, kind, turn, role, text, symbols, blank, copies, togo in zip(*(batch.column(c).to_pylist() for c in (
                    "conv", "kind", "turn", "role", "text", "symbols", "blank", "copies", "togo"))):
                if now is None or key != conv:
                    if now is not None:
                        done.append((conv, now.answer()))
                    conv, now = key, Repair(tables)
                if kind == 1:
                    now.segment(symbols, blank, copies, togo)
                elif kind == 2:
                    now.row(turn, role, text)
            yield rows_of(done)
        if now is not None:
            yield rows_of([(conv, now.answer())])

    return entries.mapInArrow(run, f"conv {conv_type}, {RESULT}")


def repair(rows: DataFrame, everyone: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: faults of its rows in order of turns (NULL first), and the cheapest edits that mend its structure.

    Columns: conv, ``gaps`` (missing turns), ``blank``, ``duplicate`` and
    ``truncated`` (first faults of rows), ``illegal`` (neighbours whose roles
    cannot follow each other), ``cost``, ``audit`` (the edits' initials:
    Delete, Insert, Keep, Rerole; of equally cheap ones the ASCII-least) and
    ``repaired_sha256`` of the repaired ``role:text`` lines.

    Conversations of ``everyone`` without rows have zeros, an empty audit and
    the hash of nothing.  NULL roles and texts are one space; NULL conversation
    ids are one conversation; rows of equal turns are ordered by role and then
    by a digest, so the result does not depend on how rows are stored; repeated
    rows are duplicates of the first; roles other than system, user and
    assistant can only be re-roled or deleted.

    A long conversation is in many chunks until its edits are known.  A hash of
    all its lines can only be computed in their order: they stream through
    one task that holds a batch of rows, one segment's edits, and the audit.
    """
    conv_type, turn_type = rows.schema[conv_col].dataType.simpleString(), rows.schema[turn_col].dataType.simpleString()
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    known = stage(ordered(own), "conversations-ordered")
    chunk = F.shiftright("rid", CHUNK_BITS).alias("chunk")
    firsts = known.filter(F.col("symbol") != MUST_GO).groupBy("conv", "digest").agg(F.min("rid").alias("rid"))
    entries = known.select(chunk, "rid", F.lit(1).alias("kind"), "conv", "symbol").unionByName(
        firsts.select(chunk, "rid", F.lit(0).alias("kind"), "conv", F.lit(None).cast("int").alias("symbol")))
    segments = _segments(entries.repartition("chunk").sortWithinPartitions("rid", "kind"), conv_type)
    segments = _costs_to_go(segments.repartition("conv").sortWithinPartitions("conv", F.desc("rid")), conv_type)
    people = own.select("conv") if everyone is None else everyone.select(F.col(conv_col).cast(conv_type).alias("conv"))
    null = lambda kind: F.lit(None).cast(kind)
    parts = [
        people.distinct().select("conv", F.lit(-1).cast("long").alias("rid"), F.lit(0).alias("kind")),
        segments.select("conv", "rid", F.lit(1).alias("kind"), "symbols", "blank", "copies", "togo"),
        known.select("conv", "rid", F.lit(2).alias("kind"), "turn", "role", "text"),
    ]
    kinds = {"turn": turn_type, "role": "string", "text": "string", "symbols": "binary", "blank": "long", "copies": "long",
             "togo": "array<long>"}
    parts = [p.select("conv", "rid", "kind", *[F.col(c) if c in p.columns else null(k).alias(c) for c, k in kinds.items()]) for p in parts]
    entries = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = _read_off(entries.repartition("conv").sortWithinPartitions("conv", "rid", "kind"), conv_type)
    return out.withColumnRenamed("conv", conv_col)
