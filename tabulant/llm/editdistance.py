"""Segments and substrings of the partition-based edit join, and its banded bit-parallel verification.

Distances count the symbols of a string: code points of text, or bytes of
``bytes``.  ASCII text is compared as bytes, other text as UTF-32.
"""

from __future__ import annotations

import numpy as np

AREA = 1 << 23   # cells (length x pairs) verified at once
STRIDE = 32      # columns after which pairs already too far apart are let go
INDEX, PROBE = 1, 2


def cut(length: int, pieces: int) -> list[tuple[int, int]]:
    """(start, size) of ``pieces`` segments of a string of ``length`` symbols, sizes at most one apart."""
    short, longer = length // pieces, length % pieces
    sizes = [short] * (pieces - longer) + [short + 1] * longer
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes))


def key_plan(length: int, edits: int) -> tuple[tuple[int, int, int, int], ...]:
    """(start, end, seed, role) of every substring that a string of ``length`` symbols is found by.

    A string is indexed under its own segments.  It probes the segments of
    strings up to ``edits`` symbols shorter with those of its substrings that can
    be aligned to them: at most ``i`` edits lie before segment ``i`` and the
    rest after it, which bounds the shift from both sides.
    """
    plan = []
    for shorter in range(edits + 1):
        other = length - shorter
        for i, (at, size) in enumerate(cut(other, edits + 1)):
            low = max(at - i, at + shorter - (edits - i), 0)
            high = min(at + i, at + shorter + (edits - i), length - size)
            for start in range(low, high + 1):
                own = shorter == 0 and start == at
                plan.append((start, start + size, other * (edits + 1) + i, INDEX | PROBE if own else PROBE))
    return tuple(plan)


def _matrix(strings: list[bytes], height: int, fill: int, unit: type) -> np.ndarray:
    """Strings as columns of symbols, padded with one that occurs in no text."""
    size = np.dtype(unit).itemsize
    return np.frombuffer(b"".join(s.ljust(height * size, bytes([fill])) for s in strings), unit).reshape(-1, height).T.copy()


def _trim(a: bytes, b: bytes, unit: type) -> tuple[bytes, bytes]:
    """Both without their common start and end."""
    x, y = np.frombuffer(a, unit), np.frombuffer(b, unit)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    n -= start
    differ = np.flatnonzero(x[len(x) - n:][::-1] != y[len(y) - n:][::-1])
    end = int(differ[0]) if len(differ) else n
    size = x.itemsize
    return a[start * size:len(a) - end * size], b[start * size:len(b) - end * size]


def _symbols(x: str | bytes, y: str | bytes) -> tuple[bytes, bytes, type]:
    """A pair of strings as arrays of symbols of one width."""
    if isinstance(x, bytes):
        return x, y, np.uint8
    if x.isascii() and y.isascii():
        return x.encode(), y.encode(), np.uint8
    return x.encode("utf-32-le", "surrogatepass"), y.encode("utf-32-le", "surrogatepass"), np.uint32


def within(a: list, b: list, edits: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) are at most ``edits`` insertions, deletions or replacements of a symbol apart."""
    out = np.zeros(len(a), bool)
    pairs: dict[type, list] = {np.uint8: [], np.uint32: []}
    for i, (x, y) in enumerate(zip(a, b)):
        if abs(len(x) - len(y)) > edits:
            continue
        x, y, unit = _symbols(x, y)
        x, y = _trim(x, y, unit)
        if len(x) < len(y):
            x, y = y, x
        size = np.dtype(unit).itemsize
        if not y:
            out[i] = len(x) <= edits * size
        else:
            pairs[unit].append((len(x) // size, i, x, y))
    for unit, some in pairs.items():
        some.sort(key=lambda p: p[0])
        at = 0
        while at < len(some):
            end = at + 1
            while end < len(some) and some[end][0] * (end + 1 - at) <= AREA:
                end += 1
            out[[p[1] for p in some[at:end]]] = _banded([p[2] for p in some[at:end]], [p[3] for p in some[at:end]], edits, unit)
            at = end
    return out


def _banded(longer: list[bytes], shorter: list[bytes], edits: int, unit: type) -> np.ndarray:
    """Bit-parallel dynamic programming over the diagonals within ``edits`` of the main one, all pairs abreast.

    Bit ``k`` of a word is the cell ``k - edits`` rows below the main diagonal.
    From one column to the next the band moves down a row, that is, words move
    right by a bit.  ``up`` and ``down`` hold where the value grows or falls by
    one from the row above; ``same`` where it equals the value on the diagonal
    before.  The distance is the length difference plus the steps on the last
    cell's diagonal that are not ``same``.
    """
    width = 2 * edits + 1
    word = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if width <= np.dtype(t).itemsize * 8)
    full, top, one = word((1 << width) - 1), word(1 << (width - 1)), word(1)
    size = np.dtype(unit).itemsize
    m, n = np.array([len(s) // size for s in longer]), np.array([len(s) // size for s in shorter])
    height = int(n.max())
    rows = _matrix([b"\xff" * edits * size + s for s in longer], int(m.max()) + 2 * edits + 1, 0xFF, unit)
    cols = _matrix(shorter, height, 0xFE, unit)
    apart, diagonal = m - n, (edits + m - n).astype(word)
    up = np.full(len(m), full & ~word((1 << (edits + 1)) - 1), word)
    down = np.zeros(len(m), word)
    alive, result = np.arange(len(m)), np.zeros(len(m), bool)
    for j in range(height):
        match = np.zeros(len(alive), word)
        for k in range(width):  # row j + k of the padded strings is row j + 1 - edits + k, counted from 1
            match |= (rows[j + k] == cols[j]).astype(word) << word(k)
        up, down = (up >> one) | top, down >> one
        same = ((((match & up) + up) ^ up) | match | down) & full
        right_up, right_down = (down | ~(same | up)) & full, same & up
        right_up, right_down = ((right_up << one) | one) & full, (right_down << one) & full
        up, down = (right_down | ~(same | right_up)) & full, same & right_up
        apart = apart + (((same >> diagonal) & one == 0) & (j < n))
        if j % STRIDE == STRIDE - 1 or j == height - 1:
            done = (n <= j + 1) | (apart > edits)
            result[alive[done]] = apart[done] <= edits
            keep = ~done
            if not keep.all():
                alive, up, down, apart, diagonal, n = (x[keep] for x in (alive, up, down, apart, diagonal, n))
                rows, cols = rows[:, keep], cols[:, keep]
            if not len(alive):
                break
    return result
