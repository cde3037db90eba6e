"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector: the sum of the signed bytes hashed
from the paragraph and from each of its sentences.  A document's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo 2**32.
Sums commute, so the order of paragraphs does not matter, and a paragraph can
be inserted into or deleted from a fingerprint by one vector addition or
subtraction without the text.  Because random signed vectors are nearly
orthogonal, the cosine of two fingerprints also estimates how much of their
paragraphs and sentences two documents share.  Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 64          # a multiple of 8: eight signed bytes from each 64-bit hash
MODULUS = 1 << 32   # lanes are kept modulo this power of two


def units(paragraph: Column) -> Column:
    """What is hashed of a paragraph: itself and, where it holds several, each of its sentences."""
    sentences = F.split(paragraph, r"(?<=[.!?]) ", -1)
    return F.when(F.size(sentences) > 1, F.concat(F.array(paragraph), sentences)).otherwise(F.array(paragraph))


def paragraph_vector(paragraph: Column) -> Column:
    """The ``LANES`` longs of one paragraph: over its units, the sums of the bytes of XXH64 under seeds 0, 1, ..."""
    hashed = lambda u: F.array(*[b for j in range(LANES // 8) for b in _bytes(F.xxhash64(F.lit(j), u))])
    zero = F.array_repeat(F.lit(0).cast("long"), LANES)
    return F.aggregate(units(paragraph), zero, lambda s, u: F.zip_with(s, hashed(u), lambda x, y: x + y))


def _bytes(word: Column) -> list[Column]:
    return [_byte(word, k) for k in range(8)]


def _byte(word: Column, k: int) -> Column:
    """Byte ``k`` of a 64-bit word, signed."""
    return F.shiftright(F.shiftleft(word, 56 - 8 * k), 56)


def fingerprint(docs: DataFrame, keys: list[str], text_col: str = "text", out: str = "lanes") -> DataFrame:
    """``keys`` and the fingerprint (array of ``LANES`` longs in [0, 2**32)) of every row's text.

    Paragraphs are what line feeds separate; empty ones and the text's other
    white space count as they are, so equal texts have equal fingerprints and
    so have texts that only order their paragraphs differently.  NULL counts as
    the empty text (one empty paragraph).  Rows are told apart by ``keys``;
    repeated keys add up, so pass keys that identify a row.  A long text is
    split into rows and summed map-side, so it needs no more memory than
    itself.
    """
    para = docs.select(*keys, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("__q"))
    para = para.select(*keys, F.explode(units(F.col("__q"))).alias("__p"))
    hashed = para.select(*keys, *[F.xxhash64(F.lit(j), F.col("__p")).alias(f"__h{j}") for j in range(LANES // 8)])
    sums = [F.sum(_byte(F.col(f"__h{i // 8}"), i % 8)).alias(f"__l{i}") for i in range(LANES)]
    lanes = F.array(*[F.col(f"__l{i}").bitwiseAND(F.lit(MODULUS - 1)) for i in range(LANES)])
    return hashed.groupBy(*keys).agg(*sums).select(*keys, lanes.alias(out))


def insert(lanes: Column, paragraph: Column) -> Column:
    """The fingerprint after adding one paragraph."""
    return merge(lanes, paragraph_vector(paragraph))


def delete(lanes: Column, paragraph: Column) -> Column:
    """The fingerprint after taking one paragraph out (the inverse of ``insert``)."""
    return F.zip_with(lanes, paragraph_vector(paragraph),
                      lambda a, b: (a - b).bitwiseAND(F.lit(MODULUS - 1)))


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of two multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS - 1)))


def to_hex(lanes: Column) -> Column:
    """Lanes as ``8 * LANES`` lower-case hex digits, lane 0 first."""
    return F.lower(F.concat(*[F.lpad(F.hex(lanes[i]), 8, "0") for i in range(LANES)]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of paragraphs in common, 0 to 1: the cosine of the two sums, negative values as 0.

    Equal fingerprints give exactly 1.  Lanes at or above 2**31 stand for
    negative sums.
    """
    signed = lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("double")
    add = lambda s, v: s + v
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: signed(p) * signed(q)), F.lit(0.0), add)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return (F.when(a == b, 1.0).when(norm == 0, 0.0)
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm))))
