"""Toxicity of texts after noisy-channel deobfuscation.

A writer's words may have been disguised: letters replaced by look-alike signs,
spelt with separators, or repeated.  Every disguised stretch becomes a lattice
of the letters it may stand for, and Viterbi decoding under a character trigram
model, counted over the whole corpus, restores the likeliest words.  Restored
texts are scored by a logistic model of words and word beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, uniform

# Fixed values of the channel: what a sign may stand for, and what disguises cost (natural logarithms).
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "li", "+": "t", "(": "c", "*": "aeiou"}
SIGN_COST, KEEP_COST, DROP_COST, JOIN_COST, SPACE_COST = 1.0, 8.0, 0.5, 0.2, 1.5
REMEMBERED = 64  # signs of a token that is worth remembering; longer ones are decoded each time

BOUNDARY, SYMBOLS = 0, 64
TAIL, HEAD = ".,;:!?\"')]}", "\"'([{¿¡"
SUSPECT = re.compile(r"(.)\1\1|[^\W\d_][0-9@$!|+*(]|[0-9@$!|+*(][^\W\d_]|^\w{1,2}(?:[.\-_~]\w{1,2}){2,}$")
RUN = re.compile(r"(.)\1{3,}")


def symbol(c: str) -> int:
    """The model's symbol of a character: 1 to 26 for a to z, 27 to 63 for other letters, 0 for the rest."""
    low = c.lower()[:1]
    if "a" <= low <= "z":
        return ord(low) - 96
    return 27 + ord(low) % 37 if low.isalpha() else BOUNDARY


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts, each framed by boundaries; the table's size is fixed.

    Partitions are counted apart and summed by Spark; what reaches the driver is the table.
    """
    table = np.array([symbol(chr(i)) for i in range(0x110000)], np.uint8)   # of every character, as decoding sees it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                codes = np.frombuffer((text.as_py() or "").encode("utf-32-le", "replace"), np.uint32)
                for at in range(0, len(codes), 1 << 20):  # the overlap of 2 keeps trigrams across blocks
                    part = codes[max(0, at - 2):at + (1 << 20)]
                    s = table[part].astype(np.int32)
                    last = at + (1 << 20) >= len(codes)
                    s = np.concatenate([[0] * (2 if at == 0 else 0), s, [0] * last]).astype(np.int32)
                    total += np.bincount(s[:-2] * SYMBOLS ** 2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["trigram", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "trigram long, n long")
    out = np.zeros(SYMBOLS ** 3)
    rows = counts.groupBy("trigram").agg(F.sum("n").alias("n")).collect()  # at most 64 ** 3 rows
    out[[r[0] for r in rows]] = [r[1] for r in rows]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log P(c | a, b): trigram counts backed by bigrams, those by single symbols."""
    single = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    pair = counts.sum(0)
    pair = (pair + 8 * single) / (pair.sum(1, keepdims=True) + 8)
    return np.log((counts + 4 * pair) / (counts.sum(2, keepdims=True) + 4)).astype(np.float32)


def lattice(stretch: str) -> Iterator[list[tuple[str, float]]]:
    """For each sign of a stretch: the strings it may stand for and their costs."""
    for i, c in enumerate(stretch):
        if c in LOOKALIKES:
            yield [(x, SIGN_COST) for x in LOOKALIKES[c]] + [(c, KEEP_COST)]
        elif c in " .-_~":
            yield [("", JOIN_COST), (" ", SPACE_COST)]
        else:
            same = stretch[i - 1:i] == c or stretch[i + 1:i + 2] == c
            repeated = same and (stretch[max(0, i - 2):i + 1] == c * 3 or stretch[i - 1:i + 2] == c * 3
                                 or stretch[i:i + 3] == c * 3)
            yield [(c, 0.0), ("", DROP_COST)] if repeated else [(c, 0.0)]


def decode(stretch: str, logp: np.ndarray) -> str:
    """The likeliest text behind a stretch: Viterbi over its lattice, states being the last two symbols.

    A state's text is a chain of (chain before, piece), so the work is linear in the stretch.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BOUNDARY, BOUNDARY): (0.0, None)}
    for options in lattice(stretch):
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, chain) in states.items():
            for piece, cost in options:
                if piece:
                    c = symbol(piece)
                    to, value = (b, c), score - cost + float(logp[a, b, c])
                else:
                    to, value = (a, b), score - cost
                if to not in reached or value > reached[to][0]:
                    reached[to] = (value, (chain, piece) if piece else chain)
        states = reached
    ends = [(score + float(logp[a, b, BOUNDARY]), chain) for (a, b), (score, chain) in states.items()]
    best = max(score for score, _ in ends)
    return max(_spelt(chain) for score, chain in ends if score == best)


def _spelt(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, piece = chain
        out.append(piece)
    return "".join(reversed(out))


def restore_token(token: str, logp: np.ndarray) -> list[str]:
    """The words behind one token without white space, lower-cased and bare of outer punctuation."""
    core = token.lower().lstrip(HEAD).rstrip(TAIL)
    if not core or not SUSPECT.search(core):
        return [core] if core else []
    short = RUN.sub(r"\1\1\1", core)
    if not any(c.isalpha() for c in short):
        return [core]
    return decode(short, logp).split() or [core]


class Words:
    """The distinct words of texts, disguises undone; remembers tokens, as most come again."""

    def __init__(self, logp: np.ndarray, remember: int = 1 << 19):
        self.logp, self.remember, self.known = logp, remember, {}

    def of_token(self, token: str) -> list[str]:
        words = self.known.get(token)
        if words is None:
            words = restore_token(token, self.logp)
            if len(self.known) >= self.remember:
                self.known.clear()
            if len(token) <= REMEMBERED:
                self.known[token] = words
        return words

    def spelt(self, tokens: list[str]) -> list[str]:
        """The words that three or more single letters in a row may spell."""
        words: list[str] = []
        single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start > 2:
                letters = "".join(tokens[start:end]).lower()
                if any(c.isalpha() for c in letters):
                    words += decode(" ".join(letters), self.logp).split()
        return words

    def of_text(self, text: str | None) -> set[str]:
        tokens = (text or "").split()
        return {w for t in set(tokens) for w in self.of_token(t)}.union(self.spelt(tokens))


BEGINNINGS = (4, 5, 6, 7, 8)
TIMES = (1, 2, 3, 5)  # a feature counts anew when that many distinct words of a text have it


def features(word: str) -> list[str]:
    """A word and its beginnings, which inflected and compound words share."""
    return [word, *[word[:k] + "^" for k in BEGINNINGS if len(word) > k]]


def present(words: set[str]) -> list[tuple[str, int]]:
    """The features of a text's words, each with every number of ``TIMES`` it reaches."""
    count = Counter(f for w in words for f in features(w))
    return [(f, t) for f, n in count.items() for t in TIMES if n >= t]


@dataclass
class Model:
    """Log probabilities of the character model; places of the chosen features by name; weights and bias."""

    logp: np.ndarray
    index: dict[str, list[tuple[int, int]]]   # (times, place) of a feature
    weights: np.ndarray
    bias: float

    def places(self):
        """A function from texts to the places of the features they have.

        Tokens behind which no chosen feature lies, nearly all, are set aside
        in one set operation a text once they have been seen.
        """
        words, index, hits = Words(self.logp), self.index, {}
        dull: set[str] = set()

        def of_word(word: str) -> tuple[str, ...]:
            names = hits.get(word)
            if names is None:
                names = tuple(f for f in features(word) if f in index)
                if names:
                    hits[word] = names
            return names

        def of(text: str | None) -> list[int]:
            tokens = (text or "").split()
            distinct = set(tokens)
            found = words.spelt(tokens) if any(len(t) == 1 for t in distinct) else []
            for t in distinct - dull:
                own = words.of_token(t)
                if any(map(of_word, own)):
                    found += own
                elif len(t) <= REMEMBERED:
                    words.known.pop(t, None)   # one place to remember it is enough
                    dull.add(t)
            for seen in (dull, hits):
                if len(seen) > words.remember:
                    seen.clear()
            count: dict[str, int] = {}
            for w in set(found):
                for f in of_word(w):
                    count[f] = count.get(f, 0) + 1
            return sorted(at for f, n in count.items() for t, at in index[f] if n >= t)

        return of

    def scorer(self):
        """A function from texts to scores in 0 to 1."""
        places, weights = self.places(), self.weights

        def score(text: str | None) -> float:
            at = places(text)
            z = self.bias + (float(weights[at].sum()) if at else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with a ridge penalty on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty),
                               x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_rows: int = 10_000, n_features: int = 512, least: int = 3, seed: int = 42) -> Model:
    """Learn a scorer: the character model from all of ``docs``, the word model from labelled rows.

    ``labels``: the rows to learn from (id and 0 or 1; others and NULL are left
    out).  About ``train_rows`` of them at most, drawn by a hash of the id, are
    used; the ``n_features`` features whose share among toxic texts exceeds
    their share among the others most significantly, in at least ``least``
    toxic texts, get weights.  Without labels of both kinds all texts score
    the share of toxic labels, 0 if there are none.
    """
    logp = language_model(count_trigrams(docs, text_col))
    wanted = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    n = wanted.count()
    drawn = stage(wanted.filter(uniform(F.lit(seed), F.col("__id")) < train_rows / max(n, 1)), "toxicity-labels")
    # The drawn labels are a table of bounded length; the planner broadcasts it by its size.
    texts = docs.join(drawn, docs[id_col] == drawn["__id"]).select(F.col(text_col).cast("string").alias("t"), "__y")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = Words(logp), {}

        def answer():
            names, sums = list(count), list(count.values())
            return pa.record_batch([pa.array([f for f, _ in names], pa.string()), pa.array([t for _, t in names], pa.int32()),
                                    pa.array([c[0] for c in sums], pa.int64()), pa.array([c[1] for c in sums], pa.int64())],
                                   ["f", "times", "clean", "toxic"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for f in present(words.of_text(text.as_py())):
                    count.setdefault(f, [0, 0])[y] += 1
                if len(count) > 200_000:  # bounds what a task holds
                    yield answer()
                    count.clear()
        yield answer()

    sizes = {r[0]: r[1] for r in texts.groupBy("__y").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(logp, {}, np.zeros(0), 30.0 if toxic else -30.0)
    share = (F.col("toxic") + F.col("clean")) / F.lit(clean + toxic)
    excess = ((F.col("toxic") / F.lit(toxic) - F.col("clean") / F.lit(clean))
              / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9))))
    # Of features with one beginning and the same counts, which say the same, the shortest stays.
    counts = (texts.mapInArrow(tally, "f string, times int, clean long, toxic long").groupBy("f", "times")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= least)
              .filter(excess > 0).groupBy("clean", "toxic", "times", F.substring("f", 1, 4).alias("beginning"))
              .agg(F.min(F.struct(F.char_length("f"), F.col("f"))).alias("__f")).select("clean", "toxic", "times", "__f.f"))
    best = counts.orderBy(excess.desc(), "f", "times").limit(n_features).select("f", "times").collect()
    index: dict[str, list[tuple[int, int]]] = {}
    for i, r in enumerate(best):
        index.setdefault(r.f, []).append((r.times, i))
    model = Model(logp, index, np.zeros(len(best)), 0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = model.places()
        for batch in batches:
            hits = [places(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([batch.column(1), pa.array(hits, pa.list_(pa.int32()))], ["y", "hits"])

    seen = texts.mapInArrow(rows, "y int, hits array<int>").collect()  # train_rows short lists
    x = np.zeros((len(seen), len(best)))
    for i, r in enumerate(seen):
        x[i, r.hits] = 1
    weights, bias = logistic(x, np.array([r.y for r in seen], float))
    return Model(logp, index, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``score``) of every row, 0 to 1; NULL and empty texts score like a text without any known word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())],
                                  ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), "score")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            keep = pa.array([of(t.as_py()) < least for t in batch.column(at)], pa.bool_())
            yield batch.drop_columns(["__text"]).filter(keep)

    return docs.select("*", F.col(text_col).cast("string").alias("__text")).mapInArrow(run, docs.schema)
