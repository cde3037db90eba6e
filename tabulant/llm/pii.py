"""Personal data: exact base patterns, and a character BiLSTM-CRF that adds disguised forms.

The base patterns find e-mail addresses, IP addresses, payment cards and
phone numbers in their plain forms.  A character tagger, trained from labelled
spans, reads overlapping windows of the text; its spans are checked for their
kind and reconciled over the whole text, and base spans always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagger import Tagger, encode

# The kinds, in the order results list them.
KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 96, 48   # characters of a window, and from one window to the next
BATCH = 256              # windows tagged at once
LEARN = 72               # characters of a window to learn from

# An added span holds one of these: a digit, an at sign, the word in brackets, or the bare word between a local part
# and a domain whose first dot may be spelt too.  Together they admit whatever ``plausible`` accepts.
SIGN = re.compile(r"[0-9@]")
SPELT = re.compile(r"[\[({]\s*at\s*[\])}]", re.I)
BARE = re.compile(r"(?<=[A-Za-z0-9._%+-])\s+at\s+(?=[A-Za-z0-9-]++(?:\.|\s+\.\s|\s+dot\s|\s*[\[({]\s*dot\s*[\])}])\s*[A-Za-z0-9-])", re.I)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, and the address only from the start of a run of digits: linear in the text however long a run is.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[str, int, int]


def signs(text: str) -> list[tuple[int, int]]:
    """Places of the signs that an added span may hold."""
    return [m.span() for p in (SIGN, SPELT, BARE) for m in p.finditer(text)]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The plain forms, leftmost and non-overlapping for each kind, by kind and then start (code points).

    A match that fails its check (part over 255, digits, Luhn) is dropped and
    not retried.  The work is linear in the text.
    """
    if not SIGN.search(text):
        return []
    spans = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def plausible(kind: str, text: str) -> bool:
    """Whether a tagged span, its disguise undone, is a value of its kind."""
    digits = _digits(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9]+(?:[ ._/-]{1,3}[0-9]+)*", text) is not None
    if kind == "phone":
        return 9 <= len(digits) <= 15 and re.fullmatch(r"[+(]{0,2}[0-9](?:[ ().0-9/-]*[0-9])?", text) is not None and (
            not re.fullmatch(r"[0-9]+", text))
    if kind == "ip":
        parts = re.split(r"\s*(?:\.|\[\.\]|\(\.\)|[\[(]?dot[\])]?)\s*", text)
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    plain = re.sub(r"\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+|\s*@\s*", "@", text, flags=re.I)
    plain = re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+|\s+\.\s+", ".", plain, flags=re.I)
    return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", plain) is not None


# -- learning ---------------------------------------------------------------------------
# The ways to write a value that the base patterns miss, as the tagger learns them.
FORMS = {"email": (" @ |.", " (at) |.", " [at] | [dot] ", "(at)|(dot)", " at | dot ", " at |.", " AT | DOT ", "[at]|.", " at | . "),
         "ip": ("[.]", "(.)", " . ", " dot "),
         "card": (".", "  ", " - ", "/", "_"),
         "phone": ("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "+{p}/{a}/{b}/{c}")}

TURNS = ("email", "ip", "card", "email", "phone")   # kinds in the order in which lessons take them


def made_up(kind: str, rng: Random) -> str:
    """A value of a kind in its plain form."""
    digits = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    if kind == "email":
        word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
        local = word(2, 8) + rng.choice(["", "", digits(1), digits(2)]) + rng.choice(["", ".", ".", "_", "-", "+"])
        local = (local + rng.choice([word(1, 8), word(2, 8), digits(2), ""])).rstrip("._-+")
        hosts = [word(2, 9) + rng.choice(["", "", digits(1), "-" + word(2, 5)]) for _ in range(rng.choice([1, 1, 2, 2, 3]))]
        return local + "@" + ".".join([*hosts, rng.choice(["com", "org", "net", "de", "io", "edu"])])
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))
    return "+" + str(rng.randint(1, 99)) + digits(10)


def disguise(kind: str, value: str, rng: Random, form: str | None = None) -> str:
    """Another way to write a value, one of ``FORMS``."""
    form = form or rng.choice(FORMS[kind])
    if kind == "email":
        at, dot = form.split("|")
        local, _, domain = value.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return value.replace(".", form)
    digits = _digits(value)
    if kind == "card":
        return form.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return form.format(a=a, b=b, c=c, p=digits[:-10] or 1)


def labelled_windows(docs: DataFrame, text_col: str = "text", rows: int = 20_000, windows: int = 1200,
                     seed: int = 42) -> list[tuple[str, list[Span]]]:
    """Windows with labelled spans to learn from: around base spans, and around signs that belong to none.

    About ``rows`` documents at most are read, drawn by a hash of their texts,
    and ``windows`` windows at most returned, so what reaches the driver is
    bounded.
    """
    text = F.col(text_col).cast("string")
    rate = rows / max(docs.count(), 1)
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), text), 11).cast("double") / F.lit(float(1 << 53))
    drawn = docs.filter(text.isNotNull() & (share < rate)).select(text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(0):
                body = value.as_py()
                spans = base_spans(body)
                rng = Random(len(body))
                cover = Cover(spans)
                loose = [a for a, b in signs(body) if not cover.meets(a, b)][::20]
                for s, e in [*sorted((s, e) for _, s, e in spans), *[(at, at + 1) for at in loose[:4]]]:
                    at = max(0, s - rng.randint(4, max(5, WIDTH - (e - s) - 8)))
                    inside = [(KINDS.index(k), a - at, b - at) for k, a, b in spans if a >= at and b <= at + WIDTH]
                    if e <= at + WIDTH:
                        found.append((body[at:at + WIDTH], [x for t in inside for x in t]))
            yield pa.record_batch([pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["window", "spans"])

    got = drawn.mapInArrow(run, "window string, spans array<int>").distinct()
    got = got.orderBy(F.xxhash64(F.lit(seed), "window"), "spans").limit(windows).collect()
    return [(r.window, [(KINDS[r.spans[i]], r.spans[i + 1], r.spans[i + 2]) for i in range(0, len(r.spans), 3)]) for r in got]


class Cover:
    """Places that any of some spans cover; spans may overlap."""

    def __init__(self, spans: list[Span]):
        ranges = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in ranges]
        self.reach = list(accumulate((e for _, e in ranges), max))  # the furthest end among spans up to each

    def meets(self, start: int, end: int) -> bool:
        """Whether a span shares a place with [start, end)."""
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start


def examples(labelled: list[tuple[str, list[Span]]], made: int, rng: Random) -> list[tuple[str, list[Span]]]:
    """What the tagger learns from: the labelled windows as they are, and ``made`` copies with a value put in.

    Kinds come in turn (addresses, which vary most, twice) and so do the forms
    of a kind, whatever the texts hold; the value takes the place of a labelled
    span, or stands at some space of a window without one.  Copies are
    ``LEARN`` characters around the value.  Some have a near miss in its
    place: the same signs, but no value.
    """
    out = [(t[:LEARN], [x for x in spans if x[2] <= LEARN]) for t, spans in labelled]
    for n in range(made if labelled else 0):
        text, spans = labelled[rng.randrange(len(labelled))]
        kind = TURNS[n % len(TURNS)]
        forms = FORMS[kind]
        turn = n // len(TURNS) % (len(forms) + 3)
        value = made_up(kind, rng)
        if turn < len(forms):
            value = disguise(kind, value, rng, forms[turn])
        elif turn > len(forms):   # a near miss: words around a bare at, too few digits, numbers in a row
            kind, value = "", rng.choice([f"look at {made_up('email', rng).partition('@')[0]} now", "at the dot of", str(rng.randint(0, 10 ** 7)),
                                          f"{rng.randint(0, 999)}.{rng.randint(0, 99)}", f"{rng.randint(1990, 2030)}-{rng.randint(1, 12)}-{rng.randint(1, 28)}",
                                          f"{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}", "x @ y", "a (at) b",
                                          "".join(rng.choice("0123456789abcdef") for _ in range(32))])
        if spans and rng.random() < 0.7:
            s, e = rng.choice(spans)[1:]
        else:
            s = e = rng.choice([i for i, c in enumerate(text) if c == " "] or [len(text)])
            value = " " + value
        before, after = text[:s], text[e:]
        if any(a < s and b > len(before) - LEARN or b > e for _, a, b in spans if (a, b) != (s, e)):
            continue   # another value would be cut or stay unlabelled
        lead = value[:len(value) - len(value.lstrip())]
        room = max(0, LEARN - len(value))
        before = before[max(0, len(before) - rng.randint(0, room)):]
        at = len(before) + len(lead)
        spans = [(kind, at, len(before) + len(value))] if kind else []
        out.append(((before + value + after)[:LEARN], [x for x in spans if x[2] <= LEARN]))
    return out


def train(labelled: list[tuple[str, list[Span]]], epochs: int = 8, made: int = 3600, seed: int = 42) -> Tagger | None:
    """A tagger from labelled windows and copies of them with varied values; None if no window has a value."""
    if not any(spans for _, spans in labelled):
        return None
    lessons = examples(labelled, made, Random(seed))
    x = np.stack([encode(text, LEARN) for text, _ in lessons])
    y = np.zeros((len(lessons), LEARN), np.int64)
    for i, (_, spans) in enumerate(lessons):
        for kind, s, e in spans:
            y[i, s] = 1 + 2 * KINDS.index(kind)
            y[i, s + 1:e] = 2 + 2 * KINDS.index(kind)
    tagger = Tagger(len(KINDS), seed=seed)
    tagger.fit(x, y, epochs=epochs, batch=64, rate=0.03, seed=seed)
    return tagger


# -- tagging ----------------------------------------------------------------------------
def window_starts(text: str, base: list[Span]) -> list[int]:
    """Starts of the windows, of all that cover the text, in which a span could be added.

    An added span holds a sign and does not overlap a base span, so windows
    without a sign outside base spans are left out without loss.
    """
    cover = Cover(base)
    starts: set[int] = set()
    for a, b in signs(text):
        if not cover.meets(a, b):
            last = a // STRIDE
            starts.update(range(max(0, last - WIDTH // STRIDE + 1) * STRIDE, last * STRIDE + 1, STRIDE))
    return sorted(starts)


def _tagged(tags: np.ndarray, margin: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
    at, width = 0, len(tags)
    while at < width:
        if tags[at] % 2 == 1:
            end = at + 1
            while end < width and tags[end] == tags[at] + 1:
                end += 1
            yield KINDS[tags[at] // 2], at, end, float(margin[at:end].sum())
            at = end
        else:
            at += 1


def reconcile(text: str, base: list[Span], found: list[tuple[str, int, int, float]]) -> list[Span]:
    """The added spans of one text: plausible, clear of base spans, and of those that overlap the best set.

    Parts of a span that neighbouring windows cut are joined; of overlapping
    spans the set with the highest sum of scores is taken (weighted interval
    scheduling over the whole text).
    """
    found = sorted(found, key=lambda f: (f[0], f[1], f[2]))
    joined = [(a[0], a[1], b[2], a[3] + b[3]) for a, b in zip(found, found[1:])
              if a[0] == b[0] and a[1] < b[1] < a[2] < b[2]]
    cover = Cover(base)
    best: dict[Span, float] = {}
    for kind, s, e, score in [*found, *joined]:
        if score > 0 and not cover.meets(s, e) and signs(text[s:e]) and plausible(kind, text[s:e]):
            best[kind, s, e] = max(score, best.get((kind, s, e), 0.0))
    spans = sorted(best, key=lambda x: (x[2], x[1], x[0]))
    ends = [x[2] for x in spans]
    total, earlier = [0.0], []   # the best sum among the first i spans; with span i taken, how many may stand before it
    for i, span in enumerate(spans):
        earlier.append(bisect_right(ends, span[1], 0, i))
        total.append(max(total[-1], total[earlier[i]] + best[span]))
    taken, i = [], len(spans)
    while i:
        if total[i] > total[i - 1]:
            taken.append(spans[i - 1])
            i = earlier[i - 1]
        else:
            i -= 1
    return taken[::-1]


def find(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``base``, ``added``) of every row: spans as (kind, start, end) in code points, end exclusive.

    NULL and empty texts have none.  Whole texts are read, in windows where the
    tagger could add anything; equal texts have equal spans, repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            base = [base_spans(t) for t in texts]
            found: list[list] = [[] for _ in texts]
            asked: list[tuple[int, int]] = []

            def answer():
                if asked:
                    tags, margin = tagger.decode(np.stack([encode(texts[i][s:s + WIDTH], WIDTH) for i, s in asked]))
                    for (i, s), t, m in zip(asked, tags, margin):
                        size = min(WIDTH, len(texts[i]) - s)
                        found[i] += [(k, a + s, b + s, x) for k, a, b, x in _tagged(t[:size], m[:size])]
                    asked.clear()

            for i, text in enumerate(texts if tagger else []):
                for s in window_starts(text, base[i]):
                    asked.append((i, s))
                    if len(asked) == BATCH:
                        answer()
            answer()
            added = [reconcile(t, b, f) if f else [] for t, b, f in zip(texts, base, found)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            pack = lambda lists: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in lists], kind)
            yield pa.record_batch([batch.column(0), pack(base), pack(added)], ["id", "base", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, base {spans}, added {spans}").select(F.col("id").alias(id_col), "base", "added")


def span_text(spans) -> F.Column:
    """``kind:start:end`` of spans, comma-joined, by kind in the order of ``KINDS`` and then start."""

    def of(kind: str):
        places = F.array_sort(F.transform(F.filter(spans, lambda s: s["kind"] == kind),
                                          lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.transform(places, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[of(k) for k in KINDS]), ",")
