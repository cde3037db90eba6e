"""PII: base spans against the patterns themselves, the tagger's gradient and decoder, reconciling, odd rows."""

import hashlib
import random
import re
import time
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulant.llm import pii
from tabulant.llm.tagger import Tagger, encode

from .conftest import frame

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and brute_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@-+ 0159()%\né", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4272683025356771", "+1 (713) 555-8702", "10.0.0.255", "1.2.3.256", "a.b@c.de",
                                 "x@y", "@", "+", "9", "0" * 14, " ", "-", ".", "@a.b", "é"]), max_size=8))
def test_base_spans_of_joined_values(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_base(text)


def test_base_spans_are_linear():
    t = time.time()
    for text in ["1" * 300_000, "a" * 300_000 + "@", "@a" * 100_000, "+1" * 100_000, "1." * 150_000, "1 " * 150_000, "+1" + " " * 300_000]:
        pii.base_spans(text)
    assert time.time() - t < 20


def test_gradient():
    rng = np.random.default_rng(1)
    t = Tagger(2, embed=3, hidden=4, seed=1)
    x = rng.integers(1, 99, (3, 7))
    y = np.array([[0, 1, 2, 2, 0, 3, 4], [0, 0, 0, 0, 0, 0, 0], [3, 4, 0, 1, 1, 2, 0]])
    _, g = t.loss(x, y)
    for name, p in t.p.items():
        flat = p.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = t.loss(x, y)[0]
            flat[i] = old - eps
            down = t.loss(x, y)[0]
            flat[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[name].reshape(-1)[i], abs=1e-6), name


def test_decoder_is_the_best_sequence():
    rng = np.random.default_rng(2)
    t = Tagger(2, embed=3, hidden=4, seed=3)
    t.p["move"] += rng.normal(size=t.p["move"].shape)
    x = rng.integers(1, 99, (4, 5))
    out = t.emissions(x)
    move, start = t._moves()
    tags, _ = t.decode(x)
    for i in range(4):
        score = lambda s: start[s[0]] + sum(out[i, k, s[k]] for k in range(5)) + sum(move[a, b] for a, b in zip(s, s[1:]))  # noqa: E731, B023
        assert score(tags[i]) == pytest.approx(max(score(s) for s in product(range(t.tags), repeat=5)))


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(pii.labelled_windows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))


def _samples(rng, n):
    fill = ["the", "word", "entzung", "que", "and,", "été", "of"]
    out = []
    for _ in range(n):
        kind = rng.choice(pii.KINDS)
        d = "".join(str(rng.randint(0, 9)) for _ in range(15))
        card = next(d + str(k) for k in range(10) if brute_luhn(d + str(k)))
        value = {"email": f"jo{rng.randint(1, 99)}.{rng.choice('abcxyz') * 3}@site{rng.randint(1, 9)}.example.org", "card": card,
                 "ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)),
                 "phone": f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"}[kind]
        pad = lambda: " ".join(rng.choice(fill) for _ in range(rng.randint(3, 9)))
        out.append((kind, pii.disguise(kind, value, rng), pad(), pad()))
    return out


def test_disguised_values_are_found(spark, tagger):
    """Unseen disguised values that the base patterns miss: most are found whole; plain text is left alone."""
    samples = _samples(random.Random(11), 300)
    texts = [f"{a} {v} {b}" for _, v, a, b in samples]
    got = {r.doc_id: r for r in pii.find(frame(spark, list(enumerate(texts))), tagger).collect()}
    hit = sum(any(s.kind == k and texts[i][s.start:s.end] == v for s in [*got[i].base, *got[i].added])
              for i, (k, v, _, _) in enumerate(samples))
    print("disguised", hit, "of", len(samples))
    assert hit >= 0.9 * len(samples)
    clean = ["on 2024-01-05 we saw 1234567 units and 3.14", "hash 43c058f85ea79848c3d302929636574a96fc2eb7 end", "x @ y", "a (at) b",
             "version 1.2.3 of 2020"]
    assert all(not r.added and not r.base for r in pii.find(frame(spark, list(enumerate(clean))), tagger).collect())


SPELT_OUT = ["jane.doe at example dot org", "jane.doe at example.org", "jane AT mail DOT example DOT org", "jane\tat\nexample . org",
             "jane at example [dot] org", "jane at example(dot)org", "jane (  at  ) example.org", "jane{at}example dot org"]


@pytest.mark.parametrize("value", SPELT_OUT)
def test_spelt_addresses_pass_every_gate(value):
    """Without a digit or an at sign: windows are read, and a tagged span is kept."""
    assert pii.plausible("email", value)
    text = "please write to " + value + " about it"
    at = text.index(value)
    assert any(s <= at and at + len(value) <= s + pii.WIDTH for s in pii.window_starts(text, []))
    assert pii.reconcile(text, [], [("email", at, at + len(value), 1.0)]) == [("email", at, at + len(value))]


def test_spelt_addresses_are_found(spark, tagger):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 7)))
    rows, want = [], {}
    for i in range(60):
        value = f"{word()}.{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}"
        rows.append((i, "Contact: " + value + " for it"))
        want[i] = value
    got = {r.doc_id: [dict(rows)[r.doc_id][s.start:s.end] for s in r.added] for r in pii.find(frame(spark, rows), tagger).collect()}
    found = sum(want[i] in got[i] for i in want)
    print("found", found, "of", len(want))
    assert found >= 0.9 * len(want)


def test_windows_meet_every_place(tagger):
    text = "ab " * 200 + "5" + " cd" * 200
    starts = pii.window_starts(text, [])
    assert starts and all(s <= 600 < s + pii.WIDTH for s in starts)
    covering = [s for s in range(0, len(text), pii.STRIDE) if s <= 600 < s + pii.WIDTH]
    assert starts == covering
    assert pii.window_starts("no sign at all", []) == [] == pii.window_starts("x 1 y", [("card", 2, 3)])


def test_reconcile():
    text = "call (713) 555-8702 or 10 . 0 . 0 . 1 now"
    phone, ip = ("phone", 5, 19, 9.0), ("ip", 23, 37, 5.0)
    assert pii.reconcile(text, [], [phone, ip, phone]) == [("phone", 5, 19), ("ip", 23, 37)]
    assert pii.reconcile(text, [("card", 10, 12)], [phone, ip]) == [("ip", 23, 37)]         # base spans stay
    assert pii.reconcile(text, [], [("phone", 5, 14, 4.0), ("phone", 12, 19, 4.0)]) == [("phone", 5, 19)]  # cut by windows
    assert pii.reconcile(text, [], [("phone", 5, 19, -1.0), ("email", 5, 19, 5.0)]) == []


def test_messy_rows(spark, messy, tagger):
    out = pii.find(messy, tagger)
    assert out.count() == messy.count() and all(not r.base and not r.added for r in out.collect())
    assert pii.find(messy.limit(0), tagger).count() == 0
    assert pii.train(pii.labelled_windows(messy)) is None
    text = "a@b.cd " * 3000 + "x" * 5000 + " +1 (713) 555-8702"
    r = pii.find(frame(spark, [(1, text)]), None).collect()[0]
    assert len(r.base) == 3001 and not r.added and r.base[-1].end == len(text)
    assert encode("", 4).tolist() == [0] * 4


def test_query_on_the_small_table(spark):
    from tabulant.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op7_pii"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        base = brute_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in base) for k in pii.KINDS]
        joined = ",".join(":".join(map(str, s)) for s in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r.spans.split(",")] if r.spans else []
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
