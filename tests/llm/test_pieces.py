"""SentencePiece encoding against the library, brute force and round trips."""

import random
import re
import tracemalloc

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from tabulant.llm import pieces as pc

from .conftest import frame

ODD = ["", " ", "  a  b ", "\n", "a\n\n b", "日本語 テスト", "\x00\x01é", "aaaa" * 50, "🙂🙂x", "▁a", "tab\ttab", " lead", "x" * 5000,
       "The the THE  the" * 3, "12 345,678.90", "ÀÉÎ õß", "áb", "end "]


def run(v, texts):
    return [x.tolist() for x in pc.encode_texts(texts, v, pc.PrefixEncoder(v), {}, re.compile(v.words))]


@pytest.fixture(scope="module")
def vocabulary():
    return pc.Vocabulary.load(pc.default_model())


def test_same_ids_as_the_library(spark, vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=pc.default_model())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    texts += ODD + ["".join(rng.choice("aeiotnsrh ▁\n") for _ in range(200)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([32, 65, 97, 101, 116, 233, 8217, 20013])) for _ in range(60)) for _ in range(200)]
    assert run(vocabulary, texts) == sp.encode(texts)


def test_round_trip(vocabulary):
    for text, ids in zip(ODD, run(vocabulary, ODD)):
        assert vocabulary.text_of(ids) == text.replace("▁", " ")
    assert vocabulary.text_of([]) == ""


def unigram(rng, bytes_too):
    """A small unigram vocabulary with random scores, by the library's own format."""
    m = proto.ModelProto()
    m.ParseFromString(open(pc.default_model(), "rb").read())
    kind = type(m.pieces[0])
    keep = [p for p in m.pieces[:3]] + ([p for p in m.pieces if p.type == kind.BYTE] if bytes_too else [])
    seen, new = {p.piece for p in keep}, []
    while len(new) < 60:
        p = "▁" * (rng.random() < 0.3) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        if p not in seen:
            seen.add(p)
            new.append(kind(piece=p, score=-rng.randint(8, 80) / 8, type=kind.NORMAL))  # exact in single precision
    del m.pieces[:]
    m.pieces.extend(keep + new)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = 1, bytes_too, len(m.pieces)
    return m


def score_of(v, low, marked, ids):
    total = 0.0
    for i in ids:
        total += v.scores[v.pieces[i]] if v.pieces[i] in v.ids else 0
    return total


@pytest.mark.parametrize("bytes_too", [True, False])
def test_viterbi_is_optimal_and_agrees_with_the_library(bytes_too):
    rng = random.Random(7)
    for _ in range(5):
        m = unigram(rng, bytes_too)
        v, sp = pc.Vocabulary.of(m), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        assert v.unigram
        texts = ["".join(rng.choice("abcabcabc d") for _ in range(rng.randint(0, 25))) for _ in range(200)]
        for text, mine, theirs in zip(texts, run(v, texts), sp.encode(texts)):
            assert len(mine) > 0 or not text
            # Ties may be cut differently; the scores must be the same.
            assert mine == theirs or abs(score_of(v, 0, text, mine) - score_of(v, 0, text, theirs)) < 1e-3, text
            assert brute_best(v, v.marked(text)) == pytest.approx(viterbi_score(v, v.marked(text)))


def brute_best(v, marked):
    low = min(v.scores[p] for p in v.ids) - pc.UNKNOWN_PENALTY
    best = [0.0] + [-1e18] * len(marked)
    for e in range(1, len(marked) + 1):
        for s in range(e):
            piece = marked[s:e]
            if piece in v.ids:
                best[e] = max(best[e], best[s] + v.scores[piece])
            elif e - s == 1:
                best[e] = max(best[e], best[s] + low)
    return best[-1]


def viterbi_score(v, marked):
    encoder, total = pc.PrefixEncoder(v), 0.0
    for w in re.findall(v.words, marked):
        states = [(0.0, b"")]
        encoder._viterbi(w, states)
        total += states[-1][0]
    return total


def test_prefixes_are_shared(vocabulary):
    """Words in any order give the same ids, and each distinct prefix is advanced over once."""
    words = ["▁the", "▁there", "▁thereby", "▁them", "▁a", "abc", "▁theme"]
    encoder, steps = pc.PrefixEncoder(vocabulary), []
    plain = encoder._merge
    encoder._merge = lambda w, s: (steps.append(len(w) + 1 - len(s)), plain(w, s))
    got = encoder.encode(words)
    assert sum(steps) == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert got == {w: pc.PrefixEncoder(vocabulary).encode([w])[w] for w in words}


def test_long_unspaced_words_need_linear_memory(vocabulary):
    """A megabyte without a space, for both kinds of vocabulary: the library's ids, and some hundred bytes a character."""
    rng = random.Random(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=pc.default_model())
    short = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/\t") for _ in range(20_000))
    m = unigram(rng, True)
    for v, text, theirs in ((vocabulary, short * 52, sp), (vocabulary, "日本語漢字" * 20_000, sp), (pc.Vocabulary.of(m), "abcab" * 20_000, None)):
        known, encoder = {}, pc.PrefixEncoder(v)
        tracemalloc.start()
        got = next(iter([*pc.encode_texts([text], v, encoder, known, re.compile(v.words))]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400 * len(text) and not known  # long words are not kept for the next lot
        assert v.text_of(got) == text
        assert v.unigram or got.tolist() == theirs.encode(text)  # unigram ties may be cut differently


def test_encode_and_decode_tables(spark, messy, vocabulary):
    encoded = pc.encode(messy, vocabulary, check=True)
    rows = encoded.collect()
    assert len(rows) == messy.count() and all(r.round_trip is not False for r in rows)
    assert {r.doc_id: list(r.ids) for r in rows if r.doc_id in (1, 2)} == {1: [], 2: []}
    texts = sorted((str(r.doc_id), r.text or "") for r in messy.collect())
    assert sorted((str(r.doc_id), r.text) for r in pc.decode(encoded, vocabulary).collect()) == texts
    assert pc.encode(messy.limit(0), vocabulary).count() == 0
    assert pc.decode(frame(spark, [(1, "x")]).selectExpr("doc_id", "cast(null as array<int>) as ids"), vocabulary).collect()[0].text is None


def test_small_lots_change_nothing(spark, vocabulary, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.ids for r in pc.encode(docs, vocabulary).collect()}
    monkeypatch.setattr(pc, "LOT", 500)
    monkeypatch.setattr(pc, "REMEMBER", 100)
    assert {r.doc_id: r.ids for r in pc.encode(docs, vocabulary).collect()} == want


def test_query_on_the_small_table(spark):
    from tabulant.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=pc.default_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op3_sentencepiece"](spark, sf).collect()
    assert {r.doc_id: list(r.ids) for r in out} == {i: sp.encode(t) for i, t in texts.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
