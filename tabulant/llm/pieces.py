"""SentencePiece encoding and decoding over a shared-prefix trie.

The distinct marked words of a lot of texts are sorted, so that walking through
them is a depth-first walk through their trie: the forward states of a prefix
are computed once and kept on a stack for all words that share it.  For a
unigram vocabulary a state is the best score of the prefix and its last piece
(Viterbi); for a BPE vocabulary it is the last piece of the prefix's encoding,
which by the nature of merges is the one piece that fits the state before it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0   # fixed value: an unknown character costs that much more than the worst piece
LOT = 4 << 20            # characters whose words are encoded together
REMEMBER = 1 << 20       # words whose encoding is kept from lot to lot
LONG = 256               # characters from which a word's encoding is not kept
TWO = (2,)


def default_model() -> str:
    """The public vocabulary that is installed here."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model file."""

    pieces: list[str]
    ids: dict[str, int]                 # of pieces that text may become
    scores: dict[str, float]
    bytes_of: dict[int, int]            # ids of the byte pieces
    byte_ids: list[int]                 # of the bytes 0 to 255; empty without byte fallback
    unknown: int
    unknown_text: str
    silent: frozenset[int]              # ids of control pieces, which decode to nothing
    unigram: bool
    prefix: bool                        # a mark is put before the text
    squeeze: bool                       # white space is squeezed to single marks, none outside
    lengths: dict[str, tuple[int, ...]] = field(default_factory=dict)  # of pieces by their last three characters, and 2
    words: str = ""                     # pattern of marked words: no piece reaches across them
    plain: list[str] = field(default_factory=list)  # the text of each id, filled when first decoding
    high: np.ndarray | None = None                  # whether each id is a byte from 128 on

    @staticmethod
    def load(path: str) -> "Vocabulary":
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:   # a file of the tokenizer library, read on the driver
            model.ParseFromString(f.read())
        return Vocabulary.of(model)

    @staticmethod
    def of(model) -> "Vocabulary":
        kind, norm = type(model.pieces[0]), model.normalizer_spec
        if norm.precompiled_charsmap or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with marked, prefixed words is supported")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE vocabularies are supported")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        by_end: dict[str, set[int]] = {}
        for p in normal:
            if len(p) > 2:
                by_end.setdefault(p[-3:], set()).add(len(p))
        lone = not any("\n" in p and len(p) > 1 for p in normal)
        across = any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        words = r"(?s:.+)" if across else rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lone else rf"{MARK}*[^{MARK}]+|{MARK}+"
        return Vocabulary(
            [p.piece for p in model.pieces], normal, {p.piece: p.score for p in model.pieces}, byte_of,
            [i for i, _ in sorted(byte_of.items(), key=lambda x: x[1])] if len(byte_of) == 256 else [],
            next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN), model.trainer_spec.unk_surface,
            frozenset(i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL), model.trainer_spec.model_type == 1,
            norm.add_dummy_prefix, norm.remove_extra_whitespaces,
            {e: (*sorted(n, reverse=True), 2) for e, n in by_end.items()}, words)

    def marked(self, text: str) -> str:
        """The text with marks for spaces, as pieces have them."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return text and (MARK if self.prefix else "") + text.replace(" ", MARK)

    def text_of(self, ids) -> str:
        """The text that ids stand for: byte pieces joined as UTF-8, marks as spaces, the prefix taken off."""
        ids = np.asarray(ids, np.int64)
        if not self.plain:
            for i, p in enumerate(self.pieces):
                byte = self.bytes_of.get(i, 0)
                self.plain.append("" if i in self.silent else self.unknown_text if i == self.unknown else
                                  chr(byte) if i in self.bytes_of else p.replace(MARK, " "))
            self.high = np.array([self.bytes_of.get(i, 0) > 127 for i in range(len(self.pieces))])
        high = self.high[ids]
        if not high.any():
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
        else:  # runs of bytes from 128 on are parts of characters
            edges = np.flatnonzero(np.diff(np.concatenate([[0], high.astype(np.int8), [0]])))
            out, at = [], 0
            for start, end in zip(edges[::2], edges[1::2]):
                out += map(self.plain.__getitem__, ids[at:start].tolist())
                out.append(bytes(self.bytes_of[i] for i in ids[start:end].tolist()).decode("utf-8", "replace"))
                at = end
            text = "".join([*out, *map(self.plain.__getitem__, ids[at:].tolist())])
        return text[1:] if self.prefix and text.startswith(" ") else text


class PrefixEncoder:
    """Encodes sorted words; the states of shared prefixes stay on a stack.

    ``states[i]`` belongs to the first ``i`` characters: for unigram (score,
    start of the last piece), for BPE the last piece.  A word's ids are read by
    walking back from its end, so memory is linear in a word however long.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[tuple[str, str], bool] = {}
        self.grown: dict[str, tuple[list[str], list[str]] | None] = {}
        self.same = {p: p for p in vocabulary.ids}   # states share the vocabulary's strings
        self.lowest = min((vocabulary.scores[p] for p in vocabulary.ids), default=0.0)

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids (packed 32-bit integers) of each of the distinct ``words``."""
        out, last = {}, ""
        states: list = [(0.0, 0) if self.v.unigram else ""]
        advance = self._viterbi if self.v.unigram else self._merge
        for word in sorted(words):
            shared, most = 0, min(len(word), len(states) - 1)
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del states[shared + 1:]
            advance(word, states)
            out[word] = self._ids(word, states)
            last = word
        return out

    def _ids(self, word: str, states: list) -> bytes:
        """The ids of ``word``: the pieces that its states lead back over."""
        v, ids, at, back = self.v, self.v.ids, len(word), []
        while at:
            piece = word[states[at][1]:at] if v.unigram else states[at]
            if piece in ids:
                back.append(ids[piece])
            elif v.byte_ids:
                back += [v.byte_ids[b] for b in reversed(piece.encode("utf-8", "replace"))]
            elif not back or back[-1] != v.unknown:  # neighbouring unknown characters are one
                back.append(v.unknown)
            at -= len(piece)
        return array("i", back[::-1]).tobytes()

    def _viterbi(self, word: str, states: list) -> None:
        lengths, scores, ids = self.v.lengths, self.v.scores, self.v.ids
        for end in range(len(states), len(word) + 1):
            c = word[end - 1]
            best, at = states[end - 1][0] + (scores[c] if c in ids else self.lowest - UNKNOWN_PENALTY), end - 1
            for n in lengths.get(word[max(0, end - 3):end], TWO):
                if n <= end and word[end - n:end] in ids:
                    score = states[end - n][0] + scores[word[end - n:end]]
                    if score > best or score == best and end - n < at:
                        best, at = score, end - n
            states.append((best, at))

    def _merge(self, word: str, states: list) -> None:
        lengths, same, fits = self.v.lengths, self.same, self.fits
        for end in range(len(states), len(word) + 1):
            for n in lengths.get(word[end - 3 if end > 3 else 0:end], TWO):
                if n <= end:
                    piece = same.get(word[end - n:end])
                    if piece is not None:
                        last = states[end - n]
                        fit = fits.get((last, piece))
                        if fit is None:
                            fit = fits[last, piece] = self._fit(last, piece)
                        if fit:
                            states.append(piece)
                            break
            else:
                states.append(word[end - 1])

    def _fit(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` from single characters ends in just these two pieces.

        It does unless some piece across the seam is merged first.  At the seam
        stand, at any time, one part of ``left`` that ends there and one of
        ``right`` that starts there; both grow with the merges inside the pieces,
        the better scored first, the left one of equals.
        """
        if not left:
            return self._seams(right) is not None
        a, b = self._seams(left), self._seams(right)
        if a is None or b is None:
            return False
        (_, ends), (starts, _), scores, ids = a, b, self.v.scores, self.v.ids
        i = j = 0
        while True:
            grow_a = scores[ends[i + 1]] if i + 1 < len(ends) else -np.inf
            grow_b = scores[starts[j + 1]] if j + 1 < len(starts) else -np.inf
            across = ends[i] + starts[j]
            if across in ids and scores[across] > grow_a and scores[across] >= grow_b:
                return False
            if grow_a == grow_b == -np.inf:
                return True
            if grow_a >= grow_b:
                i += 1
            else:
                j += 1

    def _seams(self, piece: str) -> tuple[list[str], list[str]] | None:
        """The parts of a piece that start it and that end it, as merging makes them grow; None if it is never made."""
        known = self.grown.get(piece, 0)
        if known == 0:
            parts, starts, ends = list(piece), [piece[0]], [piece[-1]]
            while len(parts) > 1 and self._merge_best(parts):
                if parts[0] != starts[-1]:
                    starts.append(parts[0])
                if parts[-1] != ends[-1]:
                    ends.append(parts[-1])
            known = self.grown[piece] = (starts, ends) if len(parts) == 1 else None
        return known

    def _merge_best(self, parts: list[str]) -> bool:
        """One byte-pair merge: the best scored pair, the leftmost of equals."""
        best = None
        for i in range(len(parts) - 1):
            pair = parts[i] + parts[i + 1]
            if pair in self.v.ids and (best is None or self.v.scores[pair] > best[0]):
                best = (self.v.scores[pair], i)
        if best is not None:
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return best is not None


def encode_texts(texts: list[str], v: Vocabulary, encoder: PrefixEncoder, known: dict[str, bytes],
                 pattern: re.Pattern) -> Iterator[np.ndarray]:
    """Ids of each text of a lot; ``known`` holds words encoded before."""
    split = [pattern.findall(v.marked(t)) for t in texts]
    words = {w for row in split for w in row}
    fresh = [w for w in words if w not in known]
    if len(known) + len(fresh) > REMEMBER:
        known.clear()
        fresh = list(words)
    known.update(encoder.encode(fresh))
    for row in split:
        yield np.frombuffer(b"".join(map(known.__getitem__, row)), np.int32)
    for word in fresh:
        if len(word) > LONG:
            del known[word]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
           check: bool = False) -> DataFrame:
    """(id, ``ids``) of every row, and with ``check`` ``round_trip``: whether decoding gives the text again.

    Whole texts are encoded, in lots of bounded size.  NULL and empty texts
    have no ids; NULL stays NULL under ``check``.  The only texts that do not
    come back are those that hold the mark U+2581 itself (it decodes to a
    space) or, without byte fallback, unknown characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known, pattern = PrefixEncoder(vocabulary), {}, re.compile(vocabulary.words)

        def answer(keys, texts):
            lists = list(encode_texts([t or "" for t in texts], vocabulary, encoder, known, pattern))
            same = [None if t is None else vocabulary.text_of(i) == t for t, i in zip(texts, lists)] if check else []
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
            columns = [pa.concat_arrays(keys), ids] + [pa.array(same, pa.bool_())] * check
            return pa.record_batch(columns, ["id", "ids"] + ["round_trip"] * check)

        for batch in batches:
            at = size = 0
            texts: list = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                texts.append(text)
                size += len(text or "") + 1
                if size >= LOT or i == batch.num_rows - 1:
                    yield answer([batch.column(0).slice(at, i + 1 - at)], texts)
                    at, size, texts = i + 1, 0, []

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, ids array<int>" + ", round_trip boolean" * check)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ``text``) of every row of ids; NULL ids give NULL, none the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not x.is_valid else vocabulary.text_of(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, f"id {kind}, text string").select(
        F.col("id").alias(id_col), "text")
