"""A character tagger in numpy: bidirectional LSTM, and a CRF over its tags."""

from __future__ import annotations

import numpy as np

PAD, SPACE, LETTER, OTHER = 0, 96, 97, 98
SYMBOLS = 99
FORBIDDEN = -1e4


def encode(text: str, width: int) -> np.ndarray:
    """Symbols of a window: printable ASCII apart, other white space, letters and the rest as one each; padded."""
    out = np.zeros(width, np.int64)
    for i, c in enumerate(text[:width]):
        code = ord(c)
        out[i] = code - 31 if 32 <= code < 127 else SPACE if c.isspace() else LETTER if c.isalpha() else OTHER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * x.dtype.type(0.5))
    x += 1
    x *= x.dtype.type(0.5)
    return x


class Tagger:
    """Tags are 0 (outside) and, for each kind k from 0, 1 + 2k (its first character) and 2 + 2k (the others)."""

    def __init__(self, kinds: int, embed: int = 12, hidden: int = 16, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = 1 + 2 * kinds, hidden
        bias = np.zeros((2, 1, 4 * hidden))
        bias[..., hidden:2 * hidden] = 1.0  # gates in the order input, forget, output, candidate
        self.p = {"embed": rng.normal(0, 0.3, (SYMBOLS, embed)), "in": rng.normal(0, 0.25, (2, embed, 4 * hidden)),
                  "loop": rng.normal(0, 0.25, (2, hidden, 4 * hidden)), "bias": bias,
                  "out": rng.normal(0, 0.25, (2, hidden, self.tags)), "out_bias": np.zeros(self.tags),
                  "move": np.zeros((self.tags, self.tags)), "start": np.zeros(self.tags)}
        inner = np.arange(2, self.tags, 2)
        self.ban = np.zeros((self.tags, self.tags))
        self.ban[:, inner] = FORBIDDEN
        self.ban[inner, inner] = 0
        self.ban[inner - 1, inner] = 0
        self.ban_start = np.where(np.isin(np.arange(self.tags), inner), FORBIDDEN, 0.0)

    # -- the LSTM -----------------------------------------------------------------------
    def emissions(self, x: np.ndarray, keep: bool = False):
        """Scores of tags, [window, position, tag]; with ``keep`` also what the backward pass needs."""
        p, h = self.p, self.hidden
        n, width = x.shape
        seq = p["embed"][x]
        seq = np.stack([seq, seq[:, ::-1]])
        pre = (seq.reshape(2, n * width, -1) @ p["in"] + p["bias"]).reshape(2, n, width, 4 * h)
        kind = p["embed"].dtype
        state, cell = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind)
        hs = np.empty((2, n, width, h), kind)
        kept = []
        for t in range(width):
            gates = pre[:, :, t] + state @ p["loop"]
            ifo, cand = _sigmoid(gates[..., :3 * h]), np.tanh(gates[..., 3 * h:])
            before, last = cell, state
            cell = ifo[..., h:2 * h] * cell + ifo[..., :h] * cand
            squashed = np.tanh(cell)
            state = ifo[..., 2 * h:] * squashed
            hs[:, :, t] = state
            if keep:
                kept.append((ifo, cand, before, squashed, last))
        out = hs[0] @ p["out"][0] + hs[1][:, ::-1] @ p["out"][1] + p["out_bias"]
        return (out, (x, seq, hs, kept)) if keep else out

    def _backward(self, d_out: np.ndarray, saved) -> dict[str, np.ndarray]:
        p, h = self.p, self.hidden
        x, seq, hs, kept = saved
        n, width = x.shape
        turned = np.stack([hs[0], hs[1][:, ::-1]])
        g = {"out": np.stack([np.einsum("nth,ntk->hk", turned[k], d_out) for k in (0, 1)]),
             "out_bias": d_out.sum((0, 1))}
        d_hs = np.stack([d_out @ p["out"][0].T, (d_out @ p["out"][1].T)[:, ::-1]])
        d_pre = np.empty((2, n, width, 4 * h), hs.dtype)
        d_loop = np.zeros_like(p["loop"])
        d_state, d_cell = np.zeros((2, n, h), hs.dtype), np.zeros((2, n, h), hs.dtype)
        for t in range(width - 1, -1, -1):
            ifo, cand, before, squashed, last = kept[t]
            i, f, o = ifo[..., :h], ifo[..., h:2 * h], ifo[..., 2 * h:]
            d_state = d_state + d_hs[:, :, t]
            d_cell = d_cell + d_state * o * (1 - squashed ** 2)
            d_gates = np.concatenate([d_cell * cand * i * (1 - i), d_cell * before * f * (1 - f),
                                      d_state * squashed * o * (1 - o), d_cell * i * (1 - cand ** 2)], -1)
            d_pre[:, :, t] = d_gates
            d_loop += last.transpose(0, 2, 1) @ d_gates
            d_state, d_cell = d_gates @ p["loop"].transpose(0, 2, 1), d_cell * f
        flat = d_pre.reshape(2, n * width, 4 * h)
        g["loop"], g["bias"] = d_loop, flat.sum(1, keepdims=True)
        g["in"] = seq.reshape(2, n * width, -1).transpose(0, 2, 1) @ flat
        d_seq = (flat @ p["in"].transpose(0, 2, 1)).reshape(seq.shape)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x, d_seq[0] + d_seq[1][:, ::-1])
        return g

    # -- the CRF ------------------------------------------------------------------------
    def _moves(self) -> tuple[np.ndarray, np.ndarray]:
        return self.p["move"] + self.ban, self.p["start"] + self.ban_start

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags ``y`` and its gradient."""
        out, saved = self.emissions(x, keep=True)
        n, width, k = out.shape
        move, start = self._moves()
        # Forward and backward sums as shares of their total at every place, so that no logarithm is needed on the way.
        top = out.max(2, keepdims=True)
        bonus, step = np.exp(out - top).transpose(1, 0, 2), np.exp(move)
        ahead, back, scale = np.empty_like(bonus), np.empty_like(bonus), np.empty((width, n, 1), out.dtype)
        share = np.exp(start) * bonus[0]
        for t in range(width):
            if t:
                share = (ahead[t - 1] @ step) * bonus[t]
            scale[t] = share.sum(1, keepdims=True)
            ahead[t] = share / scale[t]
        back[-1] = 1
        for t in range(width - 2, -1, -1):
            back[t] = (bonus[t + 1] * back[t + 1] / scale[t + 1]) @ step.T
        total = np.log(scale).sum((0, 2)) + top.sum((1, 2))
        rows, hot = np.arange(n), np.zeros((n, width, k), out.dtype)
        np.put_along_axis(hot, y[:, :, None], 1.0, 2)
        gold = (out * hot).sum((1, 2)) + start[y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(1)
        share = (ahead * back).transpose(1, 0, 2)
        d_out = (share - hot) / n
        later = (bonus[1:] * back[1:] / scale[1:]).reshape(-1, k)
        d_move = (ahead[:-1].reshape(-1, k).T @ later) * step
        np.subtract.at(d_move, (y[:, :-1], y[:, 1:]), 1.0)
        g = self._backward(d_out, saved)
        g["move"], g["start"] = d_move / n, (share[:, 0].sum(0) - np.bincount(y[rows, 0], minlength=k)) / n
        return float((total - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02,
            seed: int = 42) -> list[float]:
        """Adam with a falling rate and clipped gradients, in single precision; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.ban, self.ban_start = self.ban.astype(np.float32), self.ban_start.astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, seen = rng.permutation(len(x)), []
            for at in range(0, len(x), batch):
                rows = order[at:at + batch]
                value, g = self.loss(x[rows], y[rows])
                seen.append(value)
                norm = np.sqrt(sum((v * v).sum() for v in g.values()))
                step += 1
                now = rate * (1 - epoch / epochs) ** 0.5
                for k, v in g.items():
                    v = v.astype(np.float32) * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    moved = now * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
                    self.p[k] -= moved.astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest tags of each window (Viterbi), and at each place their score above that of tag 0."""
        out = self.emissions(x)
        n, width, k = out.shape
        move, start = self._moves()
        best, came = start + out[:, 0], np.empty((width, n, k), np.int64)
        for t in range(1, width):
            steps = best[:, :, None] + move
            came[t] = steps.argmax(1)
            best = steps.max(1) + out[:, t]
        tags = np.empty((n, width), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = came[t][np.arange(n), tags[:, t]]
        return tags, np.take_along_axis(out, tags[:, :, None], 2)[:, :, 0] - out[:, :, 0]
