"""A bidirectional gated recurrent network with attention pooling, in numpy: forward pass, gradients and Adam.

A step's input is a word's vector beside the mean vector of its character trigrams. As inputs don't depend on their
neighbours, their products with the input weights are made once for each distinct word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 8, 4096
#: Words in a window, and between the starts of two windows.
WINDOW, STRIDE = 24, 8


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character trigrams of all words, each between marks, and how many each word has."""
    text = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([max(len(w), 1) for w in words])
    first = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])[:-1]])
    at = np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    at2 = np.minimum(at + 2, len(c) - 1)  # only the empty word has less than three characters between its marks
    h = (c[at] * np.uint32(0x9E3779B1)) ^ (c[at + 1] * np.uint32(0x85EBCA6B)) ^ (c[at2] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(20)).astype(np.int32), sizes


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows with equal `at`, 0 to n - 1."""
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], 1).astype(np.float32)


@dataclass
class Network:
    """words: the vocabulary, of which row 0 of `word` stands for any other word. p: arrays by name; each direction d has
    w_d (input by 3 gates), b_d, u_d (state by update and reset gate), n_d (state by candidate). The update and reset
    gates are 1 / (1 + exp(x)), so their weights have the opposite of the usual sign."""

    words: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, words: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, k=None: (rng.standard_normal(s) * (k or 1 / np.sqrt(s[0]))).astype(np.float32)
        p = {"word": draw(len(words) + 1, WORD_DIM, k=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, k=0.1), "att": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"w_{d}": draw(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"b_{d}": np.zeros(3 * HIDDEN, np.float32), f"u_{d}": draw(HIDDEN, 2 * HIDDEN), f"n_{d}": draw(HIDDEN, HIDDEN)}
        return cls(words, p)

    def chars(self, words: list[str]) -> np.ndarray:
        """The mean trigram vector of each word."""
        found, sizes = trigrams(words)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.p["char"][found], starts, axis=0) / sizes[:, None].astype(np.float32)

    def inputs(self, words: list[str], known: bool = False) -> np.ndarray:
        """What a word adds to the gates of both directions. known: the words are the vocabulary in order."""
        if not words:
            return np.empty((0, 6 * HIDDEN), np.float32)
        p = self.p
        own = p["word"][1:] if known else np.broadcast_to(p["word"][0], (len(words), WORD_DIM))
        x = np.concatenate([own, self.chars(words)], 1)
        return np.concatenate([x @ p["w_f"] + p["b_f"], x @ p["w_b"] + p["b_b"]], 1).astype(np.float32)

    @staticmethod
    def pad() -> np.ndarray:
        """The row of no word: a closed update gate, so the state passes by."""
        row = np.zeros((1, 6 * HIDDEN), np.float32)
        row[0, :HIDDEN] = row[0, 3 * HIDDEN : 4 * HIDDEN] = -80
        return row

    def states(self, rows: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States of both directions at each step: steps by windows by 2 HIDDEN. ids: windows by steps, rows of `rows`."""
        n, steps, h_ = len(ids), ids.shape[1], HIDDEN
        out = np.empty((steps, n, 2 * h_), np.float32)
        columns = np.ascontiguousarray(ids.T)
        states = [np.zeros((n, h_), np.float32) for _ in "fb"]
        for k, d in enumerate("fb"):
            u, c, h = self.p[f"u_{d}"], self.p[f"n_{d}"], states[k]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x = rows[columns[t], 3 * h_ * k : 3 * h_ * (k + 1)]
                gate = h @ u
                gate += x[:, : 2 * h_]
                np.minimum(gate, 80, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                z, r = gate[:, :h_], gate[:, h_:]
                hc = h @ c
                cand = r * hc
                cand += x[:, 2 * h_ :]
                np.tanh(cand, out=cand)
                if keep is not None:
                    keep[d, t] = (h, z, r, hc, cand)
                h = h - cand
                h *= z
                h += cand
                out[t, :, h_ * k : h_ * (k + 1)] = h
        return out

    def pooled(self, states: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The attention of each step, and the pooled states. empty: steps by windows, true where there is no word."""
        e = states @ self.p["att"]
        e[empty] = -1e9
        e -= e.max(0)
        np.exp(e, out=e)
        e /= e.sum(0)
        return e, np.einsum("tn,tnh->nh", e, states)

    def logits(self, rows: np.ndarray, ids: np.ndarray, pad: int, at_once: int = 2048) -> np.ndarray:
        """The logit of each window; `pad` is the row of no word."""
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), at_once):
            part = ids[i : i + at_once]
            _, pooled = self.pooled(self.states(rows, part), part.T == pad)
            out[i : i + at_once] = pooled @ self.p["out"] + self.p["bias"]
        return out

    def gradients(self, word: np.ndarray, chars: tuple[np.ndarray, np.ndarray], spread: np.ndarray, y: np.ndarray, empty: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch. word: windows by steps, rows of the word vectors; chars: trigrams of the
        distinct words; spread: windows by steps, rows of `chars`; empty: windows by steps."""
        p, h_, (n, steps) = self.p, HIDDEN, word.shape
        flat, sizes = chars
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(p["char"][flat], starts, axis=0) / sizes[:, None]
        x = np.concatenate([p["word"][word], mean[spread]], 2).reshape(n * steps, -1)
        gates = np.concatenate([x @ p["w_f"] + p["b_f"], x @ p["w_b"] + p["b_b"]], 1).astype(np.float32)
        gates[empty.reshape(-1)] = self.pad()
        keep: dict = {}
        states = self.states(gates, np.arange(n * steps).reshape(n, steps), keep)
        att, pooled = self.pooled(states, empty.T)
        logit = pooled @ p["out"] + p["bias"]
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(-(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)).mean())
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = ((prob - y) / n).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_att = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = att * (d_att - (att * d_att).sum(0))
        g["att"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = att[:, :, None] * d_pooled + d_e[:, :, None] * p["att"]
        d_gates = np.zeros((n, steps, 6 * h_), np.float32)
        for k, d in enumerate("fb"):
            u, c = p[f"u_{d}"], p[f"n_{d}"]
            back = np.zeros((n, h_), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, z, r, hc, cand = keep[d, t]
                dh = back + d_states[t, :, h_ * k : h_ * (k + 1)]
                d_cand = dh * (1 - z) * (1 - cand * cand)
                d_z = dh * (cand - h) * z * (1 - z)
                d_r = -d_cand * hc * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], 1)
                d_hc = d_cand * r
                g[f"u_{d}"] += h.T @ d_zr
                g[f"n_{d}"] += h.T @ d_hc
                back = dh * z + d_zr @ u.T + d_hc @ c.T
                d_gates[:, t, 3 * h_ * k : 3 * h_ * (k + 1)] = np.concatenate([d_zr, d_cand], 1)
        d_gates[empty] = 0
        flat_gates = d_gates.reshape(n * steps, -1)
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            part = flat_gates[:, 3 * h_ * k : 3 * h_ * (k + 1)]
            g[f"w_{d}"], g[f"b_{d}"] = x.T @ part, part.sum(0)
            d_x += part @ p[f"w_{d}"].T
        g["word"] = summed(d_x[:, :WORD_DIM], word.reshape(-1), len(p["word"]))
        d_mean = summed(d_x[:, WORD_DIM:], spread.reshape(-1), len(sizes)) / sizes[:, None]
        g["char"] = summed(np.repeat(d_mean, sizes, axis=0), flat, CHAR_BUCKETS)
        return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            self.p[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)
