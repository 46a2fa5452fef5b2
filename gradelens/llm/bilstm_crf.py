"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Inputs are character classes, so the embedding is a row of the input weights.
Everything runs on batches of windows of equal length: ``emissions`` scores the
tags of every character, ``decode`` is Viterbi with the learned transitions.
"""
from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    def __init__(self, classes: int, tags: int, hidden: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.tags = h, tags
        self.p = {"out": rng.normal(0, 0.2, (2 * h, tags)), "bias": np.zeros(tags), "trans": np.zeros((tags, tags)), "start": np.zeros(tags)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (classes, 4 * h))
            self.p["h" + d] = rng.normal(0, 0.3, (h, 4 * h))
            self.p["x" + d][:, h:2 * h] += 1.0                      # forget gates begin open

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction for windows ``x`` (n, t); with the gates when they are needed again."""
        n, t = x.shape
        h, wx, wh = self.hidden, self.p["x" + d], self.p["h" + d]
        states, cells, gates = np.zeros((t, n, h)), np.zeros((t, n, h)), np.zeros((t, n, 4 * h)) if keep else None
        hid, cell = np.zeros((n, h)), np.zeros((n, h))
        for i in range(t):
            a = wx[x[:, i]] + hid @ wh
            s = _sigmoid(a[:, :3 * h])
            g = np.tanh(a[:, 3 * h:])
            cell = s[:, h:2 * h] * cell + s[:, :h] * g
            hid = s[:, 2 * h:] * np.tanh(cell)
            states[i], cells[i] = hid, cell
            if keep:
                gates[i, :, :3 * h], gates[i, :, 3 * h:] = s, g
        return states, cells, gates

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (n, t, tags)."""
        f = self._run(x, "f", False)[0]
        b = self._run(x[:, ::-1], "b", False)[0][::-1]
        return (np.concatenate([f, b], 2) @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def _back(self, x: np.ndarray, d: str, kept, grad: np.ndarray, out: dict) -> None:
        states, cells, gates = kept
        t, n, h = states.shape
        wh = self.p["h" + d]
        gx, gh = np.zeros_like(self.p["x" + d]), np.zeros_like(wh)
        dh, dc = np.zeros((n, h)), np.zeros((n, h))
        for i in range(t - 1, -1, -1):
            dh = dh + grad[i]
            s, g = gates[i, :, :3 * h], gates[i, :, 3 * h:]
            tc = np.tanh(cells[i])
            dc = dc + dh * s[:, 2 * h:] * (1 - tc * tc)
            before = cells[i - 1] if i else np.zeros((n, h))
            da = np.concatenate([dc * g, dc * before, dh * tc], 1) * s * (1 - s)
            da = np.concatenate([da, dc * s[:, :h] * (1 - g * g)], 1)
            np.add.at(gx, x[:, i], da)
            if i:
                gh += states[i - 1].T @ da
            dh, dc = da @ wh.T, dc * s[:, h:2 * h]
        out["x" + d], out["h" + d] = gx, gh

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tag sequences ``y`` and its gradients."""
        n, t = x.shape
        f, b = self._run(x, "f", True), self._run(x[:, ::-1], "b", True)
        states = np.concatenate([f[0], b[0][::-1]], 2)
        e = states @ self.p["out"] + self.p["bias"]                 # t, n, tags
        trans, start = self.p["trans"], self.p["start"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for i in range(1, t):
            alpha[i] = _lse(alpha[i - 1][:, :, None] + trans, 1) + e[i]
        for i in range(t - 2, -1, -1):
            beta[i] = _lse(trans + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        rows = np.arange(n)
        gold = start[y[:, 0]] + e[0, rows, y[:, 0]]
        for i in range(1, t):
            gold = gold + trans[y[:, i - 1], y[:, i]] + e[i, rows, y[:, i]]
        de = np.exp(alpha + beta - z[:, None])
        g = {"start": de[0].sum(0), "trans": np.zeros_like(trans)}
        for i in range(1, t):
            g["trans"] += np.exp(alpha[i - 1][:, :, None] + trans + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(g["trans"], (y[:, i - 1], y[:, i]), -1)
        np.add.at(g["start"], y[:, 0], -1)
        for i in range(t):
            de[i, rows, y[:, i]] -= 1
        g["out"] = np.tensordot(states, de, ((0, 1), (0, 1)))
        g["bias"] = de.sum((0, 1))
        ds = de @ self.p["out"].T
        h = self.hidden
        self._back(x, "f", f, ds[:, :, :h], g)
        self._back(x[:, ::-1], "b", b, ds[::-1, :, h:], g)
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 48, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam on random batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            loss, g = self.loss(x[at], y[at])
            losses.append(loss)
            now = rate * (1 - i / (steps + 1))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                self.p[k] -= now * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.999 ** i)) + 1e-8)
        return losses

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag sequences of padded emissions (n, t, tags)."""
        n, t, k = e.shape
        trans = self.p["trans"]
        back = np.zeros((t, n, k), np.int8)
        v = self.p["start"] + e[:, 0]
        for i in range(1, t):
            way = v[:, :, None] + trans
            live = (i < lengths)[:, None]
            back[i] = np.where(live, way.argmax(1), np.arange(k))
            v = np.where(live, way.max(1) + e[:, i], v)
        out = np.zeros((n, t), np.int64)
        out[:, -1] = v.argmax(1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[i, np.arange(n), out[:, i]]
        return out
