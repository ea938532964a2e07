"""A character-level bidirectional LSTM with CRF transitions, forward and backward in numpy.

All sequences of a batch have one length; shorter texts are padded with blanks tagged as outside.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class BiLstmCrf:
    """``scores``: emissions; ``fit``: Adam on the CRF's log likelihood; ``decode``: Viterbi path with marginals."""

    def __init__(self, n_symbols: int, n_tags: int, width: int = 8, hidden: int = 16, seed: int = 11, kind: type = np.float64):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"embed": rng.normal(0, 0.5, (n_symbols, width)), "out": draw(2 * hidden, n_tags), "out_b": np.zeros(n_tags), "trans": np.zeros((n_tags, n_tags)), "first": np.zeros(n_tags), "last": np.zeros(n_tags)}
        for side in ("f", "b"):
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            self.p |= {f"{side}_x": draw(width, 4 * hidden), f"{side}_h": draw(hidden, 4 * hidden), f"{side}_b": bias}
        self.p = {n: v.astype(kind) for n, v in self.p.items()}

    def _lstm(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """x is time, batch, width; gates are input, forget, output, candidate."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), x.dtype)
        c, w, out, steps = np.zeros_like(h), self.p[f"{side}_h"], np.empty((*x.shape[:2], self.hidden), x.dtype), []
        entered = x @ self.p[f"{side}_x"] + self.p[f"{side}_b"]
        for t in range(len(x)):
            z = entered[t] + h @ w
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, prior = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep:
                steps.append((i, f, o, g, before, squashed, prior))
        return out, steps

    def _forward(self, ids: np.ndarray, keep: bool = False):
        x = self.p["embed"][ids.T]
        f, fs = self._lstm(x, "f", keep)
        b, bs = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], 2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, fs, bs)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self._forward(ids)[0]

    def _alphas(self, e: np.ndarray) -> np.ndarray:
        a = np.empty_like(e)
        a[0] = self.p["first"] + e[0]
        for t in range(1, len(e)):
            a[t] = _lse(a[t - 1][:, :, None] + self.p["trans"], 1) + e[t]
        return a

    def _betas(self, e: np.ndarray) -> np.ndarray:
        b = np.empty_like(e)
        b[-1] = self.p["last"]
        for t in range(len(e) - 2, -1, -1):
            b[t] = _lse(self.p["trans"] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        return b

    def _back(self, d_out: np.ndarray, x: np.ndarray, steps: list, side: str, grads: dict) -> np.ndarray:
        w, n = self.p[f"{side}_h"], self.hidden
        dh, dc, dz_all = np.zeros(d_out.shape[1:], x.dtype), np.zeros(d_out.shape[1:], x.dtype), np.empty((*d_out.shape[:2], 4 * n), x.dtype)
        dw = np.zeros_like(w)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, squashed, prior = steps[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 1)
            dw += prior.T @ dz
            dh, dc, dz_all[t] = dz @ w.T, dc * f, dz
        flat = dz_all.reshape(-1, 4 * n)
        grads[f"{side}_h"], grads[f"{side}_b"], grads[f"{side}_x"] = dw, flat.sum(0), x.reshape(-1, x.shape[2]).T @ flat
        return dz_all @ self.p[f"{side}_x"].T

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a batch, and its gradients."""
        e, (x, both, fs, bs) = self._forward(ids, True)
        steps, batch, k = e.shape
        a, b, y, rows = self._alphas(e), self._betas(e), tags.T, np.arange(batch)
        whole = _lse(a[-1] + self.p["last"], 1)
        gold = self.p["first"][y[0]] + self.p["last"][y[-1]] + np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + self.p["trans"][y[:-1], y[1:]].sum(0)
        marginal = np.exp(a + b - whole[None, :, None])
        de = marginal.copy()
        de[np.arange(steps)[:, None], rows, y] -= 1
        de /= batch
        pairs = np.zeros((k, k), e.dtype)
        for t in range(steps - 1):
            pairs += np.exp(a[t][:, :, None] + self.p["trans"] + (e[t + 1] + b[t + 1])[:, None, :] - whole[:, None, None]).sum(0)
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        g = {"trans": pairs / batch, "first": de[0].sum(0), "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, k), "out_b": de.sum((0, 1))}
        last = marginal[-1].sum(0)
        np.subtract.at(last, y[-1], 1)
        g["last"] = last / batch
        d_both = de @ self.p["out"].T
        dx = self._back(d_both[:, :, : self.hidden], x, fs, "f", g)
        dx = dx + self._back(d_both[::-1, :, self.hidden :], x[::-1], bs, "b", g)[::-1]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids.T, dx)
        return float((whole - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        rng, moments, k, losses = np.random.default_rng(seed), {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in self.p.items()}, 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(ids)), 0.0
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                value, grads = self.loss(ids[rows], tags[rows])
                norm = np.sqrt(sum((v**2).sum() for v in grads.values()))
                k, total = k + 1, total + value * len(rows)
                clip = min(1.0, 50.0 / (norm + 1e-9))
                step = rate * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
                for n, v in grads.items():
                    m, s = moments[n]
                    v = v * clip
                    m += 0.1 * (v - m)
                    s += 0.001 * (v * v - s)
                    self.p[n] -= (step * m / (np.sqrt(s) + 1e-8)).astype(v.dtype)
            losses.append(total / max(1, len(order)))
        return losses

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags and their marginal probabilities, batch by time."""
        e = self.scores(ids)
        a, b = self._alphas(e), self._betas(e)
        marginal = np.exp(a + b - _lse(a[-1] + self.p["last"], 1)[None, :, None])
        best, back = self.p["first"] + e[0], []
        for t in range(1, len(e)):
            step = best[:, :, None] + self.p["trans"]
            back.append(step.argmax(1))
            best = step.max(1) + e[t]
        path = [(best + self.p["last"]).argmax(1)]
        rows = np.arange(ids.shape[0])
        for pointers in reversed(back):
            path.append(pointers[rows, path[-1]])
        tags = np.stack(path[::-1], 1)
        return tags, np.take_along_axis(marginal, tags.T[:, :, None], 2)[:, :, 0].T
