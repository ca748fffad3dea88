"""A gated recurrent language model in numpy: class-factored softmax, truncated
backpropagation through time, and state carried across windows of a document.

Symbols are ``top`` frequent words, then one symbol per class of the remaining words. The
output is a distribution over classes and, for a class of frequent words, one over its
members; what a rarer word has inside its class is not the network's business.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _exps(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of augmented states, and their exponentials less a common factor that only
    large weights need: |state| <= 1 bounds a logit by its weights' absolute sum."""
    x = rows @ weights
    if np.abs(weights).sum(axis=0).max() > 60:
        x -= x.max(axis=1, keepdims=True)
    return x, np.exp(x)


class GRU:
    """``weight``: training counts of the symbols, from which the output starts."""

    def __init__(self, top: int, members: int, weight: np.ndarray, hidden: int, seed: int = 0):
        self.top, self.members, self.h = top, members, hidden
        self.groups = top // members
        self.start = len(weight)  # the symbol before a document
        rng, f = np.random.default_rng(seed), np.float32
        of_class = np.concatenate([weight[:top].reshape(self.groups, members).sum(axis=1), weight[top:]])
        own = weight[:top].reshape(self.groups, 1, members)
        self.p = {
            "e": (rng.standard_normal((self.start + 1, 3 * hidden)) * 0.1).astype(f),
            "u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden) * 0.5).astype(f),
            # The last row of either is the bias; a state has a 1 for it.
            "wc": np.vstack([rng.standard_normal((hidden, len(of_class))) * 0.05, np.log(of_class / of_class.sum())]).astype(f),
            "ww": np.concatenate([rng.standard_normal((self.groups, hidden, members)) * 0.05, np.log(own / own.sum(axis=2, keepdims=True))], axis=1).astype(f),
        }
        self.moments = None

    # Parameters as one vector, for averaging.
    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, v: np.ndarray) -> "GRU":
        at = 0
        for k, x in self.p.items():
            self.p[k] = v[at:at + x.size].reshape(x.shape).astype("f4")
            at += x.size
        self.moments = None
        return self

    def steps(self, xs: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, tape: list | None = None) -> np.ndarray:
        """States, with a 1 behind, after each row of symbols ``xs`` (T, B); ``fresh``: where a
        document begins."""
        n, u, out = self.h, self.p["u"], np.ones((*xs.shape, self.h + 1), "f4")
        given = np.take(self.p["e"], xs, axis=0)
        for t in range(len(xs)):
            if fresh is not None:
                h = h * ~fresh[t][:, None]
            hu = h @ u
            gates = _sigmoid(given[t, :, : 2 * n] + hu[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(given[t, :, 2 * n:] + r * hu[:, 2 * n:])
            if tape is not None:
                tape.append((h, z, r, c, hu[:, 2 * n:]))
            h = c + z * (h - c)
            out[t, :, :n] = h
        return out

    def _by_group(self, ys: np.ndarray):
        """Positions of frequent words by their class."""
        at = np.flatnonzero(ys < self.top)
        group = ys[at] // self.members
        at = at[np.argsort(group, kind="stable")]
        ends = np.searchsorted(ys[at] // self.members, np.arange(self.groups + 1))
        return [(g, at[ends[g]:ends[g + 1]]) for g in range(self.groups) if ends[g] < ends[g + 1]]

    def classes(self, ys: np.ndarray) -> np.ndarray:
        return np.where(ys < self.top, ys // self.members, ys - self.top + self.groups)

    def log_probs(self, hs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Natural log probabilities of symbols ``ys`` after (augmented) states ``hs``."""
        ones = np.ones(max(self.members, self.p["wc"].shape[1]), "f4")
        x, e = _exps(hs, self.p["wc"])
        out = x[np.arange(len(ys)), self.classes(ys)].astype("f8") - np.log(e @ ones[: e.shape[1]])
        for g, at in self._by_group(ys):
            x, e = _exps(hs[at], self.p["ww"][g])
            out[at] += x[np.arange(len(at)), ys[at] % self.members] - np.log(e @ ones[: e.shape[1]])
        return out

    @staticmethod
    def _error(rows: np.ndarray, weights: np.ndarray, target: np.ndarray, size: np.float32) -> np.ndarray:
        """The loss's gradient by the logits."""
        _, d = _exps(rows, weights)
        d *= (1 / (size * (d @ np.ones(d.shape[1], "f4"))))[:, None]
        d[np.arange(len(target)), target] -= 1 / size
        return d

    def train_window(self, xs: np.ndarray, ys: np.ndarray, fresh: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One update on a window (T, B); returns the state after it."""
        T, B, n, p, tape = *xs.shape, self.h, self.p, []
        hs = self.steps(xs, h, fresh, tape)
        flat, y, size = hs.reshape(-1, n + 1), ys.ravel(), np.float32(xs.size)
        d = self._error(flat, p["wc"], self.classes(y), size)
        g = {"wc": flat.T @ d, "ww": np.zeros_like(p["ww"])}
        dh = d @ p["wc"][:n].T
        for k, at in self._by_group(y):
            own = flat[at]
            d = self._error(own, p["ww"][k], y[at] % self.members, size)
            g["ww"][k] = own.T @ d
            dh[at] += d @ p["ww"][k][:n].T
        dh = dh.reshape(T, B, n)
        back, u, du, given = np.zeros((B, n), "f4"), p["u"], np.zeros_like(p["u"]), np.empty((T, B, 3 * n), "f4")
        for t in range(T - 1, -1, -1):
            before, z, r, c, hc = tape[t]
            dt = dh[t] + back
            away = dt * (1 - z)
            dc = away * (1 - c * c)
            through = np.empty((B, 3 * n), "f4")
            np.multiply(away * z, before - c, out=through[:, :n])
            np.multiply(dc * hc, r * (1 - r), out=through[:, n:2 * n])
            np.multiply(dc, r, out=through[:, 2 * n:])
            given[t, :, : 2 * n], given[t, :, 2 * n:] = through[:, : 2 * n], dc
            du += before.T @ through
            back = (dt * z + through @ u.T) * ~fresh[t][:, None]
        g["u"] = du
        order = np.argsort(xs.ravel(), kind="stable")
        used, first = np.unique(xs.ravel()[order], return_index=True)
        g["e"] = np.zeros_like(p["e"])
        g["e"][used] = np.add.reduceat(given.reshape(-1, 3 * n)[order], first, axis=0)
        self._update(g, rate)
        return hs[-1, :, :n]

    def _update(self, g: dict[str, np.ndarray], rate: float) -> None:
        """Adam, with the whole gradient's norm held at 1."""
        if self.moments is None:
            self.moments, self.count = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}, 0
        self.count += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = np.float32(min(1, 1 / max(norm, 1e-12)))
        for k, x in g.items():
            x = x * scale
            m, v = self.moments[k]
            m += (x - m) * np.float32(0.1)
            v += (x * x - v) * np.float32(0.01)
            self.p[k] = self.p[k] - np.float32(rate) * (m / np.float32(1 - 0.9**self.count)) / (
                np.sqrt(v / np.float32(1 - 0.99**self.count)) + np.float32(1e-6))

    def train(self, docs: list[np.ndarray], rate: float, window: int = 16, width: int = 256) -> int:
        """One pass over documents laid end to end in ``width`` streams; returns the symbols read."""
        y = np.concatenate(docs).astype("i8")
        fresh = np.zeros(len(y), bool)
        fresh[np.cumsum([0] + [len(d) for d in docs[:-1]])] = True
        x = np.where(fresh, self.start, np.concatenate([[0], y[:-1]]))
        width = int(max(1, min(width, len(y) // (4 * window))))
        per = len(y) // width
        # The symbols over an even number of streams' length go to one more, shorter, stream.
        for lo, n, b in ((0, per, width), (per * width, len(y) - per * width, 1)):
            if not n:
                continue
            cut = slice(lo, lo + n * b)
            xs, ys, fs = (a[cut].reshape(b, n).T for a in (x, y, fresh))
            h = np.zeros((b, self.h), "f4")
            for t in range(0, n, window):
                h = self.train_window(xs[t:t + window], ys[t:t + window], fs[t:t + window], h, rate)
        return len(y)

    def score(self, docs: list[np.ndarray], cells: int = 16_384) -> np.ndarray:
        """Natural log probability of each whole document, all read in step: the state goes
        from window to window, and a document leaves when it ends."""
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        out, h, at = np.zeros(len(docs)), np.zeros((len(docs), self.h), "f4"), 0
        last = np.full(len(docs), self.start)
        ends = sizes[order]
        flat, first = np.concatenate(docs).astype("i8"), np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
        while True:
            n = int(np.searchsorted(-ends, -at, "left"))  # documents longer than ``at``
            if not n:
                return out
            T = int(min(max(1, cells // n), 64, ends[n - 1] - at))
            ys = flat[first[:n][None, :] + at + np.arange(T)[:, None]]
            xs = np.concatenate([last[None, :n], ys[:-1]])
            hs = self.steps(xs, h[:n])
            lp = self.log_probs(hs.reshape(-1, self.h + 1), ys.ravel()).reshape(T, n)
            out[order[:n]] += lp.sum(axis=0)
            h, last, at = hs[-1, :, : self.h], ys[-1], at + T
