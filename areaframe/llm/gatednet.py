"""A gated recurrent net over word classes in numpy: windows, truncated backpropagation, Adam.

The state before a token gives its class (softmax), and for classes with weights of their
own the word inside the class (a second softmax). Many documents run side by side in
lanes; a lane takes one document after the other and its state is emptied between them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass(frozen=True)
class Shape:
    inputs: int
    classes: int
    learnt: int
    words: int
    hidden: int = 16

    def empty(self) -> dict[str, np.ndarray]:
        h = self.hidden
        rng = np.random.default_rng(11)

        def small(*size):
            return (rng.standard_normal(size) * 0.1).astype(F32)

        return {
            "E": small(self.inputs, 2 * h), "Uf": small(h, h), "Uc": small(h, h),
            "Wc": small(h, self.classes), "bc": np.zeros(self.classes, F32),
            "Ww": small(self.learnt, h, self.words), "bw": np.zeros((self.learnt, self.words), F32),
        }

    def pack(self, params: dict[str, np.ndarray]) -> bytes:
        return b"".join(params[k].astype(F32).tobytes() for k in self.empty())

    def unpack(self, data: bytes) -> dict[str, np.ndarray]:
        flat, out, at = np.frombuffer(data, F32), {}, 0
        for name, like in self.empty().items():
            out[name] = flat[at : at + like.size].reshape(like.shape).copy()
            at += like.size
        return out


@dataclass
class Tokens:
    """Tokens of documents, one after the other, and their bounds. The last token of each document
    ends it. ``word`` is the place inside a class that has weights, -1 in the others."""

    inputs: np.ndarray
    classes: np.ndarray
    words: np.ndarray
    bounds: np.ndarray


def lanes(bounds: np.ndarray, most: int) -> list[np.ndarray]:
    """Documents dealt to lanes of nearly equal length, longest first; longest lane first."""
    sizes = np.diff(bounds)
    n = int(min(most, max(1, len(sizes)), max(8, sizes.sum() // 256)))
    heap = [(0, i) for i in range(n)]
    dealt: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        total, i = heap[0]
        dealt[i].append(d)
        heapq.heapreplace(heap, (total + int(sizes[d]), i))
    out = [np.concatenate([np.arange(bounds[d], bounds[d + 1], dtype=np.int32) for d in own]) for own in dealt if own]
    return sorted(out, key=len, reverse=True)


def windows(dealt: list[np.ndarray], steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token positions (steps, lanes), which are real) until every lane has ended; lanes that
    ended drop out from the back."""
    flat = np.concatenate(dealt)
    lengths = np.array([len(x) for x in dealt])
    starts = np.cumsum(lengths) - lengths
    for at in range(0, int(lengths[0]), steps):
        live = int((lengths > at).sum())
        t = np.arange(at, at + steps)[:, None]
        real = t < lengths[:live][None, :]
        yield flat[np.minimum(starts[:live] + t, (starts + lengths - 1)[:live])], real


class Net:
    def __init__(self, shape: Shape, params: dict[str, np.ndarray]):
        self.shape, self.p = shape, params

    def states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: list | None = None):
        """The state before each token, (steps, lanes, hidden), and the one after the last."""
        p, n = self.p, self.shape.hidden
        out = np.empty((*x.shape, n), F32)
        for t in range(len(x)):
            out[t] = h
            a = p["E"][x[t]]
            f = 1 / (1 + np.exp(-(a[:, :n] + h @ p["Uf"])))
            g = f * h
            c = np.tanh(a[:, n:] + g @ p["Uc"])
            if trace is not None:
                trace.append((h, f, g, c))
            h = (h + f * (c - h)) * keep[t][:, None]
        return out, h

    def log_probabilities(self, h: np.ndarray, classes: np.ndarray, words: np.ndarray, weight: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each token (rows of ``h``); with ``grads``, also the gradients
        of the weighted mean loss, of which that of ``h`` is returned."""
        p = self.p
        z = h @ p["Wc"] + p["bc"]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = (e @ np.ones(e.shape[1], F32))[:, None]
        rows = np.arange(len(h))
        out = z[rows, classes] - np.log(total[:, 0])
        dh = None
        if grads is not None:
            scale = (weight / max(1, weight.sum())).astype(F32)[:, None]
            e /= total
            e[rows, classes] -= 1
            e *= scale
            grads["Wc"], grads["bc"] = h.T @ e, e.sum(axis=0)
            dh = e @ p["Wc"].T
            grads["Ww"], grads["bw"] = np.zeros_like(p["Ww"]), np.zeros_like(p["bw"])
        inner = np.flatnonzero(words >= 0)
        inner = inner[np.argsort(classes[inner], kind="stable")]
        own = classes[inner]
        cuts = np.searchsorted(own, np.arange(self.shape.learnt + 1))
        for c in range(self.shape.learnt):
            r = inner[cuts[c] : cuts[c + 1]]
            if not len(r):
                continue
            z = h[r] @ p["Ww"][c] + p["bw"][c]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            total = e.sum(axis=1, keepdims=True)
            k = np.arange(len(r))
            out[r] += z[k, words[r]] - np.log(total[:, 0])
            if grads is not None:
                e /= total
                e[k, words[r]] -= 1
                e *= scale[r]
                grads["Ww"][c], grads["bw"][c] = h[r].T @ e, e.sum(axis=0)
                dh[r] += e @ p["Ww"][c].T
        return (out, dh) if grads is not None else out

    def back(self, x: np.ndarray, keep: np.ndarray, trace: list, dh: np.ndarray, grads: dict) -> None:
        """Backpropagation inside the window; nothing flows to the window before."""
        p, n = self.p, self.shape.hidden
        duf, duc = np.zeros_like(p["Uf"]), np.zeros_like(p["Uc"])
        da = np.zeros((*x.shape, 2 * n), F32)
        d = np.zeros_like(dh[0])
        for t in range(len(x) - 1, -1, -1):
            h, f, g, c = trace[t]
            d = d * keep[t][:, None]
            dz = d * f * (1 - c * c)
            dg = dz @ p["Uc"].T
            df = (d * (c - h) + dg * h) * f * (1 - f)
            da[t, :, :n], da[t, :, n:] = df, dz
            duf += h.T @ df
            duc += g.T @ dz
            d = d * (1 - f) + dg * f + df @ p["Uf"].T + dh[t]
        grads["Uf"], grads["Uc"] = duf, duc
        flat, rows = x.ravel(), da.reshape(-1, 2 * n)
        order = np.argsort(flat, kind="stable")
        at = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        grads["E"] = np.zeros_like(p["E"])
        grads["E"][flat[order][at]] = np.add.reduceat(rows[order], at, axis=0)

    def score(self, tokens: Tokens, width: int = 1024, steps: int = 16) -> np.ndarray:
        """Natural log-probability of every token; states run on from window to window."""
        out = np.zeros(len(tokens.inputs))
        dealt = lanes(tokens.bounds, width)
        last = np.zeros(len(tokens.inputs), bool)
        last[tokens.bounds[1:] - 1] = True
        h = np.zeros((len(dealt), self.shape.hidden), F32)
        for at, real in windows(dealt, steps):
            h = h[: at.shape[1]]
            hs, h = self.states(tokens.inputs[at], ~last[at], h)
            some = np.flatnonzero(real.ravel())
            where = at.ravel()[some]
            out[where] = self.log_probabilities(
                hs.reshape(-1, hs.shape[2])[some], tokens.classes[where], tokens.words[where], None
            )
        return out


class Trainer:
    """Adam over windows, one pass over what it is given."""

    def __init__(self, net: Net, rate: float = 0.01, width: int = 512, steps: int = 16):
        self.net, self.rate, self.width, self.steps = net, rate, width, steps
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.turn = self.seen = 0

    def fit(self, tokens: Tokens) -> None:
        net = self.net
        dealt = lanes(tokens.bounds, self.width)
        last = np.zeros(len(tokens.inputs), bool)
        last[tokens.bounds[1:] - 1] = True
        h = np.zeros((len(dealt), net.shape.hidden), F32)
        for at, real in windows(dealt, self.steps):
            h, x, keep = h[: at.shape[1]], tokens.inputs[at], (~last[at]).astype(F32)
            trace: list = []
            hs, h = net.states(x, keep, h, trace)
            grads: dict[str, np.ndarray] = {}
            weight = real.ravel().astype(F32)
            _, dh = net.log_probabilities(
                hs.reshape(-1, hs.shape[2]), tokens.classes[at].ravel(), tokens.words[at].ravel(), weight, grads
            )
            net.back(x, keep, trace, dh.reshape(hs.shape), grads)
            self._step(grads)
            self.seen += int(weight.sum())

    def _step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for k, g in grads.items():
            np.clip(g, -1, 1, out=g)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            up = self.m[k] / (1 - 0.9**self.turn)
            self.net.p[k] -= (self.rate * up / (np.sqrt(self.v[k] / (1 - 0.99**self.turn)) + 1e-6)).astype(F32)
