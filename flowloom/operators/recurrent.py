"""A bidirectional recurrent classifier of token sequences in NumPy: long short-term memory, weighted cross entropy, Adam.

It is fitted on a sample of bounded size in one task and scores all sequences in Arrow batches. Sequences are padded at
their end; steps beyond a sequence's length change no state, and the backward direction reads each sequence reversed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from flowloom.config import CLASSES, TOKENS


@dataclass(frozen=True)
class RecurrentConfig:
    """Sizes and training; the defaults are those results are compared with."""

    vocabulary: int = len(TOKENS) + 1
    padding: int = len(TOKENS)
    embedding: int = 32
    hidden: int = 128
    classes: int = len(CLASSES)
    epochs: int = 15
    batch: int = 128
    rate: float = 1e-3
    longest: int = 128


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Recurrent:
    """Weights by name: E (embedding), W/b of each direction (gates input, forget, output, cell), V/c (classes)."""

    config: RecurrentConfig = field(default_factory=RecurrentConfig)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> Recurrent:
        rng, c = np.random.default_rng(seed), self.config
        bound = 1 / np.sqrt(c.hidden)
        draw = lambda *s: rng.uniform(-bound, bound, s).astype(np.float32)
        self.weights = {"E": rng.standard_normal((c.vocabulary, c.embedding)).astype(np.float32)}
        self.weights["E"][c.padding] = 0
        for d in ("f", "b"):
            self.weights |= {f"W{d}": draw(c.embedding + c.hidden, 4 * c.hidden), f"b{d}": draw(4 * c.hidden)}
        self.weights |= {"V": (rng.uniform(-1, 1, (2 * c.hidden, c.classes)) / np.sqrt(2 * c.hidden)).astype(np.float32), "c": np.zeros(c.classes, np.float32)}
        return self

    def _padded(self, sequences: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids forward and reversed (rows, steps), and lengths; an empty sequence is one padding step."""
        c = self.config
        kept = [s[-c.longest :] or [c.padding] for s in sequences]
        n = np.array([len(s) for s in kept])
        out = np.full((2, len(kept), n.max()), c.padding)
        for i, s in enumerate(kept):
            out[0, i, : len(s)], out[1, i, : len(s)] = s, s[::-1]
        return out[0], out[1], n

    def _run(self, d: str, x: np.ndarray, n: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Last states of a direction on embedded steps x (rows, steps, embedding), and what the way back needs."""
        w, b, k = self.weights[f"W{d}"], self.weights[f"b{d}"], self.config.hidden
        h, c, past = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32), []
        for t in range(x.shape[1]):
            u = np.concatenate([x[:, t], h], axis=1)
            a = u @ w + b
            s = _sigmoid(a[:, : 3 * k])
            i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(a[:, 3 * k :])
            on = (t < n)[:, None].astype(np.float32)
            c_new = f * c + i * g
            th = np.tanh(c_new)
            if keep:
                past.append((u, i, f, o, g, c, th, on))
            h, c = on * (o * th) + (1 - on) * h, on * c_new + (1 - on) * c
        return h, past

    def _back(self, d: str, past: list, dh: np.ndarray, grads: dict | None) -> np.ndarray:
        """Gradient of the embedded steps; those of the weights are added to grads."""
        w, k, e = self.weights[f"W{d}"], self.config.hidden, self.config.embedding
        dc, dx = np.zeros_like(dh), np.zeros((len(dh), len(past), e), np.float32)
        for t in range(len(past) - 1, -1, -1):
            u, i, f, o, g, c_before, th, on = past[t]
            here, dcell = dh * on, dc * on
            dcn = here * o * (1 - th * th) + dcell
            da = np.concatenate([dcn * g * i * (1 - i), dcn * c_before * f * (1 - f), here * th * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
            du = da @ w.T
            if grads is not None:
                grads[f"W{d}"] += u.T @ da
                grads[f"b{d}"] += da.sum(axis=0)
            dx[:, t] = du[:, :e]
            dh, dc = dh * (1 - on) + du[:, e:], dc * (1 - on) + dcn * f
        return dx

    def _logits(self, sequences: list[list[int]], keep: bool = False):
        fw, bw, n = self._padded(sequences)
        xf, xb = self.weights["E"][fw], self.weights["E"][bw]
        (hf, pf), (hb, pb) = self._run("f", xf, n, keep), self._run("b", xb, n, keep)
        top = np.concatenate([hf, hb], axis=1)
        return top @ self.weights["V"] + self.weights["c"], (fw, bw, n, xf, xb, pf, pb, top)

    def fit(self, sequences: list[list[int]], y: np.ndarray, class_weight: np.ndarray, seed: int) -> Recurrent:
        """Class weights are kept above 0; batches are drawn anew each epoch from rows of like length."""
        c = self.start(seed).config
        rng, n = np.random.default_rng([seed, 1]), len(sequences)
        size = np.array([min(max(len(s), 1), c.longest) for s in sequences])
        weight = np.maximum(class_weight, 1e-6)
        moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}, 0
        for _ in range(c.epochs if n else 0):
            order = np.lexsort((rng.random(n), size + rng.integers(0, 3, n)))
            batches = [order[i : i + c.batch] for i in range(0, n, c.batch)]
            for j in rng.permutation(len(batches)):
                at, step = batches[j], step + 1
                z, (fw, bw, _, _, _, pf, pb, top) = self._logits([sequences[i] for i in at], True)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                w = weight[y[at]]
                p[np.arange(len(at)), y[at]] -= 1
                dz = (p * (w / w.sum())[:, None]).astype(np.float32)
                grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
                grads["V"], grads["c"] = top.T @ dz, dz.sum(axis=0)
                dtop = dz @ self.weights["V"].T
                for d, ids, past, part in (("f", fw, pf, dtop[:, : c.hidden]), ("b", bw, pb, dtop[:, c.hidden :])):
                    np.add.at(grads["E"], ids, self._back(d, past, part, grads))
                grads["E"][c.padding] = 0
                for k, v in self.weights.items():
                    a, b = moments[k]
                    a += 0.1 * (grads[k] - a)
                    b += 0.001 * (grads[k] ** 2 - b)
                    v -= c.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, sequences: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(sequences), self.config.classes))
        order = np.argsort([min(len(s), self.config.longest) for s in sequences], kind="stable")
        for i in range(0, len(order), 1024):
            z = self._logits([sequences[j] for j in order[i : i + 1024]])[0].astype(float)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out[order[i : i + 1024]] = p / p.sum(axis=1, keepdims=True)
        return out

    def attributions(self, sequences: list[list[int]], classes: list[int]) -> list[list[float]]:
        """Gradient times input of each step, for one class a sequence."""
        out = []
        for s, k in zip(sequences, classes, strict=True):
            z, (fw, bw, n, xf, xb, pf, pb, _) = self._logits([s], True)
            dtop = self.weights["V"][:, k][None, :]
            h = self.config.hidden
            forward = (self._back("f", pf, dtop[:, :h], None) * xf).sum(axis=2)[0]
            backward = (self._back("b", pb, dtop[:, h:], None) * xb).sum(axis=2)[0][::-1]
            out.append((forward + backward)[: len(s[-self.config.longest :])].tolist())
        return out
