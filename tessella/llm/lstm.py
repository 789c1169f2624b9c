"""A bidirectional LSTM that labels every step of a sequence, in numpy."""

from __future__ import annotations

import numpy as np


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Weights by name. Sequences are padded to one length; ``mask`` is 1 for their steps."""

    def __init__(self, n_in: int, n_hidden: int, rng: np.random.Generator):
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype("f4")
        self.h = n_hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p |= {f"x{d}": scale(n_in, 4 * n_hidden), f"h{d}": scale(n_hidden, 4 * n_hidden), f"c{d}": np.zeros(4 * n_hidden, "f4")}
            self.p[f"c{d}"][n_hidden : 2 * n_hidden] = 1  # remember at first
        self.p |= {"out": scale(2 * n_hidden + n_in, 1)[:, 0], "bias": np.zeros(1, "f4")}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states in the order of ``x``; ``x`` and ``mask`` are steps first."""
        t, n, k = len(x), x.shape[1], self.h
        given = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c, out, kept = np.zeros((n, k), "f4"), np.zeros((n, k), "f4"), np.zeros((t, n, k), "f4"), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = given[i] + h @ self.p[f"h{d}"]
            gate = logistic(z[:, : 3 * k])
            a, f, o, g = gate[:, :k], gate[:, k : 2 * k], gate[:, 2 * k :], np.tanh(z[:, 3 * k :])
            m = mask[i][:, None]
            c_new = (f * c + a * g) * m
            tc = np.tanh(c_new)
            if keep:
                kept.append((i, h, c, a, f, o, g, tc, m))
            h, c = o * tc * m, c_new
            out[i] = h
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        ahead, _ = self._run(x, mask, "f", False)
        back, _ = self._run(x, mask, "b", False)
        return np.concatenate([ahead, back, x], axis=2) @ self.p["out"] + self.p["bias"]

    def scores_in_parts(self, parts: list) -> np.ndarray:
        """Of one sequence whose steps come from functions, a part at a time: only what the gates need of them is kept."""
        k = self.h
        from_x, plain = {d: [] for d in "fb"}, []
        for part in parts:
            x = part()
            for d in "fb":
                from_x[d].append(x @ self.p[f"x{d}"] + self.p[f"c{d}"])
            plain.append(x @ self.p["out"][2 * k :])
        out = np.concatenate(plain) + self.p["bias"]
        for j, d in enumerate("fb"):
            given = np.concatenate(from_x.pop(d))
            h, c, to_out = np.zeros(k, "f4"), np.zeros(k, "f4"), self.p["out"][j * k : (j + 1) * k]
            for i in range(len(given)) if d == "f" else range(len(given) - 1, -1, -1):
                z = given[i] + h @ self.p[f"h{d}"]
                gate = logistic(z[: 3 * k])
                c = gate[k : 2 * k] * c + gate[:k] * np.tanh(z[3 * k :])
                h = gate[2 * k :] * np.tanh(c)
                out[i] += h @ to_out
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        seen = np.concatenate([runs["f"][0], runs["b"][0], x], axis=2)
        error = (logistic(seen @ self.p["out"] + self.p["bias"]) - y) * mask / mask.sum()
        grads = {"out": np.einsum("tn,tnk->k", error, seen), "bias": np.array([error.sum()])}
        k = self.h
        for j, d in enumerate("fb"):
            from_out = error[:, :, None] * self.p["out"][j * k : (j + 1) * k]
            dz_all, dh_next, dc_next = np.zeros((*x.shape[:2], 4 * k), "f4"), 0.0, 0.0
            grads[f"h{d}"] = np.zeros_like(self.p[f"h{d}"])
            for i, h, c, a, f, o, g, tc, m in reversed(runs[d][1]):
                dh = (from_out[i] + dh_next) * m
                dc = (dc_next + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * g * a * (1 - a), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - g * g)], axis=1)
                dz_all[i] = dz
                grads[f"h{d}"] += h.T @ dz
                dh_next, dc_next = dz @ self.p[f"h{d}"].T, dc * f
            grads[f"x{d}"] = np.einsum("tni,tnk->ik", x, dz_all)
            grads[f"c{d}"] = dz_all.sum((0, 1))
        return grads


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps first: values and mask."""
    t = max(map(len, sequences))
    x, mask = np.zeros((t, len(sequences), sequences[0].shape[1]), "f4"), np.zeros((t, len(sequences)), "f4")
    for j, s in enumerate(sequences):
        x[: len(s), j] = s
        mask[: len(s), j] = 1
    return x, mask


def train(sequences: list[np.ndarray], labels: list[np.ndarray], *, hidden: int, epochs: int, rate: float, seed: int, batch: int = 32) -> Tagger:
    rng = np.random.default_rng(seed)
    model = Tagger(sequences[0].shape[1], hidden, rng)
    first, second, step = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2)), None, 0
    first, second = first
    for epoch in range(epochs):
        order = np.argsort([len(s) + rng.random() * 8 for s in sequences])
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for at in rng.permutation(len(groups)):
            x, mask = padded([sequences[i] for i in groups[at]])
            y, _ = padded([labels[i][:, None] for i in groups[at]])
            step += 1
            grads = model.gradients(x, mask, y[:, :, 0])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] -= (rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return model
