"""A bidirectional LSTM over characters with a CRF on top, in numpy: training, and decoding of batches of windows."""

from __future__ import annotations

import dataclasses

import numpy as np

#: Character ids: 0 beyond the text, 1 to 95 printable ASCII, then white space, other letters, anything else.
SYMBOLS = 99


def character_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ids = np.where((points >= 32) & (points < 127), points - 31, 98)
    ids[(points >= 9) & (points <= 13)] = 96
    for k in np.flatnonzero(points > 127).tolist():
        if chr(points[k]).isalpha():
            ids[k] = 97
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclasses.dataclass
class Tagger:
    """p: for each direction d in "fb" the tables x<d> (symbol to gates) and h<d>; out, bias; transitions, first, last."""

    hidden: int
    tags: int
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, hidden: int, tags: int, seed: int) -> Tagger:
        rng, p = np.random.default_rng(seed), {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.1, (SYMBOLS, 4 * hidden)).astype(np.float32)
            p["x" + d][:, hidden : 2 * hidden] += 1  # remember at first
            p["h" + d] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        p["out"] = rng.normal(0, 0.3, (2 * hidden, tags)).astype(np.float32)
        p |= {"bias": np.zeros(tags, np.float32), "transitions": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32), "last": np.zeros(tags, np.float32)}
        return cls(hidden, tags, p)

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Both directions run at once, the second over the symbols in reverse. keep gets what the gradients need."""
        n, length, hidden = *ids.shape, self.hidden
        table, recurrent = np.stack([self.p["xf"], self.p["xb"]]), np.stack([self.p["hf"], self.p["hb"]])
        turned, direction = np.stack([ids, ids[:, ::-1]]), np.arange(2)[:, None]
        h = c = np.zeros((2, n, hidden), table.dtype)
        out, steps = np.empty((2, length, n, hidden), table.dtype), []
        for t in range(length):
            z = table[direction, turned[:, :, t]] + h @ recurrent
            gate, new = _sigmoid(z[:, :, : 3 * hidden]), np.tanh(z[:, :, 3 * hidden :])
            before, h0 = c, h
            c = gate[:, :, hidden : 2 * hidden] * c + gate[:, :, :hidden] * new
            top = np.tanh(c)
            h = out[:, t] = gate[:, :, 2 * hidden :] * top
            if keep is not None:
                steps.append((gate, new, before, top, h0))
        both = np.concatenate([out[0], out[1, ::-1]], axis=2).transpose(1, 0, 2)
        if keep is not None:
            keep |= {"both": both, "steps": steps, "recurrent": recurrent}
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window, and its emissions."""
        e = self.emissions(ids)
        n, length, _ = e.shape
        score, back = self.p["first"] + e[:, 0], np.empty((length, n, self.tags), np.int8)
        for t in range(1, length):
            ways = score[:, :, None] + self.p["transitions"]
            back[t] = ways.argmax(axis=1)
            score = ways.max(axis=1) + e[:, t]
        best = (score + self.p["last"]).argmax(axis=1)
        path = np.empty((n, length), np.int8)
        for t in range(length - 1, -1, -1):
            path[:, t] = best
            if t:
                best = back[t][np.arange(n), best]
        return path, e

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the windows' tags, and its gradients."""
        keep: dict = {}
        e = self.emissions(ids, keep).astype(np.float64)
        n, length, k = e.shape
        trans, first, last = (self.p[x].astype(np.float64) for x in ("transitions", "first", "last"))
        # forward and backward sums of products, scaled at each place so that they stay near 1
        high, steps = e.max(axis=2), np.exp(trans)
        weight = np.exp(e - high[:, :, None]).transpose(1, 0, 2)
        alpha, beta, scale = np.empty((length, n, k)), np.empty((length, n, k)), np.empty((length, n, 1))
        for t in range(length):
            alpha[t] = weight[t] * (alpha[t - 1] @ steps if t else np.exp(first))
            scale[t] = alpha[t].sum(axis=1, keepdims=True)
            alpha[t] /= scale[t]
        end = (alpha[-1] * np.exp(last)).sum(axis=1, keepdims=True)
        beta[-1] = np.exp(last) / end
        for t in range(length - 2, -1, -1):
            beta[t] = (weight[t + 1] * beta[t + 1] / scale[t + 1]) @ steps.T
        total = np.log(scale).sum(axis=(0, 2)) + np.log(end[:, 0]) + high.sum(axis=1)
        rows = np.arange(n)
        gold = first[tags[:, 0]] + last[tags[:, -1]] + e[rows[:, None], np.arange(length), tags].sum(axis=1) + trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        marginal = (alpha * beta).transpose(1, 0, 2)
        expected = steps * (alpha[:-1].reshape(-1, k).T @ (weight[1:] * beta[1:] / scale[1:]).reshape(-1, k))
        seen = np.eye(k)[tags]
        np.subtract.at(expected, (tags[:, :-1], tags[:, 1:]), 1)
        de = ((marginal - seen) / n).astype(np.float32)
        g = {"transitions": expected / n, "first": (marginal[:, 0] - seen[:, 0]).mean(axis=0), "last": (marginal[:, -1] - seen[:, -1]).mean(axis=0), "bias": de.sum(axis=(0, 1))}
        g["out"] = np.tensordot(keep["both"], de, axes=([0, 1], [0, 1]))
        dboth, hidden = (de @ self.p["out"].T).transpose(1, 0, 2), self.hidden
        part, recurrent = np.stack([dboth[:, :, :hidden], dboth[::-1, :, hidden:]]), keep["recurrent"]
        dh = dc = np.zeros((2, n, hidden), recurrent.dtype)
        dzs, h0s = np.empty((2, length, n, 4 * hidden), recurrent.dtype), np.empty((2, length, n, hidden), recurrent.dtype)
        for t in range(length - 1, -1, -1):
            gate, new, before, top, h0s[:, t] = keep["steps"][t]
            i, f, o = gate[:, :, :hidden], gate[:, :, hidden : 2 * hidden], gate[:, :, 2 * hidden :]
            dh = dh + part[:, t]
            dc = dc + dh * o * (1 - top * top)
            dz = dzs[:, t] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - new * new)], axis=2)
            dh, dc = dz @ recurrent.transpose(0, 2, 1), dc * f
        symbols = np.eye(SYMBOLS, dtype=np.float32)[ids.T].reshape(n * length, SYMBOLS)
        for k, d in enumerate("fb"):
            g["x" + d] = symbols.T @ dzs[k, :: 1 - 2 * k].reshape(n * length, -1)
            g["h" + d] = h0s[k].reshape(n * length, -1).T @ dzs[k].reshape(n * length, -1)
        return float((total - gold).mean()), g


def fit(ids: np.ndarray, tags: np.ndarray, classes: int, hidden: int = 16, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Adam over random batches of windows, with a falling rate."""
    model, rng = Tagger.new(hidden, classes, seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(ids), batch)
        _, g = model.gradients(ids[chosen], tags[chosen])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 5.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * x
            square[k] = 0.99 * square[k] + 0.01 * x * x
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            model.p[k] = (model.p[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model
