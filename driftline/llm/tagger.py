"""A small bidirectional LSTM with CRF transitions over characters, in numpy: training, decoding of windows.

Arrays are (windows, ``LENGTH``) of character classes and tags. Gradients are exact: backpropagation through time for the
LSTMs and forward-backward for the CRF. Training is deterministic for equal input.
"""

from __future__ import annotations

import numpy as np

LENGTH = 64
SIGNS = "@.-_+() \n:/,%=\"#'"  # characters with a class of their own
CLASSES = len(SIGNS) + 6  # nothing, digit, lower, upper, other letter, signs, anything else


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.full(256, CLASSES - 1, np.int8)
    table[48:58], table[97:123], table[65:91] = 1, 2, 3
    table[[k for k in range(128, 256) if chr(k).isalpha()]] = 4
    for k, sign in enumerate(SIGNS):
        table[ord(sign)] = 5 + k
    return np.where(codes < 256, table[np.minimum(codes, 255)], 4).astype(np.int8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    def __init__(self, tags: int, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"out": draw(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "move": draw(tags, tags), "first": np.zeros(tags, np.float32), "last": np.zeros(tags, np.float32)}
        for side in "fb":
            gates = np.zeros(4 * hidden, np.float32)
            gates[hidden : 2 * hidden] = 1  # forget gates start open
            self.p |= {f"x{side}": draw(CLASSES, 4 * hidden), f"h{side}": draw(hidden, 4 * hidden), f"b{side}": gates}

    def _run(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        h_size, n = self.hidden, len(x)
        h, c = np.zeros((n, h_size), np.float32), np.zeros((n, h_size), np.float32)
        out, steps = np.empty((LENGTH, n, h_size), np.float32), []
        for t in range(LENGTH) if side == "f" else range(LENGTH - 1, -1, -1):
            z = self.p["x" + side][x[:, t]] + h @ self.p["h" + side] + self.p["b" + side]
            g = _sigmoid(z)
            a = np.tanh(z[:, 3 * h_size :])
            i, f, o = g[:, :h_size], g[:, h_size : 2 * h_size], g[:, 2 * h_size : 3 * h_size]
            new = f * c + i * a
            steps.append((t, h, c, i, f, o, a, np.tanh(new)))
            c = new
            h = o * steps[-1][-1]
            out[t] = h
        return out, steps

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        forward, f_steps = self._run(x, "f")
        backward, b_steps = self._run(x, "b")
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, f_steps, b_steps)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        e, (both, f_steps, b_steps) = self.emissions(x)
        n, move = len(x), self.p["move"]
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0], beta[-1] = self.p["first"] + e[0], self.p["last"]
        for t in range(1, LENGTH):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(LENGTH - 2, -1, -1):
            beta[t] = _lse(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _lse(alpha[-1] + self.p["last"], 1)
        share = np.exp(alpha + beta - total[None, :, None])
        yt, rows = y.T.astype(np.int64), np.arange(n)
        gold = self.p["first"][yt[0]] + self.p["last"][yt[-1]] + np.take_along_axis(e, yt[:, :, None], 2)[:, :, 0].sum(axis=0) + move[yt[:-1], yt[1:]].sum(axis=0)
        de = share.copy()
        de[np.arange(LENGTH)[:, None], rows, yt] -= 1
        dm = np.zeros_like(move)
        for t in range(1, LENGTH):
            dm += np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.subtract.at(dm, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        g = {"move": dm / n, "first": de[0].sum(axis=0) / n, "last": de[-1].sum(axis=0) / n}
        de /= n
        g["out"] = np.tensordot(both, de, ((0, 1), (0, 1)))
        g["bias"] = de.sum(axis=(0, 1))
        dh = de @ self.p["out"].T
        for side, steps, part in (("f", f_steps, dh[:, :, : self.hidden]), ("b", b_steps, dh[:, :, self.hidden :])):
            g |= self._back(x, side, steps, part)
        return float((total - gold).mean()), g

    def _back(self, x: np.ndarray, side: str, steps: list, dout: np.ndarray) -> dict:
        gx, gh = np.zeros_like(self.p["x" + side]), np.zeros_like(self.p["h" + side])
        gb = np.zeros_like(self.p["b" + side])
        dh, dc = np.zeros_like(steps[0][1]), np.zeros_like(steps[0][2])
        for t, h, c, i, f, o, a, tc in reversed(steps):
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
            np.add.at(gx, x[:, t], dz)
            gh += h.T @ dz
            gb += dz.sum(axis=0)
            dh, dc = dz @ self.p["h" + side].T, dc * f
        return {"x" + side: gx, "h" + side: gh, "b" + side: gb}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 96, rate: float = 0.012, seed: int = 3) -> list[float]:
        """Adam over shuffled batches, about ``steps`` of them; the loss of each epoch."""
        rng = np.random.default_rng(seed)
        epochs = -(-steps // -(-len(x) // batch))
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order, losses_now = rng.permutation(len(x)), []
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                loss, g = self.gradients(x[part], y[part])
                losses_now.append(loss)
                step += 1
                norm = max(1.0, float(np.sqrt(sum((a * a).sum() for a in g.values()))) / 5)
                for k, a in g.items():
                    a = a / norm
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    slow = rate * (1 - epoch / epochs) + rate * 0.05
                    self.p[k] = (self.p[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(losses_now)))
        return losses

    def decode(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        """The best tags of each window (Viterbi)."""
        out = np.zeros((len(x), LENGTH), np.int8)
        for at in range(0, len(x), batch):
            e, _ = self.emissions(x[at : at + batch])
            best, back = self.p["first"] + e[0], []
            for t in range(1, LENGTH):
                way = best[:, :, None] + self.p["move"]
                back.append(way.argmax(axis=1))
                best = np.take_along_axis(way, back[-1][:, None, :], 1)[:, 0] + e[t]
            tag = (best + self.p["last"]).argmax(axis=1)
            rows = np.arange(len(tag))
            out[at : at + batch, -1] = tag
            for t in range(LENGTH - 2, -1, -1):
                tag = back[t][rows, tag]
                out[at : at + batch, t] = tag
        return out
