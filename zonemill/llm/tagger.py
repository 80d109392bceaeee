"""A character-level bidirectional LSTM with CRF transitions, in numpy: forward, backward, training, decoding."""

from __future__ import annotations

import numpy as np

#: Characters with a number of their own are the printable ASCII ones; the rest share numbers by kind.
PAD, LETTER, SPACE, OTHER, FIRST = 0, 1, 2, 3, 4
SYMBOLS = FIRST + 95


def numbers(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((code >= 32) & (code < 127), code - 32 + FIRST, OTHER).astype(np.int32)
    out[(code >= 9) & (code <= 13)] = SPACE
    out[code >= 0xC0] = LETTER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, embed: int = 12, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": f(SYMBOLS, embed) * 2, "out": f(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(embed, 4 * hidden), f"h{d}": f(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def _lstm(self, e: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """e: (time, batch, embed), in the order of reading."""
        t, n, _ = e.shape
        k = self.hidden
        into = e @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, kept, wh = np.empty((t, n, k), np.float32), [], self.p[f"h{d}"]
        for s in range(t):
            z = into[s] + h @ wh
            gates, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            kept.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[s] = h
        return out, kept

    def _lstm_back(self, e: np.ndarray, kept: list, d_out: np.ndarray, d: str, grads: dict) -> np.ndarray:
        k, wh = self.hidden, self.p[f"h{d}"]
        dz = np.empty((len(e), e.shape[1], 4 * k), np.float32)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for s in range(len(e) - 1, -1, -1):
            h, before, i, f, o, g, tc = kept[s]
            dh = dh + d_out[s]
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[s]
            z[:, :k] = dc * g * i * (1 - i)
            z[:, k : 2 * k] = dc * before * f * (1 - f)
            z[:, 2 * k : 3 * k] = dh * tc * o * (1 - o)
            z[:, 3 * k :] = dc * i * (1 - g * g)
            dh, dc = z @ wh.T, dc * f
        hs = np.stack([x[0] for x in kept])
        grads[f"h{d}"] = np.einsum("tnk,tnz->kz", hs, dz, optimize=True)
        grads[f"x{d}"] = np.einsum("tne,tnz->ez", e, dz, optimize=True)
        grads[f"c{d}"] = dz.sum(axis=(0, 1))
        return dz @ self.p[f"x{d}"].T

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """ids: (batch, time). Emission scores (time, batch, tags)."""
        e = self.p["emb"][ids.T]
        a, b = self._lstm(e, "f")[0], self._lstm(e[::-1], "b")[0][::-1]
        return np.concatenate((a, b), axis=2) @ self.p["out"] + self.p["out_b"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        e = self.p["emb"][ids.T]
        a, kept_a = self._lstm(e, "f")
        b, kept_b = self._lstm(e[::-1], "b")
        h = np.concatenate((a, b[::-1]), axis=2)
        s = h @ self.p["out"] + self.p["out_b"]
        t, n, k = s.shape
        move = self.p["move"]
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        for i in range(1, t):
            alpha[i] = _lse(alpha[i - 1][:, :, None] + move, 1) + s[i]
        for i in range(t - 2, -1, -1):
            beta[i] = _lse(move + (s[i + 1] + beta[i + 1])[:, None, :], 2)
        whole = _lse(alpha[-1], 1)
        y = tags.T
        rows = np.arange(n)
        gold = sum(s[i, rows, y[i]] for i in range(t)) + sum(move[y[i - 1], y[i]] for i in range(1, t))
        d_s = np.exp(alpha + beta - whole[None, :, None])
        d_move = np.zeros((k, k))
        for i in range(1, t):
            d_move += np.exp(alpha[i - 1][:, :, None] + move + (s[i] + beta[i])[:, None, :] - whole[:, None, None]).sum(axis=0)
            np.add.at(d_move, (y[i - 1], y[i]), -1)
        for i in range(t):
            d_s[i, rows, y[i]] -= 1
        d_s = (d_s / n).astype(np.float32)
        grads = {"move": (d_move / n).astype(np.float32), "out": np.einsum("tnh,tnk->hk", h, d_s, optimize=True), "out_b": d_s.sum(axis=(0, 1))}
        d_h = d_s @ self.p["out"].T
        d_e = self._lstm_back(e, kept_a, d_h[:, :, : self.hidden], "f", grads)
        d_e = d_e + self._lstm_back(e[::-1], kept_b, np.ascontiguousarray(d_h[::-1, :, self.hidden :]), "b", grads)[::-1]
        grads["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grads["emb"], ids.T.ravel(), d_e.reshape(-1, d_e.shape[2]))
        return float((whole - gold).mean()), grads

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int = 240, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.choice(len(ids), min(batch, len(ids)), replace=False)
            loss, grads = self.gradients(ids[pick], tags[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float(np.square(g).sum()) for g in grads.values()))
            pace = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k][0][:] += 0.1 * (g - m[k][0])
                m[k][1][:] += 0.01 * (g * g - m[k][1])
                self.p[k] -= (pace * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags (batch, time)."""
        s, move = self.scores(ids), self.p["move"]
        t, n, k = s.shape
        best, back = s[0], np.empty((t, n, k), np.int8)
        for i in range(1, t):
            both = best[:, :, None] + move
            back[i] = both.argmax(axis=1)
            best = both.max(axis=1) + s[i]
        out = np.empty((n, t), np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[i][rows, out[:, i]]
        return out
