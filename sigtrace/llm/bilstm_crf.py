"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

Tags are O and B-/I- per kind; transitions into I-k from anything but B-k or I-k are ruled
out.  Batches hold windows of one length; padding has its own character and the tag O.
"""

from __future__ import annotations

import numpy as np

#: Character classes: ASCII as itself, then non-ASCII letters, other characters, padding.
LETTER, OTHER, PAD, VOCABULARY = 128, 129, 130, 131
_NEVER = -1e4


def characters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 128, codes, LETTER).astype(np.int64)
    for i in np.flatnonzero(codes >= 128):
        out[i] = LETTER if text[i].isalpha() else OTHER
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, kinds: int, hidden: int = 20, embedding: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.kinds, self.hidden, self.tags = kinds, hidden, 1 + 2 * kinds
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": init(VOCABULARY, embedding) * 2, "out": init(2 * hidden, self.tags), "bias": np.zeros(self.tags, np.float32)}
        for d in "fb":
            self.p[f"x{d}"], self.p[f"h{d}"] = init(embedding, 4 * hidden), init(hidden, 4 * hidden)
            self.p[f"c{d}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"c{d}"][hidden : 2 * hidden] = 1.0  # forget gates start open
        self.p["trans"] = np.zeros((self.tags, self.tags), np.float32)
        self.barred = np.zeros((self.tags, self.tags), np.float32)
        self.first = np.zeros(self.tags, np.float32)  # a window may start inside a span
        for k in range(kinds):
            inside = 2 + 2 * k
            self.barred[:, inside] = _NEVER
            self.barred[inside - 1, inside] = self.barred[inside, inside] = 0.0

    # -- network ------------------------------------------------------------------
    def _run(self, chars: np.ndarray, d: str, keep: bool):
        """Hidden states (T, B, H) of one direction; with what its gradient needs."""
        p, size = self.p, self.hidden
        steps, n = chars.shape[1], chars.shape[0]
        inputs = p["emb"] @ p[f"x{d}"] + p[f"c{d}"]  # per character, looked up per step
        h = np.zeros((n, size), np.float32)
        c = np.zeros((n, size), np.float32)
        out = np.empty((steps, n, size), np.float32)
        trace = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[chars[:, t]] + h @ p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                trace.append((t, i, f, o, g, before_h, before_c, tc))
        return out, trace

    def emissions(self, chars: np.ndarray, keep: bool = False):
        hf, tf = self._run(chars, "f", keep)
        hb, tb = self._run(chars, "b", keep)
        hidden = np.concatenate([hf, hb], 2)
        return hidden @ self.p["out"] + self.p["bias"], hidden, tf, tb

    # -- CRF ----------------------------------------------------------------------
    def _forward_backward(self, e: np.ndarray):
        """Tag marginals (T, B, K), expected transition counts, log partition (B)."""
        trans = self.p["trans"] + self.barred
        steps = len(e)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0] + self.first
        for t in range(1, steps):
            a[t] = _lse(a[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = _lse(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
        log_z = _lse(a[-1], 1)
        pairs = np.zeros_like(trans)
        for t in range(1, steps):
            pairs += np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - log_z[:, None, None]).sum(0)
        return np.exp(a + b - log_z[:, None]), pairs, log_z

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path (B, T) and the marginal probability of each of its tags."""
        e, *_ = self.emissions(chars)
        trans = self.p["trans"] + self.barred
        best, back = e[0] + self.first, np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            through = best[:, :, None] + trans
            back[t] = through.argmax(1)
            best = through.max(1) + e[t]
        path = np.empty((len(e), chars.shape[0]), np.int64)
        path[-1] = best.argmax(1)
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t][np.arange(chars.shape[0]), path[t]]
        marginals, _, _ = self._forward_backward(e)
        sure = np.take_along_axis(marginals, path[:, :, None], 2)[:, :, 0]
        return path.T, sure.T

    # -- training -----------------------------------------------------------------
    def _gradient(self, chars: np.ndarray, tags: np.ndarray):
        p, size, n = self.p, self.hidden, len(chars)
        e, hidden, tf, tb = self.emissions(chars, keep=True)
        marginals, pairs, log_z = self._forward_backward(e)
        gold = tags.T
        steps = len(e)
        cols = np.arange(n)
        loss = (log_z - sum(e[t, cols, gold[t]] for t in range(steps)) - sum((p["trans"])[gold[t - 1], gold[t]] for t in range(1, steps))).mean()
        de = marginals
        np.put_along_axis(de, gold[:, :, None], np.take_along_axis(de, gold[:, :, None], 2) - 1, 2)
        de /= n
        seen = np.zeros_like(pairs)
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["trans"] = (pairs - seen) / n
        flat = hidden.reshape(-1, 2 * size)
        g["out"], g["bias"] = flat.T @ de.reshape(-1, self.tags), de.sum((0, 1))
        dh_all = de @ p["out"].T
        for d, trace, part in (("f", tf, dh_all[:, :, :size]), ("b", tb, dh_all[:, :, size:])):
            dh = np.zeros((n, size), np.float32)
            dc = np.zeros((n, size), np.float32)
            dinputs = np.zeros((VOCABULARY, 4 * size), np.float32)
            for t, i, f, o, gg, before_h, before_c, tc in reversed(trace):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                np.add.at(dinputs, chars[:, t], dz)
                g[f"h{d}"] += before_h.T @ dz
                dh, dc = dz @ p[f"h{d}"].T, dc * f
            g[f"c{d}"] = dinputs.sum(0)
            g[f"x{d}"] = p["emb"].T @ dinputs
            g["emb"] += dinputs @ p[f"x{d}"].T
        return loss, g

    def fit(self, chars: np.ndarray, tags: np.ndarray, steps: int, batch: int = 32, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam on the negative log likelihood for about ``steps`` batches; mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step = [], 0
        for _ in range(-(-steps // -(-len(chars) // batch))):
            order, held = rng.permutation(len(chars)), []
            for at in range(0, len(chars), batch):
                which = order[at : at + batch]
                loss, g = self._gradient(chars[which], tags[which])
                held.append(loss)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                scale = min(1.0, 5.0 / (norm + 1e-9))
                for k, x in g.items():
                    x = x * scale
                    m[k] = 0.9 * m[k] + 0.1 * x
                    s[k] = 0.999 * s[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(held)))
        return losses
