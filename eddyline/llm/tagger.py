"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Input is a class for each character, one-hot, so the input weights are a
table.  Both directions run side by side as one stacked batch, with the batch
as the last axis: gates are whole blocks of memory, and each step is a few
passes over them.  The squashing function is the rational ``x (27 + x^2) / (27
+ 9 x^2)`` on [-3, 3], which meets -1 and 1 at its ends with slope 0; it is
several times cheaper than tanh, and training uses it too.  Sigmoids are halved
squashes: ``s(x) = (1 + f(x / 2)) / 2``.
"""

from __future__ import annotations

import numpy as np

GATES = 4            # input, forget, output, candidate


def squash(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """f(x) in place; ``spare`` is overwritten."""
    np.clip(x, -3.0, 3.0, out=x)
    np.multiply(x, x, out=spare)
    spare += 3.0
    # f = x (27 + x^2) / (27 + 9 x^2) = x / 9 + (8 / 3) x / (3 + x^2)
    np.divide(x, spare, out=spare)
    spare *= np.float32(8 / 3)
    x *= np.float32(1 / 9)
    x += spare
    return x


def slope(x: np.ndarray) -> np.ndarray:
    """f'(x)."""
    y = np.minimum(x * x, 9.0)
    return 1 / 9 + (8 / 3) * (3 - y) / (3 + y) ** 2


class Tagger:
    """Weights: ``table (2, classes, 4h)``, ``rec (2, h, 4h)``, ``out (2h, tags)``,
    ``bias (tags)``, ``trans (tags, tags)``, ``first (tags)``."""

    def __init__(self, classes: int, tags: int, hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden, self.tags = hidden, tags
        self.table = (rng.normal(0, 0.3, (2, classes, GATES * hidden))).astype(f)
        self.table[:, :, hidden:2 * hidden] += 1.0            # remember at first
        self.rec = (rng.normal(0, 0.3, (2, hidden, GATES * hidden))).astype(f)
        self.out = (rng.normal(0, 0.3, (2 * hidden, tags))).astype(f)
        self.bias = np.zeros(tags, f)
        self.trans = np.zeros((tags, tags), f)
        self.first = np.zeros(tags, f)

    def weights(self) -> dict[str, np.ndarray]:
        return {n: getattr(self, n) for n in ("table", "rec", "out", "bias", "trans", "first")}

    # ---- forward -----------------------------------------------------------

    def _scale(self) -> np.ndarray:
        s = np.full(GATES * self.hidden, 0.5, np.float32)
        s[3 * self.hidden:] = 1.0
        return s

    def run(self, x: np.ndarray, keep: bool = False):
        """Classes ``x (n, t)`` → states ``(t, 2h, n)``; ``keep`` also returns
        what the backward pass needs."""
        n, t = x.shape
        h, s = self.hidden, self._scale()
        table = np.ascontiguousarray((self.table * s).transpose(0, 2, 1))
        rec = np.ascontiguousarray((self.rec * s).transpose(0, 2, 1))
        hs, cs = np.zeros((2, h, n), np.float32), np.zeros((2, h, n), np.float32)
        g, spare = np.empty((2, GATES * h, n), np.float32), np.empty((2, GATES * h, n), np.float32)
        tc, add = np.empty_like(cs), np.empty((GATES * h, n), np.float32)
        states = np.empty((t, 2 * h, n), np.float32)
        past = []
        xt = np.ascontiguousarray(x.T).astype(np.intp)
        for k in range(t):
            before = (cs.copy(), hs.copy()) if keep else None
            np.matmul(rec, hs, out=g)
            g[0] += np.take(table[0], xt[k], axis=1, out=add, mode="clip")
            g[1] += np.take(table[1], xt[t - 1 - k], axis=1, out=add, mode="clip")
            slopes = slope(g) if keep else None
            squash(g, spare)
            gate = g[:, :3 * h]
            gate *= 0.5
            gate += 0.5
            cs *= g[:, h:2 * h]
            cs += np.multiply(g[:, :h], g[:, 3 * h:], out=tc)
            c_slope = slope(cs) if keep else None
            np.copyto(tc, cs)
            squash(tc, spare[:, :h])
            np.multiply(g[:, 2 * h:3 * h], tc, out=hs)
            states[k, :h] = hs[0]
            states[t - 1 - k, h:] = hs[1]
            if keep:
                past.append((g.copy(), slopes, tc.copy(), c_slope, *before))
        return (states, past) if keep else states

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores ``(n, t, tags)``, a view of memory that runs time, tag, window."""
        e = np.matmul(np.ascontiguousarray(self.out.T), self.run(x))
        e += self.bias[:, None]
        return np.moveaxis(e, 2, 0)

    # ---- training ----------------------------------------------------------

    def _crf(self, e: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood and its gradients by emission,
        transition and first tag, from forward and backward sums."""
        n, t, k = e.shape
        trans, first = self.trans, self.first

        def lse(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))

        alpha, beta = np.empty((t, n, k), e.dtype), np.zeros((t, n, k), e.dtype)
        alpha[0] = first + e[:, 0]
        for i in range(1, t):
            alpha[i] = lse(alpha[i - 1][:, :, None] + trans, 1) + e[:, i]
        for i in range(t - 2, -1, -1):
            beta[i] = lse(trans + (e[:, i + 1] + beta[i + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        p = np.exp(alpha + beta - z[:, None]).transpose(1, 0, 2)
        rows = np.arange(n)
        gold = first[y[:, 0]] + e[rows[:, None], np.arange(t), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        ge = p.copy()
        ge[rows[:, None], np.arange(t), y] -= 1
        gt = np.zeros((k, k))
        for i in range(1, t):
            gt += np.exp(alpha[i - 1][:, :, None] + trans + (e[:, i] + beta[i])[:, None, :]
                         - z[:, None, None]).sum(0)
        np.add.at(gt, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        gf = p[:, 0].sum(0)
        np.add.at(gf, y[:, 0], -1)
        return float((z - gold).mean()), ge / n, gt / n, gf / n

    def gradients(self, x: np.ndarray, y: np.ndarray):
        h, s = self.hidden, self._scale()
        n, t = x.shape
        states, past = self.run(x, keep=True)
        flat = np.ascontiguousarray(states.transpose(2, 0, 1)).reshape(-1, 2 * h)
        e = (flat @ self.out + self.bias).reshape(n, t, -1)
        loss, ge, gt, gf = self._crf(e, y)
        ge = ge.astype(np.float32)
        gflat = ge.reshape(-1, self.tags)
        grad = {"out": flat.T @ gflat, "bias": gflat.sum(0), "trans": gt, "first": gf,
                "table": np.zeros_like(self.table), "rec": np.zeros_like(self.rec)}
        gs = (gflat @ self.out.T).reshape(n, t, 2 * h).transpose(1, 2, 0)
        rec = self.rec * s
        dh = np.zeros((2, h, n), np.float32)
        dc = np.zeros((2, h, n), np.float32)
        for k in range(t - 1, -1, -1):
            g, slopes, tc, c_slope, c0, h0 = past[k]
            dh[0] += gs[k, :h]
            dh[1] += gs[t - 1 - k, h:]
            i, f, o, a = (g[:, j * h:(j + 1) * h] for j in range(4))
            dc += dh * o * c_slope
            # a gate is half its squash plus a half, so it moves half as fast
            dg = np.concatenate([dc * a * 0.5, dc * c0 * 0.5, dh * tc * 0.5, dc * i], axis=1) * slopes
            dc = dc * f
            grad["rec"] += np.matmul(h0, dg.transpose(0, 2, 1)) * s
            for d, col in ((0, x[:, k]), (1, x[:, t - 1 - k])):
                np.add.at(grad["table"][d], col, dg[d].T * s)
            dh = np.matmul(rec, dg)
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.02,
            seed: int = 7) -> list[float]:
        """Adam on random batches; the rate falls to a tenth.  Returns the losses."""
        rng = np.random.default_rng(seed)
        w = self.weights()
        m1 = {k: np.zeros(v.shape) for k, v in w.items()}
        m2 = {k: np.zeros(v.shape) for k, v in w.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            loss, grad = self.gradients(x[pick], y[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            clip = min(1.0, 5.0 / max(norm, 1e-9))
            lr = rate * 0.1 ** (step / steps)
            for k, g in grad.items():
                g = g * clip
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                w[k] -= (lr * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
                         ).astype(np.float32)
        return losses

    # ---- decoding ----------------------------------------------------------

    def all_outside(self, e: np.ndarray) -> np.ndarray:
        """Windows whose best path provably keeps tag 0 throughout.  Against
        that path, any stretch of other tags gains at most its best emissions,
        the best step between other tags for each place but one, and the best
        way in and out; if no stretch can gain, none is taken."""
        t = self.trans
        within = float(t[1:, 1:].max() - t[0, 0])
        enter = max(float(t[0, 1:].max() - t[0, 0]), float(self.first[1:].max() - self.first[0]))
        leave = max(0.0, float(t[1:, 0].max() - t[0, 0]))
        e = np.moveaxis(e, 0, 2)                                 # as it lies in memory
        total = np.cumsum(e[:, 1:].max(axis=1) - e[:, 0] + np.float32(within), axis=0, dtype=np.float64)
        before = np.minimum.accumulate(np.concatenate([np.zeros_like(total[:1]), total[:-1]]), axis=0)
        return (total - before).max(axis=0) + enter + leave - within < -1e-3

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi paths ``(n, t)``."""
        n, t, k = e.shape
        path = np.zeros((n, t), dtype=np.int8)
        todo = np.flatnonzero(~self.all_outside(e))
        if not len(todo):
            return path
        e = e[todo]
        score = self.first + e[:, 0]
        back = np.empty((t, len(todo), k), dtype=np.int8)
        for i in range(1, t):
            s = score[:, :, None] + self.trans
            back[i] = s.argmax(axis=1)
            score = s.max(axis=1) + e[:, i]
        tag = score.argmax(axis=1)
        rows = np.arange(len(todo))
        for i in range(t - 1, -1, -1):
            path[todo, i] = tag
            if i:
                tag = back[i][rows, tag]
        return path
