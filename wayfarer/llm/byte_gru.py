"""A bidirectional gated recurrent network over bytes, in numpy, with training through time.

Arrays hold one sequence per column, so the gates are contiguous rows. A byte's input to all gates is
one column of a table. Every position gets label logits from both directions.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class ByteGru:
    """``w[name]``: x? (3h x 256 input table), u? (3h x h recurrent) per direction, out (labels x 2h), bias (labels x 1)."""

    def __init__(self, hidden: int, labels: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.w["u" + d] = np.concatenate([np.linalg.qr(rng.normal(size=(h, h)))[0] for _ in range(3)]).astype(np.float32)
        self.w["out"] = rng.normal(0, 0.3, (labels, 2 * h)).astype(np.float32)
        self.w["bias"] = np.zeros((labels, 1), np.float32)

    def _steps(self, x: np.ndarray, d: str, keep: bool, inside: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States (steps x hidden x sequences) in reading order of direction ``d``, and what training needs. Outside of
        ``inside`` (steps x sequences) a state stays at its beginning."""
        h, w, u = self.hidden, self.w["x" + d], self.w["u" + d]
        steps, n = x.shape
        states, kept = np.empty((steps, h, n), np.float32), []
        s = np.zeros((h, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gate_in = np.take(w, x[t], axis=1)
            gate_s = u @ s
            zr = gate_in[: 2 * h]
            zr += gate_s[: 2 * h]
            zr = _sigmoid(zr)
            z, r = zr[:h], zr[h:]
            cand = gate_in[2 * h :]
            cand += r * gate_s[2 * h :]
            np.tanh(cand, out=cand)
            new = s - cand
            new *= z
            new += cand
            if keep:
                kept.append((t, s, z, r, cand, gate_s[2 * h :]))
            if inside is not None:
                new *= inside[t]
            s = new
            states[t] = s
        return states, kept

    def position_probabilities(self, x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities (steps x labels x sequences) of bytes ``x`` (steps x sequences), of which only ``inside`` ones are
        a sequence's own."""
        h, out = self.hidden, self.w["out"]
        f, _ = self._steps(x, "f", False)
        b, _ = self._steps(x, "b", False, inside)
        logits = np.matmul(out[:, :h], f)
        logits += np.matmul(out[:, h:], b)
        logits += self.w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions (label ``y`` of their sequence) and its gradients, by backpropagation through time."""
        h, out = self.hidden, self.w["out"]
        f, kept_f = self._steps(x, "f", True)
        b, kept_b = self._steps(x, "b", True)
        both = np.concatenate([f, b], axis=1)
        logits = np.matmul(out, both) + self.w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        cols, total = np.arange(len(y)), mask.sum()
        loss = float(-(np.log(p[:, y, cols] + 1e-9) * mask).sum() / total)
        p[:, y, cols] -= 1
        p *= (mask / total)[:, None]
        g = {"out": np.einsum("tln,thn->lh", p, both), "bias": p.sum(axis=(0, 2))[:, None]}
        ds = np.matmul(out.T, p)
        for d, kept, part in (("f", kept_f, ds[:, :h]), ("b", kept_b, ds[:, h:])):
            u = self.w["u" + d]
            gx, gu = np.zeros_like(self.w["x" + d]), np.zeros_like(u)
            carry = np.zeros((h, x.shape[1]), np.float32)
            for t, s, z, r, cand, inner in reversed(kept):
                dh = part[t] + carry
                dz = dh * (s - cand) * z * (1 - z)
                dc = dh * (1 - z) * (1 - cand * cand)
                dr = dc * inner * r * (1 - r)
                gate = np.concatenate([dz, dr, dc * r])
                carry = dh * z + u.T @ gate
                gu += gate @ s.T
                gate[2 * h :] = dc
                flat = gate.reshape(-1)
                key = (np.arange(3 * h)[:, None] * 256 + x[t][None]).reshape(-1)
                gx += np.bincount(key, flat, 3 * h * 256).reshape(3 * h, 256).astype(np.float32)
            g["x" + d], g["u" + d] = gx, gu
        return loss, g


def train(x: np.ndarray, mask: np.ndarray, y: np.ndarray, labels: int, hidden: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 7) -> ByteGru:
    """Adam over shuffled batches of sequences: ``x``, ``mask`` (sequences x steps), ``y`` their labels."""
    net, rng = ByteGru(hidden, labels, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            _, g = net.gradients(np.ascontiguousarray(x[own].T), np.ascontiguousarray(mask[own].T), y[own])
            step += 1
            size = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((a.astype(np.float64) ** 2).sum() for a in g.values())))))
            now = rate * (1 - step / (steps + 1))
            for k, a in g.items():
                a = a * size
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.98 * v[k] + 0.02 * a * a
                net.w[k] = (net.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return net
