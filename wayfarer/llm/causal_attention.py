"""A causal self-attention layer over subword ids in numpy: trained by hand-derived gradients, scored window by window.

Next ids are predicted by way of classes: the layer gives the class of the next id from the window before it, and counts
of the whole corpus give the id within its class, behind the class of the id before. Queries, keys and values depend on ids alone, and order enters by a
bias for each distance, so for scoring they are tables by id and a window's work is its masked attention.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

#: Rate of a row of ``e``, as a multiple of that of the other parameters.
ROW_RATE = 10.0
#: Exponents within this need no maximum taken off: sums of their powers, weighted, stay in the range of the type.
FAR = 60
#: Places whose classes are worked on together, and rows of other products: as many as small products take without copies.
TOGETHER, STEP = 384, 512
#: What a hidden place that is always one gets: its hyperbolic tangent is one in either type.
ONE = 20.0


@dataclass(frozen=True)
class AttentionParams:
    width: int = 16
    hidden: int = 24
    classes: int = 80
    #: Times that an id's share behind a class counts as seen, before what was seen; pairs that came fewer times count as none.
    faith: float = 20.0
    least_pair: int = 3
    #: Places of a window, and how many of them the next window scores anew.
    window: int = 24
    stride: int = 20
    #: Tables of fewer than ``epochs * sample`` windows are read more than once, to as many; windows a step.
    sample: int = 10_000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


def classes_of(counts: np.ndarray, k: int) -> np.ndarray:
    """Class of each id: the most frequent ids have one of their own, the others share the rest in runs of equal weight."""
    order = np.argsort(-counts, kind="stable")
    alone = min(len(counts), 3 * k // 4)
    out = np.empty(len(counts), np.int64)
    out[order[:alone]] = np.arange(alone)
    rest = order[alone:]
    weight = np.cumsum(counts[rest] + 1.0)
    if len(rest):
        out[rest] = alone + np.minimum((weight - 1) * (k - alone) / weight[-1], k - alone - 1).astype(np.int64)
    return out


def log_shares(counts: np.ndarray, classes: np.ndarray, k: int, pairs: np.ndarray, n: np.ndarray, faith: float) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithm of an id's share of its class behind each class, and the column of each id in it.

    ``pairs`` (class before * ids + id) came ``n`` times; they weigh against ``faith`` times the share that the id has
    anywhere, with one added to every count. Ids without a count of their own are alike within a class.
    """
    ids, seen = len(counts), np.flatnonzero(counts)
    column = np.arange(len(seen), len(seen) + k)[classes]
    column[seen] = np.arange(len(seen))
    of = np.concatenate([classes[seen], np.arange(k)])
    share = np.concatenate([counts[seen] + 1.0, np.ones(k)]) / np.bincount(classes, counts + 1.0, k).clip(1)[of]
    table = np.zeros((k, len(of)))
    table[pairs // ids, column[pairs % ids]] = n
    total = np.stack([np.bincount(of, row, k) for row in table])
    return np.log((table + faith * share) / (total[:, of] + faith)).astype(np.float32), column


class _Rooms:
    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of ``kind`` that is used again at the next call: fresh pages cost more than what is written to them."""
        rooms = self.__dict__.setdefault("rooms", {})
        if (old := rooms.get(name)) is None or old.shape != shape or old.dtype != self.kind:
            rooms[name] = np.empty(shape, self.kind)
        return rooms[name]


class CausalAttention(_Rooms):
    """``e`` (ids x width); ``q``, ``k``, ``v``; ``far`` (bias by distance); ``x``, ``a`` and ``b`` (hidden layer); ``out``, ``bias``."""

    def __init__(self, p: AttentionParams, ids: int) -> None:
        rng, d, h = np.random.default_rng(p.seed), p.width, p.hidden
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = p
        self.w = {"e": rng.normal(0, 0.5, (ids, d)).astype(np.float32), "q": draw(d, d), "k": draw(d, d), "v": draw(d, d), "far": np.zeros(p.window, np.float32)}
        self.w |= {"x": draw(d, h), "a": draw(d, h), "b": np.zeros(h, np.float32), "out": draw(h, p.classes), "bias": np.zeros(p.classes, np.float32)}
        #: Row of ``e`` of each id.
        self.local = np.arange(ids, dtype=np.int32)
        place = np.arange(p.window)
        self.distance = np.maximum(place[:, None] - place[None, :], 0)
        #: Later places are out of reach.
        self.shut = np.where(place[:, None] >= place[None, :], 0, -1e9).astype(np.float32)

    @classmethod
    def even(cls, p: AttentionParams, ids: int) -> CausalAttention:
        """A layer that finds all classes equally likely, for texts without any that teach."""
        net = cls(p, 1)
        net.w["out"][:], net.local = 0, np.zeros(ids, np.int32)
        return net

    @property
    def kind(self) -> np.dtype:
        return self.w["e"].dtype

    def _mask(self, far: np.ndarray) -> np.ndarray:
        """Bias of each pair of places."""
        return (far.take(self.distance) + self.shut).astype(np.float32)

    def gradients(self, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the classes ``target`` (windows x places), and its gradients."""
        logs = np.empty(ids.size)
        (rows, sums), g = self._slopes(ids, target, weight, logs)
        logs = logs.reshape(ids.shape)
        g["e"] = np.zeros_like(self.w["e"])
        g["e"][rows] = sums
        return float(-(logs * weight).sum() / max(1.0, float(weight.sum()))), g

    def _slopes(self, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, logs: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray], dict[str, np.ndarray]]:
        """Rows of ``e`` and their gradients; the other gradients, all of the mean cross entropy. ``logs`` gets the log probabilities of the targets.

        Products of a row are taken once for all places that read it. Values only reach the hidden layer by way of
        ``a``, so ``v`` and ``a`` are one product. There is one column more than the hidden layer: the place that is always one, for the bias.
        """
        w, (n, t), d, h = self.w, rows.shape, self.p.width, self.p.hidden
        flat, goal, room, places, kind = rows.reshape(-1), target.reshape(-1), self._room, n * t, self.kind
        scale, cols, ones = kind.type(1 / np.sqrt(d)), 2 * d + h + 1, np.ones(max(places, self.p.classes), kind)
        order = np.argsort(flat.astype(np.uint16) if len(w["e"]) <= 1 << 16 else flat, kind="stable")
        ranked = flat[order]
        begins, which = np.empty(places, np.bool_), np.empty(places, np.intp)
        begins[0] = True
        np.not_equal(ranked[1:], ranked[:-1], out=begins[1:])
        which[order] = begins.cumsum()
        which -= 1
        first = np.flatnonzero(begins)
        distinct = ranked[first]
        x = w["e"].take(distinct, axis=0)
        wide = np.zeros((d, cols + h + 1), kind)
        wide[:, :d], wide[:, d : 2 * d], wide[:, 2 * d : cols - 1], wide[:, cols:-1] = w["q"] * scale, w["k"], w["v"] @ w["a"], w["x"]
        asked, alone = x @ wide[:, :cols], x @ wide[:, cols:]
        asked[:, -1] = 1
        alone[:, :-1] += w["b"]
        alone[:, -1] = ONE
        proj = np.take(asked, which, axis=0, out=room("proj", places, cols), mode="clip")
        q, key, v = (proj[:, lo:hi].reshape(n, t, -1) for lo, hi in ((0, d), (d, 2 * d), (2 * d, cols)))
        att = np.matmul(q, key.transpose(0, 2, 1), out=room("att", n, t, t))
        att += self._mask(w["far"])[:t, :t]
        if att.max() > FAR or att.reshape(n, t * t)[:, :: t + 1].min() < -FAR:
            att -= att.max(axis=2, keepdims=True)
        np.exp(att, out=att)
        att *= (1 / (att.reshape(places, t) @ ones[:t])).reshape(n, t, 1)
        mixed = room("mixed", n, t, h + 1)
        np.matmul(att, v[:, :, :h], out=mixed[:, :, :h])
        mixed = mixed.reshape(places, h + 1)
        mixed[:, -1] = 0
        full = np.take(alone, which, axis=0, out=room("full", places, h + 1), mode="clip")
        full += mixed
        np.tanh(full, out=full)
        out = np.concatenate([w["out"], w["bias"][None]])
        back, far, k = np.ascontiguousarray(w["out"].T), (ones[: h + 1] @ np.abs(out)).max() > FAR, out.shape[1]
        share = (weight.reshape(-1) / max(1.0, float(weight.sum()))).astype(kind)
        dh, to_out, starts = room("dh", places, h + 1), np.zeros_like(out), np.arange(0, TOGETHER * k, k)
        dh[:, -1] = 0
        # Probabilities of all classes are needed for a few places at a time, which stay in a core's cache.
        for lo in range(0, places, TOGETHER):
            own = slice(lo, min(places, lo + TOGETHER))
            prob = np.matmul(full[own], out, out=room("prob", TOGETHER, k)[: own.stop - lo])
            if far:
                prob -= prob.max(axis=1, keepdims=True)
            every, place = prob.reshape(-1), starts[: own.stop - lo] + goal[own]
            if logs is not None:
                logs[own] = every[place]
            np.exp(prob, out=prob)
            # Exponents are never divided by their sums, which go to the narrow side of each product.
            total = prob @ ones[:k]
            if logs is not None:
                logs[own] -= np.log(total)
            every[place] -= total
            part = np.repeat(share[own] / total, h + 1).reshape(-1, h + 1)
            np.matmul(prob, back, out=dh[own, :h])
            dh[own] *= part
            part *= full[own]
            to_out += part.T @ prob
        bent = np.multiply(full, full, out=room("bent", places, h + 1))
        bent *= dh
        dh -= bent
        mixed *= dh
        slopes = room("slopes", places, cols + h + 1)
        slopes[:, cols:] = dh
        # The last column of dh is zero and that of v one: what a softmax takes off all its slopes travels there.
        dh[:, -1] = mixed @ -ones[: h + 1]
        inner, parts = dh.reshape(n, t, h + 1), slopes.reshape(n, t, -1)
        datt = np.matmul(inner, v.transpose(0, 2, 1), out=room("datt", n, t, t))
        datt *= att
        np.matmul(att.transpose(0, 2, 1), inner[:, :, :h], out=parts[:, :, 2 * d : cols - 1])
        parts[:, :, cols - 1] = 0
        np.matmul(datt, key, out=parts[:, :, :d])
        np.matmul(datt.transpose(0, 2, 1), q, out=parts[:, :, d : 2 * d])
        read, dx, back = np.take(x, which, axis=0, out=room("read", places, d), mode="clip"), room("dx", places, d), np.ascontiguousarray(wide.T)
        to_wide = np.zeros_like(back)
        for lo in range(0, places, STEP):
            some = slopes[lo : lo + STEP]
            np.matmul(some, back, out=dx[lo : lo + STEP])
            to_wide += some.T @ read[lo : lo + STEP]
        to_wide = to_wide.T
        to_v = to_wide[:, 2 * d : cols - 1]
        g = {"q": to_wide[:, :d] * scale, "k": to_wide[:, d : 2 * d], "v": to_v @ w["a"].T, "a": w["v"].T @ to_v, "x": to_wide[:, cols:-1]}
        g |= {"b": ones[:places] @ slopes[:, cols:-1], "out": to_out[:h], "bias": to_out[h]}
        g["far"] = np.bincount(self.distance[:t, :t].ravel(), ones[:n] @ datt.reshape(n, t * t), self.p.window).astype(kind)
        # Slopes of the same row are added two by two, as complex numbers are.
        dx = dx.take(order, axis=0)
        dx = dx.view(np.complex64) if kind == np.float32 and d % 2 == 0 else dx
        return (distinct, np.add.reduceat(dx, first, axis=0).view(kind)), g


#: Parameters that all windows move, in the order in which they are joined to one vector.
DENSE = ("q", "k", "v", "far", "x", "a", "b", "out", "bias")


@dataclass
class Learned:
    """A layer on its way: rows of ``e``, what squares of gradients each has gathered, the other parameters and their mean squares."""

    e: np.ndarray
    gathered: np.ndarray
    dense: np.ndarray
    squares: np.ndarray
    steps: int = 0

    @classmethod
    def start(cls, p: AttentionParams, rows: int) -> Learned:
        w = CausalAttention(p, rows).w
        dense = np.concatenate([w[k].ravel() for k in DENSE])
        return cls(w["e"] * np.float32(0.2), np.zeros(rows, np.float32), dense, np.zeros_like(dense))

    def net(self, p: AttentionParams) -> CausalAttention:
        """The layer whose parameters are views of these."""
        out, at = CausalAttention(p, 1), 0
        for k in DENSE:
            size = out.w[k].size
            out.w[k] = self.dense[at : at + size].reshape(out.w[k].shape)
            at += size
        out.w["e"], out.local = self.e, np.arange(len(self.e), dtype=np.int32)
        return out


def learn(state: Learned, blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], p: AttentionParams, rates: Callable[[int], float], seed: int | list[int]) -> np.ndarray:
    """Moves ``state`` by blocks of windows (rows of ``e``, windows x window + 1; classes of the next ids; sizes), each window once.

    ``rates`` gives the part of the rate that is left after so many windows. The rows move as their own gathered squares allow,
    the other parameters by Adam. Returns how often each row was read.
    """
    net, rng = state.net(p), np.random.default_rng(seed)
    m, begun, done = np.zeros_like(state.dense), 0, 0
    reads, even = np.zeros(len(state.e), np.int64), np.full(p.width, 1 / p.width, np.float32)
    for rows, target, sizes in blocks:
        order = rng.permutation(len(rows))
        weight = (np.arange(p.window)[None, :] < sizes[:, None]).astype(np.float32)
        reads += np.bincount(rows[:, :-1][weight > 0], minlength=len(reads))
        rows, target, weight = rows[order, :-1].astype(np.intp), target[order].astype(np.intp), weight[order]
        for at in range(0, len(order), p.batch):
            own = slice(at, at + p.batch)
            (at_rows, sums), g = net._slopes(rows[own], target[own], weight[own])
            left = p.rate * rates(done)
            done += len(rows[own])
            begun += 1
            state.steps += 1
            flat = np.concatenate([g[k].ravel() for k in DENSE])
            m += np.float32(0.1) * (flat - m)
            flat *= flat
            flat -= state.squares
            flat *= np.float32(0.01)
            state.squares += flat
            np.multiply(state.squares, np.float32(1 / (1 - 0.99**state.steps)), out=flat)
            np.sqrt(flat, out=flat)
            flat += np.float32(1e-6)
            np.divide(m, flat, out=flat)
            flat *= np.float32(left / (1 - 0.9**begun))
            state.dense -= flat
            gathered = state.gathered[at_rows] + (sums * sums) @ even
            state.gathered[at_rows] = gathered
            sums *= (np.float32(ROW_RATE * left) / (np.sqrt(gathered) + np.float32(1e-9)))[:, None]
            state.e[at_rows] -= sums
    return reads


class Scorer(_Rooms):
    """Log probabilities of sequences of ids, each id scored once, in windows that overlap."""

    def __init__(self, net: CausalAttention, classes: np.ndarray, shares: np.ndarray, column: np.ndarray) -> None:
        w, p = net.w, net.p
        self.p, self.classes, self.shares, self.column, self.local = p, classes, shares, column, net.local
        self.kind, rows, d, h = w["e"].dtype, len(w["e"]), p.width, p.hidden
        self.query = w["e"] @ w["q"] / np.float32(np.sqrt(d))
        # Keys and values lie side by side. Values come as what they give to the hidden layer, and have one column of ones more: the
        # sum of the exponents. The hidden layer gets one more place too, which is always one, for the bias of the classes.
        self.read = np.concatenate([w["e"] @ w["k"], w["e"] @ (w["v"] @ w["a"]), np.ones((rows, 1), self.kind)], axis=1)
        self.own = np.concatenate([w["e"] @ w["x"] + w["b"], np.full((rows, 1), ONE, self.kind)], axis=1)
        self.out = np.concatenate([w["out"], w["bias"][None]])
        self.ones = np.ones(p.classes, self.kind)
        self.mask = net._mask(w["far"])
        longest = lambda m: float(np.sqrt((m * m).sum(axis=1).max()))
        #: Exponents that can't leave the range of their type aren't looked through for those that would.
        self.calm = longest(self.query) * longest(self.read[:, :d]) + float(np.abs(w["far"]).max()) < FAR and float(np.abs(self.out).sum(axis=0).max()) < FAR

    def totals(self, ids: np.ndarray, offsets: np.ndarray, block: int = 256) -> np.ndarray:
        """Log probability of each sequence ``ids[offsets[i] : offsets[i + 1]]`` after its first id, which only opens it.

        The first window of a sequence scores all its places, each later one those behind the overlap.
        """
        p, out = self.p, np.zeros(len(offsets) - 1)
        places = np.maximum(np.diff(offsets) - 1, 0)
        count = np.where(places > p.window, 1 + -(-(places - p.window) // p.stride), np.minimum(places, 1))
        row = np.repeat(np.arange(len(places)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][row] + nth * p.stride
        size = np.minimum(p.window, offsets[1:][row] - 1 - start)
        padded = np.concatenate([ids, np.zeros(p.window + 1, ids.dtype)])
        known, said = self.local[padded], np.arange(p.window + 1)
        class_ = self.classes[padded]
        # Shares of ids don't depend on windows.
        of = np.repeat(np.arange(len(places)), places)
        at = np.arange(len(of)) + (offsets[:-1] - np.cumsum(places) + places)[of]
        shares = self.shares.reshape(-1).take(class_[at] * self.shares.shape[1] + self.column[ids[at + 1]])
        out += np.bincount(of, shares, len(out))
        for those, lo in ((np.flatnonzero(nth > 0), p.window - p.stride), (np.flatnonzero(nth == 0), 0)):
            for at in range(0, len(those), block):
                own = those[at : at + block]
                x = start[own][:, None] + said[None, :]
                logs = self._logs(known[x[:, :-1]], class_[x[:, lo + 1 :]], lo)
                logs *= np.arange(lo, p.window)[None, :] < size[own][:, None]
                out += np.bincount(row[own], logs.sum(axis=1), len(out))
        return out

    def _logs(self, x: np.ndarray, nexts: np.ndarray, lo: int) -> np.ndarray:
        """Log probabilities of the classes ``nexts`` behind places ``lo`` and later of the windows ``x``."""
        (n, t), d, room, cols, k = x.shape, self.p.width, self._room, self.read.shape[1], len(self.ones)
        asking, places, h = np.ascontiguousarray(x[:, lo:]), n * (t - lo), cols - d
        read = np.take(self.read, x, axis=0, out=room("read", n, t, cols), mode="clip")
        query = np.take(self.query, asking, axis=0, out=room("query", n, t - lo, d), mode="clip")
        att = np.matmul(query, read[:, :, :d].transpose(0, 2, 1), out=room("att", n, t - lo, t))
        att += self.mask[lo:t]
        if not self.calm and (att.max() > FAR or att[:, np.arange(t - lo), np.arange(lo, t)].min() < -FAR):
            att -= att.max(axis=2, keepdims=True)
        np.exp(att, out=att)
        mixed = np.matmul(att, read[:, :, d:], out=room("mixed", n, t - lo, h)).reshape(places, h)
        mixed *= np.repeat(1 / mixed[:, -1], h).reshape(places, h)
        mixed += np.take(self.own, asking.reshape(-1), axis=0, out=room("own", places, h), mode="clip")
        np.tanh(mixed, out=mixed)
        said, total, goal, starts = np.empty(places, self.kind), np.empty(places, self.kind), nexts.reshape(-1), np.arange(0, TOGETHER * k, k)
        for at in range(0, places, TOGETHER):
            those = slice(at, min(places, at + TOGETHER))
            logits = np.matmul(mixed[those], self.out, out=room("logits", TOGETHER, k)[: those.stop - at])
            if not self.calm and np.abs(logits).max() > FAR:
                logits -= logits.max(axis=1, keepdims=True)
            said[those] = logits.reshape(-1)[starts[: those.stop - at] + goal[those]]
            np.exp(logits, out=logits)
            np.matmul(logits, self.ones, out=total[those])
        return (said.astype(np.float64) - np.log(total)).reshape(nexts.shape)
