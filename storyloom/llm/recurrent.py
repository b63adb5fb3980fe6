"""A gated recurrent network over token codes with a class-factored softmax, in numpy.

Codes 0 .. heads*width-1 are head words, ``width`` to a class; the codes after them are classes of
other words, which the network predicts as classes only. Documents run in slots side by side, one
after another; the state is carried from window to window and set to zero where a document starts,
so a document's log-likelihood is that of its whole text, and training is backpropagation through
time truncated at the windows' edges.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Shape:
    heads: int  # classes of head words
    width: int  # words in each
    rest: int  # classes of other words
    hidden: int = 16

    @property
    def classes(self) -> int:
        return self.heads + self.rest

    @property
    def codes(self) -> int:
        return self.heads * self.width + self.rest


def initial(shape: Shape, counts, seed: int = 5) -> dict:
    """Weights that give every code its relative frequency before training; counts is by code."""
    rng, h = np.random.default_rng(seed), shape.hidden
    n = np.maximum(np.asarray(counts, np.float64), 0.5)
    head = n[: shape.heads * shape.width].reshape(shape.heads, shape.width)
    by_class = np.concatenate([head.sum(axis=1), n[shape.heads * shape.width :]])
    weights = {
        # By gate: update, reset, candidate. Every array of a step is then one piece of memory.
        "E": rng.normal(0, 0.3, (3, shape.codes, h)),
        "U": rng.normal(0, h**-0.5, (3, h, h)),
        "Wc": rng.normal(0, 0.05, (h, shape.classes)),
        "bc": np.log(by_class / by_class.sum()),
        "Ww": rng.normal(0, 0.05, (shape.heads, h, shape.width)),
        "bw": np.log(head / head.sum(axis=1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in weights.items()}


def pack(weights: dict):
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpack(flat, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = np.asarray(flat[at : at + n], np.float32).reshape(like[k].shape)
        at += n
    return out


class Slots:
    """Documents laid out in slots of nearly equal length, longest slot first."""

    def __init__(self, docs: list, most: int) -> None:
        lengths = np.array([len(d) for d in docs], np.int64)
        n = int(np.clip(lengths.sum() // 1000, 1, min(most, len(docs))))
        heap = [(0, k) for k in range(n)]
        held: list[list[int]] = [[] for _ in range(n)]
        for i in np.argsort(-lengths, kind="stable").tolist():
            size, k = heapq.heappop(heap)
            held[k].append(i)
            heapq.heappush(heap, (size + int(lengths[i]), k))
        held.sort(key=lambda h: -int(lengths[h].sum()))
        order = [i for h in held for i in h]
        self.tokens = np.concatenate([docs[i] for i in order]).astype(np.int32)
        self.doc = np.repeat(np.array(order, np.int32), lengths[order])
        self.start = np.zeros(len(self.tokens), bool)
        self.start[np.cumsum(lengths[order]) - lengths[order]] = True
        self.size = np.array([int(lengths[h].sum()) for h in held], np.int64)
        self.offset = np.cumsum(self.size) - self.size

    def windows(self, steps: int, tokens: int):
        """(n, at, valid): the n slots that go on, positions (steps, n) of their tokens, and
        which of these are tokens. Where few slots go on, windows are longer (to that many tokens)."""
        t, last = 0, int(self.size[0]) if len(self.size) else 0
        while t < last:
            n = int(np.searchsorted(-self.size, -t, side="left"))
            step = t + np.arange(min(max(steps, min(tokens // n, 20 * steps)), last - t))[:, None]
            valid = step < self.size[None, :n]
            yield n, np.where(valid, self.offset[None, :n] + step, self.offset[None, :n]), valid
            t += len(step)


def states(w: dict, tokens, start, h):
    """Over a window: the states that predict each token, the gates, and the last state."""
    steps, n = tokens.shape
    hid = w["U"].shape[-1]
    x = np.empty((steps, 3, n, hid), np.float32)
    for k in range(3):
        x[:, k] = np.take(w["E"][k], tokens, axis=0)
    s_all, c_all, g_all = (np.empty((steps, n, hid), np.float32) for _ in range(3))
    zr_all = np.empty((steps, 2, n, hid), np.float32)
    carry = (~start).astype(np.float32)[:, :, None]
    for t in range(steps):
        s, zr, c = s_all[t], zr_all[t], c_all[t]
        np.multiply(h, carry[t], out=s)
        g = np.matmul(s, w["U"])
        np.add(g[:2], x[t, :2], out=zr)
        # A sigmoid by the hyperbolic tangent, in place.
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        g_all[t] = g[2]
        np.multiply(zr[1], g[2], out=c)
        c += x[t, 2]
        np.tanh(c, out=c)
        h = c - s
        h *= zr[0]
        h += s
    return s_all, (zr_all, c_all, g_all), carry, h


def outputs(w: dict, shape: Shape, s, codes, grad: dict | None = None, weight=None, block: int = 1024):
    """Log probability of each code after its state s; with grad, adds the gradients of the mean
    negative log probability over weight's ones, and returns that of s, too.

    Works in blocks of rows whose logits stay in the processor's cache; biases are the weights of a
    constant beside the states, so they take no passes of their own.
    """
    n_head, hid = shape.heads * shape.width, s.shape[1]
    is_head = codes < n_head
    cls = np.where(is_head, codes // shape.width, codes - n_head + shape.heads)
    one = np.ones((len(s), hid + 1), s.dtype)
    one[:, :hid] = s
    by_class = np.concatenate([w["Wc"], w["bc"][None, :]])
    back = np.ascontiguousarray(w["Wc"].T)
    sums = np.ones(max(shape.classes, shape.width), by_class.dtype)
    out = np.empty(len(s), np.result_type(s, by_class))
    ds = np.empty_like(s) if grad is not None else None
    d_class = np.zeros_like(by_class)
    for i in range(0, len(s), block):
        part, at = one[i : i + block], cls[i : i + block]
        rows = np.arange(len(part))
        # States are within -1 and 1, so logits are small numbers, and exp needs no shift.
        e = part @ by_class
        got = e[rows, at]
        np.exp(e, out=e)
        total = e @ sums[: shape.classes]
        out[i : i + block] = got - np.log(total)
        if grad is not None:
            share = weight[i : i + block]
            e *= (share / total)[:, None]
            e[rows, at] -= share
            d_class += part.T @ e
            np.matmul(e, back, out=ds[i : i + block])
    if grad is not None:
        grad["Wc"] += d_class[:-1]
        grad["bc"] += d_class[-1]
    heads = np.flatnonzero(is_head)
    order = heads[np.argsort(cls[heads].astype(np.int16), kind="stable")]
    edges = np.searchsorted(cls[order], np.arange(shape.heads + 1))
    sorted_one, word = one[order], codes[order] - cls[order] * shape.width
    for k in range(shape.heads):
        i, j = edges[k], edges[k + 1]
        if i == j:
            continue
        at, sk, here = order[i:j], sorted_one[i:j], np.arange(j - i)
        p = sk @ np.concatenate([w["Ww"][k], w["bw"][k][None, :]])
        got = p[here, word[i:j]]
        np.exp(p, out=p)
        total = p @ sums[: shape.width]
        out[at] += got - np.log(total)
        if grad is not None:
            share = weight[at]
            p *= (share / total)[:, None]
            p[here, word[i:j]] -= share
            d_word = sk.T @ p
            grad["Ww"][k] += d_word[:-1]
            grad["bw"][k] += d_word[-1]
            ds[at] += p @ w["Ww"][k].T
    return out, ds


def log_likelihoods(w: dict, shape: Shape, docs: list, most: int = 512, steps: int = 32):
    """Natural log probability of each document's codes."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    slots = Slots(docs, most)
    h = np.zeros((len(slots.size), shape.hidden), np.float32)
    for n, at, valid in slots.windows(steps, 16384):
        tokens = slots.tokens[at]
        s, _, _, h = states(w, tokens, slots.start[at], h[:n])
        keep = valid.ravel()
        got, _ = outputs(w, shape, s.reshape(-1, shape.hidden)[keep], tokens.ravel()[keep])
        total += np.bincount(slots.doc[at].ravel()[keep], got, len(docs))
    return total


def gradients(w: dict, shape: Shape, tokens, start, valid, h):
    """Gradients over one window, the sum of log probabilities, and the last state."""
    hid = shape.hidden
    s, (zr, c, gc), carry, last = states(w, tokens, start, h)
    flat, codes = s.reshape(-1, hid), tokens.ravel()
    weight = valid.ravel().astype(np.float32) / max(1, valid.sum())
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    got, ds_out = outputs(w, shape, flat, codes, grad, weight)
    ds_out = ds_out.reshape(s.shape)
    steps, n = tokens.shape
    # What doesn't depend on the gradient from later steps is worked out for the whole window.
    z, r = zr[:, 0], zr[:, 1]
    stay = 1 - z
    by_c, by_z, by_r = z * (1 - c * c), (c - s) * z * stay, gc * r * (1 - r)
    # Gradients before the gates: update, reset, candidate; and the candidate's through its gate.
    d, through = np.empty((3, steps, n, hid), np.float32), np.empty((steps, n, hid), np.float32)
    dh, back = np.zeros((n, hid), np.float32), np.ascontiguousarray(w["U"].transpose(0, 2, 1)).astype(np.float32)
    for t in range(steps - 1, -1, -1):
        dz, dr, dc = d[0, t], d[1, t], d[2, t]
        np.multiply(dh, by_z[t], out=dz)
        np.multiply(dh, by_c[t], out=dc)
        np.multiply(dc, by_r[t], out=dr)
        np.multiply(dc, r[t], out=through[t])
        dh *= stay[t]
        dh += dz @ back[0]
        dh += dr @ back[1]
        dh += through[t] @ back[2]
        dh += ds_out[t]
        dh *= carry[t]
    order = np.argsort(codes.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(codes[order]) > 0)))
    for k in range(3):
        rows = d[k].reshape(-1, hid)
        grad["U"][k] += flat.T @ (rows if k < 2 else through.reshape(-1, hid))
        grad["E"][k][codes[order[first]]] += np.add.reduceat(rows[order], first, axis=0)
    return grad, float(got @ valid.ravel()), last


class Trainer:
    """Adam over the windows of documents, in the order they come."""

    def __init__(self, weights: dict, shape: Shape, rate: float, most: int = 512, steps: int = 16) -> None:
        self.w = {k: v.copy() for k, v in weights.items()}
        self.shape, self.rate, self.most, self.steps = shape, rate, most, steps
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.t, self.tokens = 0, 0

    def learn(self, docs: list) -> None:
        if not docs:
            return
        slots = Slots(docs, self.most)
        h = np.zeros((len(slots.size), self.shape.hidden), np.float32)
        for n, at, valid in slots.windows(self.steps, 2048):
            tokens = slots.tokens[at]
            grad, _, h = gradients(self.w, self.shape, tokens, slots.start[at], valid, h[:n])
            self.step(grad, int(valid.sum()))

    def step(self, grad: dict, tokens: int) -> None:
        self.t += 1
        self.tokens += tokens
        norm = sum(float((g * g).sum()) for g in grad.values()) ** 0.5
        scale = min(1.0, 1.0 / (norm + 1e-12))
        # Small windows (few slots left) move the weights less: one long text mustn't undo the others.
        rate = self.rate * min(1.0, self.t / 20) * min(1.0, tokens / 2048)
        fix = rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grad.items():
            g *= scale
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            g *= g
            g *= 0.01
            v += g
            self.w[k] -= fix * m / (np.sqrt(v) + 1e-6)
