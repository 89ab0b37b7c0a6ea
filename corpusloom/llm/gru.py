"""A small gated recurrent network in numpy with a class-factored output softmax.

A token is known by a model id: below ``words`` a learned word, else a spelling
class.  The output first gives a class (a block of ``BLOCK`` learned words, or a
spelling class), then the word inside its block.  What a word has inside its
spelling class isn't the network's business.

Sequences are *packed*: step by step, the open sequences side by side, longest
first, so that each step is one matrix product and nothing is padded.  The state
is carried from window to window and cleared where a text starts.
"""

from __future__ import annotations

import numpy as np

HIDDEN, BLOCK, CHUNK = 16, 32, 1024
F32 = np.float32


def _sigmoid(x: np.ndarray) -> None:
    """In place; weights keep |x| far below what would overflow, and infinity gives 0 rightly."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += F32(1)
    np.reciprocal(x, out=x)


def _softmax(hidden: np.ndarray, target: np.ndarray, weights: np.ndarray, bias: np.ndarray, grads: tuple | None) -> tuple[np.ndarray, np.ndarray | None]:
    """(log probability of each row's target, gradient of the rows); adds to the gradients of weights and bias."""
    e = hidden @ weights
    e += bias
    rows = np.arange(len(target))
    out = e[rows, target]
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], F32)
    out -= np.log(total)
    if grads is None:
        return out, None
    e *= np.reciprocal(total)[:, None]
    e[rows, target] -= 1
    grads[0][...] += hidden.T @ e
    grads[1][...] += np.ones(len(e), F32) @ e
    return out, e @ weights.T


class Gru:
    """Weights by name, in one flat float32 array so that replicas can be averaged."""

    def __init__(self, blocks: int, classes: int, flat: np.ndarray | None = None):
        self.blocks, self.classes, self.words = blocks, classes, blocks * BLOCK
        shapes = {
            "x": (self.words + classes, 3 * HIDDEN),
            "u": (HIDDEN, 3 * HIDDEN),
            "c": (HIDDEN, blocks + classes),
            "cb": (blocks + classes,),
            "w": (blocks, HIDDEN, BLOCK),
            "wb": (blocks, BLOCK),
        }
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.flat = np.zeros(sum(sizes), F32) if flat is None else flat.astype(F32)
        self.part = dict(zip(shapes, (a.reshape(s) for a, s in zip(np.split(self.flat, np.cumsum(sizes)[:-1]), shapes.values(), strict=True)), strict=True))

    def start(self, word_counts: np.ndarray, class_counts: np.ndarray) -> Gru:
        """First weights: small noise, and output biases that equal the counts' shares."""
        rng = np.random.default_rng(7)
        for name, scale in (("x", 0.3), ("u", 0.25), ("c", 0.05), ("w", 0.05)):
            self.part[name][...] = rng.normal(0, scale, self.part[name].shape)
        full = np.zeros(self.words)
        full[: len(word_counts)] = word_counts
        by_block = full.reshape(self.blocks, BLOCK)
        self.part["wb"][...] = np.log((by_block + 1e-9) / (by_block.sum(1, keepdims=True) + 1e-9))
        mass = np.concatenate([by_block.sum(1), class_counts]) + 0.1
        self.part["cb"][...] = np.log(mass / mass.sum())
        return self

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // BLOCK, ids - self.words + self.blocks).astype(np.int16)

    def steps(self, inputs: np.ndarray, fresh: np.ndarray, bounds: np.ndarray, state: np.ndarray, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(outputs of every packed row, state of the rows open at the last step)."""
        x, u = self.part["x"], self.part["u"]
        out = np.empty((len(inputs), HIDDEN), F32)
        cleared = np.flatnonzero(fresh)
        of_step = np.searchsorted(cleared, bounds).tolist()
        two, h = 2 * HIDDEN, state
        for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            h = h[: b - a]
            if of_step[t] < of_step[t + 1]:
                h[cleared[of_step[t] : of_step[t + 1]] - a] = 0
            g = h @ u
            s = x.take(inputs[a:b], axis=0)
            zr = s[:, :two] + g[:, :two]
            _sigmoid(zr)
            z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, two:]
            n = r * gn
            n += s[:, two:]
            n *= F32(2)
            _sigmoid(n)
            n *= F32(2)
            n -= F32(1)
            if tape is not None:
                tape.append((h, z, r, gn, n))
            h = h - n
            h *= z
            h += n
            out[a:b] = h
        return out, h

    def losses(self, hidden: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(natural log probability of each target up to its spelling class, gradient of the hidden rows)."""
        kind = self.class_of(target)
        out = np.empty(len(target), F32)
        back = None if grads is None else np.empty_like(hidden)
        for a in range(0, len(target), CHUNK):  # small arrays stay in the cache
            part = slice(a, a + CHUNK)
            out[part], d = _softmax(hidden[part], kind[part], self.part["c"], self.part["cb"], grads and (grads["c"], grads["cb"]))
            if grads is not None:
                back[part] = d
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(self.blocks + 1))
        for k in range(self.blocks):
            at = order[ends[k] : ends[k + 1]]
            if len(at):
                found, d = _softmax(hidden.take(at, axis=0), target[at] - k * BLOCK, self.part["w"][k], self.part["wb"][k], grads and (grads["w"][k], grads["wb"][k]))
                out[at] += found
                if grads is not None:
                    back[at] += d
        return out, back

    def gradient(self, inputs: np.ndarray, fresh: np.ndarray, target: np.ndarray, width: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient by weight, state after the window) of one window of ``width`` sequences."""
        flat = Gru(self.blocks, self.classes)
        grads, u = flat.part, self.part["u"]
        tape: list = []
        bounds = np.arange(0, len(inputs) + 1, width)
        hidden, last = self.steps(inputs, fresh, bounds, state, tape)
        _, back = self.losses(hidden, target, grads)
        dx, dg, before = np.empty((len(inputs), 3 * HIDDEN), F32), np.empty((len(inputs), 3 * HIDDEN), F32), np.empty_like(hidden)
        carry, two, ut = np.zeros((width, HIDDEN), F32), 2 * HIDDEN, np.ascontiguousarray(u.T)
        for t in range(len(tape) - 1, -1, -1):
            a, b = t * width, (t + 1) * width
            h, z, r, gn, n = tape[t]
            d = back[a:b]
            d += carry
            dz = d * z
            dn = (d - dz) * (F32(1) - n * n)
            dx[a:b, :HIDDEN] = dz * (F32(1) - z) * (h - n)
            rn = r * dn
            dx[a:b, HIDDEN:two] = rn * gn * (F32(1) - r)
            dx[a:b, two:] = dn
            dg[a:b, :two] = dx[a:b, :two]
            dg[a:b, two:] = rn
            before[a:b] = h
            carry = dg[a:b] @ ut
            carry += dz
            carry[fresh[a:b]] = 0
        grads["u"] += before.T @ dg
        order = np.argsort(inputs, kind="stable")
        firsts = np.flatnonzero(np.concatenate([[True], inputs[order][1:] != inputs[order][:-1]]))
        grads["x"][inputs[order][firsts]] = np.add.reduceat(dx[order], firsts, axis=0)
        return flat.flat / F32(len(inputs)), last


class Trainer:
    """Truncated backpropagation with Adam steps over streams of texts laid end to end."""

    def __init__(self, model: Gru, rate: float, width: int = 512, length: int = 16):
        self.model, self.rate, self.width, self.length = model, rate, width, length
        self.m, self.v, self.turn = np.zeros_like(model.flat), np.zeros_like(model.flat), 0

    def learn(self, ids: np.ndarray, first: np.ndarray, end: int) -> None:
        """ids: the tokens of texts, each closed by the end token ``end``; first: marks each text's first token."""
        width = min(self.width, max(1, len(ids) // (64 * self.length)))  # 64 steps at least, where there are tokens for them
        steps, rest = divmod(len(ids), width)
        before = np.concatenate([[end], ids[:-1]]).astype(np.int32)
        starts = np.arange(width) * steps + np.minimum(np.arange(width), rest)  # the first lanes hold one token more
        state = np.zeros((width, HIDDEN), F32)
        for t in range(0, steps, self.length):
            state = self._step(before, first, ids, starts + np.arange(t, min(t + self.length, steps))[:, None], state)
        if rest:
            self._step(before, first, ids, (starts[:rest] + steps)[None], state[:rest])

    def _step(self, before: np.ndarray, first: np.ndarray, ids: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One Adam step on the window of tokens at (step by lane); the state after it."""
        g, state = self.model.gradient(before[at].ravel(), first[at].ravel(), ids[at].ravel(), at.shape[1], state)
        self.turn += 1
        self.m += F32(0.1) * (g - self.m)
        self.v += F32(0.01) * (g * g - self.v)
        size = self.rate * np.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn)
        self.model.flat -= F32(size) * self.m / (np.sqrt(self.v) + F32(1e-7))
        return state


def packed(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed row of every token, step bounds) of texts dealt to ``width`` lanes, longest first."""
    import heapq

    order = np.argsort(-lengths, kind="stable")
    lanes = [(0, i) for i in range(min(width, len(lengths)))]
    lane, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order.tolist():
        full, k = lanes[0]
        lane[i], at[i] = k, full
        heapq.heapreplace(lanes, (full + int(lengths[i]), k))
    total = np.zeros(len(lanes), np.int64)
    for full, k in lanes:
        total[k] = full
    rank = np.empty(len(lanes), np.int64)
    by = np.argsort(-total, kind="stable")
    rank[by] = np.arange(len(by))
    open_ = np.searchsorted(-total[by], -np.arange(total.max()), "left")  # lanes longer than step t
    bounds = np.concatenate([[0], np.cumsum(open_)])
    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    step = np.repeat(at, lengths) + inner
    return bounds[step] + np.repeat(rank[lane], lengths), bounds


def text_scores(model: Gru, ids: np.ndarray, offsets: np.ndarray, end: int, width: int = 1024, rows: int = 1 << 14) -> np.ndarray:
    """Natural log probability of every text, whole, up to the words inside spelling classes."""
    lengths = np.diff(offsets)
    if not len(lengths):
        return np.zeros(0)
    row, bounds = packed(lengths, width)
    n = len(ids)
    target, inputs, fresh, owner = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n, bool), np.empty(n, np.int32)
    target[row] = ids
    inputs[row[1:]] = ids[:-1]
    inputs[row[offsets[:-1]]] = end
    fresh[row[offsets[:-1]]] = True
    owner[row] = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros(len(lengths))
    state = np.zeros((int(bounds[1]), HIDDEN), F32)
    t = 0
    while t < len(bounds) - 1:
        stop = max(t + 1, int(np.searchsorted(bounds, bounds[t] + rows, "right")) - 1)
        a, b = bounds[t], bounds[stop]
        hidden, state = model.steps(inputs[a:b], fresh[a:b], bounds[t : stop + 1] - a, state)
        logp, _ = model.losses(hidden, target[a:b])
        out += np.bincount(owner[a:b], logp, len(lengths))
        t = stop
    return out
