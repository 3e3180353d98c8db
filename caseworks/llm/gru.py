"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time.

Words are numbers below `size`; word w is member w % width of class w // width, and its probability is that of its
class times that of the word within the class. Documents run side by side in lanes, one after another, in windows
whose state is carried on, so a document's likelihood covers it from its first word to its end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN = 16
WIDTH = 32
#: Steps that gradients go back through.
STEPS = 24
#: Documents side by side.
LANES = 512
#: Lanes are fewer where one document is so long that most of them would run out before it, but so many at least.
LEAST_LANES = 128
RATE = 0.05

Params = dict[str, np.ndarray]


def shapes(size: int) -> dict[str, tuple[int, ...]]:
    classes = -(-size // WIDTH)
    return {
        "embed": (size, HIDDEN),
        "wx": (HIDDEN, 3 * HIDDEN),
        "wh": (HIDDEN, 3 * HIDDEN),
        "b": (3 * HIDDEN,),
        "bn": (HIDDEN,),
        "wc": (HIDDEN, classes),
        "bc": (classes,),
        "ww": (classes, HIDDEN + 1, WIDTH),  # the last row is the bias
    }


def initial(counts: np.ndarray) -> Params:
    """Small random weights; output biases that give the words' relative frequencies."""
    size = len(counts)
    rng = np.random.default_rng(5)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for k, s in shapes(size).items()}
    share = np.zeros((len(p["wc"][0]), WIDTH), np.float64)
    share.reshape(-1)[:size] = (counts + 0.5) / (counts + 0.5).sum()
    p["bc"] = np.log(share.sum(1)).astype(np.float32)
    p["ww"][:, HIDDEN] = np.where(share > 0, np.log(np.maximum(share, 1e-30) / share.sum(1, keepdims=True)), -30.0)
    return p


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def unflat(values: np.ndarray, size: int) -> Params:
    out, at = {}, 0
    for k, s in sorted(shapes(size).items()):
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _forward(p: Params, table: np.ndarray, ids: np.ndarray, keep: np.ndarray, h: np.ndarray, kept: np.ndarray | None) -> np.ndarray:
    """States after each step (steps x lanes x HIDDEN); table has each word's input part. Where keep is 0 a new document
    starts from a zero state. kept (5 x steps x lanes x HIDDEN) gets what the gradients need."""
    n = HIDDEN
    x = table[ids]
    states = np.empty((*ids.shape, n), np.float32)
    for t in range(len(ids)):
        old = h * keep[t][:, None]
        u = old @ p["wh"]
        gate = _sigmoid(x[t, :, : 2 * n] + u[:, : 2 * n])
        z, r = gate[:, :n], gate[:, n:]
        un = u[:, 2 * n :] + p["bn"]
        new = r * un
        new += x[t, :, 2 * n :]
        np.tanh(new, out=new)
        h = np.add(new, z * (old - new), out=states[t])
        if kept is not None:
            kept[0, t], kept[1, t], kept[2, t], kept[3, t], kept[4, t] = old, z, r, un, new
    return states


def _soften(logits: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each row's target under the softmax, and the probabilities (in place of the logits)."""
    own = logits[rows, targets]
    np.minimum(logits, 80.0, out=logits)
    np.exp(logits, out=logits)
    total = logits.sum(1)
    return own - np.log(total), np.divide(logits, total[:, None], out=logits)


def _output(p: Params, states: np.ndarray, targets: np.ndarray, grad: Params | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target, and (grad) the states' gradients of its sum; states are rows."""
    order = np.argsort((targets // WIDTH).astype(np.int16), kind="stable")  # rows of one class together
    kind, member = targets[order] // WIDTH, targets[order] % WIDTH
    rows = np.arange(len(targets))
    with_one = np.ones((len(targets), HIDDEN + 1), np.float32)
    with_one[:, :HIDDEN] = states[order]
    sorted_states = with_one[:, :HIDDEN]
    got, classes = _soften(sorted_states @ p["wc"] + p["bc"], rows, kind)
    cuts = np.flatnonzero(np.diff(kind, prepend=-1, append=-1))
    spans = [(int(kind[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    words = np.empty((len(targets), WIDTH), np.float32)
    for c, a, b in spans:
        np.matmul(with_one[a:b], p["ww"][c], out=words[a:b])
    more, words = _soften(words, rows, member)
    out = np.empty(len(targets), np.float32)
    out[order] = got + more
    if grad is None:
        return out, None
    np.negative(classes, out=classes)
    np.negative(words, out=words)
    classes[rows, kind] += 1
    words[rows, member] += 1
    grad["wc"] += sorted_states.T @ classes
    grad["bc"] += classes.sum(0)
    back = classes @ p["wc"].T
    for c, a, b in spans:
        grad["ww"][c] += with_one[a:b].T @ words[a:b]
        back[a:b] += words[a:b] @ p["ww"][c, :HIDDEN].T
    unsorted = np.empty_like(back)
    unsorted[order] = back
    return out, unsorted


class Lanes:
    """Documents (rows of word numbers that end with the end's number) side by side, one after another in each lane.

    The lanes are held one behind the other without padding, and windows are cut from them, so memory is that of the
    words whatever the longest document's length.
    """

    def __init__(self, docs: list[np.ndarray], lanes: int) -> None:
        lanes = max(1, min(lanes, len(docs), max(LEAST_LANES, sum(map(len, docs)) // max(map(len, docs)))))
        held: list[list[int]] = [[] for _ in range(lanes)]
        filled = [(0, j) for j in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):  # longest first, each to the emptiest lane
            n, j = filled[0]
            held[j].append(i)
            heapq.heapreplace(filled, (n + len(docs[i]), j))
        filled.sort(key=lambda x: (-x[0], x[1]))  # so that the lanes still running are always the first ones
        order = [i for _, j in filled for i in held[j]]
        sizes = np.array([len(docs[i]) for i in order], np.int64)
        self.size = np.array([n for n, _ in filled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.targets = np.concatenate([docs[i] for i in order]).astype(np.int16)
        self.doc = np.repeat(np.array(order, np.int32), sizes)
        first = np.cumsum(sizes) - sizes
        self.keep = np.ones(len(self.targets), np.float32)
        self.keep[first] = 0
        self.inputs = np.roll(self.targets, 1)
        self.inputs[first] = self.targets[first + sizes - 1]

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places (steps x lanes) of each window, which of them are words, and the keep factors. Lanes that are done are
        left out; the state is carried from window to window."""
        for a in range(0, int(self.size.max(initial=0)), STEPS):
            live = int((self.size > a).sum())
            step = a + np.arange(min(STEPS, int(self.size[0]) - a))[:, None]
            on = step < self.size[:live]
            at = np.where(on, self.start[:live] + step, self.start[:live])
            yield at, on, np.where(on, self.keep[at], np.float32(0))


def log_likelihood(p: Params, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log probability of each document, from its first word to its end."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    side = Lanes(docs, lanes)
    table = p["embed"] @ p["wx"] + p["b"]
    h = np.zeros((len(side.size), HIDDEN), np.float32)
    for at, on, keep in side.windows():
        states = _forward(p, table, side.inputs[at], keep, h[: at.shape[1]], None)
        h, at = states[-1], at[on]
        got, _ = _output(p, states[on], side.targets[at].astype(np.int64), None)
        total += np.bincount(side.doc[at], got, len(docs))
    return total


class Trainer:
    """AdaGrad on windows of STEPS steps of side-by-side documents; every window gives a gradient."""

    def __init__(self, p: Params) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.square = {k: np.full_like(v, 1e-4) for k, v in p.items()}
        self.tokens = 0

    def learn(self, docs: list[np.ndarray], lanes: int = LANES) -> None:
        if not docs:
            return
        p, n = self.p, HIDDEN
        side = Lanes(docs, lanes)
        self.tokens += len(side.targets)
        h = np.zeros((len(side.size), n), np.float32)
        for at, on, keep in side.windows():
            ids = side.inputs[at]
            kept = np.empty((5, *ids.shape, n), np.float32)
            states = _forward(p, p["embed"] @ p["wx"] + p["b"], ids, keep, h[: at.shape[1]], kept)
            h = states[-1]
            grad = {x: np.zeros_like(v) for x, v in p.items()}
            above = np.zeros_like(states)
            _, above[on] = _output(p, states[on], side.targets[at[on]].astype(np.int64), grad)
            old, z, r, un, new = kept
            to_new = (1 - z) * (1 - new * new)
            to_z = (old - new) * (1 - z) * z
            to_r = un * (1 - r) * r
            dx = np.empty((*ids.shape, 3 * n), np.float32)
            du = np.empty_like(dx)
            dh = np.zeros_like(h)
            for t in range(len(ids) - 1, -1, -1):
                dh += above[t]
                dnew = dh * to_new[t]
                np.multiply(dh, to_z[t], out=du[t, :, :n])
                np.multiply(dnew, to_r[t], out=du[t, :, n : 2 * n])
                np.multiply(dnew, r[t], out=du[t, :, 2 * n :])
                dx[t, :, 2 * n :] = dnew
                dh *= z[t]
                dh += du[t] @ p["wh"].T
                dh *= keep[t][:, None]
            dx[:, :, : 2 * n] = du[:, :, : 2 * n]
            rows, flat_ids, flat_du = dx.reshape(-1, 3 * n), ids.reshape(-1), du.reshape(-1, 3 * n)
            grad["wh"] += old.reshape(-1, n).T @ flat_du
            grad["bn"] += flat_du[:, 2 * n :].sum(0)
            order = np.argsort(flat_ids, kind="stable")
            first = np.flatnonzero(np.diff(flat_ids[order], prepend=-1))
            by_word = np.zeros((len(p["embed"]), 3 * n), np.float32)
            by_word[flat_ids[order][first]] = np.add.reduceat(rows[order], first)
            grad["wx"] += p["embed"].T @ by_word
            grad["b"] += by_word.sum(0)
            grad["embed"] += by_word @ p["wx"].T
            for x, g in grad.items():
                g /= STEPS
                np.clip(g, -5, 5, out=g)
                self.square[x] += g * g
                p[x] += RATE * g / np.sqrt(self.square[x])
