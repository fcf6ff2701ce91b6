"""A gated recurrent language model over words, in numpy.

``Model`` is a GRU whose output softmax is factored by class: the probability of
a word is that of its class times that of the word in its class. The most
frequent training words (``VOCAB``) lie in classes of ``IN_CLASS`` neighbours by
rank, each with a softmax of its own. All other words lie in ``ENDINGS`` classes
by their last two characters; within such a class a word has its share of the
class's smoothed training counts, and a word that training has not seen has the
share of one that was never counted. The output biases start at the log counts,
so the untrained model is the smoothed unigram model, and training adds what the
words before say.

Documents lie end to end in parallel lanes. The state is carried through all
windows of a document and is zero at its start, so the probability of a document
is that of the whole of it. Lanes are sorted by length and the shorter ones drop
out as they end; the fewer are left, the longer a window is, so that the outputs
of some ``OUTPUTS`` words are always worked out together. Training goes back
``WINDOW`` words and updates by Adagrad. It learns from every word, from those
of a long document in spans of ``SPAN`` that start like documents, as a lane that
lasts much longer than the others would leave the machine idle.
"""

from __future__ import annotations

import numpy as np

VOCAB, IN_CLASS, ENDINGS, HIDDEN = 1024, 32, 32, 16
HEADS = VOCAB // IN_CLASS
CLASSES = HEADS + ENDINGS
#: input rows: words, then endings, then the start of a document
START = VOCAB + ENDINGS
LANES, WINDOW, SPAN, OUTPUTS, RATE, CLIP = 256, 16, 1000, 8192, 0.1, 5.0
#: logits lower than this by the largest of all are taken from the largest of their row
FAR = -60.0

SHAPES = {
    "inputs": (START + 1, 3 * HIDDEN), "again": (HIDDEN, 3 * HIDDEN),
    # the last row (of classes) and column (of words) are biases
    "classes": (HIDDEN + 1, CLASSES), "words": (VOCAB, HIDDEN + 1),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def initial(word_mass: np.ndarray, ending_mass: np.ndarray, seed: int = 42) -> np.ndarray:
    """Parameters and squared-gradient sums, one behind the other. ``word_mass``
    are the smoothed counts of the vocabulary (shorter ones are filled up with
    words that cannot occur), ``ending_mass`` those of the ending classes."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(2 * SIZE, np.float32)
    p = _views(flat[:SIZE])
    p["inputs"][:] = rng.normal(0, 0.1, p["inputs"].shape)
    p["inputs"][:, :HIDDEN] -= 1.0  # remember little at first
    p["again"][:] = rng.normal(0, HIDDEN ** -0.5, p["again"].shape)
    mass = np.full(VOCAB, 1e-9)
    mass[:len(word_mass)] = word_mass
    p["words"][:, HIDDEN] = np.log(mass)
    p["classes"][HIDDEN] = np.log(np.concatenate([mass.reshape(HEADS, IN_CLASS).sum(1), ending_mass]))
    p["classes"][HIDDEN] -= p["classes"][HIDDEN].max()
    flat[SIZE:] = 1e-2
    return flat


class Lanes:
    """Documents (arrays of class-or-word numbers, below VOCAB a word, from
    VOCAB on an ending) dealt out to at most ``lanes`` lanes of like length."""

    def __init__(self, docs: list[np.ndarray], lanes: int = LANES):
        lanes = max(1, min(lanes, len(docs)))
        held: list[list[int]] = [[] for _ in range(lanes)]
        size = np.zeros(lanes, np.int64)
        for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
            lane = int(size.argmin())
            held[lane].append(k)
            size[lane] += len(docs[k])
        by = np.argsort(-size, kind="stable")
        self.length = size[by]
        n = int(self.length.max(initial=0))
        self.target = np.full((n, lanes), START, np.int32)
        self.doc = np.zeros((n, lanes), np.int32)
        self.input = np.full((n, lanes), START, np.int32)
        for lane, source in enumerate(by):
            at = 0
            for k in held[source]:
                m = len(docs[k])
                self.target[at:at + m, lane] = docs[k]
                self.doc[at:at + m, lane] = k
                self.input[at + 1:at + m, lane] = docs[k][:-1]
                at += m

    def windows(self, steps: int = WINDOW, words: int = 0):
        """(rows, columns) of each window: lanes that have ended are left out.
        Windows have ``steps`` rows, or more to have ``words`` words."""
        a = 0
        while a < len(self.target):
            lanes = int(np.searchsorted(-self.length, -a))
            b = min(a + max(steps, words // lanes), len(self.target))
            yield slice(a, b), slice(0, lanes)
            a = b


def _sigmoid(x: np.ndarray) -> None:
    """In place. Where ``exp`` is infinite, the reciprocal is the wanted 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _log_soften(x: np.ndarray, target: np.ndarray, learn: bool) -> np.ndarray:
    """Log softmax of each row of ``x`` at its target. ``x`` is overwritten, with
    ``learn`` by the gradient of minus that. One maximum serves all rows, unless
    a row lies so far below it that its terms would vanish."""
    at = np.arange(0, x.size, x.shape[1])
    at += target
    x -= x.max()
    flat = x.reshape(-1)
    logs = flat[at]
    if logs.min() < FAR:
        x -= x.max(1, keepdims=True)
        logs = flat[at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    if learn:
        x *= (1 / total)[:, None]
        flat[at] -= 1
    return logs.astype(np.float64) - np.log(total)


class Model:
    def __init__(self, flat: np.ndarray):
        self.flat = np.array(flat, np.float32)
        self.p, self.squares = _views(self.flat[:SIZE]), _views(self.flat[SIZE:])

    def _states(self, inputs, state, keep: bool):
        """States after each input; with ``keep`` also what going back needs:
        states before, gates, new states and what the gate let in of them."""
        again = self.p["again"]
        steps, lanes = inputs.shape
        x = self.p["inputs"][inputs]
        out = np.empty((steps + 1, lanes, HIDDEN), np.float32)
        out[0] = state
        before, gates, new, inner = (np.empty((steps if keep else 1, lanes, n), np.float32) for n in (HIDDEN, 2 * HIDDEN, HIDDEN, HIDDEN))
        start = inputs == START
        starts = start.any(1)
        with np.errstate(over="ignore"):
            for t in range(steps):
                at = t if keep else 0
                h, gate, n, after = out[t], gates[at], new[at], out[t + 1]
                if starts[t]:
                    h = np.where(start[t][:, None], np.float32(0), h)
                g = h @ again
                np.add(x[t, :, :2 * HIDDEN], g[:, :2 * HIDDEN], out=gate)
                _sigmoid(gate)
                np.multiply(gate[:, HIDDEN:], g[:, 2 * HIDDEN:], out=n)
                n += x[t, :, 2 * HIDDEN:]
                np.tanh(n, out=n)
                np.subtract(h, n, out=after)
                after *= gate[:, :HIDDEN]
                after += n
                if keep:
                    before[t], inner[t] = h, g[:, 2 * HIDDEN:]
        return out, (before, gates, new, inner), start

    def _outputs(self, states, target, learn: bool):
        """Natural log probability of each target (of an ending, of its class
        alone); with ``learn`` the gradient by state, and by output weights."""
        p = self.p
        kind = np.where(target < VOCAB, target // IN_CLASS, target - VOCAB + HEADS).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        ordered = np.ones((len(order), HIDDEN + 1), np.float32)
        ordered[:, :HIDDEN] = states[order]
        target, kind = target[order], kind[order]
        by_class = ordered @ p["classes"]
        logs = _log_soften(by_class, kind, learn)
        back, grads = None, None
        if learn:
            back = by_class @ p["classes"][:HIDDEN].T
            grads = {"classes": ordered.T @ by_class, "words": np.zeros(SHAPES["words"], np.float32)}
        bounds = np.searchsorted(kind, np.arange(HEADS + 1))
        listed, used = bounds[HEADS], np.flatnonzero(np.diff(bounds))
        heads = [(slice(bounds[c], bounds[c + 1]), slice(c * IN_CLASS, (c + 1) * IN_CLASS)) for c in used]
        inside = np.empty((listed, IN_CLASS), np.float32)
        for at, own in heads:
            np.matmul(ordered[at], p["words"][own].T, out=inside[at])
        if listed:
            logs[:listed] += _log_soften(inside, target[:listed] % IN_CLASS, learn)
        if learn:
            for at, own in heads:
                back[at] += inside[at] @ p["words"][own, :HIDDEN]
                np.matmul(inside[at].T, ordered[at], out=grads["words"][own])
        out = np.empty(len(order))
        out[order] = logs
        if learn:
            moved = np.empty_like(back)
            moved[order] = back
            back = moved
        return out, back, grads

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document's numbers."""
        out = np.zeros(len(docs))
        lanes = Lanes(docs)
        state = np.zeros((lanes.target.shape[1], HIDDEN), np.float32)
        for rows, columns in lanes.windows(WINDOW, OUTPUTS):
            states, _, _ = self._states(lanes.input[rows, columns], state[columns], False)
            state[columns] = states[-1]
            target = lanes.target[rows, columns]
            live = target != START
            logs, _, _ = self._outputs(states[1:][live], target[live], False)
            out += np.bincount(lanes.doc[rows, columns][live], logs, minlength=len(docs))
        return out

    def learn(self, docs: list[np.ndarray]) -> float:
        """One pass of truncated backpropagation; the sum of log probabilities
        as they were met."""
        lanes, total = Lanes([d[a:a + SPAN] for d in docs for a in range(0, len(d), SPAN)]), 0.0
        state = np.zeros((lanes.target.shape[1], HIDDEN), np.float32)
        for rows, columns in lanes.windows(WINDOW):
            inputs, target = lanes.input[rows, columns], lanes.target[rows, columns]
            states, held, start = self._states(inputs, state[columns], True)
            state[columns] = states[-1]
            live = target != START
            logs, back, grads = self._outputs(states[1:][live], target[live], True)
            total += logs.sum()
            at_state = np.zeros((*target.shape, HIDDEN), np.float32)
            at_state[live] = back
            grads |= self._back(held, start, at_state, inputs)
            self._update(grads)
        return total

    def _back(self, held, start, at_state, inputs):
        before, gates, new, inner = held
        again = self.p["again"].T.copy()
        steps, lanes, _ = at_state.shape
        z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
        # gradient of the two gates and the new state, each by the state's; that of
        # the new state reaches the state before through the second gate
        by = np.empty((steps, lanes, 3, HIDDEN), np.float32)
        to_new = (1 - z) * (1 - new * new)
        np.multiply(to_new, r, out=by[:, :, 2])
        by[:, :, 1] = by[:, :, 2] * inner * (1 - r)
        by[:, :, 0] = (before - new) * z * (1 - z)
        after, starts = np.zeros((lanes, HIDDEN), np.float32), start.any(1)
        for t in range(steps - 1, -1, -1):
            d = at_state[t]
            d += after
            by[t] *= d[:, None, :]
            after = by[t].reshape(lanes, 3 * HIDDEN) @ again
            after += d * z[t]
            if starts[t]:
                after[start[t]] = 0
        flat = by.reshape(-1, 3 * HIDDEN)
        at_again = before.reshape(-1, HIDDEN).T @ flat
        np.multiply(to_new, at_state, out=by[:, :, 2])  # now by the inputs
        ids = inputs.ravel().astype(np.int16)
        order = np.argsort(ids, kind="stable")
        used, first = np.unique(ids[order], return_index=True)
        return {"again": at_again, "inputs": (used, np.add.reduceat(flat[order], first, axis=0))}

    def _update(self, grads) -> None:
        # windows of few lanes weigh as little as they have words
        scale = np.float32((LANES * WINDOW) ** -0.5)
        for name, g in grads.items():
            rows = slice(None)
            if name == "inputs":
                rows, g = g
            g = np.clip(g * scale, -CLIP, CLIP)
            squares = self.squares[name]
            if name == "inputs":
                squares[rows] += g * g
                self.p[name][rows] -= RATE * g / np.sqrt(squares[rows])
            else:
                squares += g * g
                self.p[name] -= RATE * g / np.sqrt(squares)
