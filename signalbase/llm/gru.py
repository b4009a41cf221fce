"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

A token is the number of a frequent word (number 0 ends a text) or, from ``head``
on, that of a class of rarer words. The network gives the log probability of each
next token: of its class, and of the word within its class. Classes of frequent
words are runs of numbers in order of frequency, so the first ones hold few words
and most tokens cost little. Texts follow each other in lanes that advance side
by side, window by window; after an end token the state starts from zero.

Parameters are views into one vector, so that replicas can be averaged.
"""

from __future__ import annotations

import heapq

import numpy as np

END = 0
#: State, time steps a gradient reaches back, most lanes in training and in scoring, step length.
UNITS, STEPS, TRAIN_LANES, SCORE_LANES, RATE = 16, 32, 256, 256, 0.15


def class_starts(counts: np.ndarray, classes: int) -> np.ndarray:
    """First number of each class: runs of equal sums of the roots of counts, and the end."""
    mass = np.cumsum(np.sqrt(counts))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0], cuts[cuts < len(counts)], [len(counts)]]))


class Network:
    """``counts`` of the frequent words, in order; ``tail`` masses of the classes of rarer ones; ``starts`` by ``class_starts``."""

    def __init__(self, counts: np.ndarray, tail: np.ndarray, starts: np.ndarray, vector: np.ndarray | None = None):
        self.head, self.starts, n = len(counts), starts, UNITS
        self.classes = len(starts) - 1 + len(tail)
        sizes = {"inputs": (self.head + len(tail), 3 * n), "shift": (3 * n,), "state": (n, 3 * n), "of_class": (n, self.classes), "class_shift": (self.classes,), "of_word": (self.head, n), "word_shift": (self.head,)}
        self.size = sum(int(np.prod(s)) for s in sizes.values())
        fresh = vector is None
        # The second half holds Adagrad's sums of squares.
        self.vector = np.zeros(2 * self.size, np.float32) if fresh else vector
        self.p, self.sums, at = {}, {}, 0
        for name, shape in sizes.items():
            end = at + int(np.prod(shape))
            self.p[name] = self.vector[at:end].reshape(shape)
            self.sums[name] = self.vector[self.size + at : self.size + end].reshape(shape)
            at = end
        self.class_of = np.concatenate([np.repeat(np.arange(len(starts) - 1), np.diff(starts)), len(starts) - 1 + np.arange(len(tail))])
        if fresh:
            # Without any training the network gives the words' own frequencies.
            random = np.random.default_rng(1)
            for name in ("inputs", "state", "of_class", "of_word"):
                self.p[name][:] = random.normal(0, 0.1, self.p[name].shape)
            mass = np.concatenate([np.add.reduceat(counts, starts[:-1]), tail])
            self.p["class_shift"][:] = np.log(mass / mass.sum())
            self.p["word_shift"][:] = np.log(counts)
            self.vector[self.size :] = 1

    def _run(self, ids: np.ndarray, state: np.ndarray, acts: np.ndarray) -> tuple:
        """States after each step of a window (steps, lanes), and what the backward pass needs; ``acts`` are its shifted inputs, gate by gate (3, steps, lanes, units), so that each step works on whole runs of memory."""
        n, (steps, lanes) = UNITS, ids.shape
        keep = (ids != END).astype(np.float32)[:, :, None]
        before, out, recurrent = (np.empty((steps, lanes, n), np.float32) for _ in range(3))
        weights = self._by_gate(self.p["state"])
        moved = np.empty((2, lanes, n), np.float32)
        ended = (ids == END).any(axis=1)
        for t in range(steps):
            if ended[t]:
                np.multiply(state, keep[t], out=before[t])
            else:
                before[t] = state
            np.matmul(before[t], weights[:2], out=moved)
            np.matmul(before[t], weights[2], out=recurrent[t])
            moved += acts[:2, t]
            np.exp(moved, out=moved)
            moved += 1
            np.reciprocal(moved, out=moved)
            acts[:2, t] = moved
            new = acts[2, t]
            state = out[t]
            np.multiply(moved[1], recurrent[t], out=state)
            new += state
            np.tanh(new, out=new)
            np.subtract(before[t], new, out=state)
            state *= moved[0]
            state += new
        return out, before, acts, recurrent, keep

    @staticmethod
    def _by_gate(weights: np.ndarray) -> np.ndarray:
        """(3, rows, units) of a matrix whose columns are the gates' units."""
        return np.ascontiguousarray(weights.reshape(len(weights), 3, UNITS).transpose(1, 0, 2))

    def _words(self, states: np.ndarray, targets: np.ndarray, logs: np.ndarray, slopes: np.ndarray | None) -> None:
        """Adds the words' part within their classes to ``logs``; in training also learns it and sets ``slopes``."""
        of = self.class_of[targets]
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=self.classes)
        ends = np.cumsum(counts)
        states, sorted_targets = states[order], targets[order]
        added = np.zeros(len(order), np.float32)
        back = None if slopes is None else np.zeros_like(states)
        for k in range(len(self.starts) - 1):
            first, last = self.starts[k], self.starts[k + 1]
            if counts[k] and last - first > 1:
                rows = slice(ends[k] - counts[k], ends[k])
                weights, at = self.p["of_word"][first:last], sorted_targets[rows] - first
                scores = states[rows] @ weights.T
                scores += self.p["word_shift"][first:last]
                added[rows] = _softmax(scores, at, learn=back is not None)
                if back is not None:
                    back[rows] = scores @ weights
                    self._step("of_word", scores.T @ states[rows], slice(first, last))
                    self._step("word_shift", np.ones(len(at), np.float32) @ scores, slice(first, last))
        logs[order] += added
        if slopes is not None:
            slopes[order] += back

    def _step(self, name: str, slope: np.ndarray, rows=slice(None)) -> None:
        sums = self.sums[name][rows] + slope * slope
        self.sums[name][rows] = sums
        np.sqrt(sums, out=sums)
        self.p[name][rows] -= RATE * slope / sums

    def _outputs(self, states: np.ndarray, targets: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of the targets after the states; in training also the slopes of the states."""
        scores = states @ self.p["of_class"]
        scores += self.p["class_shift"]
        logs = _softmax(scores, self.class_of[targets], learn)
        slopes = scores @ self.p["of_class"].T if learn else None
        self._words(states, targets, logs, slopes)
        if learn:
            self._step("of_class", states.T @ scores)
            self._step("class_shift", np.ones(len(scores), np.float32) @ scores)
        return logs, slopes

    def _back(self, ids: np.ndarray, run: tuple, slopes: np.ndarray) -> None:
        """Backpropagation through one window, and a step along it."""
        out, before, acts, recurrent, keep = run
        n = UNITS
        update, reset, new = acts
        to_update = (new - before) * update * (1 - update)
        to_new = (1 - update) * (1 - new * new)
        to_reset = recurrent * reset * (reset - 1)
        drift = np.empty((*ids.shape, 3 * n), np.float32)
        straight = np.empty_like(out)
        back = np.zeros_like(out[0])
        weights = np.ascontiguousarray(self.p["state"].T)
        for t in reversed(range(len(out))):
            back += slopes[t]
            d = drift[t]
            np.multiply(back, to_update[t], out=d[:, :n])
            np.multiply(back, to_new[t], out=straight[t])
            np.multiply(straight[t], to_reset[t], out=d[:, n : 2 * n])
            np.multiply(straight[t], reset[t], out=d[:, 2 * n :])
            back *= update[t]
            back += d @ weights
            back *= keep[t]
        flat = drift.reshape(-1, 3 * n)
        state_slope = before.reshape(-1, n).T @ flat
        drift[:, :, 2 * n :] = straight
        order = np.argsort(ids, axis=None, kind="stable")
        numbers = ids.ravel()[order]
        firsts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        self._step("inputs", np.add.reduceat(flat[order], firsts, axis=0), numbers[firsts])
        self._step("shift", np.ones(len(flat), np.float32) @ flat)
        self._step("state", state_slope)

    def train(self, stream: np.ndarray) -> None:
        """One pass over texts that follow each other in ``stream``, each with its end token."""
        if not len(stream):
            return
        # Few tokens go in few lanes, so that they still make many steps.
        lanes = int(np.clip(len(stream) // (STEPS * 64), 8, TRAIN_LANES))
        length = -(-len(stream) // lanes)
        ids, targets = np.zeros(lanes * length, np.int64), np.full(lanes * length, -1)
        ids[1 : len(stream)], targets[: len(stream)] = stream[:-1], stream
        ids, targets = ids.reshape(lanes, length).T, targets.reshape(lanes, length).T
        state = np.zeros((lanes, UNITS), np.float32)
        for at in range(0, length, STEPS):
            window, wanted = np.ascontiguousarray(ids[at : at + STEPS]), targets[at : at + STEPS].ravel()
            run = self._run(window, state, self._by_gate(self.p["inputs"] + self.p["shift"])[:, window])
            state = run[0][-1]
            known = np.flatnonzero(wanted >= 0)
            slopes = np.zeros((len(wanted), UNITS), np.float32)
            if len(known):
                slopes[known] = self._outputs(run[0].reshape(-1, UNITS)[known], wanted[known], True)[1]
            self._back(window, run, slopes.reshape(run[0].shape))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text, whose tokens end with the end token.

        Texts are laid in lanes, longest first into the shortest lane; lanes that
        have ended drop out, so one long text costs its own steps only.
        """
        if not texts:
            return np.zeros(0)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        lanes = [[0, k, []] for k in range(min(SCORE_LANES, len(texts)))]
        for k in order:
            lane = lanes[0]
            lane[2].append(k)
            heapq.heapreplace(lanes, [lane[0] + len(texts[k]), lane[1], lane[2]])
        lanes.sort(key=lambda lane: -lane[0])
        longest = lanes[0][0]
        ids, targets = np.zeros((longest, len(lanes)), np.int32), np.full((longest, len(lanes)), -1, np.int32)
        for column, (length, _, members) in enumerate(lanes):
            tokens = np.concatenate([texts[k] for k in members])
            ids[1:length, column], targets[:length, column] = tokens[:-1], tokens
        logs = np.zeros(ids.shape, np.float32)
        inputs = self._by_gate(self.p["inputs"] + self.p["shift"])
        state = np.zeros((len(lanes), UNITS), np.float32)
        lengths = np.array([lane[0] for lane in lanes])
        for at in range(0, longest, STEPS):
            active = int(np.searchsorted(-lengths, -at, "left"))
            window, wanted = ids[at : at + STEPS, :active], targets[at : at + STEPS, :active]
            out = self._run(window, state[:active], inputs[:, window])[0]
            state = out[-1]
            flat = wanted.ravel()
            known = np.flatnonzero(flat >= 0)
            part = np.zeros(len(flat), np.float32)
            part[known] = self._outputs(out.reshape(-1, UNITS)[known], flat[known], False)[0]
            logs[at : at + STEPS, :active] = part.reshape(wanted.shape)
        totals = np.zeros(len(texts))
        for column, (length, _, members) in enumerate(lanes):
            firsts = np.cumsum([0] + [len(texts[k]) for k in members])[:-1]
            totals[members] = np.add.reduceat(logs[:length, column].astype(np.float64), firsts)
        return totals


def _softmax(scores: np.ndarray, at: np.ndarray, learn: bool) -> np.ndarray:
    """Log probabilities of ``at`` by rows of ``scores``, which in training become the slopes; sums of rows are products, as those are faster."""
    if scores.max() > 60:
        scores -= scores.max(1, keepdims=True)
    flat = np.arange(0, scores.size, scores.shape[1]) + at
    values = scores.ravel()
    hit = values[flat]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], np.float32)
    if learn:
        scores *= np.reciprocal(total)[:, None]
        values[flat] -= 1
    return hit - np.log(total)

