"""A hashed maximum-entropy language model with a class-factored softmax.

Every word belongs to an outcome: the commonest words have one each, all others are hashed to shared outcomes, inside which a
word's share is that of its smoothed count. So the probabilities of all words, and of one unseen word in each shared outcome,
sum to one. Outcomes are dealt into classes. The class is predicted by weights of n-gram and skip features of the words before,
the four single words before and the hashed pair; the outcome in the class by two of these, hashed together with the class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SKIPS = 4
BATCH = 4096
FEW = 6
#: Features of outcomes in classes: the word before, and the pair.
INNER = (0, SKIPS)


@dataclass(frozen=True)
class Shape:
    classes: int = 48
    members: int = 48
    #: Classes of shared outcomes, the last ones.
    shared: int = 12
    pair_rows: int = 1 << 13
    member_rows: int = 1 << 13

    @property
    def outcomes(self) -> int:
        return self.classes * self.members

    @property
    def single(self) -> int:
        """Outcomes of one word: the first ones."""
        return (self.classes - self.shared) * self.members

    @property
    def slots(self) -> int:
        return self.shared * self.members

    @property
    def class_rows(self) -> int:
        return SKIPS * (self.outcomes + 1) + self.pair_rows

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        """The shared outcomes' numbers, from 0, that words' hashes lead to."""
        return ((hashes.view(np.uint64) >> np.uint64(24)) % np.uint64(self.slots)).astype(np.int64)


class Model:
    """Outcome i is member i % members of class i // members."""

    def __init__(self, shape: Shape, mass: np.ndarray):
        """mass: how much of the corpus each outcome has; none for those that no word has."""
        self.shape = shape
        by_class = mass.reshape(shape.classes, shape.members)
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(by_class.sum(1) / mass.sum()).astype(np.float32)
            self.member_bias = np.log(by_class / np.maximum(by_class.sum(1), 1e-300)[:, None]).astype(np.float32)
        self.class_weights = np.zeros((shape.class_rows, shape.classes), np.float32)
        self.member_weights = np.zeros((shape.member_rows, shape.members), np.float32)

    def contexts(self, words: np.ndarray) -> np.ndarray:
        """Rows of the class features of each place, (1 + SKIPS, n); `words` are the outcomes of one text."""
        s = self.shape
        symbols = s.outcomes + 1
        padded = np.concatenate([np.full(SKIPS, symbols - 1), words])
        n = len(words)
        back = [padded[SKIPS - k : SKIPS - k + n] for k in range(1, SKIPS + 1)]
        pair = (back[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + back[1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        return np.stack([b + k * symbols for k, b in enumerate(back)] + [SKIPS * symbols + (pair % np.uint64(s.pair_rows)).astype(np.int64)]).astype(np.int32)

    def member_rows(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        mixed = (rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + of.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(33)
        return (mixed % np.uint64(self.shape.member_rows)).astype(np.int32)

    @staticmethod
    def _logits(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """`bias` with the weights of all rows added, in place, less the greatest of each place."""
        moved = np.empty_like(bias)
        for r in rows:
            np.take(weights, r, 0, out=moved, mode="clip")
            bias += moved
        bias -= bias.max(1, keepdims=True)
        return bias

    def _levels(self, rows: np.ndarray, words: np.ndarray):
        """Logits of all classes, and of all members of the words' own classes."""
        of = words // self.shape.members
        outer = self._logits(np.broadcast_to(self.class_bias, (len(words), self.shape.classes)).copy(), self.class_weights, rows)
        inner_rows = self.member_rows(rows[INNER, :], of)
        return of, outer, inner_rows, self._logits(self.member_bias.take(of, 0), self.member_weights, inner_rows)

    def log_probs(self, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of each outcome's probability at its place."""
        out = np.empty(len(words))
        for at in range(0, len(words), BATCH):
            w = words[at : at + BATCH]
            of, outer, _, inner = self._levels(rows[:, at : at + BATCH], w)
            here = np.arange(len(w))
            p = outer[here, of].astype(np.float64) + inner[here, w % self.shape.members]
            for logits in (outer, inner):
                p -= np.log(np.exp(logits, out=logits).sum(1))
            out[at : at + BATCH] = p
        return out

    def learner(self) -> Learner:
        return Learner(self)


class Learner:
    """AdaGrad on a copy of a model's weights; keeps which rows it has touched."""

    START = 1e-2

    def __init__(self, model: Model):
        self.model = Model.__new__(Model)
        self.model.__dict__.update(model.__dict__, class_weights=model.class_weights.copy(), member_weights=model.member_weights.copy())
        self.steps = [np.full(len(w), self.START, np.float32) for w in (model.class_weights, model.member_weights)]

    def train(self, rows: np.ndarray, words: np.ndarray, rate: float, seed: int) -> None:
        """One pass over shuffled mini-batches."""
        m = self.model
        order = np.random.default_rng(seed).permutation(len(words))
        for at in range(0, len(words), BATCH):
            part = order[at : at + BATCH]
            w, outer_rows, here = words[part], rows[:, part], np.arange(len(part))
            of, outer, inner_rows, inner = m._levels(outer_rows, w)
            for weights, steps, own, g, hit in ((m.class_weights, self.steps[0], outer_rows, outer, of), (m.member_weights, self.steps[1], inner_rows, inner, w % m.shape.members)):
                np.exp(g, out=g)
                g /= g.sum(1, keepdims=True)
                g[here, hit] -= 1
                for r in own:
                    self._update(weights, steps, r, g, rate / len(own))

    @staticmethod
    def _update(weights: np.ndarray, steps: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        packed = np.sort(rows.astype(np.uint64) << np.uint64(32) | np.arange(len(rows), dtype=np.uint64))
        own, order = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        hit, size = own[first], np.diff(np.append(first, len(own)))
        # sums of few rows place by place for all groups at once, of many rows group by group
        moved = gradient.take(order, 0)
        g = moved.take(first, 0)
        ones = np.ones(len(rows), np.float32)
        for i in np.flatnonzero(size > FEW):
            np.dot(ones[: size[i]], moved[first[i] : first[i] + size[i]], out=g[i])
        few = np.flatnonzero((size > 1) & (size <= FEW))
        k = 1
        while len(few):
            g[few] += moved.take(first[few] + k, 0)
            k += 1
            few = few[size[few] > k]
        step = steps[hit] + np.einsum("ij,ij->i", g, g) / g.shape[1]
        steps[hit] = step
        g *= (rate / np.sqrt(step))[:, None]
        weights[hit] -= g
