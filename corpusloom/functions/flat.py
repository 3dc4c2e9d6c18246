"""Sentences of an Arrow batch as flat arrays: all words one after the other, with the place where each sentence begins.

A batch is cut into pieces of at most ``PIECE`` words (or one sentence), which bounds what a task holds besides its input. Trees are
walked for all sentences of a piece at once, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 16


def pieces(lists: pa.Array) -> Iterator[slice]:
    """Slices of a list array with at most ``PIECE`` words, or one sentence, each; at least one, which may be empty."""
    ends = np.cumsum(sizes(lists))
    start = 0
    while start < len(lists):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        yield slice(start, stop)
        start = stop
    if not len(lists):
        yield slice(0, 0)


def sizes(lists: pa.Array) -> np.ndarray:
    """Length of each list or map, 0 for NULL."""
    return np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0).astype(np.int64)


def starts(n: np.ndarray) -> np.ndarray:
    """Where each list begins among the flat words, and their end."""
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def lists_of(start: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    """Flat values as lists again, NULL where ``like`` is."""
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), values, mask=mask)


class Forest:
    """The trees of a piece.

    ``depth`` of a word is 1 for roots, and 0 for a word that never comes to a root, on a cycle or under a missing head.
    Words are numbered by their place.
    """

    def __init__(self, heads: pa.Array):
        self.n = sizes(heads)
        self.start = starts(self.n)
        flat = heads.flatten()
        self.sentence = np.repeat(np.arange(len(self.n)), self.n)
        self.head = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        words = len(self.head)
        known = (self.head >= 0) & (self.head <= self.n[self.sentence])
        # behind the words: one root above each sentence, and one place for heads that are no word
        self.above = np.where(self.head > 0, self.start[self.sentence] + self.head - 1, words + self.sentence)
        nowhere = words + len(self.n)
        self.above[~known] = nowhere
        up = np.concatenate([self.above, np.arange(words, nowhere + 1)])
        far = np.concatenate([np.ones(words, np.int64), np.zeros(len(self.n) + 1, np.int64)])
        for _ in range(int(self.n.max(initial=0)).bit_length()):
            if not (up[:words] < words).any():
                break
            far, up = far + far[up], up[up]
        self.depth = np.where((up[:words] >= words) & (up[:words] < nowhere), far[:words], 0)

    def whole(self, ids: pa.Array) -> np.ndarray:
        """Whether each sentence is one rooted tree with ids 1 to n in order."""
        place = np.arange(len(self.head)) - self.start[self.sentence] + 1
        odd = (self.depth == 0) | (pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False) != place)
        roots = np.bincount(self.sentence[self.head == 0], minlength=len(self.n))
        return (self.n > 0) & (roots == 1) & (np.bincount(self.sentence[odd], minlength=len(self.n)) == 0)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place in preorder among all words, where its sentence begins at its start, and the number of words below it and
        itself; neither means anything for words that come to no root, which take no place."""
        words = len(self.head)
        by_depth = np.argsort(self.depth, kind="stable")
        ends = np.cumsum(np.bincount(self.depth))
        levels = [by_depth[a:b] for a, b in zip(ends[:-1], ends[1:])] if words else []
        size = np.ones(words + len(self.n), np.int64)
        for level in levels[:0:-1]:
            np.add.at(size, self.above[level], size[level])
        # words of the earlier siblings and below them
        known = np.flatnonzero(self.depth)
        siblings = known[np.argsort(self.above[known], kind="stable")]
        before = np.zeros(words, np.int64)
        if len(siblings):
            total = np.cumsum(size[siblings]) - size[siblings]
            head = self.above[siblings]
            first = np.concatenate([[True], head[1:] != head[:-1]])
            before[siblings] = total - total[np.maximum.accumulate(np.where(first, np.arange(len(head)), 0))]
        at = np.concatenate([np.zeros(words, np.int64), self.start[:-1] - 1])
        for level in levels:
            at[level] = at[self.above[level]] + 1 + before[level]
        return at[:words], size[:words]

    def preorder(self) -> np.ndarray:
        """Words in preorder, sentence by sentence, without those that come to no root."""
        at, _ = self.places()
        known = np.flatnonzero(self.depth)
        out = np.full(len(self.head), -1)
        out[at[known]] = known
        return out[out >= 0]
