"""Ids of texts whose words are worked out once and looked up from then on, with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa


class Recent:
    """A cache in two generations: words that keep coming stay, the others leave.

    ``words`` maps every word of the last block to its value. New values go into the young generation. Once it holds
    more than ``limit`` words, it becomes the old one and the former old one is let go; a word found in the old one is
    young again. So at most two times ``limit`` words and one block are held, and a frequent word is worked out once.
    No value is None.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.words: dict = {}
        self.old: dict = {}

    def learn(self, block: Iterable, work: Callable[[list], Iterable]) -> dict:
        """``words`` after all of ``block`` (different words) is in it; ``work`` gives the values of the unknown ones."""
        if len(self.words) > self.limit:
            self.old, self.words = self.words, {}
        young, old = self.words, self.old
        unknown = []
        for word in [w for w in block if w not in young]:
            value = old.get(word)
            if value is None:
                unknown.append(word)
            else:
                young[word] = value
        if unknown:
            young.update(zip(unknown, work(unknown)))
        return young


def ids_of(words: pa.Array, begin: np.ndarray, recent: Recent, work: Callable[[list[str]], Iterable[bytes]],
           kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``words``, one after the other, and where those of each text begin (and of the last one end).

    ``begin`` has the same of the texts' words. ``work`` gives the ids of words as bytes of numbers of ``kind``.
    Different words are told apart once per block, and ids are gathered by number, so a word that comes often costs little.
    """
    coded = words.dictionary_encode()
    different = coded.dictionary.to_pylist()
    known = recent.learn(different, work)
    values = [known[w] for w in different]
    pool = np.frombuffer(b"".join(values), dtype=kind)
    size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // np.dtype(kind).itemsize
    first = np.cumsum(size) - size
    word = coded.indices.to_numpy(zero_copy_only=False)
    n = size[word]
    ends = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=ends[1:])
    return pool[np.arange(ends[-1]) + np.repeat(first[word] - ends[:-1], n)], ends[begin]
