"""A small stand-in model: character 3-grams through seeded random layers.

Any function with the shape of ``make_predict_fn`` can take its place, such as
one that loads a neural model once per worker and runs it on each batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BUCKETS = 512


def hashed_ngrams(layers: int = 4, width: int = 32, seed: int = 7) -> Callable:
    """A ``make_predict_fn``: texts to ``layers`` vectors of ``width``, end to end."""

    def make_predict_fn():
        rng = np.random.default_rng(seed)
        first = rng.standard_normal((BUCKETS, width)) / np.sqrt(width)
        steps = [rng.standard_normal((width, width)) / np.sqrt(width) for _ in range(layers - 1)]

        def counts(text: str) -> np.ndarray:
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            if len(codes) < 3:
                codes = np.concatenate([codes, np.zeros(3 - len(codes), dtype=np.uint64)])
            grams = (codes[:-2] * 1_000_003 + codes[1:-1]) * 1_000_003 + codes[2:]
            bins = np.bincount(((grams * 0x9E3779B1) >> np.uint64(16)) % BUCKETS, minlength=BUCKETS)
            return bins / np.linalg.norm(bins)

        def predict(texts: np.ndarray) -> np.ndarray:
            state = np.stack([counts(t) for t in texts]) @ first
            out = [state]
            for step in steps:
                state = np.tanh(state @ step * 2.0)
                out.append(state)
            return np.concatenate(out, axis=1).astype(np.float32)

        return predict

    return make_predict_fn


def hashed_tokens(layers: int = 4, width: int = 32, seed: int = 7) -> Callable:
    """The same for models that give each token its own row: texts to arrays of (tokens, ``layers`` x ``width``)."""
    make_whole = hashed_ngrams(layers, width, seed)

    def make_predict_fn():
        whole = make_whole()

        def predict(texts: np.ndarray) -> list[np.ndarray]:
            lists = [t.split() for t in texts]
            flat = [token for tokens in lists for token in tokens]
            rows = whole(np.array(flat, dtype=object)) if flat else np.zeros((0, layers * width), dtype=np.float32)
            return np.split(rows, np.cumsum([len(x) for x in lists])[:-1])

        return predict

    return make_predict_fn
