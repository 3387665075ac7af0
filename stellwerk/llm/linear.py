"""Hashed sparse features and a logistic regression trained in numpy on a bounded sample."""

from __future__ import annotations

import numpy as np

from stellwerk.llm.batches import mix


def ngram_buckets(offsets: np.ndarray, data: np.ndarray, sizes: tuple[int, ...], bits: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte n-gram of the given sizes (1 to 7) that lies in one row."""
    wide = data.astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    rows, buckets = [], []
    for size in sizes:
        if len(wide) < size:
            continue
        code = np.full(len(wide) - size + 1, np.uint64(size + 16 * salt))
        for i in range(size):
            code = (code << np.uint64(8)) | wide[i : len(wide) - size + 1 + i]
        inside = row[: len(code)] == row[size - 1 :]
        rows.append(row[: len(code)][inside])
        buckets.append((mix(code[inside]) >> np.uint64(64 - bits)).astype(np.int32))
    if not rows:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(rows), np.concatenate(buckets)


def counted(rows: np.ndarray, buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) in order, and how often each occurs."""
    key, n = np.unique((rows.astype(np.int64) << bits) | buckets, return_counts=True)
    return (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32), n.astype(np.float32)


def unit_rows(rows: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
    """Values divided by the length of their row's vector."""
    length = np.sqrt(np.bincount(rows, values.astype(np.float64) ** 2, n_rows))
    return (values / np.maximum(length, 1e-9)[rows]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(
    rows: np.ndarray,
    columns: np.ndarray,
    values: np.ndarray,
    target: np.ndarray,
    dims: int,
    epochs: int = 30,
    rate: float = 0.5,
    l2: float = 1e-6,
    batch: int = 256,
    seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Weights and bias by mini-batch AdaGrad. ``rows`` must be sorted; targets may lie between 0 and 1.

    Without rows, or with one class only, the weights stay near 0 and the bias tells the class.
    """
    weights, seen = np.zeros(dims), np.full(dims, 1e-6)
    share = float(np.clip(target.mean(), 0.01, 0.99)) if len(target) else 0.5
    bias, bias_seen = float(np.log(share / (1 - share))), 1e-6
    starts = np.searchsorted(rows, np.arange(len(target) + 1))
    generator = np.random.default_rng(seed)
    for _ in range(epochs if len(target) else 0):
        order = generator.permutation(len(target))
        for first in range(0, len(order), batch):
            chosen = order[first : first + batch]
            lengths = starts[chosen + 1] - starts[chosen]
            at = np.repeat(starts[chosen] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            local = np.repeat(np.arange(len(chosen)), lengths)
            column, value = columns[at], values[at]
            raw = np.bincount(local, value * weights[column], len(chosen)) + bias
            error = (sigmoid(raw) - target[chosen]) / len(chosen)
            used, place = np.unique(column, return_inverse=True)
            gradient = np.bincount(place, value * error[local], len(used)) + l2 * weights[used]
            seen[used] += gradient**2
            weights[used] -= rate * gradient / np.sqrt(seen[used])
            bias_seen += error.sum() ** 2
            bias -= rate * 0.1 * error.sum() / np.sqrt(bias_seen)
    return weights.astype(np.float32), float(bias)
