"""Hashed linear scorers over whole texts: features, training on a bounded sample, scoring.

Features of a text are its runs of letters, digits or other signs (lower-cased, hashed into BUCKETS), two
more buckets for runs in capitals and for runs that repeat the one before. A text's value in a bucket is
its count divided by the square root of the number of its runs, so a score is a sum of weights over runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from postlake.llm.common import LOWER, group_of, prefix_hash, span_hash

BUCKETS = 1 << 16
CAPITALS, REPEATED = BUCKETS, BUCKETS + 1
WIDTH = BUCKETS + 2

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1


@dataclass(frozen=True)
class Runs:
    """starts, stops, kind and hash of each run; how many each text has."""

    starts: np.ndarray
    stops: np.ndarray
    kind: np.ndarray
    hashes: np.ndarray
    capitals: np.ndarray
    repeated: np.ndarray
    counts: np.ndarray


def runs(data: np.ndarray, ends: np.ndarray) -> Runs:
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[ends] = True
    edges = np.flatnonzero(change)
    starts, stops = edges[:-1], edges[1:]
    solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, stops = starts[solid], stops[solid]
    counts = np.diff(np.searchsorted(starts, ends))
    hashes = span_hash(prefix_hash(LOWER[data]), starts, stops)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals = (upper[stops] - upper[starts] == stops - starts) & (stops - starts > 1)
    owner = group_of(counts)
    repeated = np.zeros(len(starts), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return Runs(starts, stops, kind[starts] if len(starts) else kind[:0], hashes, capitals, repeated, counts)


def buckets(r: Runs) -> np.ndarray:
    return (r.hashes >> np.uint64(48)).astype(np.int64)


def sparse_rows(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all non-zero features."""
    owner = group_of(r.counts)
    extra = [owner[r.capitals], owner[r.repeated]]
    place = [np.full(len(extra[0]), CAPITALS), np.full(len(extra[1]), REPEATED)]
    key = np.concatenate([owner, *extra]) * WIDTH + np.concatenate([buckets(r), *place])
    key, count = np.unique(key, return_counts=True)
    row = key // WIDTH
    return row, key % WIDTH, count / np.sqrt(np.maximum(r.counts[row], 1))


def scores(r: Runs, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """texts x classes: weighted sums; a text without runs has the bias."""
    out = np.zeros((len(r.counts), weights.shape[1]))
    some = np.flatnonzero(r.counts)
    if len(some):
        heads = (np.cumsum(r.counts) - r.counts)[some]
        at, caps, again = buckets(r), r.capitals, r.repeated
        for k in range(weights.shape[1]):
            w = weights[:, k]
            each = w[at] + caps * w[CAPITALS] + again * w[REPEATED]
            out[some, k] = np.add.reduceat(each, heads) / np.sqrt(r.counts[some])
    return out + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 80, least_texts: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression on soft labels (texts x classes), by adaptive gradients.

    Buckets that fewer than `least_texts` texts have keep a weight of 0.
    """
    n, classes = target.shape
    weights, bias = np.zeros((WIDTH, classes)), np.log(target.mean(axis=0) + 1e-6)
    wanted = np.flatnonzero(np.bincount(bucket, minlength=WIDTH) >= least_texts)
    number = np.full(WIDTH, -1)
    number[wanted] = np.arange(len(wanted))
    used = number[bucket] >= 0
    row, column, value = row[used], number[bucket[used]], value[used]
    w = np.zeros((len(wanted), classes))
    past, past_bias = np.full_like(w, 1e-8), np.full(classes, 1e-8)
    for _ in range(rounds):
        z = np.stack([np.bincount(row, value * w[column, k], n) for k in range(classes)], axis=1) + bias
        error = (softmax(z) - target) / n
        for k in range(classes):
            g = np.bincount(column, value * error[row, k], len(wanted)) + 1e-6 * w[:, k]
            past[:, k] += g * g
            w[:, k] -= 0.3 * g / np.sqrt(past[:, k])
        g = error.sum(axis=0)
        past_bias += g * g
        bias = bias - 0.1 * g / np.sqrt(past_bias)
    weights[wanted] = w
    return weights, bias
