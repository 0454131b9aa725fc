"""Word shingles of texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from postlake.llm.common import LOWER, dictionary, group_of, mix, spread, words

_FOLD = np.uint64(0x9FB21C651E98DF25)
_NONE = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in one array; and how many each text has.

    Letters A-Z are lower-cased, words are runs without white space. A text with fewer words than `width`
    has its whole word sequence as its one shingle, a text without words has none.
    """
    data = LOWER[data]
    starts, stops, counts = words(data, ends)
    codes, found = dictionary(data, starts, stops)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found.to_pylist()), np.uint64, len(found))[codes]
    windows = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.cumsum(counts) - counts
    at = spread(first, windows)
    limit = np.repeat(first + counts, windows)
    padded = np.append(hashes, np.full(width, _NONE))
    made = np.zeros(len(at), np.uint64)
    for t in range(width):
        word = np.where(at + t < limit, padded[at + t], _NONE)
        made = mix(made * _FOLD + word)
    ends_of = np.concatenate([[0], np.cumsum(windows)])
    for a, b in zip(ends_of[:-1].tolist(), ends_of[1:].tolist(), strict=True):
        made[a:b].sort()
    owner = group_of(windows)
    keep = np.ones(len(made), bool)
    keep[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    return made[keep], np.bincount(owner[keep], minlength=len(windows))
