"""Bounded pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: What a piece holds at most: texts, and characters unless one text alone has more.
PIECE_TEXTS = 200
PIECE_CHARS = 1 << 20


def pieces(texts: pd.Series) -> Iterator[pd.Series]:
    """Consecutive slices of a batch, all of its texts in order, so that what a function makes of them stays small.

    An empty batch is one empty slice.
    """
    start = chars = 0
    for i, text in enumerate(texts):
        size = len(text) if text is not None else 0
        if i > start and (i - start >= PIECE_TEXTS or chars + size > PIECE_CHARS):
            yield texts.iloc[start:i]
            start, chars = i, 0
        chars += size
    yield texts.iloc[start:]
