"""Text columns as flat byte arrays: the helpers that the operators share.

An Arrow string column is one buffer of bytes and one of offsets. The operators work on these buffers
with numpy, a few megabytes at a time, so no Python object is made per row or word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at once; the working memory of a kernel is a few dozen times as much.
SLICE_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_column(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    ends = ends.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def texts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of one slice after the other."""
    data, ends = flat(column)
    for first, last in slices(ends, limit):
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    for name, step in (("up", _BASE), ("down", _INVERSE)):
        have = _powers[name]
        while len(have) < n:
            factor = int(have[-1]) * int(step) % (1 << 64)
            have = np.concatenate([have, have * np.uint64(factor)])
        _powers[name] = have
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Entry i: polynomial hash of data[:i]; with `span_hash` any span's hash takes constant time."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix) + 1)
    return mix((prefix[stops] - prefix[starts]) * down[starts])


def stretches(solid: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the runs of solid bytes, and how many each text has."""
    before = np.zeros(len(solid), bool)
    before[1:] = solid[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    before[heads] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(solid), bool)
    after[:-1] = solid[1:]
    after[ends[1:][ends[:-1] < ends[1:]] - 1] = False
    stops = np.flatnonzero(solid & ~after) + 1
    counts = np.diff(np.searchsorted(starts, ends))
    return starts, stops, counts


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the runs without white space, and how many each text has."""
    return stretches(~SPACE[data], ends)


def dictionary(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number from 0 for each span, the same for the same bytes, and the bytes of each number."""
    sizes = stops - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    held = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[spread(starts, sizes)]))]
    made = pa.Array.from_buffers(pa.large_binary(), len(sizes), held).dictionary_encode()
    return made.indices.to_numpy().astype(np.int64), made.dictionary


def group_of(counts: np.ndarray) -> np.ndarray:
    """Row number of each element when row i has counts[i] of them."""
    return np.repeat(np.arange(len(counts)), counts)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then the same for the next row."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
