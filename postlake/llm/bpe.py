"""Byte-pair encoding and decoding with a public vocabulary file (JSON of the `tokenizers` library).

Texts are normalised (NFC, lower case), cut at white space, and each distinct piece is encoded once per
task: the pieces that a batch brings anew are laid out as symbols in one flat array and merged in rounds.
A round looks up all neighbouring pairs by binary search over the sorted pair keys, takes the lowest rank
of each piece, and merges its occurrences from the left. The result equals merging one pair at a time
because a merged symbol only takes part in pairs of higher rank, which `load` verifies.

Character classes are those of the installed `regex` module; code points that a newer Unicode version
assigned may be cut differently by the library.

Null texts count as empty: no ids, decoded text empty. Repeated rows are encoded alike. Columns named as
the output columns are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import group_of, spread

#: Distinct pieces that a task remembers; it starts afresh beyond that, results do not depend on it.
REMEMBERED = 400_000

# The pre-tokenizer expression of the vocabulary file.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# White space for Python, but not for the expression above.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


@dataclass(frozen=True)
class Vocabulary:
    """keys: sorted left * size + right of the merges; ranks, merged: their rank and the symbol they give."""

    tokens: list[str]
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    specials: dict[str, int]


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def load(path: str) -> Vocabulary:
    """Read a vocabulary with word ends. Raises ValueError where merging in rounds would not be exact."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model = held["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
        raise ValueError("a BPE vocabulary with word ends is needed")
    ids = dict(model["vocab"])
    specials = {t["content"]: t["id"] for t in held["added_tokens"]}
    size = max([*ids.values(), *specials.values()]) + 1
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made: dict[str, int] = {}
    for rank, (left, right) in enumerate(pairs):
        if max(made.get(left, -1), made.get(right, -1)) >= rank:
            raise ValueError("a merge uses a symbol that a later merge makes")
        made.setdefault(left + right, rank)
    for rank, (left, right) in enumerate(pairs):
        if max(made.get(left, -1), made.get(right, -1)) > rank:
            raise ValueError("a merge uses a symbol that a later merge makes")
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    symbols = _byte_symbols()
    tokens = [""] * size
    for token, i in {**ids, **specials}.items():
        tokens[i] = token
    return Vocabulary(
        tokens=tokens,
        first=np.array([ids[s] for s in symbols], np.int64),
        last=np.array([ids[s + "</w>"] for s in symbols], np.int64),
        keys=keys[order],
        ranks=order.astype(np.int64),
        merged=np.array([ids[a + b] for a, b in pairs], np.int64)[order],
        specials=specials,
    )


def merge_rounds(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in one array, and how many each piece has. Pieces are not empty."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    symbols = v.first[raw]
    tails = np.cumsum(sizes) - 1
    symbols[tails] = v.last[raw[tails]]
    owner = group_of(sizes)
    size = len(v.tokens)
    done_symbols, done_owner = [], []
    none = len(v.keys)
    while len(symbols):
        key = symbols[:-1] * size + symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, key), none - 1)
        known = (v.keys[at] == key) & (owner[:-1] == owner[1:])
        rank = np.where(known, v.ranks[at], none)
        rank = np.append(rank, none)
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(owner))))
        settled = lowest == none
        if settled.any():
            done_symbols.append(symbols[settled])
            done_owner.append(owner[settled])
            open_ = ~settled
            symbols, owner, rank, lowest = symbols[open_], owner[open_], rank[open_], lowest[open_]
            at = np.append(at, 0)[open_]
            if not len(symbols):
                break
        else:
            at = np.append(at, 0)
        hits = np.flatnonzero(rank == lowest)
        # In a run of overlapping hits every second one is merged, from the left.
        run_start = np.append(True, np.diff(hits) > 1)
        place = np.arange(len(hits))
        hits = hits[(place - np.maximum.accumulate(np.where(run_start, place, 0))) % 2 == 0]
        symbols[hits] = v.merged[at[hits]]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
    symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(pieces))


class _Encoder:
    """Remembers where the ids of each white-space-free piece stand in a growing pool."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.special = re.compile("(" + "|".join(map(re.escape, v.specials)) + ")") if v.specials else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)
        self.add([], np.zeros(0, np.int64), np.zeros(0, np.int32))
        for token, i in self.v.specials.items():
            # A control character keeps the names of special tokens apart from ordinary pieces.
            self.add(["\x00 " + token], np.ones(1, np.int64), np.array([i], np.int32))

    def add(self, names: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        base = len(self.place)
        self.place.update(zip(names, range(base, base + len(names)), strict=True))
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.pool = np.append(self.pool, ids.astype(np.int32))

    def cut(self, text: str) -> list[str]:
        """Pieces without white space, special tokens as entries of their own."""
        if self.special and "<|" in text:
            out: list[str] = []
            for part in self.special.split(text):
                out += ["\x00 " + part] if part in self.v.specials else self.plain(part)
            return out
        return self.plain(text)

    @staticmethod
    def plain(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if _ODD_SPACE.search(text):
            return _PIECES.findall(text)
        return text.split()

    def learn(self, names: list[str]) -> None:
        inner = [[w.encode("utf-8") for w in _PIECES.findall(n)] for n in names]
        ids, counts = merge_rounds([w for part in inner for w in part], self.v)
        parts = np.fromiter(map(len, inner), np.int64, len(inner))
        total = np.bincount(group_of(parts), weights=counts, minlength=len(inner)).astype(np.int64)
        self.add(names, total, ids)

    def encode(self, column: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        if len(self.place) > REMEMBERED:
            self.forget()
        pieces = [self.cut(t) if t else [] for t in column]
        get = self.place.get
        new = dict.fromkeys(p for part in pieces for p in part if get(p) is None)
        if new:
            self.learn(list(new))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.fromiter((get(p) for part in pieces for p in part), np.int64, int(sizes.sum()))
        counts = self.counts[at]
        ids = self.pool[spread(self.starts[at], counts)]
        per_text = np.bincount(group_of(sizes), weights=counts, minlength=len(column)).astype(np.int64)
        return ids, per_text


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` without `text`, with the ids of each text as an array of int."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                flat_ids, counts = encoder.encode(batch.column(text).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [made], [*kept, ids])

    return df.select(*kept, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the tokens of `ids` joined by a space, as the library does without a decoder."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(held.value, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                held_ids = batch.column(ids)
                lists = pc.fill_null(held_ids, []) if held_ids.null_count else held_ids
                names = tokens.take(pc.list_flatten(lists))
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names), " ")
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [joined.cast(pa.string())], [*kept, text])

    return df.mapInArrow(run, schema)


def digest(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents."""
    return decode(encoded.select("doc_id", "ids"), vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
