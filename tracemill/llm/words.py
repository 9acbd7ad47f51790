"""Hashed words, portions of texts, and bitmaps of fixed size that tell what may be left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose hash a worker remembers, text that is at hand at once, and the seed of the word hash.
REMEMBERED, PORTION_BYTES, SEED = 300_000, 4 << 20, 11
#: Bits of a bitmap (8 MB), and of the blocks in which Spark makes it.
BITMAP_BITS, BLOCK_BITS = 1 << 26, 1 << 18

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_known = _Known()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def text_portions(batches: Iterator[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[pa.Table]:
    """Rows of batches whose texts (binary) come to about ``most`` bytes, one row at least."""
    most = most or PORTION_BYTES
    for batch in batches:
        if not len(batch):
            continue
        size = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
        part = (size - 1) // most
        border = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(border, border[1:], strict=False):
            yield pa.Table.from_batches([batch.slice(a, b - a)])


def _places(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) % _U(BITMAP_BITS)).astype(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits with those of the keys (the only column, longs) set, made block by block in Spark.

    Whatever the number of keys, the driver gets 8 MB at most. A full bitmap lets everything through.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK_BITS).astype(np.int32)), pa.array((at % BLOCK_BITS).astype(np.int32))], ["block", "at"])

    def block(group: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, bool)
        bits[group.column("at").to_numpy()] = True
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in keys.mapInArrow(place, "block int, at int").distinct().groupBy("block").applyInArrow(block, "block int, bits binary").collect():
        out[r.block * BLOCK_BITS // 8 : (r.block + 1) * BLOCK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
