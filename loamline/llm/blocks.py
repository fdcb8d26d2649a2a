"""Texts of an Arrow batch as flat arrays: where words are, what they hash to, which document they are in.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``. UTF-8 never uses those
bytes inside a character, so byte positions are safe to cut at. Nothing here keeps state between
batches, and no step costs more than linear time and memory in the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Rows and bytes of one Arrow batch: a few MB of ordinary texts, and bounded memory with very long ones.
BATCH_ROWS = 512
BATCH_BYTES = "8m"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of texts small on this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the frame does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a batch: byte ranges in ``data``, and for each document its range of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # word index at which each document begins, and the total at the end

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word. Words of up to eight bytes without trailing NULs never collide."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, np.dtype("<u8"), padded, strides=(1,))
        size = self.ends - self.starts
        out = mix(eight[self.starts] & _MASKS[np.minimum(size, 8)])
        rest, at = np.flatnonzero(size > 8), 8
        while len(rest):
            left = size[rest] - at
            piece = eight[self.starts[rest] + at] & _MASKS[np.minimum(left, 8)]
            out[rest] = mix((out[rest] + _ODD) ^ piece)
            rest, at = rest[left > 8], at + 8
        return mix(out + size.astype(np.uint64) * _ODD)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null reads as empty."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset:filled.offset + len(filled) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def find_words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = raw_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = ~IS_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[at] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[:-1] = inside
    after[at] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values; order matters."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _ODD + hashes[i:i + n]
    return mix(out)


def inside_documents(first: np.ndarray, width: int) -> np.ndarray:
    """For every start of ``width`` words in a batch: do all of them belong to one document?"""
    total = int(first[-1])
    if total < width:
        return np.zeros(0, bool)
    stop = np.repeat(first[1:], np.diff(first))
    return np.arange(total - width + 1) + width <= stop[:total - width + 1]


def binary_column(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Consecutive runs of a fixed-width array as one binary value each."""
    width = values.dtype.itemsize
    offsets = (np.asarray(first, np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1,
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
