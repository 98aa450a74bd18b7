"""Numpy helpers for whole UTF-8 texts inside Arrow tasks: pieces of bounded size, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Word classes as tables over byte values; bytes of 0x80 and more always belong to a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER_ALNUM = np.zeros(256, bool)
LOWER_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

PIECE = 1 << 20  # bytes of text that the numpy code handles at once; a longer text is a piece of its own

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: a few hundred rows rather than ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts end to end, offsets) of about ``limit`` bytes each; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = (col.fill_null("") if col.null_count else col).cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.empty(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes within rows, and each row's range in them."""
    ok = member[data]
    n = len(ok)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ok[:-1], ok[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(ok & ~before), np.flatnonzero(ok & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _UNBASE)):
            table = np.full(n + 1, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each slice of data; equal bytes have equal hashes wherever they stand."""
    up, down = _power_tables(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=run[1:])
    return mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
