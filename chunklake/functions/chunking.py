"""Content-defined chunking with a gear hash, data-parallel within a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN, AVG, MAX = 64 << 10, 256 << 10, 1 << 20


def gear_table(seed: int = 0) -> np.ndarray:
    """256 values of 64 bits from a rule: SplitMix64 outputs from a seed. Pass another table to match other archives."""
    state = np.uint64(seed) + np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return state ^ (state >> np.uint64(31))


def cut_points(data: bytes, least: int = MIN, avg: int = AVG, most: int = MAX, gear: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of data; none for an empty one.

    The rolling value doubles per byte and adds the byte's gear value, so its low bits depend on the last few bytes
    only, fewer than ``least``: all places where they are zero are found at once, and chunks then take the first
    such place from ``least`` bytes on, or end at ``most``.
    """
    if least < 64 or not least <= avg < most:
        raise ValueError("chunk sizes must be 64 <= min <= avg < max")
    bits = (avg - 1).bit_length() - 1
    table = ((gear_table() if gear is None else gear) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    own = table[np.frombuffer(data, np.uint8)]
    sums = np.zeros(len(own), np.uint32)
    for k in range(min(bits, len(own))):
        sums[k:] += own[: len(own) - k] << np.uint32(k)
    places = np.flatnonzero((sums & np.uint32((1 << bits) - 1)) == 0) + 1
    ends, at = [], 0
    while at < len(data):
        k = np.searchsorted(places, at + least)
        end = min(int(places[k]) if k < len(places) else len(data), at + most, len(data))
        ends.append(end)
        at = end
    return ends


def chunk_files(files: DataFrame, least: int = MIN, avg: int = AVG, most: int = MAX, gear: np.ndarray | None = None) -> DataFrame:
    """(path, ordinal, file_off, u_size, content) of every chunk of files (path, content). Empty files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends = cut_points(content or b"", least, avg, most, gear)
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(ends), pa.string()),
                        pa.array(range(len(ends)), pa.int64()),
                        pa.array(begins[: len(ends)], pa.int64()),
                        pa.array([b - a for a, b in zip(begins, ends, strict=False)], pa.int64()),
                        pa.array([content[a:b] for a, b in zip(begins, ends, strict=False)], pa.binary()),
                    ],
                    ["path", "ordinal", "file_off", "u_size", "content"],
                )

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "path string, ordinal long, file_off long, u_size long, content binary")
