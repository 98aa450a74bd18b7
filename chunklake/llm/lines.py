"""Substring dedup by hashing lines and sentences: keep the earliest occurrence of each unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.llm.text import LOWER, LOWER_ALNUM, mixed, pieces, slice_hashes, small_batches, words
from chunklake.session import materialize

_STEP = np.uint64(0xD6E8FEB86659FD93)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x80] = True
_SIGN[[c for c in range(0x80) if chr(c).isalnum()]] = False
_SIGN &= ~_ENDS


def _codes(chars: str) -> np.ndarray:
    return np.array([int.from_bytes(c.encode(), "big") for c in chars])


# Stops beyond ASCII, those that end a sentence without white space, and quotes and brackets that may follow a stop.
_STOPS, _TIGHT = _codes("。！？．｡؟۔।॥։።…"), _codes("。！？．｡")
_CLOSERS = _codes("«»‘’“”‹›」』）】》〉〕］｝")


def signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to a stop, to a stop that needs no white space after it, and to another sign."""
    stop, tight, sign = _ENDS[data], np.zeros(len(data), bool), _SIGN[data]
    for size, leads in ((2, (0xC2, 0xD6, 0xD8, 0xDB)), (3, (0xE0, 0xE1, 0xE2, 0xE3, 0xEF))):
        at = np.flatnonzero(np.isin(data[: max(len(data) - size + 1, 0)], leads))
        code = sum(data[at + k].astype(np.int64) << (8 * (size - 1 - k)) for k in range(size))
        for chars, mark in ((_STOPS, stop), (_TIGHT, tight), (_CLOSERS, sign)):
            hit = at[np.isin(code, chars)]
            for k in range(size):
                mark[hit + k] = True
    return stop, tight, sign


def unit_bounds(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units begin, and the end: at rows' starts, after line breaks, and after a stop, any signs behind it and one space.

    No space is needed after the stops of scripts that are written without spaces.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    stop, tight, sign = signs(data)
    rows = off[:-1][off[:-1] < len(data)]
    sign_on = sign.copy()
    sign_on[rows] = False  # signs at a row's start follow no stop of the row before
    last = np.maximum.accumulate(np.where(sign_on, 0, np.arange(len(data))))
    ended, ended_tight = (np.concatenate([[False], mark[last][:-1]]) for mark in (stop, tight))
    ended[rows] = False
    after = ended_tight & ~sign & ~stop & ~_SPACE[data]
    after[1:] |= (data[:-1] == 0x0A) | (data[:-1] == 0x0D) | (_SPACE[data] & ended)[:-1]
    after[rows] = True
    return np.concatenate([np.flatnonzero(after), [len(data)]])


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, key, unit, start, end, words, chars, line, of, d1, d2): every unit that has words, numbered, with UTF-8 offsets and a 128-bit digest.

    chars counts the words' characters, line numbers the row's lines, and of is how many units the line has. key is null, or a hash of the text where there is no doc_id. The digest is of the unit's words, lower-cased and without signs and spaces, in order.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in pieces(batches, "text"):
            if not len(data):
                continue
            stop, _, sign = signs(data)
            low = np.where(stop | sign, np.uint8(0x20), LOWER[data])
            starts, ends, _ = words(low, off, LOWER_ALNUM)
            h = slice_hashes(low, starts, ends)
            bounds = unit_bounds(data, off)
            at = np.searchsorted(starts, bounds)
            n = np.diff(at)
            digests = []
            for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDEF)):
                up = np.cumprod(np.full(len(h) + 1, _STEP, np.uint64))
                down = np.cumprod(np.full(len(h) + 1, _UNSTEP, np.uint64))
                run_sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ salt) * up[:-1], dtype=np.uint64)])
                digests.append(mixed((run_sum[at[1:]] - run_sum[at[:-1]]) * down[at[:-1]] + n.astype(np.uint64)))
            row = np.searchsorted(off, bounds[:-1], "right") - 1
            keep = np.flatnonzero(n > 0)
            chars = np.concatenate([[0], np.cumsum(LOWER_ALNUM[low] & ((low & 0xC0) != 0x80))])[bounds]
            broken = np.concatenate([[0], np.cumsum((data == 0x0A) | (data == 0x0D))])
            new_line = np.concatenate([[True], (np.diff(broken[bounds[:-1]][keep]) > 0) | (np.diff(row[keep]) > 0)])[: len(keep)]
            line = np.cumsum(new_line) - 1
            first = np.searchsorted(row[keep], np.arange(len(off) - 1))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(row[keep])),
                    rows.column(1).take(pa.array(row[keep])),
                    pa.array((np.arange(len(keep)) - first[row[keep]]).astype(np.int32)),
                    pa.array((bounds[:-1] - off[row])[keep]),
                    pa.array((bounds[1:] - off[row])[keep]),
                    pa.array(n[keep].astype(np.int32)),
                    pa.array(np.diff(chars)[keep].astype(np.int32)),
                    pa.array((line - np.concatenate([line, [0]])[first[row[keep]]]).astype(np.int32)),
                    pa.array(np.bincount(line, minlength=1)[line].astype(np.int32)),
                    pa.array(digests[0][keep].view(np.int64)),
                    pa.array(digests[1][keep].view(np.int64)),
                ],
                ["doc_id", "key", "unit", "start", "end", "words", "chars", "line", "of", "d1", "d2"],
            )

    schema = "doc_id long, key long, unit int, start long, end long, words int, chars int, line int, of int, d1 long, d2 long"
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    return docs.select(F.col("doc_id").cast("long"), key.alias("key"), "text").mapInArrow(run, schema)


def repeated_units(docs: DataFrame, min_words: int = 10, min_chars: int = 50, line_chars: int = 10) -> DataFrame:
    """One row per unit to remove: doc_id, start, end, n_words, first_doc_id, first_start.

    Units are lines, and sentences within lines. Digests are grouped globally; of each repeated unit the occurrence
    with the smallest (doc_id, position) stays and the others go, if they stand in a run of consecutive
    later occurrences of at least ``min_words`` words or ``min_chars`` characters (letters and digits), or are all of a line of at
    least ``line_chars``: a passage goes with its short sentences and a line by itself, a lone short sentence stays.

    Counting is a map-side combined aggregate and the way back is a join on the digest that can be split, so a line that a
    third of all texts share is no hot task. Nulls: a null, empty or wordless text has no units. Repeated rows:
    rows of one doc_id are one document, those without an id one per text, after all others; equal units at the same place don't count twice. Ties: by position. Empty
    table: no rows. Other columns are ignored.
    """
    found = materialize(units(docs), "units")
    counted = found.groupBy("d1", "d2").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "unit", "start")).alias("_first")).where("_n > 1")
    counted = materialize(counted, "unit-counts")  # read as a table, it leaves the join below free to split hot digests
    shared = found.join(counted, ["d1", "d2"])
    is_first = F.expr("doc_id <=> _first.doc_id AND key <=> _first.key AND unit = _first.unit")
    later = shared.where(~is_first).repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "unit", "d1", "d2"])
    place = Window.partitionBy("doc_id", "key").orderBy("unit")
    islands = later.withColumn("_island", F.col("unit") - F.dense_rank().over(place))
    in_run, in_line = Window.partitionBy("doc_id", "key", "_island"), Window.partitionBy("doc_id", "key", "line", "of")
    long_run = (F.sum("words").over(in_run) >= min_words) | (F.sum("chars").over(in_run) >= min_chars)
    whole_line = (F.count("*").over(in_line) >= F.col("of")) & (F.sum("chars").over(in_line) >= line_chars)
    gone = islands.withColumn("_gone", long_run | whole_line).where("_gone")
    return gone.select("doc_id", "start", "end", F.col("words").alias("n_words"), F.col("_first.doc_id").alias("first_doc_id"), F.col("_first.start").alias("first_start"))
