"""Benchmark decontamination by a prefix-filtered set join on rare shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake.llm.text import LOWER, LOWER_ALNUM, mixed, pieces, slice_hashes, small_batches, words

#: Words in a shingle; the token of the set join. Shorter windows have one shingle, the whole window.
SHINGLE = 4
#: Bytes of benchmark text that are sent to the tasks at once; a larger benchmark is joined block by block.
BLOCK_BYTES = 32 << 20

_STEPS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


@dataclass
class Windows:
    """A block of distinct windows: words' hashes (rows padded with 0), lengths, words joined by blanks, item numbers."""

    hashes: np.ndarray
    lengths: np.ndarray
    texts: list[bytes]
    items: list[list[int]]
    names: list[str]


def tokenise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and hashes of the words, each row's range."""
    low = LOWER[data]
    starts, ends, ranges = words(low, off, LOWER_ALNUM)
    return low, starts, ends, slice_hashes(low, starts, ends), ranges


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring words, rows ignored (verification sees to them)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _STEPS[k]
    return mixed(out + np.uint64(size))


def _block(items: list[tuple[str, str]], window: int) -> Windows:
    """The distinct windows of some items."""
    at: dict[bytes, int] = {}
    owners: list[set[int]] = []
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    rows: list[np.ndarray] = []
    for name, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        low, starts, ends, h, _ = tokenise(raw, np.array([0, len(raw)]))
        found = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        for s in range(max(1, len(found) - window + 1) if found else 0):
            key = b" ".join(found[s : s + window])
            if key not in at:
                at[key] = len(rows)
                rows.append(h[s : s + window])
                owners.append(set())
            owners[at[key]].add(number[name])
    hashes = np.zeros((len(rows), window), np.uint64)
    for k, r in enumerate(rows):
        hashes[k, : len(r)] = r
    return Windows(hashes, np.array([len(r) for r in rows], np.int64), list(at), [sorted(x) for x in owners], names)


class Lookup:
    """Positions of 64-bit values in a sorted set, after a table of bits that rejects most others."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, positions in values) of the members."""
        near = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, h[near]), len(self.values) - 1)
        hit = self.values[at] == h[near] if len(self.values) else np.zeros(len(near), bool)
        return near[hit], at[hit]


def _window_tokens(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset, size, hash) of every shingle of every window."""
    win, at, size, token = [], [], [], []
    for n in np.unique(w.lengths):
        rows, s = np.flatnonzero(w.lengths == n), min(SHINGLE, int(n))
        for k in range(int(n) - s + 1):
            h = np.zeros(len(rows), np.uint64)
            for j in range(s):
                h += w.hashes[rows, k + j] * _STEPS[j]
            win.append(rows)
            at.append(np.full(len(rows), k))
            size.append(np.full(len(rows), s))
            token.append(mixed(h + np.uint64(s)))
    if not win:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return np.concatenate(win), np.concatenate(at), np.concatenate(size), np.concatenate(token)


def _count_tokens(texts: DataFrame, sizes: list[int], values: np.ndarray) -> dict[int, int]:
    """Occurrences over all texts of each token in values (the tokens of one block, so their number is bounded)."""
    sent = texts.sparkSession.sparkContext.broadcast((sizes, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, members = sent.value
        lookup = Lookup(members)
        total = np.zeros(len(lookup.values), np.int64)
        for _, data, off in pieces(batches, "text"):
            *_, h, _ranges = tokenise(data, off)
            for s in lengths:
                total += np.bincount(lookup.find(shingles(h, s))[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lookup.values[seen].view(np.int64)), pa.array(total[seen])], ["token", "n"])

    counted = texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {r["token"]: r["n"] for r in counted.collect()}
    sent.unpersist()
    return found


def _hits(texts: DataFrame, w: Windows, counts: dict[int, int]) -> DataFrame:
    """Per row: number of words, hit runs of words as [from, to) pairs, names of items with occurring windows."""
    win, at, size, token = _window_tokens(w)
    often = np.array([counts.get(int(t), 0) for t in token.view(np.int64)], np.int64)
    order = np.lexsort((at, token, often, win))
    firsts = order[np.unique(win[order], return_index=True)[1]] if len(order) else order
    firsts = firsts[often[firsts] > 0]  # a window with a shingle that no text has occurs nowhere
    firsts = firsts[np.argsort(token[firsts], kind="stable")]
    sizes = sorted(set(size[firsts].tolist()))
    sent = texts.sparkSession.sparkContext.broadcast((w, win[firsts], at[firsts], token[firsts], sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, win, at, token, sizes = sent.value
        lookup = Lookup(token)
        begin = np.searchsorted(token, lookup.values, "left")
        end = np.searchsorted(token, lookup.values, "right")
        window = w.hashes.shape[1]
        for rows, data, off in pieces(batches, "text"):
            low, starts, ends, h, ranges = tokenise(data, off)
            row_of = np.repeat(np.arange(len(off) - 1), np.diff(ranges))
            froms, cands = [], []
            for s in sizes:
                p, k = lookup.find(shingles(h, s))
                n = end[k] - begin[k]
                which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[k], n)
                froms.append(np.repeat(p, n) - at[which])
                cands.append(win[which])
            f = np.concatenate([*froms, np.empty(0, np.int64)]).astype(np.int64)
            c = np.concatenate([*cands, np.empty(0, np.int64)]).astype(np.int64)
            fits = (f >= 0) & (f + w.lengths[c] <= len(h))  # positions and lengths
            f, c = f[fits], c[fits]
            same = row_of[f] == row_of[f + w.lengths[c] - 1]
            f, c = f[same], c[same]
            for k in range(window):
                good = (k >= w.lengths[c]) | (h[np.minimum(f + k, len(h) - 1)] == w.hashes[c, k])
                f, c = f[good], c[good]
            keep = []
            for i, (a, x) in enumerate(zip(f.tolist(), c.tolist(), strict=True)):  # the words themselves
                b = a + int(w.lengths[x])
                text = low[starts[a] : ends[b - 1]].tobytes()
                if text == w.texts[x] or b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(a, b)) == w.texts[x]:
                    keep.append(i)
            f, c = f[keep], c[keep]
            change = np.zeros(len(h) + 1, np.int64)
            np.add.at(change, f, 1)
            np.add.at(change, f + w.lengths[c], -1)
            hit = np.cumsum(change[:-1]) > 0
            runs: list[list[int]] = [[] for _ in range(len(off) - 1)]
            items: list[set[str]] = [set() for _ in range(len(off) - 1)]
            for r in np.unique(row_of[f]):
                own = hit[ranges[r] : ranges[r + 1]]
                runs[r] = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).tolist()
            for r, x in set(zip(row_of[f].tolist(), c.tolist(), strict=True)):
                items[r].update(w.names[i] for i in w.items[x])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(2),
                    pa.array(np.diff(ranges)),
                    pa.array(runs, pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["doc_id", "_key", "n_words", "runs", "items"],
            )

    return texts.mapInArrow(run, "doc_id long, _key long, n_words long, runs array<long>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: n_words, the runs of words hit by windows of the items, and the items found.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and all other characters from U+0080. A window is
    ``window`` consecutive words of an item, or a whole item of fewer; a window must occur exactly. That is a set
    join at containment 1: the tokens of a window are its shingles, counted over all documents; its one necessary
    prefix token is its rarest. Documents are looked up by those tokens; the token's offset fixes where the window would
    start, which must lie within the document; then the words are compared.

    The items are sent to the tasks in blocks of at most ``block_bytes`` of text (one larger item is a block of its
    own); with several blocks, their results are joined per (doc_id, text). Documents are read in place, twice per block, without a
    shuffle. Nulls: a null text or item has no words; a null item_id counts as the name ''. Rows without hits are
    returned too; repeated rows stay; empty tables give no rows or no hits. Other columns are ignored.
    Returns doc_id, n_words, runs (flat from, to pairs of word positions), items (sorted names).
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_key"))
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    total = named.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    found = []
    for b in range(blocks):
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b)
        w = _block([(r["name"], r["text"]) for r in part.select("name", "text").collect()], window)
        _, _, size, token = _window_tokens(w)
        counts = _count_tokens(texts, sorted(set(size.tolist())), token) if len(token) else {}
        found.append(_hits(texts, w, counts))
    if blocks == 1:
        return found[0].drop("_key")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("doc_id", "_key", "n_words").agg(
        F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / blocks).cast("int").alias("copies")
    )
    joined = merged.select("doc_id", "n_words", "runs", "items", "copies").mapInArrow(_join_runs, "doc_id long, n_words long, runs array<long>, items array<string>, copies int")
    return joined.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "runs", "items")


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each row's lists of runs."""
    for batch in batches:
        out = []
        for lists in batch.column(2).to_pylist():
            runs: list[int] = []
            for a, b in sorted((r[k], r[k + 1]) for r in lists for k in range(0, len(r), 2)):
                if runs and a <= runs[-1]:
                    runs[-1] = max(runs[-1], b)
                else:
                    runs += [a, b]
            out.append(runs)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64())), *batch.columns[3:]], batch.schema.names)


def hit_words(runs) -> Column:
    """Number of words in flat from, to pairs."""
    return F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
