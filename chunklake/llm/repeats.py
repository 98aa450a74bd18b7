"""Byte-exact substring dedup: threshold-bounded interval expansion on Burrows-Wheeler orders of anchored contexts.

Every string of ``length`` bytes holds grams of GRAM bytes; those with the smallest hash are its anchors, so two equal
strings have the same anchor at the same place, and all strings that may be equal meet in the cell of an anchor gram.
In a cell the occurrences are sorted by what follows (their suffixes). Level j then holds the suffixes that start j
bytes before the anchor: extending all intervals backward by one byte is a stable regrouping by the byte before, as the
Burrows-Wheeler transform gives it. So common prefixes grow level by level, and intervals of one are dropped. Suffixes of an
interval match over ``length`` bytes if their right sides agree over what is missing, which the common prefixes of neighbours
tell. The expansion stops at the threshold: longer prefixes are never derived. Several lengths share one expansion: anchors are dealt for the
shortest, so every longer string holds one too, and contexts reach as far as the longest needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.cuts import cut_spans
from chunklake.llm.text import pieces, slice_hashes, small_batches
from chunklake.session import discard, materialize

#: Bytes of an anchor gram.
GRAM = 80
#: Distinct contexts that one cell may bring into a task; cells of more are divided.
CELL = 100_000
#: Contexts that the expansion handles at once.
BATCH = 20_000


def _sliding(x: np.ndarray, w: int, op: np.ufunc, rest: int) -> np.ndarray:
    """op over x[i:i+w] for every i, by running values from both sides of blocks of w."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, rest, x.dtype)]).reshape(-1, w)
    ahead = op.accumulate(padded, axis=1).ravel()
    back = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are smallest in some string of ``length`` bytes within a row (all of a tie)."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < length:
        return none
    at = np.arange(len(data) - gram + 1)
    h = slice_hashes(data, at, at + gram) | np.uint64(1)
    w = length - gram + 1
    least = _sliding(h, w, np.minimum, np.iinfo(np.uint64).max)
    change = np.zeros(len(least) + 1, np.int64)
    begin = np.minimum(off[:-1], len(least))
    end = np.clip(off[1:] - length + 1, begin, len(least))
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    least[np.cumsum(change[:-1]) == 0] = 0  # strings across rows
    around = np.zeros(len(h) + w - 1, np.uint64)
    around[w - 1 : w - 1 + len(least)] = least
    found = np.flatnonzero(_sliding(around, w, np.maximum, 0) == h)
    return found, h[found]


def _anchor_rows(texts: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """(gram hash, context hash, doc_id, tag, pos, after): every anchor; ``after`` counts the context's bytes behind the gram, at most ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in pieces(batches, "text"):
            pos, h = anchors(data, off, length, gram)
            if not len(pos):
                continue
            row = np.searchsorted(off, pos, "right") - 1
            left = np.minimum(pos - off[row], reach)
            after = np.minimum(off[row + 1] - pos - gram, reach)
            raw = data.tobytes()
            c = [xxhash.xxh3_64_intdigest(raw[a:b], n) for a, b, n in zip((pos - left).tolist(), (pos + gram + after).tolist(), left.tolist(), strict=True)]
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(np.array(c, np.uint64).view(np.int64)),
                    rows.column(0).take(pick),
                    rows.column(1).take(pick),
                    pa.array((pos - off[row]).astype(np.int32)),
                    pa.array(after.astype(np.int32)),
                ],
                ["h", "c", "doc_id", "tag", "pos", "after"],
            )

    return texts.mapInArrow(run, "h long, c long, doc_id long, tag int, pos int, after int")


CONTEXT = "cell long, goal int, low int, high int, doc_id long, tag int, pos int, single boolean, before binary, behind binary"


def _contexts(texts: DataFrame, wanted: DataFrame, reach: int, gram: int) -> DataFrame:
    """The bytes around the wanted anchors (h, doc_id, tag, pos, single): ``before`` in reverse, ``behind`` from the gram on. goal 0: for all lengths."""
    per_doc = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct("h", "pos", "single")).alias("at"))
    joined = texts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    joined = joined.select("doc_id", "tag", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in pieces(batches, "text"):
            at = rows.column(3)
            row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
            seen, raw, pick = at.flatten(), data.tobytes(), pa.array(row)
            pos, begin, end = seen.field("pos").to_numpy().astype(np.int64), off[row], off[row + 1]
            own = pos + begin
            before = [raw[a:b][::-1] for a, b in zip(np.maximum(begin, own - reach).tolist(), own.tolist(), strict=True)]
            behind = [raw[a:b] for a, b in zip(own.tolist(), np.minimum(end, own + gram + reach).tolist(), strict=True)]
            level = lambda x: pa.array(np.full(len(row), x, np.int32))
            cols = [seen.field("h"), level(0), level(0), level(reach), rows.column(0).take(pick), rows.column(1).take(pick), seen.field("pos"), seen.field("single")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.binary()), pa.array(behind, pa.binary())], names)

    names = [c.split()[0] for c in CONTEXT.split(", ")]
    return joined.mapInArrow(run, CONTEXT)


def _matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix filled up with 0, and their lengths."""
    sizes = pa.compute.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(col), width), np.uint8)
    flat = np.frombuffer(b"".join(col.to_pylist()), np.uint8)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out, sizes


def expand(cell: np.ndarray, goal: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray, n_before: np.ndarray, behind: np.ndarray, n_behind: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Per length, context and level j: does the string of that length that starts j bytes before the gram start in another context of the cell too?"""
    m, reach, width = len(cell), before.shape[1], behind.shape[1]
    gram = width - reach
    matches = [np.zeros((m, n - gram + 1), bool) for n in lengths]
    keyed = np.concatenate([cell.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(m, 8), behind], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{8 + width}").ravel(), kind="stable")
    same = behind[order[1:]] == behind[order[:-1]]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    common[cell[order[1:]] != cell[order[:-1]]] = -1
    at = np.arange(m)  # positions in ``order`` of the suffixes that are left, interval by interval
    interval = np.cumsum(np.concatenate([[True], cell[order[1:]] != cell[order[:-1]]]))
    for j in range(reach + 1):
        size = np.bincount(interval)
        alive = size[interval] > 1
        at, interval = at[alive], interval[alive]
        if not len(at):
            break
        rows = order[at]
        for n, match in zip(lengths, matches, strict=True):
            missing = n - j
            if missing < gram:
                continue
            kind = np.concatenate([[0], np.cumsum(common < missing)])
            fit = np.flatnonzero((n_behind[rows] >= missing) & (low[rows] <= j) & (j <= high[rows]) & ((goal[rows] == 0) | (goal[rows] == n)))
            twin = np.flatnonzero((interval[fit[1:]] == interval[fit[:-1]]) & (kind[at[fit[1:]]] == kind[at[fit[:-1]]]))
            match[rows[fit[twin]], j] = True
            match[rows[fit[twin + 1]], j] = True
        if j == reach:
            break
        more = np.flatnonzero((n_before[rows] > j) & (high[rows] > j))
        at, rows = at[more], rows[more]
        key = interval[more] * 256 + before[rows, j]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        interval = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    return matches


def _spans(contexts: DataFrame, lengths: list[int], gram: int, batch_rows: int = BATCH) -> DataFrame:
    """Spans of the matching strings of single contexts: (doc_id, tag, start, end, size). Cells are whole within a task."""
    reach = max(lengths) - gram
    names = ["doc_id", "tag", "start", "end", "size"]

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        col = lambda n: t[n].to_numpy(zero_copy_only=False)
        flat = lambda n: pa.concat_arrays(t[n].chunks)
        before, n_before = _matrix(flat("before"), reach)
        behind, n_behind = _matrix(flat("behind"), gram + reach)
        matches = expand(col("cell"), col("goal"), col("low"), col("high"), before, n_before, behind, n_behind, lengths)
        for n, match in zip(lengths, matches, strict=True):
            match[~col("single").astype(bool)] = False
            edge = np.diff(np.pad(match, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, first = np.nonzero(edge == 1)
            _, last = np.nonzero(edge == -1)
            pos, pick = col("pos").astype(np.int64)[row], pa.array(row)
            size = pa.array(np.full(len(row), n, np.int32))
            yield pa.RecordBatch.from_arrays([flat("doc_id").take(pick), flat("tag").take(pick), pa.array(pos - last + 1), pa.array(pos - first + n), size], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < batch_rows:
                continue
            t = pa.Table.from_batches(kept)
            cells = t["cell"].to_numpy()
            cut = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if cells[0] != cells[-1] else 0
            if cut:
                yield from out(t.slice(0, cut))
                kept = t.slice(cut).to_batches()
        if kept and (t := pa.Table.from_batches(kept)).num_rows:
            yield from out(t)

    return contexts.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "doc_id long, tag int, start long, end long, size int")


def _halves(contexts: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Divide cells by length and level: both halves of [low, high], each by the bytes that all strings of the half have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                for n in [r["goal"]] if r["goal"] else lengths:
                    low, high = (r["low"], r["high"]) if r["goal"] else (0, n - gram)
                    mid = (low + high) // 2
                    for a, b in ((low, mid), (mid + 1, high)):
                        need = n - b
                        if a <= b and len(r["before"]) >= a and len(r["behind"]) >= need:
                            core = r["before"][:a] + r["behind"][:need]
                            cell = np.array([xxhash.xxh3_64_intdigest(core, (n << 40) + (a << 20) + b)], np.uint64).view(np.int64)[0]
                            out.append(r | {"cell": int(cell), "goal": n, "low": a, "high": b})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return contexts.mapInArrow(run, CONTEXT)


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = GRAM, cell: int = CELL, batch_rows: int = BATCH, report: int | None = None) -> DataFrame:
    """Spans (doc_id, tag, start, end, size) whose union, per size, is all bytes covered by strings of ``size`` bytes that start twice.

    Sizes are ``length`` and, if given, the shorter ``report``. tag is a hash of the text, so rows that share a doc_id stay apart. Texts are read whole as
    UTF-8, strings never cross rows. Contexts (up to length - gram bytes on either side) that occur more than once match over all their
    strings, and only the others of a gram with several contexts are compared by their bytes; one row per such context is shuffled.
    Cells of more than ``cell`` contexts are divided by lengths, levels and the bytes common to a half, down to single levels, where
    counting is enough; so no gram gathers its contexts in one task.
    """
    small_batches(docs.sparkSession)
    lengths = sorted({length, min(length, report or length)})
    gram = min(gram, lengths[0])
    reach = length - gram
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text")).where(
        F.octet_length("text") >= lengths[0]
    )
    found = materialize(_anchor_rows(texts, lengths[0], gram, reach), "anchors")
    # counts are read as tables, which leaves the joins with them free to split hot grams
    often = materialize(found.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h"), "anchor-counts")
    shared = materialize(found.join(often, "h"), "anchors-shared")
    discard(found)
    contexts = shared.groupBy("h", "c").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "pos")).alias("at")
    )
    contexts = materialize(contexts, "anchor-contexts")
    copies = shared.join(contexts.where("n > 1").select("h", "c"), ["h", "c"])
    copies = copies.select(
        "doc_id",
        "tag",
        (F.col("pos") - F.least(F.col("pos"), F.lit(reach))).cast("long").alias("start"),
        (F.col("pos") + gram + F.col("after")).cast("long").alias("end"),
        F.explode(F.array(*[F.lit(n) for n in lengths])).alias("size"),
    )
    spans = copies.where(F.col("end") - F.col("start") >= F.col("size"))
    mixed = contexts.groupBy("h").agg(F.count("*").alias("_c"), F.min("n").alias("_least")).where("_c > 1 AND _least = 1")
    mixed = materialize(mixed.select("h"), "anchor-mixed")
    wanted = contexts.join(mixed, "h").select("h", "at.doc_id", "at.tag", "at.pos", (F.col("n") == 1).alias("single"))
    todo = materialize(_contexts(texts, wanted, reach, gram), "anchor-bytes")
    while True:
        flat = (F.min("low") == F.max("high")) & (F.min("goal") > 0)
        sizes = materialize(todo.groupBy("cell").agg(F.count("*").alias("_m"), flat.alias("_flat")).where("_m > 1"), "anchor-cells")
        sized = todo.join(sizes, "cell")
        spans = spans.unionByName(_spans(sized.where((F.col("_m") <= cell) & ~F.col("_flat")).drop("_m", "_flat"), lengths, gram, batch_rows))
        one_level = sized.where(F.col("_flat") & F.col("single"))
        start = (F.col("pos") - F.col("low")).cast("long")
        spans = spans.unionByName(one_level.select("doc_id", "tag", start.alias("start"), (start + F.col("goal")).alias("end"), F.col("goal").alias("size")))
        large = sized.where((F.col("_m") > cell) & ~F.col("_flat")).drop("_m", "_flat")
        if sizes.where((F.col("_m") > cell) & ~F.col("_flat")).isEmpty():
            return spans
        todo = materialize(_halves(large, lengths, gram), "anchor-halves")


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, cell: int = CELL, report: int | None = None) -> DataFrame:
    """Every row's text without the bytes covered by repeated strings of ``length`` bytes, judged on the input.

    ``report`` is a shorter length: bytes covered by repeated strings of that many bytes are not removed but counted in n_marked.

    Nulls: a null text counts as empty; null ids are kept. Texts shorter than ``length`` lose nothing. Repeated rows are
    documents that repeat each other. Empty table: no rows. Other columns are ignored. Returns the columns of cut_spans.
    """
    spans = repeated_spans(docs, length, gram, cell, report=report)
    spans = spans.withColumn("mark", F.col("size") < length)
    return cut_spans(docs.select("doc_id", "text").withColumn("tag", F.hash("text")), spans, by=["doc_id", "tag"], mark="mark")
