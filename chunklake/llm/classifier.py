"""Quality classifier: cumulative-link (ordinal logistic) regression on hashed texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.text import LOWER, LOWER_ALNUM, NOT_SPACE, mixed, pieces, slice_hashes, small_batches, words
from chunklake.session import discard, materialize

#: Hash buckets of the shared weights.
BUCKETS = 1 << 18
#: Labelled texts that a model is fitted on at most, the first by a hash of their id, and their features together; one text is taken in any case.
FIT_ROWS, FIT_FEATURES = 8000, 1 << 24


@dataclass
class OrdinalModel:
    """P(grade >= k+1) = logistic(weights . x - thresholds[k]), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values: the square root of each token's share of its text, over whole texts.

    Tokens are the lower-cased words and, per word, its shape: counts of capitals, small letters, signs, digits and
    other characters in steps, and its last byte; and whether it repeats the word before it.
    """
    low = LOWER[data]
    starts, ends, ranges = words(low, off, LOWER_ALNUM)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(ranges))
    parts = [(rows, slice_hashes(low, starts, ends))]
    starts, ends, ranges = words(data, off, NOT_SPACE)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(ranges))

    def within(kind: np.ndarray, most: int) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(kind)])
        return np.minimum(run[ends] - run[starts], most)

    upper, digit, other = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data >= 128
    small = (data >= 97) & (data <= 122)
    sign = ~(upper | digit | other | small)
    shape = within(upper, 2)
    for kind, most in ((small, 1), (sign, 3), (digit, 1), (other, 1)):
        shape = shape * (most + 1) + within(kind, most)
    last = data[ends - 1].astype(np.int64)
    last[last >= 128] = 128
    seen = slice_hashes(low, starts, ends)
    again = np.zeros(len(seen), np.int64)
    again[1:] = (seen[1:] == seen[:-1]) & (rows[1:] == rows[:-1])
    parts.append((rows, mixed((shape * 2 + again).astype(np.uint64) + np.uint64(1 << 40))))
    parts.append((rows, mixed(last.astype(np.uint64) + np.uint64(1 << 41))))
    out = []
    for rows, h in parts:
        key = rows * BUCKETS + (h >> np.uint64(46)).astype(np.int64)
        key, n = np.unique(key, return_counts=True)
        total = np.bincount(rows, minlength=len(off) - 1)
        out.append((key // BUCKETS, key % BUCKETS, np.sqrt(n / total[key // BUCKETS])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fit(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, rounds: int = 300, ridge: float = 3e-4) -> OrdinalModel:
    """Full-batch Adam steps on the mean log loss of all tails; y holds grades."""
    rows, cols, vals = x
    grades = np.unique(y)
    k, n = len(grades) - 1, len(y)
    if k < 1:
        return OrdinalModel(np.zeros(BUCKETS), np.full(0, 0.0), grades)
    over = (y[:, None] > grades[None, :-1]).astype(float)
    used = np.flatnonzero(np.bincount(cols, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    cols = place[cols]
    share = over.mean(0)
    theta, w = -np.log(share / (1 - share)), np.zeros(len(used))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, theta)]
    for t in range(1, rounds + 1):
        score = np.bincount(rows, vals * w[cols], n)
        gap = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50))) - over
        gw = np.bincount(cols, vals * gap.sum(1)[rows], len(used)) / n + ridge * w / 100
        for p, g, (m, v), rate in ((w, gw, state[0], 0.15), (theta, -gap.mean(0), state[1], 0.05)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        theta = np.maximum.accumulate(theta)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return OrdinalModel(weights, theta, grades)


def train(docs: DataFrame, ratings: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> OrdinalModel:
    """Fit on at most ``fit_rows`` rated texts of at most ``fit_features`` features together. ratings: doc_id, grade (int); null ids or grades are left out.

    Texts are taken in the order of the hashes of their id and themselves, while both bounds hold; features are made in tasks, so the driver
    gets no more than that, whatever the input. Repeated rows count once, texts that share an id are texts of their own, an id with several
    grades has the smallest. Null and empty texts have no features. Without rated texts the model has no grades.
    """
    small_batches(docs.sparkSession)
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("grade").cast("long").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rated_docs = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("long"), "text", "grade")
    rated_docs = rated_docs.withColumns({"_order": F.xxhash64("doc_id"), "_text": F.xxhash64("text")})
    key = ["_order", "doc_id", "_text"]
    first = rated_docs.select(*key).distinct().orderBy(*key).limit(fit_rows)
    once = rated_docs.join(F.broadcast(first), key, "left_semi").groupBy(*key).agg(F.first("text").alias("text"), F.first("grade").alias("grade"))
    picked = once.select("doc_id", "text", "grade", "_order", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in pieces(batches, "text"):
            r, c, v = features(data, off)
            order = np.lexsort((c, r))
            bounds = pa.array(np.searchsorted(r[order], np.arange(len(off))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(k) for k in (0, 2, 3, 4)),
                    pa.ListArray.from_arrays(bounds, pa.array(c[order].astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(v[order].astype(np.float32))),
                ],
                ["doc_id", "grade", "_order", "_text", "cols", "vals"],
            )

    kept = materialize(picked.mapInArrow(run, "doc_id long, grade long, _order long, _text long, cols array<int>, vals array<float>"), "fit")
    sizes = kept.select(*key, F.size("cols").alias("n")).toArrow()
    if not len(sizes):
        return OrdinalModel(np.zeros(BUCKETS), np.zeros(0), np.zeros(0, np.int64))
    sizes = sizes.sort_by([(c, "ascending") for c in key])
    within = int((np.cumsum(sizes["n"].to_numpy()) <= fit_features).sum())
    last = sizes.slice(max(within, 1) - 1, 1).to_pylist()[0]
    made = kept.where(F.struct(*key) <= F.struct(*[F.lit(last[c]).cast("long") for c in key])).toArrow()
    made = made.take(np.lexsort((made["_text"].to_numpy(), made["doc_id"].to_numpy()))).combine_chunks()
    discard(kept)
    cols, vals = made["cols"].combine_chunks(), made["vals"].combine_chunks()
    if isinstance(cols, pa.ChunkedArray):
        cols, vals = pa.concat_arrays(cols.chunks), pa.concat_arrays(vals.chunks)
    sizes = cols.value_lengths().to_numpy()
    x = (np.repeat(np.arange(len(sizes)), sizes), cols.flatten().to_numpy().astype(np.int64), vals.flatten().to_numpy().astype(float))
    y = made["grade"].to_numpy().copy()
    del made, cols, vals  # x has copies; the driver's memory is small
    pa.default_memory_pool().release_unused()
    return fit(x, y)


def score(docs: DataFrame, model: OrdinalModel, at_least: int) -> DataFrame:
    """All columns of docs, with expected_grade and p_select = P(grade >= at_least).

    Every whole text is read; a null, empty or blank text has no features and gets the model's base rates. A model
    without two grades to tell apart gives p_select 1 and its only grade (null if none). Names that clash are replaced.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("expected_grade", "p_select")
    at = base.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", expected_grade double, p_select double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for rows, data, off in pieces(batches, rows_text):
            r, c, v = features(data, off)
            tails = m.tails(np.bincount(r, v * m.weights[c], len(off) - 1)) if len(m.thresholds) else np.zeros((len(off) - 1, 0))
            if len(m.grades):
                expected = m.grades[0] + tails @ np.diff(m.grades) if len(m.thresholds) else np.full(len(off) - 1, float(m.grades[0]))
            level = np.searchsorted(m.grades, at_least)
            chance = np.ones(len(off) - 1) if level == 0 or not len(m.thresholds) else tails[:, level - 1] if level < len(m.grades) else np.zeros(len(off) - 1)
            graded = pa.array(expected) if len(m.grades) else pa.nulls(len(off) - 1, pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns, graded, pa.array(chance)], [*rows.schema.names, "expected_grade", "p_select"])

    rows_text = base.columns[at]
    return base.mapInArrow(run, fields)


def grades(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 toxic, 1 of low quality, 2 good; null if a label that decides is null."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
