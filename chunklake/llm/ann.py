"""Approximate nearest neighbours by collision counting over sorted single projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.session import materialize

#: Numbers (vectors times dimensions) of one block of the index.
BLOCK_NUMBERS = 1 << 20
#: Projections; share of them in which a candidate must collide; half width of a window in units of the search radius.
PROJECTIONS, COLLISIONS, HALF_WIDTH = 128, 0.85, 1.5
#: Projections that the probe counts in.
PROBE = 32
#: Radii of the virtual rehashing, in units of the probe's bound on the k-th distance.
RADII = (0.95, 1.0)


def random_lines(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random directions as columns, orthogonal within every ``dim`` of them, of length sqrt(dim).

    The projections of a vector on orthogonal lines can't all be large, so collisions tell distances better than with independent lines.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(turns, axis=1)[:, :count] * np.sqrt(dim)


class Block:
    """Vectors of one dimension with the sorted array of every projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, seed: int):
        self.ids, self.vectors = ids, vectors
        self.lines = random_lines(vectors.shape[1], projections, seed)
        places = vectors @ self.lines
        self.order = np.ascontiguousarray(np.argsort(places, axis=0, kind="stable").T)
        self.values = np.take_along_axis(places.T, self.order, axis=1)

    def _windows(self, centre: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per line and half width the window's bounds in the sorted array."""
        low = np.stack([np.searchsorted(v, c - halves, "left") for v, c in zip(self.values, centre, strict=False)])
        high = np.stack([np.searchsorted(v, c + halves, "right") for v, c in zip(self.values, centre, strict=False)])
        return low, high

    def search(self, query_id: int, query: np.ndarray, k: int, share: float, half_width: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest candidates found (ids, distances) and how many vectors were verified.

        The k-th distance to a few vectors bounds the search; a first count in windows of that radius is a probe, whose
        vectors of most collisions bound it closely. Then windows centred on the query's own values expand by virtual
        rehashing: each larger radius only takes in what is new on either side, every vector in a window gets one count, and vectors
        that reach ``share`` of the lines are verified. The search ends when the k-th distance is within the radius, at the
        probe's bound at the latest, where every nearer vector collides in a line with probability 0.87 or more.
        """
        n, need = len(self.ids), int(share * self.lines.shape[1])
        dist, tested = np.full(n, np.inf), self.ids == query_id
        want = min(k, n - int(tested.sum()))
        if not want:
            return self.ids[:0], dist[:0], 0

        def verify(rows: np.ndarray) -> float:
            rows = rows[~tested[rows]]
            dist[rows] = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
            tested[rows] = True
            return np.partition(dist, want - 1)[want - 1]

        def count(counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            """One more for all in a window; of one that holds most vectors, one less for those outside, and one for all."""
            for line, a, b in zip(self.order, low.tolist(), high.tolist(), strict=False):
                if 2 * (b - a) <= n:
                    counts[line[a:b]] += 1
                else:
                    counts[line[:a]] -= 1
                    counts[line[b:]] -= 1
                    counts[n] += 1

        centre = query @ self.lines
        bound = verify(np.arange(0, n, max(1, n // (8 * k))))
        if not np.isfinite(bound):
            bound = verify(np.arange(n))
        counts = np.zeros(n + 1, np.int16)
        low, high = self._windows(centre[:PROBE], np.array([half_width * bound]))
        count(counts, low[:, 0], high[:, 0])
        most = min(n, 8 * want)
        bound = verify(np.argpartition(counts[:n], n - most)[n - most :])
        counts[:] = 0
        low, high = self._windows(centre, half_width * bound * np.array(RADII))
        for step, radius in enumerate(bound * np.array(RADII)):
            if step == 0:
                count(counts, low[:, 0], high[:, 0])
            else:
                count(counts, low[:, step], low[:, step - 1])
                count(counts, high[:, step - 1], high[:, step])
            if verify(np.flatnonzero(counts[:n] >= need - counts[n])) <= radius:
                break
        found = np.flatnonzero(np.isfinite(dist))
        ranked = found[np.lexsort((self.ids[found], dist[found]))[:want]]
        return self.ids[ranked], dist[ranked], int(np.isfinite(dist).sum())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, projections: int = PROJECTIONS, share: float = COLLISIONS, half_width: float = HALF_WIDTH, seed: int = 17, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """For every query the k nearest vectors found by Euclidean distance in double precision, not of its own vec_id.

    vectors, queries: vec_id, embedding. Every vector is dealt to one block of the index and travels once; the queries visit
    each block, where they stream past its sorted projections. The blocks' best k are then ranked; ties go to the smaller vec_id.
    Vectors of different dimension don't meet.

    Null, zero and empty vectors and those with null or non-finite components take no part; rows with a null vec_id
    neither. Repeated rows of a vec_id are candidates each; a query id with several vectors asks with the smallest. Empty table: no
    rows. Other columns are ignored. Returns query_id, rank (from 1), vec_id, score, and verified: how many vectors of its block
    were compared exactly for this query.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & sound)

    numbers = usable(vectors).agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = max(1, -(-numbers // block_numbers))
    points = materialize(usable(vectors).repartition(blocks).withColumn("block", F.spark_partition_id()), "ann-blocks")
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = points.select("block", F.size("v").alias("dim"), F.lit(0).alias("kind"), "vec_id", "v").unionByName(
        everywhere.select("block", F.size("v").alias("dim"), F.lit(1).alias("kind"), "vec_id", "v")
    )
    names = ["query_id", "vec_id", "score", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, index = None, [], [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            vec_id, flat = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(place[:, 1])])
            cuts = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, [len(place)]])
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                block, dim, kind = place[a].tolist()
                if (block, dim) != key:
                    key, ids, parts, index = (block, dim), [], [], None
                some = flat[starts[a] : starts[b]].reshape(b - a, dim)
                if kind == 0:
                    ids.append(vec_id[a:b])
                    parts.append(some)
                    continue
                if index is None and parts:
                    index, ids, parts = Block(np.concatenate(ids), np.concatenate(parts), projections, seed), [], []
                for q, vector in zip(vec_id[a:b].tolist(), some, strict=True):
                    if index is not None:
                        near, dist, verified = index.search(q, vector, k, share, half_width)
                        out.append((np.full(len(near), q), near, dist, np.full(len(near), verified)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    dealt = rows.repartition("block").sortWithinPartitions("block", "dim", "kind")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double, verified long")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
