"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake.operators.graph import connected_components
from chunklake.llm.text import LOWER, NOT_SPACE, mixed, pieces, small_batches, words
from chunklake.session import materialize

#: Distinct fingerprints that one task compares with each other; larger buckets are divided further.
BUCKET = 2048
#: Levels of masks; a bucket that they leave over BUCKET is compared whole up to WHOLE times BUCKET, by pairs of blocks beyond.
LEVELS = 2
WHOLE = 64

# XXH64's primes (fixed values).
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def starts_of(seed: int) -> list[int]:
    """The four accumulators' first values, mod 2**64."""
    return [x % 2**64 for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))]


def xxh64_slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:start+size] for every slice, by columns of the same step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    at4 = np.ndarray((len(data),), "<u4", padded, strides=(1,))
    seed = np.uint64(seed)
    h = np.full(len(starts), seed + P5, np.uint64)
    at, left = starts.copy(), sizes.copy()
    if len(long := np.flatnonzero(sizes >= 32)):
        acc = [np.full(len(long), x, np.uint64) for x in starts_of(int(seed))]
        live = np.arange(len(long))
        while len(live):
            rows = long[live]
            for k in range(4):
                acc[k][live] = _rot(acc[k][live] + at8[at[rows] + 8 * k] * P2, 31) * P1
            at[rows] += 32
            left[rows] -= 32
            live = live[left[rows] >= 32]
        v = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for k in range(4):
            v = (v ^ (_rot(acc[k] * P2, 31) * P1)) * P1 + P4
        h[long] = v
    h += sizes.astype(np.uint64)
    rows = np.flatnonzero(left >= 8)
    while len(rows):
        h[rows] = _rot(h[rows] ^ (_rot(at8[at[rows]] * P2, 31) * P1), 27) * P1 + P4
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] >= 8]
    if len(rows := np.flatnonzero(left >= 4)):
        h[rows] = _rot(h[rows] ^ (at4[at[rows]].astype(np.uint64) * P1), 23) * P2 + P3
        at[rows] += 4
        left[rows] -= 4
    rows = np.flatnonzero(left > 0)
    while len(rows):
        h[rows] = _rot(h[rows] ^ (data[at[rows]].astype(np.uint64) * P5), 11) * P1
        at[rows] += 1
        left[rows] -= 1
        rows = rows[left[rows] > 0]
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(data: np.ndarray, off: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of ``size`` words (fewer words: the whole sequence) and each row's range in them."""
    data = LOWER[data]
    starts, ends, ranges = words(data, off, NOT_SPACE)
    text = np.where(NOT_SPACE[data], data, np.uint8(0x20))
    counts = np.diff(ranges)
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    first = np.arange(bounds[-1]) + np.repeat(ranges[:-1] - bounds[:-1], shingles)
    last = first + np.repeat(np.minimum(counts, size), shingles) - 1
    gaps = np.zeros(len(starts) + 1, np.int64)  # how many gaps before a word are wider than one byte
    if len(starts):
        gaps[1:-1] = np.cumsum(starts[1:] - ends[:-1] != 1)
        gaps[-1] = gaps[-2]
    begin, length = starts[first], ends[last] - starts[first]
    odd = (gaps[last] != gaps[first]) | (length > 256)
    out = np.empty(len(first), np.uint64)
    plain = np.flatnonzero(~odd)
    out[plain] = xxh64_slices(text, begin[plain], length[plain], seed)
    raw = text.tobytes() if odd.any() else b""
    for i in np.flatnonzero(odd):
        joined = b" ".join(raw[starts[w] : ends[w]] for w in range(first[i], last[i] + 1))
        out[i] = xxhash.xxh64_intdigest(joined, seed)
    return out, bounds


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row the 64 bits that are set in over half of its hashes; no hashes: zero.

    Eight counters of one byte share a word; runs of at most 255 hashes can't overflow them.
    """
    counts = np.diff(bounds)
    runs = -(-counts // 255)
    firsts = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(bounds[:-1], runs) + 255 * (np.arange(firsts[-1]) - np.repeat(firsts[:-1], runs))
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & np.uint64(0x0101010101010101), begin)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts[:-1][full], axis=0)
        for k in range(8):
            out[full] |= (sums[:, k] * 2 > counts[full]).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, seed: int = 42, count: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, w0, w1, ...): ``count`` 64-bit SimHashes of the shingles of each whole text, as signed longs.

    w0 takes the bits of the shingles' XXH64, the others those of independent mixes of it.
    """
    small_batches(docs.sparkSession)
    names = [f"w{k}" for k in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in pieces(batches, "text"):
            h, bounds = shingle_hashes(data, off, words_in_shingle, seed)
            prints = [majority_bits(mixed(h + np.uint64(k) * P5) if k else h, bounds) for k in range(count)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(p.view(np.int64)) for p in prints]], ["doc_id", *names])

    schema = ", ".join(["doc_id long", *[f"{n} long" for n in names]])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def covering_masks(radius: int, level: int = 0, positions: range = range(64)) -> list[int]:
    """2**(radius+1) - 1 masks: any ``radius`` of the positions or fewer are all left out by at least one of them.

    Each position has a nonzero vector of radius+1 bits, dealt evenly in an order that depends on ``level``; the mask
    of a nonzero vector v keeps the positions whose vector has an odd product with v. Up to radius vectors never
    span the whole space, so some v is orthogonal to all of them.
    """
    n = (1 << (radius + 1)) - 1
    deal = np.random.Generator(np.random.PCG64(1000 + level)).permutation(positions)
    vector = {int(p): 1 + k % n for k, p in enumerate(deal)}
    masks = [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def sliced_masks(radius: int, parts: int, level: int = 0) -> list[int]:
    """Masks of ``parts`` equal slices of the bits: of any ``radius`` bits one slice has radius // parts at most."""
    step = 64 // parts
    return [m for p in range(parts) for m in covering_masks(radius // parts, level * parts + p, range(p * step, (p + 1) * step))]


def _components_of_large(w: np.ndarray, total: int) -> np.ndarray:
    """A label per row of ``w``: the components over all links, comparing only rows outside the largest one with all others.

    Of two rows in different components one is outside the largest, so no link is missed; n variants of one text join
    after a few rows and cost about n comparisons each, not n * n in all.
    """
    label, fresh = np.arange(len(w)), np.ones(len(w), bool)
    while True:
        todo = np.flatnonzero(fresh & (label != np.bincount(label).argmax()))
        if not len(todo):
            return label
        for p in todo[:: max(1, len(todo) // 16)][:16]:
            fresh[p] = False
            joined = np.zeros(len(w), bool)
            joined[label[np.bitwise_count(w ^ w[p]).sum(axis=-1, dtype=np.int16) <= total]] = True
            label[joined[label]] = np.flatnonzero(joined)[0]


def _close_in_buckets(bucket: np.ndarray, w: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (root, member) of a forest over the links within sorted buckets; w: a row of words per fingerprint."""

    def linked(p, q):
        return np.bitwise_count(w[p] ^ w[q]).sum(axis=-1, dtype=np.int16) <= total

    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    sizes = np.diff(edges)
    left, right = [], []
    i = np.flatnonzero(np.repeat(sizes <= 32, sizes))
    for k in range(1, 32):
        i = i[i + k < len(w)]
        i = i[bucket[i + k] == bucket[i]]
        if not len(i):
            break
        hit = i[linked(i, i + k)]
        left.append(hit)
        right.append(hit + k)
    label = np.arange(len(w))
    for a, b in zip(edges[:-1][sizes > 32], edges[1:][sizes > 32], strict=True):
        if b - a > BUCKET:
            label[a:b] = a + _components_of_large(w[a:b], total)
            continue
        every = np.arange(a, b)
        for x in range(a, b, 256):
            p, q = np.nonzero(linked(every[x - a : x - a + 256, None], every[None, :]))
            p, q = p + x, q + a
            left.append(p[p < q])
            right.append(q[p < q])
    if left:
        u, v = np.concatenate(left), np.concatenate(right)
        while True:
            before = label.copy()
            low = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            label = label[label]
            if (label == before).all():
                break
    member = np.flatnonzero(label != np.arange(len(w)))
    return label[member], member


def _links(buckets: DataFrame, names: list[str], total: int) -> DataFrame:
    """Compare the fingerprints of each bucket: edges as words u_*, v_*."""
    out_names = [f"{side}_{n}" for side in "uv" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_b, kept_w = np.empty(0, np.int64), np.empty((0, len(names)), np.uint64)

        def out(b, w):
            u, v = _close_in_buckets(b, w, total)
            cols = [w[side, k].view(np.int64) for side in (u, v) for k in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], out_names)

        for batch in batches:
            kept_b = np.concatenate([kept_b, batch.column(0).to_numpy(zero_copy_only=False)])
            w = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(names))], axis=1).view(np.uint64)
            kept_w = np.concatenate([kept_w, w])
            if len(kept_b) >= 1 << 15 and kept_b[0] != kept_b[-1]:
                cut = int(np.searchsorted(kept_b, kept_b[-1]))
                yield out(kept_b[:cut], kept_w[:cut])
                kept_b, kept_w = kept_b[cut:], kept_w[cut:]
        if len(kept_b):
            yield out(kept_b, kept_w)

    schema = ", ".join(f"{n} long" for n in out_names)
    return buckets.repartition("bucket").sortWithinPartitions("bucket", *names).mapInArrow(run, schema)


def near_links(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints w0 of ``prints`` that differ in at most ``radius`` bits.

    Every fingerprint goes to one bucket per mask, so every pair within the radius meets. Buckets of one are dropped,
    buckets up to ``bucket`` are compared in tasks, and larger ones are divided by the masks of the next level, which also bring every
    pair within the radius together. A bucket that is still large then is a dense cluster, or agrees in the kept bits of both
    levels: all its pairs are compared, in one task up to WHOLE * ``bucket`` rows, beyond that in one per pair of blocks. So the rows
    of a bucket grow by a fixed factor, and any density gives the same links.
    """
    found = []
    todo = prints.select("w0").distinct().withColumn("bucket", F.lit(0).cast("long"))
    for level in range(LEVELS):
        masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius, level)])
        dealt = todo.select("bucket", "w0", F.posexplode(masks).alias("_m", "_mask"))
        dealt = dealt.select(F.xxhash64("bucket", "_m", F.col("w0").bitwiseAND(F.col("_mask"))).alias("bucket"), "w0")
        sizes = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1"), "simhash-sizes")
        shared = dealt.join(sizes, "bucket")
        last, is_over = level == LEVELS - 1, F.col("_n") > bucket
        over = not sizes.where(is_over).isEmpty()
        if over:
            shared = materialize(shared, "simhash-buckets")
        whole = in_blocks(shared, ["w0"], WHOLE * bucket) if last and over else shared if not over else shared.where(~is_over)
        found.append(materialize(_links(whole.select("bucket", "w0"), ["w0"], radius), "simhash-links"))
        if not over:
            break
        todo = shared.where(is_over).select("bucket", "w0").repartition("bucket", "w0")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.select(F.col("u_w0").alias("u"), F.col("v_w0").alias("v")).distinct()


def in_blocks(shared: DataFrame, names: list[str], limit: int, keep: int = 0) -> DataFrame:
    """Rows of buckets over ``limit`` (their size in _n), once for every pair of blocks that holds their own block; other rows as they are.

    The lowest ``keep`` bits of the bucket's number stay.
    """
    n = F.coalesce("_n", F.lit(0))
    blocks = F.ceil(n * 2 / limit).cast("long")
    own, other = F.pmod(F.xxhash64(F.lit(7), *names), F.col("_blocks")), F.col("_other")
    large = shared.where(n > limit).withColumn("_blocks", blocks).withColumn("_own", own)
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).where("_other <> _own")
    low = F.lit((1 << keep) - 1).cast("long")
    made = F.xxhash64("bucket", F.least("_own", other), F.greatest("_own", other)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.col("bucket").bitwiseAND(low))
    large = large.withColumn("bucket", made)
    return shared.where(n <= limit).select("bucket", *names).unionByName(large.select("bucket", *names))


def simhash_components(docs: DataFrame, radius: int = 3, words_in_shingle: int = 3, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """Per row its fingerprint and the smallest doc_id it reaches over links of at most ``radius`` differing bits.

    Texts are lower-cased (A-Z) and split at space and 0x09-0x0D; null and blank texts have fingerprint zero and link
    like any other. Only distinct fingerprints are compared, so copies cost nothing; rows with a null doc_id get the
    component of their fingerprint. Empty table: no rows. Repeated rows are kept; other columns are ignored.
    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    prints = materialize(fingerprints(docs, words_in_shingle, seed), "simhash-prints")
    distinct = materialize(prints.groupBy("w0").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(near_links(distinct, radius, bucket))
    rooted = distinct.join(roots, F.col("w0") == F.col("node"), "left").select("w0", "first", F.coalesce("root", "w0").alias("root"))
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-smallest")
    of_print = rooted.join(smallest, "root").select("w0", "component_id")
    return prints.join(of_print, "w0").select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
