"""Near copies at an exact similarity: SimHash buckets bring pairs together, their shingle sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.llm.simhash import BUCKET, P5, WHOLE, in_blocks, majority_bits, shingle_hashes, sliced_masks
from chunklake.llm.text import mixed, pieces, small_batches
from chunklake.operators.graph import connected_components
from chunklake.session import discard, keys_to_join, materialize

#: 64-bit fingerprints of a set; radius within which two values of one of them are sure to meet; most differing bits of a candidate.
PRINTS, RADIUS, BITS = 3, 7, 48
#: Sets up to this size are few bits' worth; pairs with one of them meet by their shingles instead.
SHORT = 40
#: Nearest candidates that a set tries in the first round; sixteen times as many in each later one.
TRIES = 3
#: Slots of a parity map at most: 1 kB. Longer sets' maps rule out less, and their pairs are still compared whole.
SLOTS = 1 << 13
#: When so few nodes ask, only rows of their buckets are dealt.
FEW = 1000
#: Cells of buckets that are counted first; a bucket over a limit is in a cell over it.
CELLS = 1 << 16
_TABLE_BITS = 7  # of a bucket's number, for the table


def needed(n: np.ndarray | int, least: float) -> np.ndarray | int:
    """The smallest overlap of a set of n with any set that is at least ``least`` similar to it."""
    return np.ceil(np.round(least * np.asarray(n), 9)).astype(int)


def similar(common: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Is the Jaccard similarity of sets of n and m with ``common`` members at least ``least``?"""
    return common >= least * (n + m - common) - 1e-9


def parity_maps(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per set a map of 2n slots or more, a power of two: is the number of its members in the slot odd? As bytes end to end, and offsets.

    Two maps differ in no more slots than the sets in members, so they bound what the sets share, from above.
    """
    slots = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), 64, SLOTS)
    first = np.concatenate([[0], np.cumsum(slots)])
    odd = np.bincount(first[row] + (h & (slots[row] - 1).astype(np.uint64)).astype(np.int64), minlength=first[-1]) & 1
    return np.packbits(odd.astype(bool), bitorder="little"), first // 8


def may_link(n: np.ndarray, least: float, maps: pa.Array | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of pairs (p, q), by position: False only where their sizes or parity maps show that the sets can't be ``least`` similar."""
    if maps is not None:
        off = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset : maps.offset + len(maps) + 1].astype(np.int64)
        words, start, size = np.frombuffer(maps.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint64), (off[:-1] - off[0]) // 8, np.diff(off) // 8

    def test(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        ok = similar(np.minimum(n[p], n[q]), n[p], n[q], least)
        if maps is None:
            return ok
        todo = np.flatnonzero(ok)
        kinds, kind = np.unique(np.stack([size[p[todo]], size[q[todo]]]), axis=1, return_inverse=True)
        for k, (a, b) in enumerate(kinds.T.tolist()):
            own, step = todo[kind == k], max(1, (1 << 19) // max(a, b))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                x, y = (words[start[r[some]][:, None] + np.arange(c)].reshape(len(some), -1, min(a, b)) for r, c in ((p, a), (q, b)))
                differ = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1, dtype=np.int64)
                ok[some] = similar((n[p[some]] + n[q[some]] - differ) // 2, n[p[some]], n[q[some]], least)
        return ok

    return test


def set_table(docs: DataFrame, words_in_shingle: int, least: float) -> DataFrame:
    """Per row its shingle set: doc_id, node (a hash of the set), n, w0.. (SimHashes of the set), keys (of a short set), set (sorted 32-bit hashes), map (of parities)."""
    small_batches(docs.sparkSession)
    names = [f"w{k}" for k in range(PRINTS)]
    top = int(SHORT / least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in pieces(batches, "text"):
            h, bounds = shingle_hashes(data, off, words_in_shingle, 42)
            row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)]
            h, row = h[fresh], row[fresh]
            bounds = np.searchsorted(row, np.arange(len(off)))
            n = np.diff(bounds)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h), dtype=np.uint64)])
            node = mixed(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64))
            prints = [majority_bits(mixed(h + np.uint64(k) * P5) if k else h, bounds) for k in range(PRINTS)]
            short = np.where(n <= top, n, 0)
            prefix = np.where(short > 0, short - needed(short, least) + 1, 0)
            within = np.arange(len(h)) - bounds[row]
            small = np.sort(h.astype(np.uint32) + (row.astype(np.uint64) << np.uint64(32))).astype(np.uint32)
            binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((4 * bounds).astype(np.int64)), pa.py_buffer(small)])
            odd, at = parity_maps(h, row, n)
            parities = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(odd)])
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)), pa.array(h[within < prefix[row]].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), *[pa.array(p.view(np.int64)) for p in prints], keys, binary.cast(pa.binary()), parities.cast(pa.binary())],
                ["doc_id", "node", "n", *names, "keys", "set", "map"],
            )

    words = ", ".join(f"{x} long" for x in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, node long, n int, {words}, keys array<long>, set binary, map binary")


def forest(n: int, linked: Callable[[int], np.ndarray]) -> np.ndarray:
    """Links, as rows (p, q), that connect what all links connect; linked(p) gives the members linked to p.

    Of two members in different components one is outside the largest, so asking those outside it is enough: n variants
    of one text join after a few questions.
    """
    label, fresh, found = np.arange(n), np.ones(n, bool), [np.empty((0, 2), np.int64)]
    while True:
        todo = np.flatnonzero(fresh & (label != np.bincount(label).argmax()))
        if not len(todo):
            return np.concatenate(found)
        for p in todo[:: max(1, len(todo) // 16)][:16].tolist():
            fresh[p] = False
            near = linked(p)
            near = near[label[near] != label[p]]
            if len(near):
                groups, at = np.unique(label[near], return_index=True)
                found.append(np.stack([np.full(len(at), p), near[at]], axis=1))
                joined = np.zeros(n, bool)
                joined[groups] = True
                label[joined[label]] = label[p]


def linked_sets(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Links of a bucket of sets. Candidates of a set are those that share one of its prefix members, the rarest in the bucket."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], owner[order]

    def linked(p: int) -> np.ndarray:
        a, b = np.searchsorted(value, sets[p], "left"), np.searchsorted(value, sets[p], "right")
        rare = np.argsort(b - a, kind="stable")[: sizes[p] - int(needed(sizes[p], least)) + 1]
        seen = np.unique(np.concatenate([owner[a[k] : b[k]] for k in rare]))
        common = np.bincount(np.concatenate([owner[x:y] for x, y in zip(a, b, strict=True)]), minlength=len(sets))[seen]
        return seen[similar(common, sizes[p], sizes[seen], least) & (seen != p)]

    return forest(len(sets), linked)


def _buckets(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole buckets of a partition sorted by its first column, about ``rows`` rows at a time."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) < rows:
            continue
        t = pa.Table.from_batches(kept)
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield t.slice(0, cut)
            kept = t.slice(cut).to_batches()
    if kept and (t := pa.Table.from_batches(kept)).num_rows:
        yield t


def short_links(nodes: DataFrame, least: float) -> DataFrame:
    """All links (u, v) between two sets of which one has at most SHORT members, checked on the whole sets."""
    few = nodes.where(F.size("keys") > 0).select(F.explode("keys").alias("bucket"), "node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches, 1 << 14):
            bucket, node, sets = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            out = [np.empty((0, 2), np.int64)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    out.append(a + linked_sets([np.frombuffer(s, np.uint32) for s in sets[a:b]], least))
            pairs = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, k]]) for k in (0, 1)], ["u", "v"])

    return few.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "u long, v long")


def candidates(
    bucket: np.ndarray, node: np.ndarray, w: np.ndarray, may: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int, tries: int, masks: np.ndarray, before: tuple | None = None
) -> tuple[np.ndarray, ...]:
    """Pairs (p, q, differing bits) to try, by position: each asked row's nearest ``tries`` of other components that may() link, and one more; bits -1: p has more.

    before: component, that of the first round (home), bits and node of what was tried last, from the second round on. A pair counts in the
    first table where it meets only, so it is given once. Rows of the bucket's largest home needn't ask; homes stay, so who asks stays too.
    In a bucket of over BUCKET rows the first round takes a forest of the pairs within ``bits`` and has its rows ask again.

    In the first round all rows ask, so those of p's nearest that met in an earlier table were given there: p's nearest are taken first, then
    what met earlier goes, and a dense group, whose members meet in most tables, gives a few rows per member. Later a row doesn't ask in
    every bucket, so what met earlier goes first and can't hide what met here only.
    """
    found: list[tuple[np.ndarray, ...]] = []
    comp, home, tried, last = before if before else (np.arange(len(w)), None, np.full(len(w), -1), np.zeros(len(w), np.int64))

    def open_pairs(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        d = np.bitwise_count(w[p] ^ w[q]).sum(axis=-1, dtype=np.int64)
        ok = (d <= bits) & (comp[p] != comp[q]) & ((d > tried[p]) | ((d == tried[p]) & (node[q] > last[p])))
        ok[ok] = may(p[ok], q[ok])
        return p[ok], q[ok], d[ok]

    def met_first(p: np.ndarray, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        table = bucket[p] & ((1 << _TABLE_BITS) - 1)
        for k, (word, mask) in enumerate(masks.tolist()):
            if not len(p):
                break
            early = (table > k) & ((w[p, word] ^ w[q, word]) & np.uint64(mask) == 0)
            p, q, d, table = p[~early], q[~early], d[~early], table[~early]
        return p, q, d

    def nearest(p: np.ndarray, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((node[q], d, p))
        p, q, d = p[order], q[order], d[order]
        keep = np.arange(len(p)) - np.searchsorted(p, p, "left") <= tries
        return p[keep], q[keep], d[keep]

    def take(p: np.ndarray, q: np.ndarray, d: np.ndarray) -> None:
        found.append(nearest(*met_first(p, q, d)) if before else met_first(*nearest(p, q, d)))

    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    sizes = np.diff(edges)
    i, small = np.flatnonzero(np.repeat(sizes <= 64, sizes)), []
    for k in range(1, 64):
        i = i[i + k < len(w)]
        i = i[bucket[i + k] == bucket[i]]
        if not len(i):
            break
        small += [open_pairs(i, i + k), open_pairs(i + k, i)]
    if small:
        take(*(np.concatenate(x) for x in zip(*small, strict=True)))
    more = []
    for a, b in zip(edges[:-1][sizes > 64].tolist(), edges[1:][sizes > 64].tolist(), strict=True):
        own = np.arange(a, b)
        if before is None and b - a > BUCKET:
            pairs = forest(b - a, lambda p, a=a, b=b: np.flatnonzero(np.bitwise_count(w[a:b] ^ w[a + p]).sum(axis=-1, dtype=np.int16) <= bits))
            more.append(own)
            p, q = a + pairs[:, 0], a + pairs[:, 1]
            found.append(nearest(q, p, np.bitwise_count(w[p] ^ w[q]).sum(axis=-1, dtype=np.int64)))
            continue
        ask = own
        if before:
            label = np.unique(home[a:b], return_inverse=True)[1]
            ask = own[(tried[a:b] <= bits) & (label != np.bincount(label).argmax())]
        step = max(1, (1 << 19) // (b - a))
        for at in range(0, len(ask), step):
            some = ask[at : at + step]
            near = np.bitwise_count(w[some][:, None] ^ w[a:b][None]).sum(axis=-1, dtype=np.int16)
            p, q = np.nonzero((near <= bits) & (comp[some][:, None] != comp[a:b][None]))
            take(*open_pairs(some[p], q + a))
    p, q, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    again = np.concatenate(more) if more else np.empty(0, np.int64)
    return np.concatenate([p, again]), np.concatenate([q, again]), np.concatenate([d, np.full(len(again), -1)])


def large_buckets(dealt: DataFrame, limit: int) -> DataFrame | None:
    """(bucket, _n) of the buckets of over ``limit`` rows, None if there are none. Only those in cells of over ``limit`` rows are counted one by one."""
    cell = F.shiftrightunsigned("bucket", _TABLE_BITS).bitwiseAND(F.lit(CELLS - 1).cast("long"))
    full = materialize(dealt.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_cell"), "near-cells")
    if full.isEmpty():
        return None
    some = dealt.select("bucket").join(F.broadcast(full), cell == F.col("_cell"), "left_semi")
    sizes = materialize(some.groupBy("bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > limit), "near-large")
    return None if sizes.isEmpty() else sizes


def _try_pairs(nodes: DataFrame, names: list[str], least: float, bits: int, tries: int, bucket: int) -> DataFrame:
    """(p, q, bits) of candidates() over all buckets of nodes, the nearest ``tries`` + 1 of each p."""
    made = sliced_masks(RADIUS, 2)
    tables = [(word, m) for word in range(PRINTS) for m in made]
    carried = ["node", *names, "n", *[c for c in ("comp", "home", "tried", "last", "map") if c in nodes.columns]]
    keyed = F.array(*[F.col(f"w{word}").bitwiseAND(F.lit(m).cast("long")) for word, m in tables])
    dealt = nodes.select(*carried, F.posexplode(keyed).alias("_t", "_key"))
    low = F.lit((1 << _TABLE_BITS) - 1)
    dealt = dealt.select(F.xxhash64("_t", "_key").bitwiseAND(F.bitwise_not(low.cast("long"))).bitwiseOR(F.col("_t").cast("long")).alias("bucket"), *carried)
    if "tried" in carried and nodes.where(F.col("tried") <= bits).limit(FEW + 1).count() <= FEW:
        dealt = dealt.join(F.broadcast(dealt.where(F.col("tried") <= bits).select("bucket").distinct()), "bucket", "left_semi")
    if (sizes := large_buckets(dealt, WHOLE * bucket)) is not None:
        dealt = in_blocks(dealt.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "bucket", "left"), carried, WHOLE * bucket, keep=_TABLE_BITS)
    masks = np.array([(word, m % (1 << 64)) for word, m in tables], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches, 1 << 15):
            col = {c: t.column(c).to_numpy() for c in ("bucket", *carried) if c != "map"}
            w = np.stack([col[n] for n in names], axis=1).view(np.uint64)
            before = (col["comp"], col["home"], col["tried"], col["last"]) if "comp" in col else None
            may = may_link(col["n"].astype(np.int64), least, pa.concat_arrays(t.column("map").chunks) if "map" in carried else None)
            p, q, d = candidates(col["bucket"], col["node"], w, may, bits, tries, masks, before)
            yield pa.RecordBatch.from_arrays([pa.array(col["node"][p]), pa.array(col["node"][q]), pa.array(d.astype(np.int32))], ["p", "q", "bits"])

    found = dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "p long, q long, bits int")
    by_bits = Window.partitionBy("p").orderBy("bits", "q")
    ranked = found.withColumn("rank", F.dense_rank().over(by_bits)).where(F.col("rank") <= tries + 1)
    return materialize(ranked.dropDuplicates(["p", "q"]), "near-pairs")


def sets_of(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(node, set) of the nodes in pairs (u, v). Other rows of the table go before anything is grouped, as sets are most of the data."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return table.select("node", "set").join(keys_to_join(wanted, "near-wanted"), "node", "left_semi").groupBy("node").agg(F.min("set").alias("set"))


def _verified(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose whole sets are at least ``least`` similar."""
    sets = materialize(sets_of(pairs, table), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(bool(similar((y[at] == x).sum(), len(x), len(y), least)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "near-links")
    discard(sets)
    return links


def near_duplicates(docs: DataFrame, least: float = 0.8, words_in_shingle: int = 5, bits: int = BITS, tries: int = TRIES, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id): rows linked by a Jaccard similarity of ``least`` or more of their sets of word shingles.

    Texts are lower-cased (A-Z) and split at space and 0x09-0x0D. Rows of equal sets are one node. Sets have three SimHashes; covering masks of
    each put every pair that differs in at most RADIUS bits of one of them into a common bucket, and most other pairs at the threshold too. Pairs of a bucket
    that differ in at most ``bits`` of all bits are candidates. Each node tries its nearest few; their whole sets are compared, so a link
    is never a guess. Then nodes that have more candidates outside their component so far try the next ones, among themselves, sixteen times as many each
    round, until none are left: a dense group costs a few tries per member, not all its pairs. A candidate isn't tried if the sizes, from the
    second round on also the parity maps, show that it can't be a link; so variants of one text that are alike but not enough cost no comparison either. Sets of up to SHORT shingles meet by prefix shingles and miss nothing.

    Nulls: rows with a null id, and null, empty or blank texts, are left out. Ties: component_id is the smallest doc_id. Repeated rows come
    out as often as they go in, very long texts are read whole, empty tables give no rows, other columns are ignored.
    """
    spoken = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    table = materialize(set_table(spoken.select("doc_id", "text"), words_in_shingle, least), "near-sets")
    names = [f"w{k}" for k in range(PRINTS)]
    nodes = materialize(table.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.min(c).alias(c) for c in ("n", *names, "map")]), "near-nodes")
    lone = table.where(F.size("keys") > 0).groupBy("node").agg(F.min("set").alias("set"), F.first("keys").alias("keys"))
    edges = materialize(short_links(lone, least), "near-links")
    asked = nodes.where(F.col("n") > SHORT).select("node", *names, "n")
    universe = roots = body = None
    while True:
        pairs = _try_pairs(asked, names, least, bits, tries, bucket)
        new = pairs.where("bits >= 0").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
        found = _verified(new, table, least)
        if roots is None or not found.isEmpty():  # from the second round on, the components so far as stars and what links them
            roots = connected_components(edges.unionByName(found))
            edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        at = F.max(F.when(F.col("bits") >= 0, F.struct("bits", "q")))
        told = pairs.groupBy("p").agg(F.min("bits").alias("_least"), F.max("rank").alias("_rank"), at.alias("_at"))
        if told.where(f"_least < 0 OR _rank > {tries}").isEmpty():
            break
        if universe is None:
            none_yet = [F.lit(-1).alias("tried"), F.lit(0).cast("long").alias("last")]
            old = nodes.select("node", *none_yet).join(roots, "node", "left").select("node", "tried", "last", F.coalesce("root", "node").alias("home"))
        else:
            old = universe
        # who has more to try goes on behind the last one tried, or from where it was; who has not is done
        state = (
            (told.join(old, F.col("p") == F.col("node")) if universe is None else old.join(told, F.col("p") == F.col("node"), "left"))
            .select(
                "node",
                "home",
                F.when(F.col("_least") < 0, F.col("tried")).when(F.col("_rank") > tries, F.col("_at.bits")).otherwise(F.lit(1 << 20)).alias("tried"),
                F.when((F.col("_least") >= 0) & (F.col("_rank") > tries), F.col("_at.q")).otherwise(F.col("last")).alias("last"),
            )
        )
        if universe is None:  # who has no more to try has tried all its pairs, so nobody needs to meet it again
            state = state.where(F.col("tried") <= bits)
        universe = materialize(state, "near-state")
        if body is None:
            body = materialize(nodes.select("node", *names, "n", "map").join(keys_to_join(universe.select("node"), "near-open"), "node", "left_semi"), "near-body")
        labels = universe.join(roots, "node", "left").select("node", "home", "tried", "last", F.coalesce("root", "node").alias("comp"))
        asked = materialize(labels.join(body, "node"), "near-asked")
        tries *= 16
    rooted = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "near-smallest")
    of_node = rooted.join(smallest, "root").select("node", "component_id")
    components = materialize(table.select("doc_id", "node").join(of_node, "node").select("doc_id", "component_id"), "near-components")
    discard(table)
    return components
