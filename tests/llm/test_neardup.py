"""Near copies against brute force: links at an exact similarity, short texts, dense groups, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, odd_rows

from chunklake import session
from chunklake.llm import neardup, simhash


def shingles(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1))} if found else set()


def brute(rows, least=0.8):
    """Pairs of rows' positions at least ``least`` alike, and every row's component."""
    sets = [shingles(t) for _, t in rows]
    holders, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for own in holders.values():
        shared.update((a, b) for i, a in enumerate(own) for b in own[i + 1 :])
    pairs = [(a, b) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    first = defaultdict(lambda: 10**9)
    for k, (d, _) in enumerate(rows):
        first[find(k)] = min(first[find(k)], d)
    return sorted(pairs), {d: first[find(k)] for k, (d, t) in enumerate(rows) if sets[k]}


def edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("bucket", [simhash.BUCKET])
def test_pairs_at_an_exact_similarity(spark, bucket):
    rng = random.Random(11)
    rows = []
    for k in range(200):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 400, 900]))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, max(1, int(len(words) * rng.choice([0.004, 0.015, 0.02, 0.022, 0.03]))), rng))]
    pairs, _ = brute(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(corpus(spark, rows), bucket=bucket).collect()}
    linked = {d // 2 for d in got if d % 2 and got[d] == got[d - 1]}
    true = {a // 2 for a, _ in pairs}
    assert len(got) == 400 and all(got[d] in (d, d - d % 2) for d in got)
    assert linked <= true and len(true) > 90 and len(linked) >= 0.97 * len(true)


def test_short_texts_miss_nothing(spark):
    rng = random.Random(3)
    rows = []
    for n in range(1, 60):
        for _ in range(6):
            words = [f"w{rng.randrange(40)}" for _ in range(n)]
            rows += [(0, " ".join(words)), (0, " ".join(words[:-1]).upper()), (0, " ".join([*words, "end"])), (0, edited(words, 1, rng))]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    _, want = brute([r for r in rows if len(shingles(r[1])) <= neardup.SHORT])
    got = neardup.near_duplicates(corpus(spark, [r for r in rows if len(shingles(r[1])) <= neardup.SHORT])).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bucket", [1])
def test_candidates_that_fail_dont_hide_later_ones(spark, bucket):
    """Many texts of one template are candidates of each other but too different; true links lie behind them. Four tries in the first round; buckets are compared by blocks."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(k, edited(base, 7, rng)) for k in range(90)]
    rows += [(100 + k, edited(rows[k][1].split(), 5, rng)) for k in range(0, 90, 3)]
    pairs, want = brute(rows)
    assert 30 <= len(pairs) and len(set(want.values())) > 3
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(corpus(spark, rows), tries=4, bucket=bucket).collect()}
    assert sum(got[d] == want[d] for d in want) >= 0.97 * len(want)
    assert all(want[d] == want[got[d]] for d in got)


def test_twenty_thousand_variants_of_one_text(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    docs = spark.range(20000).selectExpr("id AS doc_id", f"concat('{say(300)} own', id, ' {say(300)}') AS text")
    assert {r.component_id for r in neardup.near_duplicates(docs).select("component_id").distinct().collect()} == {0}


def test_odd_rows(spark):
    rows = [*odd_rows(), (None, "one two three four five"), (4, "one two three four five"), (9, "Other text")]
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(corpus(spark, rows).withColumnRenamed("lang", "node")).collect())
    assert got == [(4, 4), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 9)]
    assert neardup.near_duplicates(corpus(spark, [])).collect() == []


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_bounds_rule_out_no_link(spark):
    """Pairs around the threshold, of sizes with maps of different widths: no link is ruled out, clear misses are, also those of equal size."""
    rng = np.random.default_rng(5)
    sets = []
    for n in [41, 60, 64, 66, 120, 128, 130, 500, 1020, 1030, 4090, 5000, 9000]:
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for share in (0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.2, 0.35):
            cut = int(share * n)
            sets += [np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)])), np.unique(base[cut:])]
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    data, at = neardup.parity_maps(np.concatenate(sets), row, n)
    maps = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
    p, q = (x.ravel() for x in np.meshgrid(np.arange(len(n)), np.arange(len(n))))
    real = np.array([jaccard(set(sets[a].tolist()), set(sets[b].tolist())) if abs(a - b) < 16 else 0 for a, b in zip(p.tolist(), q.tolist(), strict=True)])
    for bound in (neardup.may_link(n, 0.8, maps), neardup.may_link(n, 0.8)):
        assert bound(p, q)[real >= 0.8 - 1e-9].all()
    kept = neardup.may_link(n, 0.8, maps)(p, q)
    missed = (real > 0) & (real < 0.65) & (np.maximum(n[p], n[q]) < 4000)
    assert missed.sum() > 50 and kept[missed].mean() < 0.03
    part = slice(16, 48)  # a slice of an Arrow array starts inside its buffers
    a, b = (x.ravel() for x in np.meshgrid(np.arange(32), np.arange(32)))
    assert (neardup.may_link(n[part], 0.8, maps[16:48])(a, b) == neardup.may_link(n, 0.8, maps)(a + 16, b + 16)).all()


def test_variants_that_are_no_links_are_not_compared(spark, monkeypatch):
    """Pairs compared grow with a template's rows, not with their square; what is linked stays as brute force has it."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(k, edited(base, 12, rng)) for k in range(400)]
    rows += [(1000 + k, edited(rows[k][1].split(), 3, rng)) for k in range(0, 400, 4)]
    tried, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *more: tried.append(pairs.count()) or verified(pairs, *more))
    _, want = brute(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(corpus(spark, rows)).collect()}
    assert sum(got[d] == want[d] for d in want) >= 0.97 * len(want) and all(want[d] == want[got[d]] for d in got)
    assert sum(tried) < 5 * len(rows)


def test_dense_groups_give_few_rows_and_the_nearest():
    """First round: members of a dense group meet in most of the 90 tables, yet give a few rows each, with their nearest among them."""
    rng = np.random.default_rng(8)
    made = simhash.sliced_masks(neardup.RADIUS, 2)
    masks = np.array([(word, m % (1 << 64)) for word in range(neardup.PRINTS) for m in made], np.uint64)
    group = np.repeat(np.arange(1 + 40 + 300), [1000, *[20] * 40, *[1] * 300])
    w = rng.integers(0, 1 << 63, (341, 3), dtype=np.uint64)[group]
    for k in range(len(w)):
        for bit in rng.integers(0, 192, rng.integers(0, 9)).tolist():
            w[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    node = np.sort(rng.integers(-(1 << 62), 1 << 62, len(w)))
    keys = np.stack([w[:, int(word)] & mask for word, mask in masks])
    bucket = np.concatenate([(np.unique(k, return_inverse=True)[1] << 7) | t for t, k in enumerate(keys)])
    own = np.tile(np.arange(len(w)), len(masks))
    order = np.lexsort((node[own], bucket))
    bucket, own = bucket[order], own[order]
    p, q, d = neardup.candidates(bucket, node[own], w[own], neardup.may_link(np.full(len(own), 100), 0.8), 48, 3, masks)
    got = [set() for _ in w]
    for a, b, bits in zip(own[p].tolist(), own[q].tolist(), d.tolist(), strict=True):
        got[a].add((bits, int(node[b]), b))
    for a in range(len(w)):
        differ = np.bitwise_count(w ^ w[a]).sum(axis=1)
        met = (keys == keys[:, a][:, None]).any(axis=0) & (differ <= 48)
        met[a] = False
        assert sorted(got[a])[:4] == sorted((int(differ[b]), int(node[b]), b) for b in np.flatnonzero(met).tolist())[:4]
    assert len(p) == sum(len(x) for x in got) < 12 * len(w)


@pytest.mark.parametrize("cells", [1, 16, 1 << 16])
def test_large_buckets_are_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(neardup, "CELLS", cells)
    rng = random.Random(4)
    bucket = [(rng.randrange(-40, 40) ** 3 << 7) | rng.randrange(3) for _ in range(3000)] + [-(1 << 40)] * 50
    dealt = spark.createDataFrame([(b, k) for k, b in enumerate(bucket)], "bucket long, node long")
    sizes = Counter(bucket)
    assert dict(map(tuple, neardup.large_buckets(dealt, 30).collect())) == {b: n for b, n in sizes.items() if n > 30}
    assert neardup.large_buckets(dealt, max(sizes.values())) is None


def test_only_sets_of_pairs_are_grouped(spark, monkeypatch):
    """The sets are most of the data: those that no pair names go before the shuffle, not behind it."""
    plans, write = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label))
    sets = [np.arange(k, k + 100, dtype=np.uint32).tobytes() for k in range(60)]
    table = spark.createDataFrame([(k % 60, bytearray(sets[k % 60])) for k in range(120)], "node long, set binary")
    pairs = spark.createDataFrame([(1, 2), (1, 12), (1, 13), (2, 50)], "u long, v long")
    assert sorted(map(tuple, neardup._verified(pairs, table, 0.8).collect())) == [(1, 2), (1, 12)]
    assert plans[0].index("min(set") < plans[0].index("LeftSemi") and "Join Inner" not in plans[0]


def test_later_rounds_hold_only_who_has_more_to_try(spark, monkeypatch):
    """Pairs of copies are settled in the first round and aren't dealt again beside a dense group that goes on."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, rows = say(300), []
    for k in range(60):
        rows += [(k, edited(base, 10, rng)), (1000 + k, " ".join(own := say(300))), (2000 + k, edited(own, 2, rng))]
    dealt, try_pairs = [], neardup._try_pairs
    monkeypatch.setattr(neardup, "_try_pairs", lambda nodes, *more: dealt.append(nodes.count()) or try_pairs(nodes, *more))
    _, want = brute(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(corpus(spark, rows)).collect()}
    assert sum(got[d] == want[d] for d in want) >= 0.97 * len(want) and all(want[d] == want[got[d]] for d in got)
    assert dealt[0] == 180 and len(dealt) > 1 and max(dealt[1:]) <= 60


def test_keys_are_broadcast_up_to_a_bound(spark, monkeypatch):
    """With Spark's own broadcasts off, a wide table isn't shuffled to drop a few of its rows; beyond the bound it is."""
    monkeypatch.setattr(session, "KEYS", 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n, few in ((0, True), (100, True), (101, False)):
            left = spark.range(1000).join(session.keys_to_join(spark.range(n)), "id", "left_anti")
            assert ("BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()) == few
            assert left.count() == 1000 - n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
