import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
from helpers import corpus, odd_rows

from chunklake.llm import simhash
from chunklake.operators.graph import connected_components
from chunklake.llm.mixing import mix, source_targets
from chunklake.llm.shards import shard_by_bytes


def texts(n, seed, copies=0):
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return out + ["the very same text"] * copies


@pytest.mark.parametrize("copies", [0, 300])
def test_shards_are_near_equal_and_gapless(spark, copies):
    rows = list(enumerate(texts(400, 1, copies)))
    got = shard_by_bytes(corpus(spark, rows), shards=4).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in rows]
    by, text = defaultdict(list), dict(rows)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        by[r.shard].append(r)
    sums = [sum(r.size for r in by[s]) for s in range(4)]
    assert max(sums) - min(sums) < 0.06 * sum(sums) / 4
    for s in range(4):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for t, x in where.items() if copies * 19 <= 0.04 * sum(sums) / 4 or t != "the very same text")


def brute_shards(rows, shards, together):
    # rows: (order, text, size); in the stated order
    total = sum(x[2] for x in rows)
    target, out, at, spans = total / shards, [], 0, {}
    part = lambda m: min(int(m // target), shards - 1)
    for _, t, n in rows:
        out.append(part(at + n / 2))
        spans[t] = (spans.get(t, (at,))[0], at + n)
        at += n
    for k, (_, t, _n) in enumerate(rows):
        a, b = spans[t]
        if b - a <= together * target:
            out[k] = part((a + b) / 2)
    return out


@pytest.mark.parametrize("together", [0.0, 0.04, 0.5])
def test_shards_against_brute_force(spark, together):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(texts(120, 6, 40))] + [(500, "a" * 9000), (501, "b" * 9000), (502, "a" * 9000), (None, "the very same text"), (7, None)]
    rng.shuffle(rows)
    docs = corpus(spark, rows)
    order = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "if(text is null, 0, xxhash64(text)) AS h").collect()}
    ranked = sorted(rows, key=lambda x: (order[x], x[0] is not None, x[0] or 0))
    want = brute_shards([(d, t, len((t or "").encode()) + 1) for d, t in ranked], 5, together)
    got = shard_by_bytes(docs, shards=5, together=together).collect()
    assert sorted((r.doc_id or -1, r.size, r.shard) for r in got) == sorted((d or -1, len((t or "").encode()) + 1, s) for (d, t), s in zip(ranked, want, strict=True))
    assert want == sorted(want)  # contiguous in the stated order
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_two_texts_of_nearly_a_shard_each_stay_balanced(spark):
    rows = [(k, "t%03d" % (k % 90) * 25) for k in range(400)] + [(1000 + k, c * 400) for c in "xy" for k in range(22)]
    got = shard_by_bytes(corpus(spark, rows), shards=6).collect()
    sums = [sum(r.size for r in got if r.shard == s) for s in range(6)]
    assert max(sums) - min(sums) <= 0.04 * sum(sums) / 6 + 2 * 401


def test_shards_of_odd_rows(spark):
    got = shard_by_bytes(corpus(spark, odd_rows()).withColumnRenamed("lang", "shard"), shards=3).collect()
    assert len(got) == len(odd_rows()) and {(r.doc_id, r.size, r.text_crc32) for r in got} >= {(1, 1, 0), (2, 1, 0)}
    assert shard_by_bytes(corpus(spark, []), shards=3).collect() == []


def fill(sizes, weights, share, most):
    budget, active, target = share * sum(sizes.values()), dict(weights), {}
    while active:
        level = budget / sum(active.values())
        full = [s for s in active if active[s] * level > most * sizes[s]]
        if not full:
            return target | {s: w * level for s, w in active.items()}
        for s in full:
            target[s] = most * sizes[s]
            budget -= target[s]
            del active[s]
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 80), rng.choice("aaaaaabcd")) for i in range(900)]
    got = mix(corpus(spark, rows), [3, 1, 2]).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = fill(sizes, dict(zip("abcd", [3, 1, 2, 3], strict=True)), 1.5, 2)
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken in (0, r.size, 2 * r.size)
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) < 40 + 0.01 * want[s]
    again = mix(corpus(spark, rows[::-1]).repartition(7), [3, 1, 2]).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_mix_of_odd_rows(spark):
    got = mix(corpus(spark, odd_rows()).withColumnRenamed("lang", "target"), [3, 1, 2]).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[1].size == by[2].size == by[3].size == 0 and by[4].size == 5 and by[6].size == 30000 and by[7].size == 5
    assert all(r.taken <= 2 * r.size for r in got) and mix(corpus(spark, []), [3, 1, 2]).collect() == []
    assert source_targets(spark.createDataFrame([], "source string, size long"), [1]).collect() == []


def brute_print(text, n=3):
    words = regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[a] = root[b] = min(a, b, key=lambda x: prints[x][0])
    return [prints[find(i)][0] for i in range(len(prints))]


def near_rows():
    rng = random.Random(5)
    base = texts(60, 9)
    rows = [(i, t) for i, t in enumerate(base)]
    long = " ".join(rng.choice(texts(1, 2)[0].split()) + str(rng.randint(0, 99)) for _ in range(900))
    for k in range(40):
        words = long.split()
        words[rng.randrange(900)] = f"edit{k}"
        rows.append((1000 + k, " ".join(words)))
    return [*rows, *[(2000 + i, t) for i, (_, t, _) in enumerate(odd_rows())], (3000, "A  b\tC d\n\nE " + "long" * 100)]


def test_simhash_against_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: r for r in simhash.simhash_components(corpus(spark, rows)).collect()}
    prints = sorted((d, brute_print(t)) for d, t in rows)
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == dict(prints)
    assert [got[d].component_id for d, _ in prints] == brute_components(prints)
    assert len({got[d].component_id for d in got if 1000 <= d < 2000}) < 40
    assert simhash.simhash_components(corpus(spark, [])).collect() == []


@pytest.mark.parametrize("bucket", [40, 1])
def test_links_when_buckets_are_divided(spark, bucket):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62)
    fps = sorted({int(base) ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 7), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    df = spark.createDataFrame([(f,) for f in fps], "w0 long")
    roots = {r.node: r.root for r in connected_components(simhash.near_links(df, 3, bucket)).collect()}
    want = brute_components([(f, f) for f in fps])
    assert [roots.get(f, f) for f in fps] == want


@pytest.mark.parametrize("parts", [1, 2])
def test_sliced_masks_cover_the_radius_at_every_level(parts):
    rng = random.Random(2)
    for level in range(3):
        masks = simhash.sliced_masks(7, parts, level)
        assert all(any(m & sum(1 << b for b in bits) == 0 for m in masks) for bits in (rng.sample(range(64), 7) for _ in range(1000)))


def test_masks_cover_every_small_set_of_positions():
    rng = random.Random(0)
    for level in range(3):
        masks = simhash.covering_masks(3, level)
        for _ in range(2000):
            bits = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & bits == 0 for m in masks)


def test_xxh64_of_all_lengths():
    data = np.random.default_rng(0).integers(0, 256, 400, dtype=np.uint8)
    sizes = np.arange(300)
    starts = np.arange(300) % 100
    got = simhash.xxh64_slices(data, starts, sizes, 42)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, sizes, strict=True)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 300)] + [(7, 7)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 100 for i in range(101, 161)) and all(roots[500 + i] == 500 for i in range(1, 300))
