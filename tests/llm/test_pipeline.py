"""run() as a whole: each stage's decisions against a brute-force version on the rows it was given."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from chunklake.session import table
from helpers import corpus, odd_rows

SF = "/root/testdata/sf0.01"


def shingles(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1))} if found else set()


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(found):
    return {tuple(found[i : i + 10]) for i in range(max(len(found) - 9, 1))} if found else set()


def run_recorded(spark, monkeypatch, sf_dir):
    """run()'s rows and, per stage, the rows it was given and those it returned, as written."""
    given, stages = {}, corpus_pipeline.STAGES

    def recorded(name, stage):
        def run(spark, docs, sf_dir):
            given[name] = docs.select("doc_id", "text", "source").collect()
            assert docs.columns == corpus_pipeline.COLUMNS
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, recorded(n, s)) for n, s in stages])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    names = [n for n, _ in stages]
    return out, {n: (given[n], given[m]) for n, m in zip(names, names[1:], strict=False)} | {"sharding": (given["sharding"], out)}


def test_run_against_brute_force(spark, monkeypatch):
    out, steps = run_recorded(spark, monkeypatch, SF)

    before, after = steps["quality"]
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    good = {d for d, r in labels.items() if r.quality == 1 and r.toxic == 0} & {r.doc_id for r in before}
    assert len(before) == 1000 and kept <= {r.doc_id for r in before}
    assert len(good & kept) >= 0.98 * len(good)
    bad = {d for d, r in labels.items() if r.quality == 0 or r.toxic == 1}
    assert len(bad & kept) <= 0.02 * len(bad)

    before, after = steps["near_dedup"]
    sets, kept = {r.doc_id: shingles(r.text) for r in before}, {r.doc_id for r in after}
    holders = defaultdict(list)
    for d, s in sorted(sets.items()):
        for g in s:
            holders[g].append(d)
    shared = Counter((a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    near = [p for p, j in alike.items() if j >= 0.8]
    assert near and sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)
    assert not any(a in kept and b in kept for (a, b), j in alike.items() if j >= 0.95)
    closest = defaultdict(float)
    for p, j in alike.items():
        for d in p:
            closest[d] = max(closest[d], j)
    assert all(closest[d] >= 0.6 for d in set(sets) - kept)
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert all(first[r.text] == r.doc_id for r in after)

    before, after = steps["decontamination"]
    items = [tokens(r.text) for r in table(spark, SF, "benchmark").collect()]
    banned = set().union(*(windows(i) for i in items))
    sizes = {len(w) for w in banned}
    hit = {r.doc_id for r in before if any(tuple(t[i : i + n]) in banned for t in [tokens(r.text)] for n in sizes for i in range(len(t) - n + 1))}
    assert hit and {r.doc_id for r in after} == {r.doc_id for r in before} - hit

    before, after = steps["mixing"]
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
    have, took = Counter(), Counter()
    for r in before:
        have[r.source] += words[r.doc_id]
    for r in after:
        took[r.source] += words[r.doc_id]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(sorted(have))}
    target, free, left = {}, set(have), 1.5 * sum(have.values())
    while free:
        asked = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if asked[s] > 2 * have[s]}
        if not over:
            target |= asked
            break
        target |= {s: 2.0 * have[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    largest = defaultdict(int)
    for r in before:
        largest[r.source] = max(largest[r.source], words[r.doc_id])
    assert all(abs(took[s] - target[s]) <= max(0.02 * target[s], largest[s]) for s in have)
    assert max(Counter(r.doc_id for r in after).values()) <= 2

    before, after = steps["sharding"]
    want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in before)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in after) == want
    filled, slots = Counter(), defaultdict(list)
    for r in after:
        filled[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    even = sum(filled.values()) / 16
    assert sorted(filled) == list(range(16)) and all(abs(x - even) <= 0.1 * even for x in filled.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("rows", [[], odd_rows()])
def test_run_of_odd_tables(spark, tmp_path, monkeypatch, rows):
    """No rows, or nulls, blanks, repeated rows and clashing columns, with no labels and no benchmark."""
    folder = f"file://{tmp_path}"
    corpus(spark, rows).selectExpr("*", "1 AS component_id", "2 AS shard").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in rows}
    assert bool(out) == bool(rows)


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    """Exact rows of the stages that look rows up, though ids are null or stand for several texts."""
    say = lambda word, n: " ".join(f"{word}{i}" for i in range(n))
    leak = say("leak", 12)
    rows = [(None, say("a", 30)), (None, say("a", 30)), (3, say("a", 30)), (None, say("b", 30)), (None, say("b", 30)), (7, say("c", 30)), (7, say("c", 30))]
    rows += [(7, say("d", 30)), (None, f"{leak} {say('e', 30)}"), (7, f"{leak} {say('f', 30)}"), (None, None), (None, None), (8, ""), (8, "")]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([("x", leak)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")

    def stage(run, rows, name):
        corpus(spark, rows).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        return Counter((r.doc_id, r.text) for r in run(spark, table(spark, folder, name), folder).collect())

    copies = {(None, say("a", 30)): 2, (None, say("b", 30)): 1, (7, say("c", 30)): 1}
    assert stage(corpus_pipeline.keep_one_of_copies, rows, "near") == Counter(rows) - Counter(copies)
    assert stage(corpus_pipeline.keep_uncontaminated, rows, "leaks") == Counter(r for r in rows if leak not in (r[1] or ""))
    mixed = [(d, say("m", 40), s) for s in "abc" for d in [None] * 20 + [7] * 20]
    took = stage(corpus_pipeline.take_mixture, mixed, "mix")
    assert set(took) == {(None, say("m", 40)), (7, say("m", 40))} and abs(sum(took.values()) - 180) <= 3
    assert max(took.values()) <= 2 * 60
