"""op5, op6, op7, op10 against brute force or held-out labels."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import corpus, odd_rows
from pyspark.sql import functions as F

from chunklake.llm import classifier, repeats
from chunklake.llm.classifier import score, train
from chunklake.llm.cuts import cut_spans
from chunklake.llm.decontaminate import contamination, hit_words
from chunklake.llm.lines import repeated_units


def brute_repeats(rows, n):
    seen = Counter()
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    for _, b in raw:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeat_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, rows = say(40), []
    for i in range(40):
        kind = i % 5
        text = say(rng.randint(1, 80))
        if kind == 1:
            text = text + passage + say(20)
        if kind == 2:
            text = passage[rng.randint(0, 30) :] + text
        if kind == 3:
            text = text[:60] * 3
        if kind == 4 and rows:
            old = rng.choice(rows)[1].split()
            old.insert(rng.randint(0, len(old)), word())
            text = " ".join(old)
        rows.append((i, text))
    return [*rows, (90, rows[3][1]), (91, "z" * 300), (92, "ab" * 150), (93, None), (94, ""), (95, "short"), (90, rows[3][1]), (96, rows[7][1]), (96, rows[8][1])]


@pytest.mark.parametrize(("seed", "cell", "batch"), [(1, 100_000, 20_000), (2, 100_000, 50), (3, 4, 20), (4, 1, 20)])
def test_repeated_bytes(spark, seed, cell, batch):
    rows = repeat_rows(seed)
    docs = corpus(spark, rows)
    spans = repeats.repeated_spans(docs, 60, 20, cell, batch, report=35).withColumn("mark", F.col("size") < 60)
    got = cut_spans(docs.withColumn("tag", F.hash("text")), spans, ["doc_id", "tag"], "mark").collect()
    want = brute_repeats(rows, 60)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sorted((r.doc_id, r.n_bytes, r.n_marked) for r in got) == sorted(r[:3] for r in brute_repeats(rows, 35)) != sorted(r[:3] for r in want)


def test_repeated_bytes_of_odd_rows(spark):
    got = repeats.remove_repeats(corpus(spark, odd_rows()).withColumnRenamed("lang", "tag"), 400).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(odd_rows(), 400)
    assert repeats.remove_repeats(corpus(spark, [])).collect() == []


def brute_hits(rows, items, n=10):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for name, t in items:
        w = words(t)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[s : s + n])].add("" if name is None else str(name))
    out = []
    for d, t, *_ in rows:
        w, hit, names = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if (own := wins.get(tuple(w[s : s + k]))) is not None:
                    hit.update(range(s, s + k))
                    names |= own
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 25, 1000])
def test_contamination(spark, block_bytes):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(30)] + ["é", "文字"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(0, 25)))) for k in range(30)] + [(40, "one two"), (41, None), (42, "..."), (None, "null's own item text"), (43, "one two"), (44, "rare")]
    rows = list(odd_rows())
    for i in range(60):
        own = rng.choice([t for _, t in items if t])
        text = " ".join(say(rng.randint(0, 30))) + rng.choice([" ", "-", "\n"]) + (own.upper() if i % 2 else own) + ", " + " ".join(say(5))
        rows.append((100 + i, text))
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = contamination(corpus(spark, rows), bench, 10, block_bytes).select("doc_id", "n_words", hit_words("runs").alias("n"), "items").collect()
    assert sorted(((r.doc_id, r.n_words, r.n, r["items"]) for r in got), key=str) == brute_hits(rows, items)
    assert contamination(corpus(spark, []), bench).collect() == []
    clean = contamination(corpus(spark, rows), bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.runs for r in clean)


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    grade = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END"
    rated = labels.selectExpr("doc_id", f"{grade} AS grade")
    model = train(docs, rated.where("doc_id % 4 <> 0"))
    assert list(model.grades) == [0, 1, 2] and model.thresholds[0] <= model.thresholds[1]
    test = score(docs, model, 2).join(rated.where("doc_id % 4 = 0"), "doc_id").select("grade", "p_select", "expected_grade").collect()
    right = sum((r.p_select >= 0.5) == (r.grade == 2) for r in test) / len(test)
    assert right > 0.9 and all(0 <= r.expected_grade <= 2 for r in test)


def test_classifier_of_odd_rows(spark):
    docs = corpus(spark, odd_rows()).withColumnRenamed("lang", "p_select")
    none = train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert [r.p_select for r in score(docs, none, 2).collect()] == [1.0] * len(odd_rows())
    model = train(docs, spark.createDataFrame([(4, 0), (6, 2), (None, 1), (7, None)], "doc_id long, grade int"), fit_rows=5)
    got = score(docs, model, 2).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.p_select <= 1 for r in got)
    assert score(corpus(spark, []), model, 2).collect() == []


def test_classifier_fit_is_bounded_by_rows_and_features(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(classifier, "fit", lambda x, y: taken.append((len(y), len(x[0]))))
    many = [(k % 3, f"text number {k} of an id that many rows share", "en", "web", 1) for k in range(60)]
    docs = corpus(spark, [*many, *many[:20], (2, "word " * 200_000 + "end", "en", "web", 1)])
    ratings = spark.createDataFrame([(0, 0), (1, 1), (1, 2), (2, 2)], "doc_id long, grade int")
    for bounds in ({}, {"fit_rows": 10}, {"fit_features": 300}, {"fit_features": 1}):
        train(docs, ratings, **bounds)
    assert [n for n, _ in taken[:2]] == [61, 10]
    assert 1 < taken[2][0] < 61 and taken[2][1] <= 300 and taken[3][0] == 1


def test_lines_keep_the_first_and_leave_short_ones(spark):
    long = "this line has more than ten words in it, does it not, my friend"
    rows = [
        (1, f"Intro here.\n{long}\nshort one"),
        (2, f"Other text. {long.upper()}\r\nshort one\nunique tail"),
        (3, None),
        (4, ""),
        (5, f"A first. A second sentence of the passage is here. Third of it is rather long too. Own end."),
        (6, f"Own start! A second sentence of the passage is here. Third of it is rather long too. Other."),
        (7, "...\n\n---"),
        (8, "short one"),
    ]
    got = repeated_units(corpus(spark, rows).withColumnRenamed("source", "unit")).collect()
    cut = defaultdict(list)
    text = dict(rows)
    for r in got:
        cut[r.doc_id].append(text[r.doc_id].encode()[r.start : r.end].decode().strip())
        first = text[r.first_doc_id].encode()[r.first_start :].decode().lower()
        assert first.startswith(cut[r.doc_id][-1].lower())
    want = {2: [long.upper(), "short one"], 6: ["A second sentence of the passage is here.", "Third of it is rather long too."]}
    assert {k: sorted(v) for k, v in cut.items()} == {k: sorted(v) for k, v in want.items()}
    assert repeated_units(corpus(spark, [])).collect() == []
    left = {r.doc_id: r.text for r in cut_spans(corpus(spark, rows), repeated_units(corpus(spark, rows))).collect()}
    assert left[2] == "Other text. \nunique tail" and left[1] == text[1] and left[3] == ""


def test_sentences_end_behind_signs_and_at_stops_of_other_scripts(spark):
    said = "Ten words or more are in this one sentence of theirs"
    rows = [(1, f"Own one. {said}. Tail a"), (2, f"*Own two.* {said}.** Tail b"), (3, f'"Own three." ({said}!) Tail c'), (4, f"“Own four.” «{said}?» Tail d")]
    rows += [(5, f"自己的开头。{said}！」尾巴"), (6, f"另一个开头？{said}。别的"), (7, 'A row that ends in a stop.'), (8, f'" {said}')]
    text = dict(rows)
    got = {r.doc_id: text[r.doc_id].encode()[r.start : r.end].decode() for r in repeated_units(corpus(spark, rows)).collect()}
    assert set(got) == {2, 3, 4, 5, 6, 8} and all(said in x and len(x) < len(said) + 6 for x in got.values())


def test_whole_lines_go_at_any_number_of_words(spark):
    license, thai, both = "Released under the MIT license.", "ภาษาไทยไม่มีช่องว่างระหว่างคำในประโยค", "Up to date. See below."
    rows = [(d, f"own {d}\n{license}\n{thai}\nIn a line of {d}: yes. See below. Really {d}\n\n{both}") for d in (1, 2, 3)]
    rows += [(4, f"{license} And more of its own"), (5, license), (6, "你们好我们在这里等着你们的到来\n六")]
    rows += [(7, "七\n你们好我们在这里等着你们的到来")]
    text = dict(rows)
    got = sorted((r.doc_id, text[r.doc_id].encode()[r.start : r.end].decode().strip()) for r in repeated_units(corpus(spark, rows)).collect())
    assert got == sorted([(d, x) for d in (2, 3) for x in (license, thai, "Up to date.", "See below.")] + [(5, license), (7, text[7][2:])])


def test_lines_of_rows_without_an_id(spark):
    line = "a first line of many words that every one of these texts begins with\n"
    rows = [(None, line + "own"), (None, line + "other"), (2, line + "two"), (3, line + "three"), (4, "four\n" + line)]
    got = repeated_units(corpus(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.start) for r in got) == [(0, 0), (0, 0), (3, 0), (4, 5)] and {r.first_doc_id for r in got} == {2}
    assert [r.first_doc_id for r in repeated_units(corpus(spark, rows[:2])).collect()] == [None]


def test_lines_within_a_document_and_over_repeated_rows(spark):
    line = "a line of many words that is said again and again by one author\n"
    got = repeated_units(corpus(spark, [(1, line * 3), *odd_rows()])).where("doc_id = 1").collect()
    assert sorted(r.start for r in got) == [len(line), 2 * len(line)] and {r.first_start for r in got} == {0}
