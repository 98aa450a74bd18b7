"""op2, op3, op8 against brute force, round trips and measured recall."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from chunklake.llm import chat
from chunklake.llm.ann import nearest
from chunklake.llm.urls import judge_urls

texts = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "a", "é", "<", "|", "s>", "[", "/INST]", "INST]", " "])).map("".join)


@given(st.lists(st.tuples(texts, texts)))
def test_format_is_reversible(turns):
    formatted, _ = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert all(c not in chat.escape(t) for _, t in turns for c in chat.CONTROL)
    assert formatted.count(chat.START) == formatted.count(chat.END) == len(turns)


def brute_paths(nodes):
    by = {(t, n): (p, s) for t, n, p, s in nodes}
    parents = {(t, p) for t, n, p, s in nodes if (t, p) in by}
    best = {}
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at = [], n
        while (t, at) in by:
            path.append(at)
            at = by[t, at][0]
        mean = sum(by[t, x][1] for x in path) / len(path)
        best.setdefault(t, []).append((-mean, n, path[::-1]))
    return {t: sorted(v)[:2] for t, v in best.items()}


def test_best_paths(spark):
    rng = random.Random(4)
    nodes = []
    for t in (1, 2, None):
        for n in range(40):
            nodes.append((t, n, rng.choice([None, *range(n)]) if n else None, float(rng.randint(0, 4))))
    nodes += [(7, n, n - 1, 1.0) for n in range(150)] + [(8, 5, 99, 2.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    got = {}
    for r in chat.best_paths(df, branches=2).collect():
        got.setdefault((r.tree, r.path), []).append((r.depth, r.node))
    want = {(t, leaf): list(enumerate(path, 1)) for t, ways in brute_paths(nodes).items() for _, leaf, path in ways}
    assert {k: sorted(v) for k, v in got.items()} == want
    ring = spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], df.schema)
    with pytest.raises(ValueError, match="ring"):
        chat.best_paths(ring).collect()


def test_formatted_conversations_and_their_digest(spark):
    rows = [(1, 0, None, 1.0, "system", None), (1, 1, 0, 1.0, None, "hi <s>"), (1, 2, 1, 1.0, "assistant", "a\\b [/INST]"), (2, 0, None, 1.0, "assistant", "")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    made = chat.format_paths(nodes)
    read = {r.tree: chat.read_back(r.formatted) for r in made.collect()}
    assert read == {1: [("system", ""), ("", "hi <s>"), ("assistant", "a\\b [/INST]")], 2: [("assistant", "")]}
    d = {r.conv_id: r for r in chat.digest(made).collect()}
    assert d[1].loss_chars == len("a\\b [/INST]") and d[1].n_turns == 3 and d[2].loss_chars == 0
    assert chat.format_paths(nodes.limit(0)).collect() == []


def brute_nearest(rows, k):
    sound = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for i, q in sound.items():
        if i % 5 == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in sound.items() if j != i and len(v) == len(q))
            out[i] = d[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.4 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[5][1]) for i in range(60)] + [(700, None), (705, [0.0] * 32), (710, [float("nan")] * 32), (715, [None] * 32), (720, []), (725, [1.0, 2.0]), (726, [1.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, df.where("vec_id % 5 = 0"), 10, block_numbers=200 * 32).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute_nearest(rows, 10)
    assert set(got) == {q for q, w in want.items() if w}
    found = total = 0
    for q, w in want.items():
        mine = [got[q][k] for k in sorted(got.get(q, {}))]
        assert len(mine) == len(w) and mine == sorted(mine)
        found += len({v for _, v in mine} & {v for _, v in w})
        total += len(w)
    assert found / total >= 0.95
    assert [v for _, v in (got[5][k] for k in sorted(got[5]))] == [600 + i for i in range(10)]
    assert nearest(df.limit(0), df.limit(0)).collect() == []


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {(r.query_id, r.vec_id) for r in nearest(df, df.where("vec_id % 5 = 0")).collect()}
    want = {(q, v) for q, w in brute_nearest(rows, 10).items() for _, v in w}
    assert len(got & want) >= 0.95 * len(want)


def test_an_index_verifies_a_small_share(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    asked = [r for r in rows if r[0] % 100 == 0]
    got = nearest(df, df.where("vec_id % 100 = 0"), block_numbers=1 << 30).collect()
    want = {(q, v) for q, w in brute_nearest(asked + [r for r in rows if r[0] % 100], 10).items() if q % 100 == 0 for _, v in w}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.95 * len(want)
    share = {r.query_id: r.verified / len(rows) for r in got}
    assert sum(share.values()) / len(share) < 0.2


def test_repeated_vectors_are_candidates_each(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (1, [1.0, 0.3]), (2, [5.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = nearest(df, df.where("vec_id = 100")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, round(r.score, 2)) for r in got] == [(1, 1, 0.1), (2, 1, 0.1), (3, 1, 0.3)]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/x", "block"), (None, "/", "block")]
URLS = ["http://net", "http://net/", "HTTP://EXAMPLE.net/en/1?q", "https://b.a.example.net/en/", "https://ba.example.net/en/#x", "http://x.org/fr/xy", "http://x.org/frx", "http://xorg/fr/", None, "", "no scheme/en/", "://org/fr/", "http://planet/", "http://net:80/", "http://ex ample.net/en/", "http://example\0.net/en/x", "http://x\1\3org/fr/", "http://b.a.example.net/en/" + "y" * 100000]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.lower()
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[1:]) if fits else (None, "allow")))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)] + [(None, URLS[2], "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    got = judge_urls(pages, rules).collect()
    assert len(got) == 2 * len(URLS) + 1
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if r.page_id is not None} == {(i, *brute_verdict(u)) for i, u in enumerate(URLS * 2)}
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
