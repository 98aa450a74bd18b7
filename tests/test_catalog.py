"""Operators on small fixtures: replay, chunking, codecs, integrity, trees, stores, streams."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunklake.functions import codecs
from chunklake.functions import scalars as fn
from chunklake.functions.chunking import chunk_files, cut_points, gear_table
from chunklake.operators import catalog, integrity, overlay
from chunklake.sources.store import ArchiveStore
from chunklake.sources.tree import dirs_of, scan_tree, write_tree
from chunklake.streaming.uploads import reassemble

LOG = "seq long, op string, path string, dst string, size long, mtime long, mode long"


def fold(records):
    live = {}
    for seq, op, path, dst, size, _, _ in sorted(records):
        if op == "put":
            live[path] = size
        elif op == "rm":
            live.pop(path, None)
        elif op == "mv" and path in live:
            live[dst] = live.pop(path)
    return live


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_is_the_fold(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice("abcdefghijkl")
    log = [(s, rng.choice(["put", "put", "rm", "mv", "note"]), name(), name() + rng.choice(["", "2"]), s, 0, 0) for s in range(80)]
    got = {r.path: r["size"] for r in overlay.replay(spark.createDataFrame(log + log[:5], LOG)).collect()}
    assert got == fold(log)


def serial_cuts(data, least, avg, most):
    bits, gear, ends, fp, start = (avg - 1).bit_length() - 1, gear_table().tolist(), [], 0, 0
    for i, b in enumerate(data):
        fp = ((fp << 1) + gear[b]) % (1 << 64)
        n = i + 1 - start
        if n >= most or (n >= least and fp % (1 << bits) == 0):
            ends.append(i + 1)
            fp, start = 0, i + 1
    return [*ends, len(data)] if start < len(data) else ends


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 6000), st.integers(0, 5))
def test_chunks_cut_like_a_serial_scan(n, kind):
    data = np.random.default_rng(n).integers(0, 256 if kind else 1, n, dtype=np.uint8).tobytes()
    ends = cut_points(data, 64, 256, 1024)
    assert ends == serial_cuts(data, 64, 256, 1024)
    sizes = np.diff([0, *ends])
    assert all(64 <= s <= 1024 for s in sizes[:-1]) and (not n or ends[-1] == n)


def test_pack_read_verify_and_find_damage(spark):
    rng = np.random.default_rng(1)
    big = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    files = [("a", big), ("a/b", big), ("ab", b"x" * 3000), ("empty", b"")]
    df = spark.createDataFrame(files, "path string, content binary")
    refs, chunks, payload = catalog.pack(chunk_files(df, 64, 256, 1024), codecs.encode(F.col("content")))
    mapped = catalog.chunk_map(refs, chunks).join(chunks.select("id"), "id")
    for start, length in [(0, 0), (100, 700), (4999, 10), (5000, 5), (2999, 0)]:
        want = {p: c[start : start + length if length else None] for p, c in files if len(c) > start}
        got = catalog.read_range(mapped, payload, start, length).collect()
        assert {r.path: bytes(r.content) for r in got} == want
    assert integrity.corrupt_chunks(chunks, payload).count() == integrity.dangling_refs(refs, chunks).count() == 0
    sizes = df.select("path", F.octet_length("content").alias("u_size"))
    assert integrity.size_mismatches(sizes, refs).count() == 0
    totals = chunks.agg(F.sum("u_size").alias("total_u"), F.sum("c_size").alias("total_c"))
    tail = totals.crossJoin(integrity.ordered_digest(chunks.select("id", F.lower(F.hex("hash")).alias("h")), "id", "h"))
    assert integrity.verify(chunks, payload, tail).first().ok
    damaged = payload.withColumn("bytes", F.when(F.col("codec") == 0, F.concat(F.col("bytes"), F.lit(b"!"))).otherwise(F.col("bytes")))
    assert integrity.corrupt_chunks(chunks, damaged).count() > 0 and not integrity.verify(chunks, damaged, tail).first().ok
    s = catalog.stats(sizes, refs, chunks).first()
    assert s.files == 4 and s.logical_bytes == 13000 and s.unique_chunks == chunks.count() and s.stored_bytes < 13000
    assert catalog.stats(sizes.limit(0), refs.limit(0), chunks.limit(0)).first().compression_ratio == 1.0
    laid = chunks.orderBy("id").collect()
    assert [r.data_off for r in laid] == [sum(x.c_size for x in laid[:k]) for k in range(len(laid))]


def test_encryption_round_trip(spark):
    key = codecs.derive_key("hunter2", b"s" * 32)
    df = spark.createDataFrame([(b"secret",)], "c binary").withColumn("s", codecs.seal(F.col("c"), F.lit(key), "chunk"))
    other = codecs.derive_key("hunter3", b"s" * 32)
    r = df.select(codecs.unseal(F.col("s"), F.lit(key), "chunk").alias("a"), codecs.unseal(F.col("s"), F.lit(other), "chunk").alias("b"), codecs.unseal(F.col("s"), F.lit(key), "manifest").alias("c")).first()
    assert bytes(r.a) == b"secret" and r.b is None and r.c is None


def test_scalars(spark):
    df = spark.createDataFrame([("foo/bar.txt",), ("/etc/passwd",), ("../secret",), ("foo/../../etc",), ("..",), ("a/./b",), ("./a",), ("",), ("a\\b.PNG",)], "p string")
    got = {r.p: r for r in df.select("p", fn.is_safe_to_extract(F.col("p")).alias("x"), fn.is_safe_upload(F.col("p")).alias("u"), fn.basename(F.col("p")).alias("b"), fn.type_class(F.col("p")).alias("t")).collect()}
    assert [p for p, r in got.items() if r.x] == ["foo/bar.txt", "a/./b", "./a", "", "a\\b.PNG"]
    assert [p for p, r in got.items() if r.u] == ["foo/bar.txt", "a/./b", "a\\b.PNG"]
    assert got["a\\b.PNG"].b == "b.PNG" and got["a\\b.PNG"].t == "images"
    sizes = spark.createDataFrame([("10",), ("4kb",), ("1.5 MB",), ("2G",), ("x",)], "s string").select(fn.parse_size(F.col("s")).alias("n")).collect()
    assert [r.n for r in sizes] == [10, 4096, 1572864, 2 << 30, None]
    keys = spark.createDataFrame([("42" * 32,), ("42",), ("zz" * 32,)], "k string").select(fn.parse_key(F.col("k")).alias("k")).collect()
    assert [r.k is not None for r in keys] == [True, False, False]


def test_tree_round_trip(spark, tmp_path):
    root = tmp_path / "in"
    os.makedirs(root / "sub/deep")
    (root / "hello.txt").write_bytes(b"hello world\n")
    (root / "sub/deep/data.bin").write_bytes(b"\xff" * 4096)
    (root / "sub/empty.txt").write_bytes(b"")
    files = scan_tree(spark, str(root))
    assert {r.path: r.u_size for r in files.collect()} == {"hello.txt": 12, "sub/deep/data.bin": 4096, "sub/empty.txt": 0}
    assert {r.path for r in dirs_of(files).collect()} == {"sub", "sub/deep"}
    bad = spark.createDataFrame([("../evil", b"x")], "path string, content binary")
    out = write_tree(files.select("path", "content").unionByName(bad), str(tmp_path / "out")).collect()
    assert {r.path for r in out if r.written is None} == {"../evil"}
    assert (tmp_path / "out/sub/deep/data.bin").read_bytes() == b"\xff" * 4096 and not (tmp_path / "evil").exists()


def test_store(spark, tmp_path):
    store = ArchiveStore(spark, str(tmp_path))
    for tenant, archive in [("t1", "a"), ("t1", "b"), ("t2", "c")]:
        store.write("files", spark.createDataFrame([(f"{archive}.txt", 1)], "path string, u_size long"), tenant, archive)
    store.write("files", spark.createDataFrame([("a2.txt", 2)], "path string, u_size long"), "t1", "a")
    assert {r.path for r in store.read("files", "t1").collect()} == {"a2.txt", "b.txt"}
    store.append_journal(spark.createDataFrame([(1, "put", "x")], "seq long, op string, path string"))
    (tmp_path / "journal/torn.json").write_text('{"seq": 2, "op"')
    good, bad = store.journal("seq long, op string, path string")
    assert good.count() == 1 and bad.count() == 1
    os.makedirs(tmp_path / "labels")
    (tmp_path / "labels/a.json").write_text('{"label": "Mine", "updated_at": 5}')
    (tmp_path / "labels/b.json").write_text("torn")
    assert {(r.archive_id, r.label) for r in store.labels().collect()} == {("a", "Mine"), ("b", None)}


def frames():
    out = []
    for s in ("s1", "s2"):
        kinds = [("header", None, None), ("file", f"{s}/a", None), ("data", None, b"1"), ("data", None, b"2"), ("file", f"{s}/b", None), ("finalize", None, None)]
        out += [(s, k, kind, p, d) for k, (kind, p, d) in enumerate(kinds)]
    return out


def test_streamed_uploads_out_of_order(spark, tmp_path):
    schema = "stream_id string, seq long, kind string, path string, data binary"
    rows = frames()
    want = {("s1", "s1/a", b"12"), ("s1", "s1/b", b""), ("s2", "s2/a", b"12"), ("s2", "s2/b", b"")}
    batch = reassemble(spark.createDataFrame(rows + rows[:3], schema)).collect()
    assert {(r.stream_id, r.path, bytes(r.content)) for r in batch} == want
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    src = str(tmp_path / "frames")
    for part in (shuffled[:5] + shuffled[:2], shuffled[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = reassemble(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("uploads").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.stream_id, r.path, bytes(r.content)) for r in spark.table("uploads").collect()} == want


def test_live_content_follows_puts_renames_and_the_base(spark):
    base = spark.createDataFrame([("a", 4, 1, 0), ("b", 2, 1, 0), ("gone", 2, 1, 0)], "path string, u_size long, mtime long, mode long")
    first = spark.createDataFrame([(-1, "a", 0, b"ol"), (-1, "a", 1, b"da"), (-1, "b", 0, b"xx"), (-1, "gone", 0, b"zz")], "seq long, path string, ordinal long, bytes binary")
    stored = first.withColumns({"hash": codecs.content_hash(F.col("bytes")), "codec": F.lit(0)})
    new = spark.createDataFrame([("b", 0, b"ne", 5, 0), ("b", 1, b"ol", 5, 0), ("c", 0, b"", 5, 0)], "path string, ordinal long, content binary, mtime long, mode long")
    records, refs, fresh = overlay.put(new, stored.select("hash"), 10)
    assert sorted((r.seq, r.path, r["size"]) for r in records.collect()) == [(10, "b", 4), (11, "c", 0)]
    assert sorted(bytes(r.bytes) for r in fresh.collect()) == [b"", b"ne"]
    moves = spark.createDataFrame([(1, "mv", "a", "moved"), (2, "rm", "gone", None), (20, "mv", "c", "a")], "seq long, op string, path string, dst string")
    live = overlay.replay(overlay.with_base(base, records.unionByName(moves, allowMissingColumns=True)))
    payload = stored.select("hash", "codec", "bytes").unionByName(fresh)
    every = stored.select("seq", "path", "ordinal", "hash").unionByName(refs.select("seq", "path", "ordinal", "hash"))
    got: dict[str, bytes] = {}
    for r in sorted(overlay.read_live(live, every, payload).collect()):
        got[r.path] = got.get(r.path, b"") + bytes(r.part)
    assert got == {"moved": b"olda", "b": b"neol", "a": b""}


def test_format_bytes_rounds_halves_to_even(spark):
    rows = [(288000, "281.2 KB"), (288256, "281.5 KB"), (672000, "656.2 KB"), (288 << 20, "288.0 MB"), (5 << 18, "1.2 MB"), (7 << 18, "1.8 MB"), (1047552, "1023.0 KB"), (1048575, "1024.0 KB")]
    rows += [(9 << 27, "1.12 GB"), (11 << 27, "1.38 GB"), (1023, "1023 B"), (1024, "1.0 KB"), (round(4194304.005 * 2**30), "4194304.00 GB"), ((1 << 63) - 1, "8589934592.00 GB"), (None, None)]
    got = spark.createDataFrame(rows, "n long, want string").select("n", fn.format_bytes(F.col("n")).alias("got"), "want")
    assert [r for r in got.collect() if r.got != r.want] == []


def test_times_of_null_are_null(spark):
    t = F.lit(None).cast("long")
    assert spark.range(1).select(fn.time_ago(t, 1000).alias("a"), fn.iso_date(t).alias("b")).first() == (None, None)
