"""The overlay: an append-only journal over an immutable base snapshot, replayed into the live files.

journal(seq, op, path, dst, mode, mtime, size, chunks, note), op one of put, rm, mv, note, policy. seq orders a journal;
a put over a live path replaces it, rm of a missing path does nothing, mv of a missing path does nothing and otherwise
replaces its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.functions.codecs import content_hash, decode
from chunklake.functions.scalars import in_subtree
from chunklake.operators.graph import connected_components
from chunklake.operators.prefix import prefix_sums
from chunklake.session import materialize

LIVE = "path string, size long, mtime long, mode long, born_seq long, born_path string"


def with_base(base: DataFrame, journal: DataFrame) -> DataFrame:
    """The base snapshot's files as puts before all others (seq below 0)."""
    cols = ["seq", "op", "path", "dst", "size", "mtime", "mode"]
    first = base.select(
        F.lit(-1).cast("long").alias("seq"), F.lit("put").alias("op"), "path", F.lit(None).cast("string").alias("dst"), F.col("u_size").alias("size"), "mtime", "mode"
    )
    return first.unionByName(journal.select(*cols))


def replay(journal: DataFrame) -> DataFrame:
    """Live files (path, size, mtime, mode, born_seq, born_path: the put they come from) after the journal; records of equal (seq, path, op) count once.

    Paths that no mv names need no order beyond their last record: one aggregate with map-side combine. Paths that
    mv records tie together (connected components of the renames) are folded in the order of seq, one component at a
    time; rows stream through sorted tasks, so a component's state is all that is held.
    """
    log = materialize(journal.where("op IN ('put', 'rm', 'mv')").dropDuplicates(["seq", "path", "op"]), "journal")
    key = lambda c: F.xxhash64(c)
    roots = connected_components(log.where("op = 'mv'").select(key("path").alias("u"), key("dst").alias("v")))
    nodes = log.where("op = 'mv'").select(F.explode(F.array(key("path"), key("dst"))).alias("node")).distinct()
    tied = materialize(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "ties")
    marked = log.join(tied, key("path") == F.col("node"), "left")
    last = marked.where("root IS NULL").groupBy("path").agg(F.max_by(F.struct("op", "size", "mtime", "mode", "seq"), F.struct("seq", "op")).alias("l"))
    plain = last.where("l.op = 'put'").select("path", "l.size", "l.mtime", "l.mode", F.col("l.seq").alias("born_seq"), F.col("path").alias("born_path"))
    ordered = marked.where("root IS NOT NULL").select("root", "seq", "op", "path", "dst", "size", "mtime", "mode")
    folded = ordered.repartition("root").sortWithinPartitions("root", "seq", "op", "path").mapInArrow(_fold, LIVE)
    return plain.unionByName(folded)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "size", "mtime", "mode", "born_seq", "born_path"]

    def out(live: dict[str, tuple]) -> pa.RecordBatch:
        rows = [(p, *v) for p, v in live.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k in (0, 5) else pa.int64()) for k in range(6)], names)

    live: dict[str, tuple] = {}
    now = None
    for batch in batches:
        for root, seq, op, path, dst, *file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if root != now:
                if live:
                    yield out(live)
                live, now = {}, root
            if op == "put":
                live[path] = (*file, seq, path)
            elif op == "rm":
                live.pop(path, None)
            elif path in live:
                live[dst] = live.pop(path)
    if live:
        yield out(live)


def diff(base: DataFrame, live: DataFrame, hash_col: str | None = None) -> DataFrame:
    """(kind, path): A added, D deleted, M changed. Changed is another content hash, or size or mtime if there is none."""
    b, n = base.alias("b"), live.alias("n")
    changed = (~F.col(f"b.{hash_col}").eqNullSafe(F.col(f"n.{hash_col}"))) if hash_col else ((F.col("b.u_size") != F.col("n.size")) | (F.col("b.mtime") != F.col("n.mtime")))
    kind = F.when(F.col("b.path").isNull(), "A").when(F.col("n.path").isNull(), "D").when(changed, "M")
    both = b.join(n, F.col("b.path") == F.col("n.path"), "full_outer")
    return both.select(kind.alias("kind"), F.coalesce("b.path", "n.path").alias("path")).where("kind IS NOT NULL")


def put(chunked: DataFrame, known: DataFrame, first_seq: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, refs, fresh) that add files to a journal, numbered from first_seq by path.

    chunked: path, ordinal, content, mtime, mode; an empty file is one empty chunk. known: hashes already stored.
    records: journal rows; refs: (seq, path, ordinal, u_size, hash); fresh: (hash, codec, bytes) of unknown chunks, each once.
    """
    made = materialize(chunked.withColumns({"hash": content_hash(F.col("content")), "u_size": F.octet_length("content").cast("long")}), "put")
    sized = made.groupBy("path").agg(F.sum("u_size").alias("size"), F.max("mtime").alias("mtime"), F.max("mode").alias("mode"), F.lit(1).cast("long").alias("_one"))
    numbered = materialize(prefix_sums(sized, [], [F.col("path")], {"_n": "_one"}).withColumn("seq", F.col("_n") + first_seq), "put-records")
    records = numbered.select("seq", F.lit("put").alias("op"), "path", F.lit(None).cast("string").alias("dst"), "size", "mtime", "mode")
    refs = made.select("path", "ordinal", "u_size", "hash").join(numbered.select("path", "seq"), "path")
    fresh = made.join(known.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.first("content").alias("bytes"))
    return records, refs, fresh.select("hash", F.lit(0).alias("codec"), "bytes")


def read_live(live: DataFrame, refs: DataFrame, payload: DataFrame) -> DataFrame:
    """(path, ordinal, part): the chunks of every live file in the merged view, decoded; a file's bytes are its parts in order.

    refs: (seq, path, ordinal, hash) of all puts, the base snapshot's with seq -1 (with_base). A file keeps its put's chunks through
    renames, so chunk lists needn't travel through the replay.
    """
    born = live.select(F.col("path").alias("_now"), F.col("born_seq").alias("seq"), F.col("born_path").alias("path"))
    held = born.join(refs.select("seq", "path", "ordinal", "hash"), ["seq", "path"])
    return held.join(payload, "hash").select(F.col("_now").alias("path"), "ordinal", decode(F.col("codec"), F.col("bytes")).alias("part"))


def remove_below(live: DataFrame, top: str, first_seq: int) -> DataFrame:
    """Journal records that delete a path and all below it, numbered from first_seq by path."""
    hit = live.where(in_subtree(F.col("path"), top)).select("path", F.lit(1).cast("long").alias("_one"))
    numbered = prefix_sums(hit, [], [F.col("path")], {"_n": "_one"})
    return numbered.select((F.col("_n") + first_seq).alias("seq"), F.lit("rm").alias("op"), "path")


def check_renames(live: DataFrame, renames: DataFrame) -> DataFrame:
    """renames (path, dst) with ``error``: source missing, target exists, or null if it may be done."""
    r, s, t = renames.alias("r"), live.select("path").distinct().alias("s"), live.select("path").distinct().alias("t")
    both = r.join(s, F.col("r.path") == F.col("s.path"), "left").join(t, F.col("r.dst") == F.col("t.path"), "left")
    error = F.when(F.col("s.path").isNull(), "source missing").when(F.col("t.path").isNotNull(), "target exists")
    return both.select("r.path", "r.dst", error.alias("error"))


def compact(live: DataFrame, out: str) -> DataFrame:
    """Write the live files as a new base snapshot; the old one and its journal stay until the caller drops them."""
    live.select("path", F.col("size").alias("u_size"), "mtime", "mode").write.mode("errorifexists").parquet(out)
    return live.sparkSession.read.parquet(out)
