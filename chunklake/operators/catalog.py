"""Reading a catalog: files, chunk references, chunks, payload; listing, paging, chunk maps, ranges, statistics, dedup.

Relations: files(path, mode, mtime, u_size), chunk_refs(path, ordinal, id, u_size), chunks(id, codec, u_size, c_size,
data_off, hash), payload(hash, codec, bytes). With several archives every relation has archive_id, given as ``keys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.functions.codecs import content_hash, decode
from chunklake.operators.prefix import prefix_sums
from chunklake.session import materialize


def list_files(files: DataFrame, refs: DataFrame, chunks: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per file its size, number of references and, with chunks, its stored size (a chunk used twice counts twice)."""
    by = [*keys, "path"]
    used = refs.select(*by, "id")
    if chunks is not None:
        used = used.join(chunks.select(*keys, "id", "c_size"), [*keys, "id"], "left")
    sums = [F.count("*").alias("chunks")] + ([F.sum("c_size").alias("c_size")] if chunks is not None else [])
    out = files.join(used.groupBy(*by).agg(*sums), by, "left")
    named = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (["chunks", "c_size"] if chunks is not None else ["chunks"])]
    return out.select(*by, "u_size", *named)


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path) with the file of that path; ``found`` is false where there is none."""
    return wanted.join(files.withColumn("_hit", F.lit(True)), "path", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of rows in order; limit 0: all rows. For deep pages pass the last key seen as a filter instead."""
    ordered = rows.orderBy(*order)
    return ordered.offset(offset).limit(limit) if limit else ordered


def search(files: DataFrame, text: str, limit: int = 500) -> DataFrame:
    """Paths that contain text in any case, the first ``limit`` by path."""
    return page(files.where(F.contains(F.lower("path"), F.lit(text.lower()))), [F.col("path")], 0, limit) if limit else files.limit(0)


def chunk_map(refs: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every reference with its chunk, its offset in the file and how much of the file ends with it.

    References of one file are a window; a file has few of them next to all files.
    """
    by = [*keys, "path"]
    order = Window.partitionBy(*by).orderBy("ordinal")
    before = F.coalesce(F.sum("u_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("u_size").over(Window.partitionBy(*by))
    placed = refs.withColumn("file_off", before).withColumn("pct_end", ((before + F.col("u_size")) / F.greatest(total, F.lit(1)) * 100).cast("float"))
    return placed.join(chunks.select(*keys, "id", "codec", "c_size", "data_off"), [*keys, "id"], "left")


def layout(chunks: DataFrame, base: int = 0) -> DataFrame:
    """data_off of every chunk: base and the stored sizes of all chunks before it by id, without a single-task window."""
    summed = prefix_sums(chunks, [], [F.col("id")], {"_before": "c_size"})
    return summed.withColumn("data_off", F.col("_before") + F.lit(base)).drop("_before")


def assign_chunk_ids(refs: DataFrame) -> DataFrame:
    """(hash, id): ids from 0 by first occurrence in the order of (path, ordinal)."""
    first = refs.groupBy("hash").agg(F.min(F.struct("path", "ordinal")).alias("_at"), F.lit(1).cast("long").alias("_one"))
    return prefix_sums(first.select("hash", "_at.path", "_at.ordinal", "_one"), [], [F.col("path"), F.col("ordinal")], {"id": "_one"}).select("hash", "id")


def ranges(mapped: DataFrame, start: int, length: int = 0) -> DataFrame:
    """References that meet bytes [start, start+length) of their file, with the part to take; length 0: to the end."""
    stop = F.lit(start + length) if length else F.lit((1 << 63) - 1)
    hit = mapped.where((F.col("file_off") < stop) & (F.col("file_off") + F.col("u_size") > start))
    skip = F.greatest(F.lit(start) - F.col("file_off"), F.lit(0))
    return hit.withColumn("skip", skip).withColumn("take", F.least(F.col("u_size"), stop - F.col("file_off")) - skip)


def read_range(mapped: DataFrame, payload: DataFrame, start: int = 0, length: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(path, content): those bytes of every file in ``mapped`` (with hash). Past the end: no row."""
    parts = ranges(mapped, start, length).join(payload.select("hash", F.col("codec").alias("_codec"), "bytes"), "hash")
    plain = parts.withColumn("_part", decode(F.col("_codec"), F.col("bytes")))
    cut = plain.withColumn("_part", F.substring("_part", F.col("skip").cast("int") + 1, F.col("take").cast("int")))
    joined = cut.groupBy(*keys, "path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "_part"))).alias("_parts"))
    return joined.select(*keys, "path", F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["_part"])).alias("content"))


def deduplicate(files: DataFrame) -> DataFrame:
    """(hash, first_path, copies, u_size): content by address; the first path by byte order stands for its copies."""
    addressed = files.select("path", content_hash(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("u_size"))
    return addressed.groupBy("hash").agg(F.min("path").alias("first_path"), F.count("*").alias("copies"), F.max("u_size").alias("u_size"))


def stats(files: DataFrame, refs: DataFrame, chunks: DataFrame, dirs: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Files, dirs, references, unique chunks, logical and stored bytes, ratio (1 if there are no bytes), savings."""
    per = lambda df, *aggs: df.groupBy(*keys).agg(*aggs)
    parts = [
        per(files, F.count("*").alias("files"), F.coalesce(F.sum("u_size"), F.lit(0)).cast("long").alias("logical_bytes")),
        per(refs, F.count("*").alias("chunk_refs")),
        per(chunks, F.count("*").alias("unique_chunks"), F.coalesce(F.sum("c_size"), F.lit(0)).cast("long").alias("stored_bytes")),
    ]
    if dirs is not None:
        parts.append(per(dirs, F.count("*").alias("dirs")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys), "left") if keys else out.crossJoin(part)  # one row each
    counts = ["chunk_refs", "unique_chunks", "stored_bytes", *(["dirs"] if dirs is not None else [])]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    ratio = F.when(F.col("logical_bytes") > 0, F.col("stored_bytes") / F.col("logical_bytes")).otherwise(1.0)
    return out.withColumn("compression_ratio", ratio).withColumn("savings_bytes", F.greatest(F.lit(0), F.col("logical_bytes") - F.col("stored_bytes")))


def pack(chunked: DataFrame, encode: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk_refs, chunks, payload) from chunked files (path, ordinal, u_size, content).

    Chunks are addressed by hash and stored once; ``encode`` gives struct(codec, bytes) of the column content.
    """
    addressed = materialize(chunked.withColumn("hash", content_hash(F.col("content"))), "pack")
    ids = materialize(assign_chunk_ids(addressed.select("hash", "path", "ordinal")), "pack-ids")
    refs = addressed.select("path", "ordinal", "u_size", "hash").join(ids, "hash")
    once = addressed.groupBy("hash").agg(F.first("content").alias("content"), F.max("u_size").alias("u_size"))
    payload = materialize(once.withColumn("_made", encode).select("hash", "u_size", "_made.codec", "_made.bytes"), "payload")
    sized = payload.join(ids, "hash").select("id", "codec", "u_size", F.octet_length("bytes").cast("long").alias("c_size"), "hash")
    return refs, layout(sized), payload.select("hash", "codec", "bytes")


def recent(files: DataFrame, n: int = 4) -> DataFrame:
    """The n files changed last over all archives, ties by archive and path."""
    return files.orderBy(F.col("mtime").desc(), "archive_id", "path").limit(n)


def between(rows: DataFrame, order: list[Column], anchor: Column, target: Column) -> DataFrame:
    """Rows from anchor to target, both included, whichever comes first. anchor, target: true on one row each."""
    numbered = materialize(prefix_sums(rows.withColumns({"_one": F.lit(1).cast("long"), "_end": anchor | target}), [], order, {"_at": "_one"}), "between")
    ends = numbered.where("_end").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    picked = numbered.join(F.broadcast(ends), F.col("_at").between(F.col("_low"), F.col("_high")))
    return picked.drop("_one", "_end", "_at", "_low", "_high")
