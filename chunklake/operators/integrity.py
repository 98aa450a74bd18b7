"""Checks of a catalog: bounds, references, sizes, content hashes, totals and an order-aware digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.functions.codecs import content_hash, decode

#: Limits of what a reader accepts, in bytes (fixed values).
MAX_MANIFEST, MAX_CHUNK_TABLE, MAX_CHUNK = 256 << 20, 64 << 20, 2 << 20


def bound_violations(chunks: DataFrame, data_off: int, data_end: int) -> DataFrame:
    """Chunks that begin before the data, end behind it, are too large or have an unknown codec, with the reason."""
    reason = (
        F.when(F.col("data_off") < data_off, "starts before the data")
        .when(F.col("data_off") + F.col("c_size") > data_end, "ends behind the data")
        .when((F.col("u_size") > MAX_CHUNK) | (F.col("c_size") > MAX_CHUNK), "too large")
        .when(~F.col("codec").isin(0, 1), "unknown codec")
    )
    return chunks.withColumn("reason", reason).where("reason IS NOT NULL")


def dangling_refs(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """References to chunks that don't exist."""
    return refs.join(chunks.select("id"), "id", "left_anti")


def size_mismatches(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files whose references don't add up to their size; a file without references must be empty."""
    sums = refs.groupBy("path").agg(F.sum("u_size").alias("ref_bytes"))
    return files.join(sums, "path", "left").withColumn("ref_bytes", F.coalesce("ref_bytes", F.lit(0)).cast("long")).where("u_size <> ref_bytes")


def corrupt_chunks(chunks: DataFrame, payload: DataFrame) -> DataFrame:
    """Chunks whose plain bytes have another hash than recorded, or are missing; a null hash isn't checked."""
    found = chunks.where("hash IS NOT NULL").join(payload.select("hash", F.col("codec").alias("_codec"), "bytes"), "hash", "left")
    return found.where(F.col("bytes").isNull() | (content_hash(decode(F.col("_codec"), F.col("bytes"))) != F.col("hash"))).select("id", "hash")


def ordered_digest(rows: DataFrame, order: str, value: str, block: int = 4096) -> DataFrame:
    """One digest that depends on every value and its place: hashes of blocks of ``block`` rows, hashed again in order.

    ``order`` numbers the rows from 0 without gaps, so blocks are fixed and hashed in parallel; the last step sees one
    short hash per block.
    """
    blocks = rows.groupBy(F.floor(F.col(order) / block).alias("_block")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_rows"))
    hashed = blocks.select("_block", F.sha2(F.array_join(F.transform("_rows", lambda r: r["v"]), ","), 256).alias("_hash"))
    return hashed.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_hash"))), lambda r: r["_hash"]), ","), 256).alias("digest"))


def verify(chunks: DataFrame, payload: DataFrame, tail: DataFrame) -> DataFrame:
    """One row: do totals and digest of the chunks agree with the tail (total_u, total_c, digest), and all hashes hold?"""
    totals = chunks.agg(F.coalesce(F.sum("u_size"), F.lit(0)).alias("u"), F.coalesce(F.sum("c_size"), F.lit(0)).alias("c"))
    digest = ordered_digest(chunks.select("id", F.lower(F.hex("hash")).alias("h")), "id", "h").withColumnRenamed("digest", "d")
    bad = corrupt_chunks(chunks, payload).agg(F.count("*").alias("bad"))
    one = tail.crossJoin(totals).crossJoin(digest).crossJoin(bad)  # one row each
    return one.select(((F.col("u") == F.col("total_u")) & (F.col("c") == F.col("total_c")) & (F.col("d") == F.col("digest")) & (F.col("bad") == 0)).alias("ok"))
