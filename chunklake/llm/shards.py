"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.operators.prefix import prefix_sums
from chunklake.session import materialize


def shard_by_bytes(docs: DataFrame, shards: int = 16, together: float = 0.04, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into ``shards`` contiguous shards of near-equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1 (null text: 1). Rows are put in the order of (text hash, id), so equal
    texts are neighbours, and one running sum over all rows gives each its start. Shard s takes the rows whose middle lies in the
    s-th of ``shards`` equal parts of all bytes; so a shard differs from the target by half a row at either end. Only
    the groups of equal texts that lie across a cut, fewer than ``shards``, would be divided: such a group goes as a whole to the
    shard of its own middle if it has at most ``together`` of a shard's target, and is divided by rows otherwise. Shards stay contiguous.

    Nulls: a null text sizes 1 and has checksum 0; null ids are kept, first of their text. Empty table: no rows. Repeated rows and
    ties: each row gets a slot of its own. Other columns are ignored. Returns id, size, text_crc32, shard, slot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text)).alias("_text"),
        F.lit(1).cast("long").alias("_one"),
    )
    placed = materialize(prefix_sums(rows, [], [F.col("_text"), F.col("doc_id")], {"_start": "size", "_place": "_one"}), "shard-rows")
    total = placed.agg(F.sum("size")).first()[0] or 0
    target = max(total / shards, 1.0)

    def part(middle):
        return F.least(F.floor(middle / F.lit(target)), F.lit(shards - 1)).cast("int")

    cuts = F.array(*[F.lit(target * s) for s in range(1, shards)]).cast("array<double>")
    start, end = F.col("_start"), F.col("_start") + F.col("size")
    middle = start + F.col("size") / 2
    # the texts across a cut: those of the rows around it, at most two for each cut
    beside = placed.where(F.exists(cuts, lambda c: (c >= start) & (c <= end))).select("_text").distinct()
    across = placed.join(F.broadcast(beside), "_text").groupBy("_text").agg(F.min("_start").alias("_from"), F.max(end).alias("_to"))
    whole = across.where(F.col("_to") - F.col("_from") <= together * target).select("_text", part((F.col("_from") + F.col("_to")) / 2).alias("_whole"))
    dealt = placed.join(F.broadcast(whole), "_text", "left").withColumn("shard", F.coalesce("_whole", part(middle)))
    dealt = materialize(dealt.select("doc_id", "size", "text_crc32", "shard", "_place"), "shard-dealt")
    first = dealt.groupBy("shard").agg(F.min("_place").alias("_first"))  # a row per shard
    return dealt.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot"))
