"""The engine's relations derived from the driver's tables, in Spark and, as CTEs of the same content, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunklake.session import table

NOW = 1_700_000_000  # "now" of all queries, in epoch seconds

EXT = "CASE doc_id % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'PNG' WHEN 2 THEN 'mp4' WHEN 3 THEN 'mp3' WHEN 4 THEN 'zip' ELSE 'bin' END"

#: files: one archive per source, a document each.
FILES_SQL = f"""files AS (SELECT source AS archive_id, doc_id, lang || '/' || doc_id || '.' || {EXT} AS path, CAST(33188 AS BIGINT) AS mode,
  CAST({NOW} - (doc_id * 7919) % 500000 AS BIGINT) AS mtime, CAST(octet_length(encode(text)) AS BIGINT) AS u_size, text FROM documents)"""

#: chunk_refs and chunks: orders are archives, each with one file; a line is a reference, a part is a chunk.
REFS_SQL = """refs AS (SELECT l_orderkey AS archive_id, 'f' || l_orderkey AS path,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal,
  l_partkey AS id, CAST(p_size AS BIGINT) * 1000 + 17 AS u_size FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CHUNKS_SQL = """chunks AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) * 1000 + 17 AS u_size,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) * 1000 + 17 ELSE CAST(p_size AS BIGINT) * (300 + p_partkey % 700) + 9 END AS c_size FROM part)"""

#: journal: users are paths; signup and purchase put, error deletes, click renames to a fresh path, view is a note.
JOURNAL_SQL = """journal AS (SELECT event_id AS seq, 'u' || user_id AS path, CAST(round(value * 100) AS BIGINT) AS size,
  CASE event_type WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'put' WHEN 'error' THEN 'rm' WHEN 'click' THEN 'mv' ELSE 'note' END AS op,
  CASE WHEN event_type = 'click' THEN 'u' || user_id || '@' || event_id END AS dst, CAST(floor(epoch(ts)) AS BIGINT) AS mtime FROM events)"""
#: In this journal a rename's source is live exactly if the path's last record before it is a put.
LIVE_SQL = """acts AS (SELECT *, lag(op) OVER w AS op_before, lag(size) OVER w AS size_before, lag(mtime) OVER w AS mtime_before, lag(seq) OVER w AS seq_before,
    lead(op) OVER w AS op_after FROM journal WHERE op <> 'note' WINDOW w AS (PARTITION BY path ORDER BY seq)),
  live AS (SELECT path, size, mtime, seq AS born_seq FROM acts WHERE op = 'put' AND op_after IS NULL
    UNION ALL SELECT dst, size_before, mtime_before, seq_before FROM acts WHERE op = 'mv' AND op_before = 'put')"""
#: base: the snapshot before the journal, all users.
BASE_SQL = "base AS (SELECT DISTINCT 'u' || user_id AS path, CAST(user_id * 10 AS BIGINT) AS u_size, CAST(1000 AS BIGINT) AS mtime FROM events)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("source").alias("archive_id"),
        "doc_id",
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.expr(EXT)).alias("path"),
        F.lit(33188).cast("long").alias("mode"),
        (F.lit(NOW) - (F.col("doc_id") * 7919) % 500000).cast("long").alias("mtime"),
        F.octet_length("text").cast("long").alias("u_size"),
        "text",
    )


def refs(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("archive_id"),
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"),
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        F.col("l_partkey").alias("id"),
        (F.col("p_size").cast("long") * 1000 + 17).alias("u_size"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    u = F.col("p_size").cast("long") * 1000 + 17
    c = F.when(F.col("p_partkey") % 3 == 0, u).otherwise(F.col("p_size").cast("long") * (F.col("p_partkey") % 700 + 300) + 9)
    return parts.select(F.col("p_partkey").alias("id"), u.alias("u_size"), c.alias("c_size"))


def journal(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "put", "purchase": "put", "error": "rm", "click": "mv"}.items() for x in kv])
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        path.alias("path"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("note")).alias("op"),
        F.when(F.col("event_type") == "click", F.concat(path, F.lit("@"), F.col("event_id").cast("string"))).alias("dst"),
        F.unix_timestamp("ts").alias("mtime"),
        F.lit(33188).cast("long").alias("mode"),
    )


def base(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        (F.col("user_id") * 10).cast("long").alias("u_size"),
        F.lit(1000).cast("long").alias("mtime"),
        F.lit(33188).cast("long").alias("mode"),
    )

