"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunklake.functions import codecs
from chunklake.functions import scalars as fn
from chunklake.functions.chunking import chunk_files
from chunklake.operators import admin, catalog, integrity, overlay
from chunklake.operators.prefix import prefix_sums
from chunklake.plans import relations as rel
from chunklake.plans.relations import BASE_SQL, CHUNKS_SQL, FILES_SQL, JOURNAL_SQL, LIVE_SQL, REFS_SQL
from chunklake.session import materialize, shared_dir, table
from chunklake.streaming import uploads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its own name, with its SQL if it has any."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


@query("""
WITH f AS (SELECT source, sha256(text) AS hash, octet_length(encode(text)) AS u FROM documents WHERE text IS NOT NULL),
     c AS (SELECT source, hash, max(u) AS u, count(*) AS n, sum(u) AS logical FROM f GROUP BY source, hash)
SELECT source, CAST(sum(n) AS BIGINT) AS files, count(*) AS unique_chunks, CAST(sum(logical) AS BIGINT) AS logical_bytes,
       CAST(sum(u) AS BIGINT) AS stored_bytes FROM c GROUP BY source""")
def dedup_by_source(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    files = docs.select("source", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("u"))
    chunks = files.groupBy("source", "hash").agg(F.max("u").alias("u"), F.count("*").alias("n"), F.sum("u").alias("logical"))
    return chunks.groupBy("source").agg(
        F.sum("n").alias("files"),
        F.count("*").alias("unique_chunks"),
        F.sum("logical").alias("logical_bytes"),
        F.sum("u").alias("stored_bytes"),
    )


@query(f"WITH {FILES_SQL} SELECT archive_id, path, u_size, CAST(CASE WHEN u_size > 0 THEN 1 ELSE 0 END AS BIGINT) AS chunks FROM files")
def list_files(spark, sf):
    """Files with their number of references; whole documents are single chunks at the default sizes."""
    f = rel.files(spark, sf).select("archive_id", "path", "u_size")
    return catalog.list_files(f, f.where("u_size > 0").withColumn("id", F.lit(0)), keys=("archive_id",))


@query(f"""WITH {REFS_SQL}, {CHUNKS_SQL}
SELECT archive_id, path, CAST(sum(r.u_size) AS BIGINT) AS u_size, count(*) AS chunks, CAST(sum(c_size) AS BIGINT) AS c_size
FROM refs r JOIN chunks c USING (id) GROUP BY archive_id, path""")
def list_c_size(spark, sf):
    """Stored size per file."""
    refs = rel.refs(spark, sf)
    files = refs.groupBy("archive_id", "path").agg(F.sum("u_size").alias("u_size"))
    # every archive refers to the one chunk table
    used = refs.drop("u_size").join(rel.chunks(spark, sf).select("id", "c_size"), "id")
    return catalog.list_files(files, used, used.select("archive_id", "id", "c_size").distinct(), keys=("archive_id",))


@query(f"""WITH {REFS_SQL}, {CHUNKS_SQL}
SELECT path || CASE WHEN archive_id % 2 = 0 THEN ' [E]' ELSE '' END || '  u=' || CAST(sum(r.u_size) AS BIGINT) || '  c=' || CAST(sum(c_size) AS BIGINT) || '  chunks=' || count(*) AS line
FROM refs r JOIN chunks c USING (id) GROUP BY archive_id, path""")
def list_lines(spark, sf):
    """The listing as text, encrypted archives marked."""
    rows = list_c_size(spark, sf)
    return rows.select(fn.list_line(F.col("path"), F.col("archive_id") % 2 == 0, F.col("u_size"), F.col("c_size"), F.col("chunks")).alias("line"))


@query(f"WITH {REFS_SQL} SELECT archive_id, path, CAST(list(id ORDER BY ordinal) AS VARCHAR) AS ids FROM refs GROUP BY archive_id, path")
def list_entries(spark, sf):
    """Ids of each file's chunks in order."""
    grouped = rel.refs(spark, sf).groupBy("archive_id", "path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("r"))
    ids = F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ", ")
    return grouped.select("archive_id", "path", F.concat(F.lit("["), ids, F.lit("]")).alias("ids"))


@query(f"""WITH {REFS_SQL}, {CHUNKS_SQL}
SELECT archive_id, path, ordinal, id, r.u_size, c_size,
  CAST(coalesce(sum(r.u_size) OVER (PARTITION BY archive_id, path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_off,
  CAST(CAST(sum(r.u_size) OVER (PARTITION BY archive_id, path ORDER BY ordinal) / greatest(sum(r.u_size) OVER (PARTITION BY archive_id, path), 1) * 100 AS FLOAT) AS DOUBLE) AS pct_end
FROM refs r JOIN chunks c USING (id)""")
def chunk_map(spark, sf):
    """J1, W1, P22."""
    chunks = rel.chunks(spark, sf).withColumns({"codec": F.lit(1), "data_off": F.lit(0)})
    mapped = catalog.chunk_map(rel.refs(spark, sf), chunks)
    return mapped.select("archive_id", "path", "ordinal", "id", "u_size", "c_size", "file_off", F.col("pct_end").cast("double").alias("pct_end"))


@query(f"""WITH {CHUNKS_SQL} SELECT id, c_size, CAST(80 + coalesce(sum(c_size) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_off FROM chunks""")
def chunk_layout(spark, sf):
    """Data offsets by running sums."""
    return catalog.layout(rel.chunks(spark, sf), base=80).select("id", "c_size", "data_off")


@query(f"""WITH {FILES_SQL}, h AS (SELECT sha256(text) AS hash, min(path) AS path FROM files GROUP BY 1)
SELECT hash, row_number() OVER (ORDER BY path) - 1 AS id FROM h""")
def chunk_ids(spark, sf):
    """Ids by first occurrence of a content."""
    f = rel.files(spark, sf).select("path", F.lit(0).alias("ordinal"), F.sha2("text", 256).alias("hash"))
    return catalog.assign_chunk_ids(f)


@query(f"""WITH {CHUNKS_SQL} SELECT id, CASE WHEN (u_size - c_size) >= u_size * CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END AS codec FROM chunks""")
def codec_choice(spark, sf):
    """P10."""
    return rel.chunks(spark, sf).select("id", fn.picks_zstd(F.col("u_size"), F.col("c_size")).alias("codec"))


_RANGE = f"""WITH {REFS_SQL}, m AS (SELECT *, CAST(coalesce(sum(u_size) OVER (PARTITION BY archive_id, path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_off FROM refs)
SELECT archive_id, path, ordinal, greatest(25000 - file_off, 0) AS skip, least(u_size, 65000 - file_off) - greatest(25000 - file_off, 0) AS take
FROM m WHERE file_off < 65000 AND file_off + u_size > 25000"""


@query(_RANGE)
def range_locate(spark, sf):
    """References that hold bytes 25000 to 65000 of their file."""
    order = Window.partitionBy("archive_id", "path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    mapped = rel.refs(spark, sf).withColumn("file_off", F.coalesce(F.sum("u_size").over(order), F.lit(0)))
    hit = catalog.ranges(mapped, 25000, 40000)
    return hit.select("archive_id", "path", "ordinal", F.col("skip").cast("long").alias("skip"), F.col("take").cast("long").alias("take"))


@query(f"""WITH {FILES_SQL} SELECT archive_id, path, substr(hex(encode(text)), 201, 600) AS part FROM files WHERE octet_length(encode(text)) > 100""")
def range_bytes(spark, sf):
    """300 bytes from byte 100 of every file."""
    f = rel.files(spark, sf).where("u_size > 100")
    return f.select("archive_id", "path", F.hex(F.substring(F.col("text").cast("binary"), 101, 300)).alias("part"))


@query(f"""WITH {FILES_SQL}, h AS (SELECT archive_id, sha256(text) AS hash, max(u_size) AS u FROM files GROUP BY 1, 2),
  s AS (SELECT archive_id, count(*) AS unique_chunks, CAST(sum(u) AS BIGINT) AS stored_bytes FROM h GROUP BY 1),
  l AS (SELECT archive_id, count(*) AS files, CAST(sum(u_size) AS BIGINT) AS logical_bytes, count(DISTINCT split_part(path, '/', 1)) AS dirs FROM files GROUP BY 1)
SELECT archive_id, files, dirs, files AS chunk_refs, unique_chunks, logical_bytes, stored_bytes,
  round(CASE WHEN logical_bytes > 0 THEN stored_bytes / logical_bytes ELSE 1.0 END, 6) AS compression_ratio, greatest(0, logical_bytes - stored_bytes) AS savings_bytes
FROM l JOIN s USING (archive_id)""")
def archive_stats(spark, sf):
    """A1, A2, A4, A5 per archive."""
    f = materialize(rel.files(spark, sf).select("archive_id", "path", "u_size", F.sha2("text", 256).alias("hash")), "files")
    chunks = f.groupBy("archive_id", "hash").agg(F.max("u_size").alias("c_size"))
    dirs = f.select("archive_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).distinct()
    s = catalog.stats(f, f, chunks, dirs, keys=("archive_id",))
    return s.withColumn("compression_ratio", F.round("compression_ratio", 6)).select(
        "archive_id", "files", "dirs", "chunk_refs", "unique_chunks", "logical_bytes", "stored_bytes", "compression_ratio", "savings_bytes"
    )


@query(f"""WITH {FILES_SQL}, h AS (SELECT archive_id, sha256(text) AS hash, max(u_size) AS u, sum(u_size) AS l FROM files GROUP BY 1, 2),
  t AS (SELECT CAST(sum(l) AS BIGINT) AS logical, CAST(sum(u) AS BIGINT) AS stored FROM h)
SELECT logical, stored, greatest(0, logical - stored) * 100 // greatest(logical, 1) AS saved_pct, least(100, stored * 100 // greatest(logical, 1)) AS stored_pct,
  CASE WHEN greatest(0, logical - stored) * 100 // greatest(logical, 1) >= 5 THEN 'down' ELSE 'flat' END AS direction FROM t""")
def storage_overview(spark, sf):
    """Totals over all archives with whole percentages."""
    f = rel.files(spark, sf).select("archive_id", "u_size", F.sha2("text", 256).alias("hash"))
    per = f.groupBy("archive_id", "hash").agg(F.max("u_size").alias("u"), F.sum("u_size").alias("l"))
    t = per.agg(F.sum("l").alias("logical"), F.sum("u").alias("stored"))
    return t.selectExpr(
        "logical", "stored", "greatest(0, logical - stored) * 100 div greatest(logical, 1) AS saved_pct", "least(100, stored * 100 div greatest(logical, 1)) AS stored_pct"
    ).withColumn("direction", F.when(F.col("saved_pct") >= 5, "down").otherwise("flat"))


@query(f"""WITH {FILES_SQL}, h AS (SELECT archive_id, sha256(text) AS hash, max(u_size) AS u, sum(u_size) AS l FROM files GROUP BY 1, 2),
  s AS (SELECT archive_id, CAST(sum(l) AS BIGINT) AS logical, CAST(sum(u) AS BIGINT) AS stored FROM h GROUP BY 1),
  p AS (SELECT archive_id, CASE WHEN logical > 0 THEN greatest(0, logical - stored) / logical * 100 ELSE 0.0 END AS saved, CASE WHEN logical > 0 THEN least(100.0, stored / logical * 100) ELSE 100.0 END AS kept FROM s)
SELECT archive_id, round(saved, 6) AS saved_pct, round(kept, 6) AS stored_pct, CAST(floor(saved + 0.5) AS BIGINT) AS saved_whole, CAST(floor(kept + 0.5) AS BIGINT) AS stored_whole FROM p""")
def vault_percentages(spark, sf):
    """Saved and stored percentages of each archive, exact and whole."""
    f = materialize(rel.files(spark, sf).select("archive_id", "path", "u_size", F.sha2("text", 256).alias("hash")), "files")
    s = catalog.stats(f, f, f.groupBy("archive_id", "hash").agg(F.max("u_size").alias("c_size")), keys=("archive_id",))
    saved, kept = fn.saved_pct(F.col("logical_bytes"), F.col("savings_bytes")), fn.stored_pct(F.col("logical_bytes"), F.col("stored_bytes"))
    whole = lambda c: F.floor(c + 0.5).cast("long")
    return s.select("archive_id", F.round(saved, 6).alias("saved_pct"), F.round(kept, 6).alias("stored_pct"), whole(saved).alias("saved_whole"), whole(kept).alias("stored_whole"))


@query("SELECT sha256(text) AS hash, min(lang || '/' || doc_id) AS first_path, count(*) AS copies, CAST(max(octet_length(encode(text))) AS BIGINT) AS u_size FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_first_path(spark, sf):
    """Content by address with its first path and number of copies."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    found = catalog.deduplicate(docs.select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content")))
    return found.withColumn("hash", F.lower(F.hex("hash")))


@query(f"""WITH {FILES_SQL}, w AS (SELECT 'en/' || doc_id || '.txt' AS path FROM documents)
SELECT w.path, u_size, archive_id IS NOT NULL AS found FROM w LEFT JOIN files USING (path)""")
def point_lookup(spark, sf):
    """Every wanted path with its file, or not found."""
    wanted = table(spark, sf, "documents").select(F.concat(F.lit("en/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return catalog.lookup(rel.files(spark, sf).select("path", "u_size"), wanted)


@query(f"""WITH {FILES_SQL}, n AS (SELECT path, mtime, archive_id, row_number() OVER (ORDER BY archive_id, path) AS k FROM files),
  e AS (SELECT min(k) AS low, max(k) AS high FROM n WHERE mtime = (SELECT max(mtime) FROM files) OR mtime = (SELECT min(mtime) FROM files))
SELECT archive_id, path FROM n, e WHERE k BETWEEN low AND high""")
def range_selection(spark, sf):
    """The listing from its newest to its oldest file, whichever comes first."""
    f = rel.files(spark, sf).select("archive_id", "path", "mtime")
    ends = f.agg(F.max("mtime").alias("new"), F.min("mtime").alias("old")).first()
    return catalog.between(f, [F.col("archive_id"), F.col("path")], F.col("mtime") == ends["new"], F.col("mtime") == ends["old"]).select("archive_id", "path")


@query(f"""WITH {FILES_SQL}, x AS (SELECT lower(split_part(path, '.', -1)) AS ext, path FROM files)
SELECT CASE WHEN ext IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'avif', 'svg', 'bmp') THEN 'image' WHEN ext IN ('mp4', 'mov', 'webm', 'mkv', 'm4v') THEN 'video'
  WHEN ext IN ('mp3', 'wav', 'flac', 'm4a', 'ogg', 'aac') THEN 'audio' WHEN ext = 'pdf' THEN 'pdf'
  WHEN ext IN ('txt', 'md', 'json', 'yaml', 'yml', 'toml', 'rs', 'ts', 'tsx', 'js', 'jsx', 'py', 'sh', 'log', 'csv', 'xml', 'html', 'css', 'go', 'java') THEN 'text'
  WHEN ext IN ('zip', 'tar', 'gz', '7z', 'rar') THEN 'archive' ELSE 'other' END AS preview, path = 'en/0.txt' AS wanted, count(*) AS files FROM x GROUP BY 1, 2""")
def preview_classes(spark, sf):
    """Files by how they are previewed, the one of an optional path filter apart."""
    p = F.col("path")
    f = rel.files(spark, sf).where(fn.matches_path(p, ""))
    return f.groupBy(fn.preview_class(p).alias("preview"), fn.matches_path(p, "en/0.txt").alias("wanted")).agg(F.count("*").alias("files"))


@query(f"WITH {FILES_SQL} SELECT archive_id, path, u_size, mtime FROM files WHERE starts_with(path, 'de/1')")
def ls_prefix(spark, sf):
    """P4, P23."""
    return rel.files(spark, sf).where(F.col("path").startswith("de/1")).select("archive_id", "path", "u_size", "mtime")


@query(f"WITH {FILES_SQL} SELECT archive_id, path FROM files WHERE path = 'en' OR starts_with(path, 'en/')")
def subtree(spark, sf):
    """P6."""
    return rel.files(spark, sf).where(fn.in_subtree(F.col("path"), "en")).select("archive_id", "path")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE contains(lower(path), '7.p') ORDER BY path LIMIT 500")
def search_substring(spark, sf):
    """P5, L3: a search with its limit."""
    return catalog.search(rel.files(spark, sf), "7.P", 500).select("path")


@query(f"WITH {FILES_SQL} SELECT path, u_size, (SELECT count(*) FROM files) AS total FROM files ORDER BY path LIMIT 100 OFFSET 100")
def page(spark, sf):
    """The second page of 100 with the total before paging."""
    f = rel.files(spark, sf).select("path", "u_size")
    return catalog.page(f, [F.col("path")], 100, 100).withColumn("total", F.lit(f.count()).cast("long"))


@query(f"WITH {FILES_SQL} SELECT archive_id, path, mtime FROM files ORDER BY mtime DESC, archive_id, path LIMIT 4")
def recent_top4(spark, sf):
    """L6, J11."""
    return catalog.recent(rel.files(spark, sf).select("archive_id", "path", "mtime"), 4)


_TYPES = """WHEN ext IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'avif', 'svg', 'bmp') THEN 'images'
  WHEN ext IN ('mp4', 'mov', 'avi', 'mkv', 'webm', 'm4v') THEN 'video'
  WHEN ext IN ('mp3', 'wav', 'flac', 'm4a', 'ogg', 'aac') THEN 'audio'
  WHEN ext IN ('pdf', 'txt', 'md', 'json', 'yaml', 'toml', 'rs', 'ts', 'tsx', 'js', 'csv', 'doc', 'docx') THEN 'docs'
  WHEN ext IN ('zip', 'tar', 'gz', '7z', 'rar') THEN 'archives'"""


@query(f"""WITH {FILES_SQL}, x AS (SELECT *, lower(split_part(path, '.', -1)) AS ext FROM files)
SELECT CASE {_TYPES} ELSE 'other' END AS type, ext, count(*) AS files, CAST(sum(u_size) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE ext IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'avif', 'svg', 'bmp') AND u_size < 8388608) AS thumbnails FROM x GROUP BY 1, 2""")
def type_filter(spark, sf):
    """P8, P25, F25."""
    p = F.col("path")
    f = rel.files(spark, sf).select(fn.type_class(p).alias("type"), fn.extension(p).alias("ext"), "u_size", fn.has_thumbnail(p, F.col("u_size")).alias("t"))
    return f.groupBy("type", "ext").agg(F.count("*").alias("files"), F.sum("u_size").alias("bytes"), F.count_if("t").alias("thumbnails"))


@query(f"""WITH {FILES_SQL}, b AS (SELECT path, u_size * (doc_id % 5) * (doc_id % 5) * 3000 AS n, mtime FROM files)
SELECT path, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS size,
  CASE WHEN {rel.NOW} - mtime < 60 THEN 'just now' WHEN {rel.NOW} - mtime < 3600 THEN (({rel.NOW} - mtime) // 60) || 'm ago' WHEN {rel.NOW} - mtime < 86400 THEN (({rel.NOW} - mtime) // 3600) || 'h ago' ELSE (({rel.NOW} - mtime) // 86400) || 'd ago' END AS age,
  strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM b""")
def format_columns(spark, sf):
    """F21, F23, F24."""
    n = F.col("u_size") * (F.col("doc_id") % 5) * (F.col("doc_id") % 5) * 3000
    m = F.col("mtime")
    return rel.files(spark, sf).select("path", fn.format_bytes(n).alias("size"), fn.time_ago(m, rel.NOW).alias("age"), fn.iso_date(m).alias("iso"))


@query(f"WITH {JOURNAL_SQL}, {LIVE_SQL} SELECT path, size, mtime, born_seq FROM live")
def replay_rename(spark, sf):
    """The live files of a journal with renames."""
    return overlay.replay(rel.journal(spark, sf)).select("path", "size", "mtime", "born_seq")


@query(f"""WITH {JOURNAL_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM journal WHERE op IN ('put', 'rm'))
SELECT path, size, mtime, seq AS born_seq FROM p WHERE k = 1 AND op = 'put'""")
def replay_put_delete(spark, sf):
    """Without renames the last record of a path decides."""
    return overlay.replay(rel.journal(spark, sf).where("op IN ('put', 'rm')")).select("path", "size", "mtime", "born_seq")


@query(f"""WITH {FILES_SQL}, f AS (SELECT archive_id || '/' || path AS path, u_size, sha256(text) AS hash FROM files WHERE text IS NOT NULL),
  known AS (SELECT sha256(text) AS hash FROM files WHERE starts_with(path, 'de/') AND text IS NOT NULL)
SELECT path, row_number() OVER (ORDER BY path) - 1 + 1000 AS seq, u_size AS size, hash, hash NOT IN (SELECT hash FROM known) AS fresh FROM f""")
def put_files(spark, sf):
    """M1: all documents put into an archive that holds the German ones; only unknown chunks are stored."""
    f = rel.files(spark, sf).where("text IS NOT NULL")
    known = f.where(F.col("path").startswith("de/")).select(codecs.content_hash(F.col("text").cast("binary")).alias("hash"))
    chunked = f.select(F.concat_ws("/", "archive_id", "path").alias("path"), F.lit(0).cast("long").alias("ordinal"), F.col("text").cast("binary").alias("content"), "mtime", "mode")
    records, refs, fresh = overlay.put(chunked, known, 1000)
    placed = records.select("path", "size").join(refs, "path").join(fresh.select("hash", F.lit(True).alias("_new")), "hash", "left")
    return placed.select("path", "seq", "size", F.lower(F.hex("hash")).alias("hash"), F.coalesce("_new", F.lit(False)).alias("fresh"))


_MERGED = f"""{JOURNAL_SQL.replace("journal AS", "j0 AS")}, {BASE_SQL},
  journal AS (SELECT seq, path, size, op, dst, mtime FROM j0 UNION ALL SELECT -1, path, u_size, 'put', NULL, mtime FROM base), {LIVE_SQL}"""


@query(f"""WITH {_MERGED}
SELECT CASE WHEN b.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS kind, coalesce(b.path, n.path) AS path
FROM base b FULL JOIN live n ON b.path = n.path WHERE b.path IS NULL OR n.path IS NULL OR b.u_size <> n.size OR b.mtime <> n.mtime""")
def diff_admn(spark, sf):
    """M6, J6, J7, U1, U2, U3."""
    base = rel.base(spark, sf)
    live = overlay.replay(overlay.with_base(base, rel.journal(spark, sf)))
    return overlay.diff(base, live)


@query(f"""WITH {_MERGED} SELECT path, size, mtime FROM live WHERE NOT (path = 'u7' OR starts_with(path, 'u7/') OR starts_with(path, 'u1@'))""")
def recursive_delete(spark, sf):
    """Deletes of a subtree and of a prefix are journalled and replayed."""
    merged = materialize(overlay.with_base(rel.base(spark, sf), rel.journal(spark, sf)), "merged")
    live = materialize(overlay.replay(merged), "live")
    gone = overlay.remove_below(live, "u7", 1 << 40).unionByName(live.where(F.col("path").startswith("u1@")).select(F.lit(1 << 41).alias("seq"), F.lit("rm").alias("op"), "path"))
    return overlay.replay(merged.unionByName(gone, allowMissingColumns=True)).select("path", "size", "mtime")


@query(f"""WITH {JOURNAL_SQL}, {LIVE_SQL}, r AS (SELECT DISTINCT path, 'u' || (CAST(substr(path, 2) AS BIGINT) + 1) AS dst FROM journal)
SELECT r.path, r.dst, CASE WHEN s.path IS NULL THEN 'source missing' WHEN t.path IS NOT NULL THEN 'target exists' END AS error
FROM r LEFT JOIN live s ON r.path = s.path LEFT JOIN live t ON r.dst = t.path""")
def rename_checks(spark, sf):
    """M4, J12."""
    j = rel.journal(spark, sf)
    renames = j.select("path").distinct().withColumn("dst", F.concat(F.lit("u"), (F.substring("path", 2, 20).cast("long") + 1).cast("string")))
    return overlay.check_renames(materialize(overlay.replay(j), "live"), renames)


@query(f"""WITH {_MERGED}
SELECT l.path, sha256(CASE WHEN born_seq = -1 THEN 'base' ELSE split_part(l.path, '@', 1) || ':' || e.event_type END || (born_seq % 97)) AS content
FROM live l LEFT JOIN events e ON e.event_id = born_seq""")
def read_live(spark, sf):
    """M9: contents in the merged view, of base files, put files and renamed ones; chunks are shared between them."""
    events, base = table(spark, sf, "events"), rel.base(spark, sf)
    parts = lambda a, b: F.posexplode(F.array(a, b)).alias("ordinal", "text")
    who = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    puts = events.where("event_type IN ('signup', 'purchase')").select(
        F.col("event_id").alias("seq"), who.alias("path"), parts(F.concat(who, F.lit(":"), "event_type"), (F.col("event_id") % 97).cast("string"))
    )
    first = base.select(F.lit(-1).cast("long").alias("seq"), "path", parts(F.lit("base"), F.lit("-1")))
    held = materialize(puts.unionByName(first).select("seq", "path", "ordinal", F.col("text").cast("binary").alias("bytes"), codecs.content_hash(F.col("text").cast("binary")).alias("hash")), "held")
    payload = held.groupBy("hash").agg(F.first("bytes").alias("bytes"), F.lit(0).alias("codec"))
    live = overlay.replay(overlay.with_base(base, rel.journal(spark, sf)))
    read = overlay.read_live(live, held.select("seq", "path", "ordinal", "hash"), payload)
    whole = read.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part"))).alias("p"))  # two parts each
    return whole.select("path", F.sha2(F.concat(F.col("p")[0]["part"], F.col("p")[1]["part"]), 256).alias("content"))


@query(f"""WITH {_MERGED} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS logical_bytes, max(mtime) AS last_commit FROM live""")
def compact_snapshot(spark, sf):
    """M7, A3: a new base from the merged view, written and read again."""
    live = overlay.replay(overlay.with_base(rel.base(spark, sf), rel.journal(spark, sf)))
    snapshot = overlay.compact(live, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}")
    return snapshot.agg(F.count("*").alias("files"), F.sum("u_size").alias("logical_bytes"), F.max("mtime").alias("last_commit"))


@query(f"""WITH {FILES_SQL}, o AS (SELECT sha256(text) AS h, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM files),
  b AS (SELECT k // 4096 AS b, sha256(string_agg(h, ',' ORDER BY k)) AS hash FROM o GROUP BY 1)
SELECT sha256(string_agg(hash, ',' ORDER BY b)) AS digest FROM b""")
def verify_digest(spark, sf):
    """An order-aware digest over all contents."""
    f = rel.files(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"), F.lit(1).cast("long").alias("_one"))
    return integrity.ordered_digest(prefix_sums(f, [], [F.col("doc_id")], {"k": "_one"}), "k", "h")


@query(f"""WITH {CHUNKS_SQL}, l AS (SELECT id, c_size, u_size, coalesce(sum(c_size) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM chunks)
SELECT id, CASE WHEN off < 100000 THEN 'starts before the data' ELSE 'ends behind the data' END AS reason FROM l WHERE off < 100000 OR off + c_size > 20000000""")
def bounds_check(spark, sf):
    """P11, P13."""
    laid = catalog.layout(rel.chunks(spark, sf)).withColumn("codec", F.lit(1))
    return integrity.bound_violations(laid, 100000, 20000000).select("id", "reason")


@query(f"WITH {REFS_SQL}, {CHUNKS_SQL} SELECT archive_id, ordinal, id FROM refs WHERE id NOT IN (SELECT id FROM chunks WHERE id % 50 <> 7)")
def dangling_refs(spark, sf):
    """References to chunks that the table lacks."""
    return integrity.dangling_refs(rel.refs(spark, sf), rel.chunks(spark, sf).where("id % 50 <> 7")).select("archive_id", "ordinal", "id")


@query("""SELECT o_orderkey AS archive_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, substr('archive-' || o_orderkey, 1, 8)) AS name, n AS chunk_refs
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE c_nationkey = 7""")
def owner_scoped_list(spark, sf):
    """A tenant's archives with resolved labels and their statistics."""
    o = table(spark, sf, "orders")
    named = lambda c: F.concat(F.lit("archive-"), F.col(c).cast("string")).alias("archive_id")
    archives = o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        named("o_orderkey"), F.col("c_nationkey").alias("tenant_id"), F.col("o_orderstatus").alias("label"), (F.col("o_orderkey") % 2 != 0).alias("encrypted"), "o_orderkey"
    )
    labels = o.where("o_orderkey % 3 = 0").select(named("o_orderkey"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("updated_at"))
    stats = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chunk_refs")).select(named("l_orderkey"), "chunk_refs")
    return admin.list_archives(archives, labels, stats, 7).select(F.col("o_orderkey").alias("archive_id"), "name", "chunk_refs")


@query(f"""WITH {FILES_SQL}, o AS (SELECT path, doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a/b' WHEN 2 THEN '..' || doc_id ELSE 'v' || doc_id END AS name,
  CASE WHEN doc_id % 5 <> 0 THEN {rel.NOW} + (doc_id % 5) * 20 END AS expires_at FROM files)
SELECT path, name, name <> '' AND NOT contains(name, '/') AND NOT contains(name, '..') AS safe, CASE WHEN path LIKE 'en/%' OR path LIKE 'de/%' THEN substr(path, 4) ELSE path END AS relative,
  ltrim('//' || path, '/') AS bare, expires_at, {rel.NOW} + 50 >= expires_at - 30 AS expired, left(path, 4) AS preview FROM o""")
def path_and_token_rules(spark, sf):
    """Relative paths, archive ids, expiry and previews."""
    p, k = F.col("path"), F.col("doc_id")
    name = F.when(k % 4 == 0, "").when(k % 4 == 1, "a/b").when(k % 4 == 2, F.concat(F.lit(".."), k.cast("string"))).otherwise(F.concat(F.lit("v"), k.cast("string")))
    expires = fn.expires_at(F.lit(rel.NOW), k % 5 * 20)
    return rel.files(spark, sf).select(
        "path",
        name.alias("name"),
        fn.is_safe_archive_id(name).alias("safe"),
        fn.relative_to(p, ["en", "de/"]).alias("relative"),
        fn.without_leading_slashes(F.concat(F.lit("//"), p)).alias("bare"),
        expires.alias("expires_at"),
        fn.is_expired(expires, F.lit(rel.NOW + 50)).alias("expired"),
        fn.preview_text(p.cast("binary"), 4).alias("preview"),
    )


@query("""WITH c AS (SELECT o_custkey AS archive_id, o_orderpriority AS label, o_orderdate AS updated_at FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY updated_at DESC, label DESC) AS k FROM c)
SELECT archive_id, label FROM k WHERE k = 1""")
def label_upsert(spark, sf):
    """Labels after all changes, the last write of an archive wins."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("archive_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("updated_at"), "o_orderstatus")
    return admin.upsert_labels(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")).select("archive_id", "label")


@query("""SELECT c_custkey AS archive_id, CASE WHEN c_nationkey % 2 = 1 THEN c_mktsegment END AS label, CASE WHEN c_acctbal > 0 THEN c_name END AS owner FROM customer""")
def issue_archives(spark, sf):
    """M8: new archives; empty strings are no label or owner, ids that exist stay as they are."""
    c = table(spark, sf, "customer")
    rows = c.select(
        F.col("c_custkey").alias("archive_id"),
        F.when(F.col("c_nationkey") % 2 == 1, F.col("c_mktsegment")).otherwise("").alias("label"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("owner"),
        F.lit("").alias("notes"),
    )
    there = admin.issue(rows.limit(0), rows.where(F.col("owner") == ""))
    return admin.issue(there, rows).select("archive_id", "label", "owner")


_USERS = """SELECT c_custkey AS user_id, c_name AS email, c_nationkey AS tenant_id FROM customer WHERE c_acctbal > 0"""


@query(f"""WITH u AS ({_USERS}), k AS (SELECT sha256('key-' || o_orderkey) AS key_hash, o_custkey AS user_id, o_orderstatus = 'F' AS revoked,
  CASE WHEN o_orderkey % 4 <> 0 THEN {rel.NOW} + (o_orderkey % 7 - 3) * 1000 END AS expires_at FROM orders)
SELECT key_hash, user_id, email, tenant_id, n_name AS tenant FROM k JOIN u USING (user_id) JOIN nation ON n_nationkey = tenant_id
WHERE NOT revoked AND (expires_at IS NULL OR expires_at > {rel.NOW})""")
def live_tokens(spark, sf):
    """P19, P20, J9, F17."""
    o = table(spark, sf, "orders")
    keys = o.select(
        F.sha2(F.concat(F.lit("key-"), F.col("o_orderkey").cast("string")), 256).alias("key_hash"),
        F.col("o_custkey").alias("user_id"),
        (F.col("o_orderstatus") == "F").alias("revoked"),
        F.when(F.col("o_orderkey") % 4 != 0, F.lit(rel.NOW) + (F.col("o_orderkey") % 7 - 3) * 1000).alias("expires_at"),
    )
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.col("c_nationkey").alias("tenant_id"), (F.col("c_acctbal") > 0).alias("active"))
    keys = keys.join(users.select(F.col("id").alias("user_id"), "tenant_id"), "user_id")
    tenants = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return admin.resolve_keys(keys, users, tenants, rel.NOW)


@query(f"""WITH {FILES_SQL} SELECT path, path NOT LIKE '%../%' AND NOT starts_with(path, '/') AS safe,
  octet_length(encode(trim(archive_id))) BETWEEN 1 AND 128 AS labelled, regexp_extract(path, '[^/]*$') AS name FROM (SELECT CASE doc_id % 4 WHEN 0 THEN '/' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN '../' ELSE '' END || path AS path, archive_id FROM files)""")
def path_safety(spark, sf):
    """P14, P16, F29, F32."""
    f = rel.files(spark, sf)
    odd = F.concat(F.when(F.col("doc_id") % 4 == 0, "/").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "../").otherwise(""), F.col("path"))
    return f.select(odd.alias("path"), fn.is_safe_to_extract(odd).alias("safe"), fn.is_valid_label(F.col("archive_id")).alias("labelled"), fn.basename(odd).alias("name"))


@query("""WITH f AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
SELECT 'c' || conv_id AS stream_id, 'conv/' || conv_id AS path, sha256(string_agg(text, '' ORDER BY turn)) AS content FROM f GROUP BY conv_id""")
def upload_reassembly(spark, sf):
    """Conversations as upload streams: header, one file of a data frame per turn, finalize."""
    conv = table(spark, sf, "conversations")
    stream = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    data = conv.select(stream.alias("stream_id"), (rank + 1).cast("long").alias("seq"), F.lit("data").alias("kind"), F.lit(None).cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    per = conv.groupBy("conv_id").agg(F.count("*").alias("n"))
    marks = F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit("header").alias("kind"), F.lit(None).cast("string").alias("path")),
        F.struct(F.lit(1).cast("long").alias("seq"), F.lit("file").alias("kind"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path")),
        F.struct((F.col("n") + 2).alias("seq"), F.lit("finalize").alias("kind"), F.lit(None).cast("string").alias("path")),
    )
    edges = per.select(stream.alias("stream_id"), F.explode(marks).alias("m")).select("stream_id", "m.*", F.lit(None).cast("binary").alias("data"))
    return uploads.reassemble(data.unionByName(edges)).select("stream_id", "path", F.sha2("content", 256).alias("content"))


@query()
def cdc_dedup(spark, sf):
    """Content-defined chunks of every document at small sizes, deduplicated per archive."""
    f = rel.files(spark, sf).select(F.concat_ws("/", "archive_id", "path").alias("path"), F.col("text").cast("binary").alias("content"))
    chunks = chunk_files(f, 64, 256, 1024).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("archive_id"), "u_size", F.sha2("content", 256).alias("hash"))
    per = chunks.groupBy("archive_id", "hash").agg(F.max("u_size").alias("u"), F.count("*").alias("n"), F.sum("u_size").alias("l"))
    return per.groupBy("archive_id").agg(F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum("l").alias("logical_bytes"), F.sum("u").alias("stored_bytes"))


@query()
def pack_verify(spark, sf):
    """Chunk, deduplicate, compress and lay out all documents, then verify every hash and size."""
    f = rel.files(spark, sf).select(F.concat_ws("/", "archive_id", "path").alias("path"), F.col("text").cast("binary").alias("content"))
    refs, chunks, payload = catalog.pack(chunk_files(f, 1 << 10, 4 << 10, 16 << 10), codecs.encode(F.col("content")))
    refs, chunks = materialize(refs, "refs"), materialize(chunks, "chunks")
    bad = integrity.corrupt_chunks(chunks, payload).count() + integrity.dangling_refs(refs, chunks).count()
    return catalog.stats(f.select("path", F.octet_length("content").alias("u_size")), refs, chunks).withColumn("corrupt", F.lit(bad))
