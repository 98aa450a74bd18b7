"""Directory trees as files, and files back to a tree."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions.scalars import is_safe_to_extract


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """files(path, mode, mtime, u_size, content) below root, paths relative to it. Links aren't followed beyond Spark's reader.

    Spark's readers skip empty files, so those come from the file system's listing on the driver, as file listings do anyway.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = raw.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("u_size"), "content")
    empty = spark.createDataFrame(_empty_files(spark, root), "path string, mtime long")
    every = found.unionByName(empty.withColumns({"u_size": F.lit(0).cast("long"), "content": F.lit(b"")}))
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    top = root.split("://", 1)[-1].rstrip("/") + "/"
    return every.select(F.substr(plain, F.instr(plain, top) + len(top)).alias("path"), F.lit(0o100644).cast("long").alias("mode"), "mtime", "u_size", "content")


def _empty_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    out = []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            out.append((status.getPath().toString(), status.getModificationTime() // 1000))
    return out


def dirs_of(files: DataFrame) -> DataFrame:
    """All parent directories of the files' paths."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.where(F.contains("path", F.lit("/"))).select(F.explode(prefixes).alias("path")).where("path <> ''").distinct()


def write_tree(files: DataFrame, out: str) -> DataFrame:
    """Write files (path, content) below ``out``, a folder that all executors share; unsafe paths are refused.

    Returns (path, bytes written or null if refused). A retried task writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, content, safe in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not safe:
                    done.append(None)
                    continue
                target = os.path.join(out, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.part", "wb") as f:
                    f.write(content or b"")
                os.replace(f"{target}.part", target)
                done.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.int64())], ["path", "written"])

    return files.select("path", "content", is_safe_to_extract(F.col("path")).alias("safe")).mapInArrow(run, "path string, written long")
