"""The corpus pipeline: quality, near copies, benchmark leaks, source mixture, shards; each stage's table feeds the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm.classifier import grades, score, train
from chunklake.llm.decontaminate import contamination
from chunklake.llm.mixing import mix
from chunklake.llm.shards import shard_by_bytes
from chunklake.llm.neardup import near_duplicates
from chunklake.session import keys_to_join, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_rows(docs: DataFrame) -> DataFrame:
    """docs, read from Parquet, with each row's own key _row by file and place; ids may be null or repeated."""
    return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good at even odds by the ordinal model of the labels."""
    model = train(docs, grades(table(spark, sf_dir, "labels")))
    return score(docs.select(*COLUMNS), model, at_least=2).where("p_select >= 0.5").select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, null last; documents without words are no copies."""
    rows = with_rows(docs)
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    copies = materialize(rows.select("_row", place.alias("_place")).join(found, "_row"), "near-rows")
    first = copies.groupBy("component_id").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    gone = copies.join(first, "component_id").where("_row <> _first._row").select("_row")
    return rows.join(keys_to_join(gone, "near-gone"), "_row", "left_anti").select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    rows = with_rows(docs)
    hit = contamination(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where(F.size("runs") > 0)
    return rows.join(keys_to_join(hit.select(F.col("doc_id").alias("_row")), "leaked"), "_row", "left_anti").select(*COLUMNS)


def take_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mixture takes; a document with no copies goes."""
    rows = with_rows(docs)
    placed = rows.select(F.struct("doc_id", F.xxhash64("text"), "_row").alias("_place"), "text", "source")
    mixed = mix(placed, weights=[3, 1, 2], share=1.5, most=2, id_col="_place").where("copies > 0").select(F.col("doc_id._row").alias("_row"), "copies")
    taken = rows.join(mixed, "_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The final table: which shard and slot each taken row goes to."""
    return shard_by_bytes(docs, shards=16)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", take_mixture),
    ("sharding", deal_shards),
]

#: A fitted classifier and entropy balancing are not SQL; tests hold each stage of run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
