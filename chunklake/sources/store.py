"""Archives as folders of Parquet tables, partitioned by tenant and archive; sidecars and journals beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["files", "dirs", "chunk_refs", "chunks", "payload"]


class ArchiveStore:
    """A folder with one table per relation; (tenant_id, archive_id) are partitions, so a listing reads their folders only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, name: str, rows: DataFrame, tenant_id: str, archive_id: str) -> None:
        placed = rows.withColumns({"tenant_id": F.lit(tenant_id), "archive_id": F.lit(archive_id)})
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy("tenant_id", "archive_id").parquet(f"{self.root}/{name}")

    def read(self, name: str, tenant_id: str | None = None, archive_id: str | None = None) -> DataFrame:
        out = self.spark.read.parquet(f"{self.root}/{name}")
        if tenant_id is not None:
            out = out.where(F.col("tenant_id") == tenant_id)
        return out if archive_id is None else out.where(F.col("archive_id") == archive_id)

    def append_journal(self, records: DataFrame) -> None:
        records.write.mode("append").json(f"{self.root}/journal")

    def journal(self, schema: str) -> tuple[DataFrame, DataFrame]:
        """(good records, quarantined lines): a line that isn't a record is kept aside, not lost."""
        lines = self.spark.read.text(f"{self.root}/journal")
        parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
        return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select("value")

    def labels(self) -> DataFrame:
        """archive_id, label, updated_at from the JSON sidecars; one that can't be parsed gives nulls."""
        text = self.spark.read.text(f"{self.root}/labels", wholetext=True).withColumn("_file", F.col("_metadata.file_name"))
        parsed = F.from_json("value", "label string, updated_at long")
        return text.select(F.regexp_extract("_file", r"^(.*?)(\.json)?$", 1).alias("archive_id"), parsed["label"].alias("label"), parsed["updated_at"].alias("updated_at"))
