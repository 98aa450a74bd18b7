"""Session helpers: the shared folder for intermediate tables, and writing and rereading one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Long keys that are broadcast at most, by keys_to_join(): about 100 MB as a hash table.
KEYS = 1 << 21


def build_session(app: str = "chunklake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this engine expects; anything the cluster sets stays as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    A local session without that setting gets a temporary folder; a cluster without it is an error,
    as a machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chunklake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.table_path = path
    return again


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialize() result that nothing reads any more."""
    path = getattr(df, "table_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def keys_to_join(keys: DataFrame, label: str = "keys") -> DataFrame:
    """A column of long keys, written; up to KEYS of them are broadcast, so the wide table that they pick rows of is not shuffled."""
    keys = materialize(keys, label)
    return F.broadcast(keys) if keys.count() <= KEYS else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
