"""Running sums over any number of rows: per-partition totals first, then offsets, then sums inside partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.session import materialize


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add, for each name in ``sums``, the exclusive running sum of its column within ``keys`` along ``order``.

    A window partitioned by ``keys`` alone would put a hot key (or, without keys, everything) into one
    task. Here the rows are range-partitioned by (keys, order), so a hot key spans many partitions; the
    totals of each (keys, partition) are summed over the few partitions of a key; each partition then
    only adds its offset. The partition number is written with the rows, so a retried task sees the same
    one. Null keys form a key of their own. ``order`` should be total, ties are ordered arbitrarily.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    staged = materialize(ranged.withColumn("_pid", F.spark_partition_id()), "prefix")
    by = [*keys, "_pid"]
    totals = staged.groupBy(*by).agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_o_{c}") for c in by],
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in sums],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in keys] + [F.col("_pid") == F.col("_o__pid")]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(offsets, same, "inner")
    for out, c in sums.items():
        joined = joined.withColumn(out, F.col(f"_b_{out}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return joined.select(*[c for c in staged.columns if c != "_pid"], *sums)
