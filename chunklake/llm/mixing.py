"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.operators.prefix import prefix_sums
from chunklake.session import discard, materialize

#: Rates are rounded on a grid of 2**-GRID, so running sums are exact and reruns agree; they fit a long for 2**38 rows of one source.
GRID = 24
#: Newton steps between two looks at whether all sources are done; a step leaves a source alone that is.
STEPS = 4
#: Starts of the rounding grid that are tried for each source.
STARTS = 32


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes other than space and 0x09-0x0D; null: 0. One regex pass, no array of words."""
    runs = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x"))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), runs).otherwise(F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size and target. Sources by code point, null last, take ``weights`` in turn.

    ``share`` of all sizes is dealt by weight; no target exceeds ``most`` times its source's size, and the excess
    goes to the others by weight. In the order of capacity per weight, the sources that are full form a prefix;
    the common level is the one at which the next source isn't full, the largest such.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per.withColumn("_w", F.element_at(listed, (F.row_number().over(order) - 1) % len(weights) + 1))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    full, used = F.coalesce(F.sum("_cap").over(by_level), F.lit(0.0)), F.coalesce(F.sum("_w").over(by_level), F.lit(0.0))
    levels = weighed.withColumn("_level", (budget - full) / (F.sum("_w").over(everything) - used))
    level = F.coalesce(F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(everything), F.lit(float("inf")))
    return levels.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * level).alias("target"))


def _newton_step(state: DataFrame, bars: DataFrame, most: float) -> DataFrame:
    """One safeguarded step for every source that isn't done yet. It reads the state once, so its plan stays small."""
    s, b = state.alias("s"), bars.alias("b")
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(most), F.exp(F.col("tilt") * x))
    exact = lambda c: F.sum(c.cast("decimal(30,6)")).cast("double")
    j = (
        b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
        .groupBy(*[F.col(f"s.{c}") for c in state.columns])
        .agg(
            exact(rate * F.col("size") * F.col("n")).alias("got"),
            exact(F.when(rate < most, rate * x * F.col("size") * F.col("n")).otherwise(0.0)).alias("slope"),
        )
    )
    over = F.col("got") > F.col("target")
    low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
    step = F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope")
    fine = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= F.greatest(F.col("target") * 1e-7, F.lit(1e-3)))
    kept = lambda new, old: F.when(fine, F.col(old)).otherwise(new)
    moved = F.when((F.col("slope") > 0) & (step > low) & (step < high), step).otherwise((low + high) / 2)
    return j.select("source", "mean", "target", kept(moved, "tilt").alias("tilt"), kept(low, "low").alias("low"), kept(high, "high").alias("high"), fine.alias("done"))


def _tilts(sizes: DataFrame, targets: DataFrame, most: float, rounds: int = 40) -> DataFrame:
    """Per source the multiplier of the dual: rates min(most, exp(tilt * size / mean size)) sum to the target.

    Safeguarded Newton steps for all sources at once over the histogram of (source, size). Sums are of decimals,
    so their order doesn't matter. A source at ``most`` times its size has all rates at ``most`` (tilt infinite).
    """
    bars = materialize(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-bars")
    docs = bars.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    start = docs.join(targets, same(docs, targets)).select(
        docs["source"],
        "mean",
        "target",
        F.when(F.col("target") >= F.col("source_size") * most, float("inf")).otherwise(0.0).alias("tilt"),
        F.lit(-60.0).alias("low"),
        F.lit(60.0).alias("high"),
        (F.col("target") >= F.col("source_size") * most).alias("done"),
    )
    state = materialize(start, "mix-tilts")
    for _ in range(-(-rounds // STEPS)):
        if state.where(~F.col("done")).isEmpty():
            break
        for _ in range(STEPS):
            after = materialize(_newton_step(state, bars, most), "mix-tilts")
            discard(state)
            state = after
    return state.select("source", "mean", "tilt")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many copies of each document bring every source near its token target.

    Entropy balancing from rates of 1: the rates with the least relative entropy whose tokens meet the targets are
    exponentials in the size, cut at ``most``; distributed Newton steps find each source's multiplier. Rates become
    0..most whole copies by systematic rounding along each source's rows by size: the running sum of rates, shifted
    by a start, gives a copy whenever it passes a whole number. Of STARTS starts each source takes the one whose
    words come nearest to its target.

    Nulls: a null source is a source (last), a null text has size 0; documents of size 0 take 0 words and no
    copies. Empty table: no rows. Repeated rows are separate documents. Other columns are ignored.
    Returns id, source, size, source_size, target, copies, taken (copies times size).
    """
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, float(most)), "mix-targets")
    tilts = _tilts(sizes, targets, float(most))
    s, t, m = sizes.alias("s"), targets.alias("t"), tilts.alias("m")
    joined = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).join(m, F.col("s.source").eqNullSafe(F.col("m.source")), "left")
    rate = F.when(F.col("s.size") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("s.size") / F.col("mean"))))
    rated = joined.select("s.doc_id", "s.source", "s.size", "source_size", "target", F.round(rate * 2.0**GRID).cast("long").alias("_rate"))
    run = materialize(prefix_sums(rated, ["source"], [F.col("size").desc(), F.col("doc_id")], {"_before": "_rate"}), "mix-rates")

    starts = [(2 * k + 1) * (1 << GRID) // (2 * STARTS) for k in range(STARTS)]
    tried = run.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(copies_at(F.lit(u)) * F.col("size")).alias(f"_{k}") for k, u in enumerate(starts)])
    misses = F.array(*[F.struct(F.abs(F.col(f"_{k}") - F.col("target")).alias("miss"), F.lit(u).alias("start")) for k, u in enumerate(starts)])
    best = tried.select(F.col("source").alias("_source"), F.array_min(misses)["start"].alias("_start"))
    chosen = run.join(best, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", copies_at(F.col("_start")))
    return chosen.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies_at(start: Column) -> Column:
    """Whole copies of a row whose running rate passes whole numbers, counted from ``start``."""
    grid = F.lit(1 << GRID)
    return (F.floor((F.col("_before") + F.col("_rate") + start) / grid) - F.floor((F.col("_before") + start) / grid)).cast("long")
