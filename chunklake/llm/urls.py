"""URL filters by a sort-merge range join of reversed hosts with rule intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake.session import materialize


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; null or without ://: empty."""
    raw = F.regexp_extract(_after_scheme(url), r"^[^/?#]*+", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or without ://: empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*+([^?#]*+)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a NUL, so that a host and its subdomains are one interval of keys.

    A NUL or 0x01 of the host itself is written as two characters without NUL.
    """
    plain = F.replace(F.replace(host, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\3"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), "\0"), F.lit("\0"))


class HostRules:
    """The rules of one host, whose interval of keys ends at ``to``."""

    def __init__(self, host: str, to: str):
        self.host, self.to = host, to
        self.verdicts: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        self.verdicts[path] = verdict
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> str | None:
        """The longest rule path that ``path`` starts with."""
        return next((path[:n] for n in self.lengths if path[:n] in self.verdicts), None)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row its host, path, the longest rule that fits and the verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's
    path; the longest (host plus path, then host, then by verdict) wins; without any the verdict is ``default``.

    A host's key is its labels in reverse, so a rule covers the interval of keys that begin with its own. The keys
    (with path and id, so a hot host is cut too) are divided into ranges at sampled quantiles; a rule goes to every range that its
    interval meets. Each task walks through its range in order with a stack of the rules whose interval is open: these
    are nested, so the ones that have ended are on top. The stack holds an entry for each host, at most one per label of the page's
    host, with its rules' paths by length, so a page costs labels times lengths, not rules.

    Nulls: a null url, or one without ://, has empty host and path and fits no rule; rules with a null or empty host or
    a null path are ignored. Ties: equal rules count once, by verdict ascending. Repeated rows stay, an empty table gives no
    rows, other columns are ignored. Urls of any length are judged whole. Returns page_id, host, path, rule, verdict.
    """
    keyed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    ranged = keyed.repartitionByRange("key", "path", "page_id").withColumn("bucket", F.spark_partition_id())
    events = materialize(ranged, "urls")
    bounds = events.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    usable = rules.where("host IS NOT NULL AND path IS NOT NULL AND host <> ''").withColumn("from", host_key(F.col("host")))
    usable = usable.groupBy("host", "path", "from").agg(F.min("verdict").alias("verdict"))
    # the smallest string above all that begin with the key: its closing NUL becomes 0x01
    spans = usable.withColumn("to", F.concat(F.expr("left(`from`, length(`from`) - 1)"), F.lit("\1")))
    placed = spans.join(F.broadcast(bounds), (F.col("from") <= F.col("high")) & (F.col("to") > F.col("low")))
    none = F.lit(None)
    page_rows = events.select("bucket", "key", F.lit(1).alias("kind"), "page_id", "host", "path", none.cast("string").alias("to"), none.cast("string").alias("verdict"))
    rule_rows = placed.select("bucket", F.col("from").alias("key"), F.lit(0).alias("kind"), none.cast("long").alias("page_id"), "host", "path", "to", "verdict")
    swept = page_rows.unionByName(rule_rows).repartition("bucket").sortWithinPartitions("bucket", "key", "kind", "host", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[HostRules] = []
        now = None
        for batch in batches:
            out = []
            for b, key, kind, page, host, path, to, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    stack, now = [], b
                while stack and stack[-1].to <= key:
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].host != host:
                        stack.append(HostRules(host, to))
                    stack[-1].add(path, verdict)
                    continue
                fits = [(len(r.host) + len(p), len(r.host), r.host + p, v) for r in stack if (p := r.longest(path)) is not None for v in [r.verdicts[p]]] if host else []
                best = max(fits) if fits else None
                out.append((page, host, path, best and best[2], best[3] if best else default))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    names = ["page_id", "host", "path", "rule", "verdict"]
    types = [pa.int64(), *[pa.string()] * 4]
    return swept.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
