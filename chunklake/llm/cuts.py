"""Cutting byte spans out of whole texts, with the original offsets of what stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_spans(docs: DataFrame, spans: DataFrame, by: list[str] | None = None, mark: str | None = None) -> DataFrame:
    """Remove the spans (doc_id, start, end in UTF-8 bytes; they may overlap) from every row's text.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, text (what is left, invalid ends
    of characters replaced), kept (original [start, end) pairs, flat) and n_marked. Spans whose column ``mark`` is true aren't removed; n_marked counts the bytes
    that they cover. Spans belong to the rows with the same
    values of ``by``; a null
    text counts as empty; spans beyond a text are clipped.
    """
    by = by or ["doc_id"]
    marked = F.col(mark) if mark else F.lit(False)
    sorted_spans = lambda rows: F.array_sort(F.collect_set(F.when(rows, F.struct("start", "end"))))
    per_doc = spans.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(sorted_spans(~marked).alias("spans"), sorted_spans(marked).alias("marks"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    joined = docs.join(per_doc, same, "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans", "marks")

    def merged(found: list[dict] | None, size: int) -> list[tuple[int, int]]:
        """The maximal runs of sorted spans within a text of ``size`` bytes."""
        runs: list[tuple[int, int]] = []
        for s in found or []:
            a, b = max(0, s["start"]), min(size, s["end"])
            if a < b and runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            elif a < b:
                runs.append((a, b))
        return runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found, marks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = (text or "").encode()
                runs = merged(found, len(raw))
                bounds = [0, *(x for r in runs for x in r), len(raw)]
                kept = [x for a, b in zip(bounds[::2], bounds[1::2], strict=True) if a < b for x in (a, b)]
                removed = sum(b - a for a, b in runs)
                left = b"".join(raw[kept[k] : kept[k + 1]] for k in range(0, len(kept), 2)) if runs else raw
                covered = sum(b - a for a, b in merged(marks, len(raw)))
                out.append((doc, len(raw), removed, len(runs), hashlib.sha256(left).hexdigest(), left.decode(errors="replace"), kept, covered))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "kept", "n_marked"]
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, kept array<long>, n_marked long")
