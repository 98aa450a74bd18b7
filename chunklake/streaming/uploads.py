"""Streams: reassembly of framed uploads, and following a journal into live files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunklake.operators.overlay import replay

FILE = "stream_id string, path string, content binary"


def reassemble(frames: DataFrame) -> DataFrame:
    """(stream_id, path, content) of finished files from frames (stream_id, seq, kind, path, data); batch or streaming.

    kinds: header, file, data, finalize. Frames are applied in the order of seq from 0; frames that come early wait in the
    state, and repeated ones are ignored. A file ends with the next file frame or with finalize.
    """
    if not frames.isStreaming:
        known = frames.dropDuplicates(["stream_id", "seq"])
        return known.groupBy("stream_id").applyInPandas(lambda key, rows: _files(key[0], _advance((0, None, b"", {}), rows)[1]), FILE)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = (state.get[0], state.get[1], bytes(state.get[2]), {r["seq"]: (r["kind"], r["path"], bytes(r["data"] or b"")) for r in state.get[3]}) if state.exists else (0, None, b"", {})
        done: list[tuple[str, bytes]] = []
        for rows in parts:
            now, more = _advance(now, rows)
            done += more
        waiting = [{"seq": s, "kind": k, "path": p, "data": d} for s, (k, p, d) in sorted(now[3].items())]
        state.update((now[0], now[1], now[2], waiting))
        yield _files(key[0], done)

    held = "next long, path string, content binary, waiting array<struct<seq: long, kind: string, path: string, data: binary>>"
    return frames.groupBy("stream_id").applyInPandasWithState(step, FILE, held, "append", GroupStateTimeout.NoTimeout)


def _advance(now: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple[str, bytes]]]:
    seq, path, content, waiting = now
    done = []
    for s, k, p, d in zip(rows["seq"], rows["kind"], rows["path"], rows["data"], strict=True):
        if s >= seq:
            waiting[int(s)] = (k, p, bytes(d) if d is not None else b"")
    while seq in waiting:
        kind, name, data = waiting.pop(seq)
        seq += 1
        if kind in ("file", "finalize"):
            if path is not None:
                done.append((path, content))
            path, content = (name, b"") if kind == "file" else (None, b"")
        elif kind == "data":
            content += data
    return (seq, path, content, waiting), done


def _files(stream: str, done: list[tuple[str, bytes]]) -> pd.DataFrame:
    return pd.DataFrame([(stream, p, c) for p, c in done], columns=["stream_id", "path", "content"])


def follow_journal(journal: DataFrame, keep: Callable[[DataFrame], None], history: Callable[[], DataFrame], checkpoint: str) -> StreamingQuery:
    """Follow a journal stream: every micro-batch replays the history, which holds the batch, for the paths it touches.

    ``history`` returns all records so far; ``keep`` gets the new live rows of (touched path, live file or nulls).
    A repeated batch gives the same rows, so an idempotent ``keep`` makes the whole exactly-once.
    """

    def step(batch: DataFrame, _: int) -> None:
        touched = batch.select(F.explode(F.array_compact(F.array("path", "dst"))).alias("path")).distinct()
        keep(touched.join(replay(history()), "path", "left"))

    return journal.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
