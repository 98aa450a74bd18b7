"""Chat formatting: reply trees, their best root-to-leaf paths, one formatted conversation per path."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.session import materialize

# The template's marks and other models' control strings (fixed values); texts may not hold any of them.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = [START, END, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]


def escape(text: str) -> str:
    """Double every backslash and put one behind the first character of every control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The formatted conversation, and flat start, end pairs (code points) of the assistant texts in it: the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        if role == "assistant":
            mask += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


_TURN = re.compile(re.escape(START) + r"((?:\\.|[^\\\n])*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _same(a: str, b: str, *cols: tuple[str, str]):
    out = None
    for x, y in cols:
        one = F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}"))
        out = one if out is None else out & one
    return out


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The turns of the best root-to-leaf paths of every tree: tree, path (its leaf), node, depth (from 1).

    nodes: tree, node (unique in its tree), parent, score. A node whose parent is null or missing is a root.
    Paths are ranked by mean score, ties by the smaller leaf; ``branches`` of them are kept per tree.

    Self-joins double the distance: round i joins every node's 2**i-th ancestor with that one's own, so a chain of
    n replies takes log2(n) rounds; each is written to the shared folder. The same tables then list a chosen leaf's
    ancestors: going down the powers of two, each node found so far adds the one 2**i above it. A ring of replies has no root and raises an error.
    """
    n, p = nodes.alias("n"), nodes.select("tree", "node").alias("p")
    found = n.join(p, _same("n", "p", ("tree", "tree"), ("parent", "node")) & F.col("n.parent").isNotNull(), "left")
    base = found.select("n.tree", "n.node", F.col("p.node").alias("up"), F.coalesce("n.score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth"))
    state = materialize(base, "paths")
    limit, jumps, done = state.count().bit_length() + 1, [], []
    while not (active := state.where("up IS NOT NULL")).isEmpty():
        if len(jumps) > limit:
            raise ValueError("replies form a ring")
        jumps.append(active.select("tree", "node", "up"))
        a, b = active.alias("a"), state.alias("b")
        longer = a.join(b, _same("a", "b", ("tree", "tree"), ("up", "node"))).select(
            "a.tree", "a.node", "b.up", (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.depth") + F.col("b.depth")).alias("depth")
        )
        state = materialize(longer.unionByName(state.where("up IS NULL")), "paths")
    leaves = state.alias("s").join(nodes.alias("c"), _same("s", "c", ("tree", "tree"), ("node", "parent")), "left_anti")
    ranked = leaves.withColumn("mean", F.col("total") / F.col("depth")).withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(64)))
    for keys in (["tree", "_part"], ["tree"]):  # first within parts, so a tree of very many leaves is no hot task
        order = Window.partitionBy(*keys).orderBy(F.col("mean").desc(), F.col("node"))
        ranked = ranked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= branches)
    members = ranked.select("tree", F.col("node").alias("path"), "node")
    for up in reversed(jumps):
        m, j = members.alias("m"), up.alias("j")
        both = m.join(j, _same("m", "j", ("tree", "tree"), ("node", "node")), "left")
        members = both.select("m.tree", "m.path", F.explode(F.array_compact(F.array("m.node", "j.up"))).alias("node"))
    m, s = members.alias("m"), state.alias("s")
    return m.join(s, _same("m", "s", ("tree", "tree"), ("node", "node"))).select("m.tree", "m.path", "m.node", "s.depth")


def format_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One formatted conversation per chosen path: tree, path, formatted, loss_mask (flat start, end pairs of code points).

    nodes: tree, node, parent, score, role, text. A null role or text is empty. Each path is gathered into one row, which
    is the result asked for. Empty table: no rows. Repeated nodes of a tree aren't allowed; other columns are ignored.
    """
    paths = best_paths(nodes.select("tree", "node", "parent", "score"), branches)
    p, n = paths.alias("p"), nodes.alias("n")
    turns = p.join(n, _same("p", "n", ("tree", "tree"), ("node", "node"))).groupBy("p.tree", "p.path").agg(
        F.array_sort(F.collect_list(F.struct("p.depth", F.coalesce("n.role", F.lit("")).alias("role"), F.coalesce("n.text", F.lit("")).alias("text")))).alias("turns")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int64()))],
                ["tree", "path", "formatted", "loss_mask"],
            )

    return turns.mapInArrow(run, "tree long, path long, formatted string, loss_mask array<long>")


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations: turns, and the text under the loss mask, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, text, mask in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tree", "formatted", "loss_mask")), strict=True):
                turns = read_back(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True))
                rows.append((tree, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
