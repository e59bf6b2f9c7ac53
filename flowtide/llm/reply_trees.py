"""Reply trees: every root-to-leaf path by iterative self-joins, branches ranked by score, chosen paths as conversations.

Nodes are (tree, node, parent, role, text, score). Jump tables (the ancestor 1, 2, 4, ... steps up) come from joins of a
table with itself; paths come from joining the leaves with them from the longest jump down, so a path of n turns takes
about 2 log n joins and n rows, never n squared.

Cases: a null text or role counts as empty, a null score as 0; a node without a parent, or whose parent is not in its
tree, is a root; of rows with the same tree and node the one of the smallest (parent, role, text) counts; nodes that reach
no root (circles) are on no path. Trees may have null ids. Ties between branches go to the smaller leaf. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.storage import materialise

LEARNED_ROLE = "assistant"
#: Fixed template: a turn is START, the role, MIDDLE, the text, STOP; the sign before a control string escapes it.
START, MIDDLE, STOP, SIGN = "### ", ": ", "</turn>\n", "\\"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
FORMATTED = "n_turns bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: SIGN + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans (code points) of the texts that a model learns to write."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = START + _ROLE_CONTROL.sub(lambda m: SIGN + m[0], role) + MIDDLE
        body = escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, STOP]
        at += len(head) + len(body) + len(STOP)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Inverse of ``format_turns``."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_loss(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def _same(*pairs):
    out = None
    for a, b in pairs:
        out = a.eqNullSafe(b) if out is None else out & a.eqNullSafe(b)
    return out


def root_to_leaf_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, score, rank, depth, node): a row for each node of each path; ``depth`` counts up from the leaf.

    ``score`` is the sum of the path's node scores; ``rank`` orders the paths of a tree, and ``best`` keeps so many.
    """
    slim = nodes.groupBy("tree", "node").agg(
        F.min(F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("n"))
    slim = materialise(slim.select("tree", "node", F.col("n.parent").alias("up"), F.col("n.score").alias("score")), "tree")
    known = slim.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    rounds = max(1, slim.count()).bit_length()
    first = slim.join(known, _same((F.col("tree"), F.col("t")), (F.col("up"), F.col("n"))), "left")
    first = materialise(first.select("tree", "node", F.col("n").alias("up"), "score"), "jump-0")
    parents = first.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = first.join(parents, _same((F.col("tree"), F.col("t")), (F.col("node"), F.col("n"))), "left_anti")
    # Nodes that have reached their root are done, with the score of their whole path; only the others jump on.
    done, jump, jumps = first.where("up is null"), first.where("up is not null"), []
    while len(jumps) <= rounds and not jump.isEmpty():
        jumps.append(jump.select("tree", "node", "up"))
        above = jump.unionByName(done).select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"), F.col("score").alias("more"))
        moved = jump.join(above, _same((F.col("tree"), F.col("t")), (F.col("up"), F.col("n")))).select(
            "tree", "node", F.col("far").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        moved = materialise(moved, f"jump-{len(jumps)}")
        done, jump = done.unionByName(moved.where("up is null")), moved.where("up is not null")
    rooted = done.select("tree", F.col("node").alias("leaf"), F.col("score").alias("path_score"))
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    chosen = rooted.join(leaves.select("tree", F.col("node").alias("leaf")).withColumnRenamed("tree", "t")
                         .withColumnRenamed("leaf", "l"),
                         _same((F.col("tree"), F.col("t")), (F.col("leaf"), F.col("l"))), "left_semi")
    chosen = chosen.withColumn("rank", F.row_number().over(order))
    if best is not None:
        chosen = chosen.where(F.col("rank") <= best)
    paths = chosen.select("tree", "leaf", F.col("path_score").alias("score"), "rank", F.lit(0).alias("depth"),
                          F.col("leaf").alias("node"))
    paths = materialise(paths, "leaves")
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = paths.join(step, _same((F.col("tree"), F.col("t")), (F.col("node"), F.col("n")))).select(
            "tree", "leaf", "score", "rank", (F.col("depth") + 2**k).alias("depth"), F.col("up").alias("node"))
        paths = paths.unionByName(materialise(further, f"paths-{k}"))
    return paths


def conversations(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """One row per chosen path: tree, leaf, score, rank, n_turns, formatted, loss_spans."""
    paths = root_to_leaf_paths(nodes, best)
    text = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = nodes.groupBy(F.col("tree").alias("t"), F.col("node").alias("n")).agg(F.min(text).alias("turn"))
    told = paths.join(turns, _same((F.col("tree"), F.col("t")), (F.col("node"), F.col("n"))))
    ordered = told.groupBy("tree", "leaf", "score", "rank").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("at"), "turn.role", "turn.text"))).alias("turns"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name != "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in row.as_py()]) for row in batch.column("turns")]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "turns"}
            yield pa.RecordBatch.from_pydict(columns | {
                "n_turns": pa.array([len(row) for row in batch.column("turns")], pa.int64()),
                "formatted": pa.array([text for text, _ in made], pa.string()),
                "loss_spans": pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], span),
            })

    return ordered.mapInArrow(run, f"{keys}, {FORMATTED}")
