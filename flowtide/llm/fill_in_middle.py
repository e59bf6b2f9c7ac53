"""Fill-in-middle: whole texts cut at two token units and put in an order that a model can fill.

Units are runs of letters A-Z and single other code points. A text is seen as fixed blocks of code points; a Fenwick tree
over the blocks holds how many units begin in each and how many code points it has. Descending by powers of two finds the
block in which a cut unit begins and all that stands before it, and the cut is then located inside that block alone. Only
one block is held as numbers at a time.

Cases: a null or empty text is plain; a null id counts as the empty string in the draw and is kept; rows may repeat, each
is formed by itself (equal ids are cut alike); columns other than id and text are not read. An empty table gives an empty
result. Texts are formed whole, at any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a block.
BLOCK = 4096
#: Percentages: texts that stay plain, and transformed ones that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
FORMED = pa.schema([
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output", pa.string()),
])


def unit_starts(block: str, after_letter: bool) -> tuple[np.ndarray, bool]:
    """Which code points of a block begin a unit, and whether its last one is a letter."""
    codes = np.frombuffer(block.encode("utf-32-le"), np.uint32)
    letter = ((codes | 32) - np.uint32(97)) < 26
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[0] |= not after_letter
    return starts, bool(letter[-1])


class BlockTree:
    """Fenwick tree over the blocks of a text: sums of (units that begin in a block, code points)."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        rows, letter = [(0, 0)], False
        for at in range(0, len(text), block):
            piece = text[at:at + block]
            starts, letter = unit_starts(piece, letter)
            rows.append((int(starts.sum()), len(piece)))
        self.n = len(rows) - 1
        self.units = sum(u for u, _ in rows)
        self.tree = rows
        for i in range(1, self.n + 1):
            up = i + (i & -i)
            if up <= self.n:
                self.tree[up] = (self.tree[up][0] + self.tree[i][0], self.tree[up][1] + self.tree[i][1])

    def cut(self, k: int) -> int:
        """The code points before unit ``k`` (from 0); all of them for ``k`` = the number of units."""
        if k >= self.units:
            return len(self.text)
        at, units, chars = 0, 0, 0
        step = 1 << self.n.bit_length()
        while step:
            to = at + step
            if to <= self.n and units + self.tree[to][0] <= k:
                at, units, chars = to, units + self.tree[to][0], chars + self.tree[to][1]
            step >>= 1
        after_letter = chars > 0 and self.text[chars - 1].isascii() and self.text[chars - 1].isalpha()
        starts, _ = unit_starts(self.text[chars:chars + self.block], after_letter)
        return chars + int(np.flatnonzero(starts)[k - units])


def draws(key: str, seed: str) -> list[int]:
    """The first four 8-digit groups of the digest of seed and id, as whole numbers."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def form(key: str, text: str, seed: str = "1", block: int = BLOCK) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle in code points, output) of one text."""
    tree = BlockTree(text, block)
    n = tree.units
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= 100 - PLAIN or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((tree.cut(h1 % (n + 1)), tree.cut(h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", first, second - first, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(form_name: str, output: str) -> str:
    """The exact text, from output and form."""
    if form_name == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form_name == "spm":
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX, 1)
    else:
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX, 1)
    return "".join((prefix, middle, suffix))


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "1") -> DataFrame:
    """Per document: id, n (units), form, prefix_chars, middle_chars, output; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).cast("string").alias("id"), whole_text(text).alias("text"))
    schema = pa.schema([pa.field("id", pa.string()), *FORMED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [form(key or "", value.as_py(), seed)
                    for key, value in zip(batch.column("id").to_pylist(), batch.column("text"))]
            columns = list(zip(*rows)) if rows else [()] * len(FORMED)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, f.type) for c, f in zip(columns, FORMED)]], schema=schema)

    out = slim.mapInArrow(
        run, "id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def restored(formed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of ``formed`` and ``restored``: the text built from form and output, in column functions."""
    out = F.col("output")
    middle_at = F.instr(out, MIDDLE)
    inner = F.when(F.col("form") == "spm", F.instr(out, PREFIX)).otherwise(F.instr(out, SUFFIX))
    left = out.substr(F.lit(len(PREFIX) + 1), inner - len(PREFIX) - 1)
    right = out.substr(inner + len(PREFIX), middle_at - inner - len(PREFIX))
    middle = out.substr(middle_at + len(MIDDLE), F.length(out))
    prefix, suffix = (F.when(F.col("form") == "spm", x).otherwise(y) for x, y in ((right, left), (left, right)))
    whole = F.when(F.col("form") == "plain", out).otherwise(F.concat(prefix, middle, suffix))
    return formed.withColumn("restored", whole)
