"""Vector codes: vectors of whole numbers cut into parts, each part replaced by the nearest entry of its codebook.

Codebooks are learned by rounds of assignment and update. Between rounds every part of every vector keeps its entry, its b
next closest entries with lower bounds of their distances, and one outer bound for all others. When entries move, bounds
shrink by how far; only if they no longer prove the entry to be the nearest are distances worked out again, of as many close
entries as are in doubt, or of all. b is set for each part and round by how many close entries were in doubt. What decides
is always a comparison of exact whole numbers, so codes are those of an exhaustive search, ties to the lower entry.

Cases: a null vector, and one with null or non-finite components, is dropped, as the contract says. The width is that of
the kept vector with the smallest id (nulls last); vectors of another width, or with fewer components than parts or a
number that parts do not divide, cannot be cut alike and are dropped. Whole components are held within 2^24. Rows may
repeat, each counts; equal ids are taken in order of their vectors. Null ids are kept; null labels are one label. With
fewer vectors than entries the codebooks are shorter. Columns other than id, vector and label are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.storage import materialise

from .common import spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole components beyond this are held there, so that sums of squares stay within 64 bits up to 8,000 components.
LARGEST = 1 << 24
#: Close entries that a part keeps in the first round, and the least and most later.
FIRST_B, LEAST_B, MOST_B = 8, 2, 16
#: Share of the parts whose doubts the kept entries are to cover.
COVERED = 0.98
#: Numbers that one step may hold at once.
STEP = 1 << 21
SLACK = 1e-12


def whole_vectors(rows: DataFrame, id_col: str, vector: str, label: str | None, parts: int) -> DataFrame:
    """(vec_id, vec, label): vectors without gaps, as whole numbers."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    wide = F.col(vector).cast("array<double>")
    n = F.size(wide)
    clean = F.col(vector).isNotNull() & (n > 0) & (n % parts == 0) & F.forall(wide, finite)
    held = F.transform(wide, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(
        -float(LARGEST)))).cast("int"))
    named = F.lit(None).cast("string") if label is None else F.col(label)
    return rows.where(clean).select(F.col(id_col).alias("vec_id"), held.alias("vec"), named.alias("label"))


@dataclass
class Parts:
    """What a batch knows of one part: entry, squared distance, close entries with lower bounds, bound of all others."""

    code: np.ndarray
    error: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray
    doubts: np.ndarray


def _squares(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)[None, :]


def _below(values: np.ndarray) -> np.ndarray:
    """Roots of whole squares as single-precision lower bounds."""
    return np.nextafter(np.sqrt(values.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def search(part: np.ndarray, book: np.ndarray, b: int) -> Parts:
    """All distances: the nearest entry and the b next ones."""
    n, k = len(part), len(book)
    b = min(b, k - 1)
    out = Parts(np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros((n, b), np.uint8),
                np.zeros((n, b), np.float32), np.full(n, np.inf, np.float32), np.full(n, b + 1, np.int64))
    step = max(1, STEP // max(k, 1))
    for at in range(0, n, step):
        rows = slice(at, at + step)
        squares = _squares(part[rows], book)
        order = np.argsort(squares, axis=1, kind="stable")[:, :b + 2]
        sorted_squares = np.take_along_axis(squares, order, 1)
        out.code[rows], out.error[rows] = order[:, 0], sorted_squares[:, 0]
        out.near[rows], out.low[rows] = order[:, 1:b + 1], _below(sorted_squares[:, 1:b + 1])
        if k > b + 1:
            out.outer[rows] = _below(sorted_squares[:, b + 1])
    return out


def refresh(part: np.ndarray, book: np.ndarray, moved: np.ndarray, known: Parts, b: int) -> Parts:
    """The nearest entries after the entries moved (``moved``: how far), by bounds where they suffice."""
    n, kept = known.near.shape
    farthest = moved.max(initial=0.0)
    low = known.low.astype(np.float64)
    low = low - moved[known.near] - SLACK * (np.abs(low) + farthest)
    outer = known.outer.astype(np.float64)
    outer = np.where(np.isinf(outer), np.inf, outer - farthest - SLACK * (np.abs(outer) + farthest))
    ordered = np.minimum.accumulate(np.concatenate([low, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    error = ((part - book[known.code]) ** 2).sum(1)
    reach = np.sqrt(error.astype(np.float64)) * (1 + SLACK)
    doubts = (ordered <= reach[:, None]).sum(1)
    code, near = known.code.copy(), known.near.copy()
    some = np.flatnonzero((doubts > 0) & (doubts <= kept))
    step = max(1, STEP // max((kept + 1) * part.shape[1], 1))
    for at in range(0, len(some), step):
        rows = some[at:at + step]
        choice = np.concatenate([code[rows, None], near[rows]], axis=1)
        squares = ((part[rows][:, None, :] - book[choice]) ** 2).sum(2)
        tried = np.arange(kept + 1)[None, :] <= doubts[rows, None]
        squares = np.where(tried, squares, np.iinfo(np.int64).max)
        order = np.lexsort((choice, squares), axis=1)
        order = np.where(tried, order, np.arange(kept + 1)[None, :])
        choice, squares = np.take_along_axis(choice, order, 1), np.take_along_axis(squares, order, 1)
        code[rows], error[rows] = choice[:, 0], squares[:, 0]
        near[rows] = choice[:, 1:]
        low[rows] = np.where(tried[:, 1:], _below(np.where(tried, squares, 0)[:, 1:]), low[rows])
    out = Parts(code, error, near, np.nextafter(low.astype(np.float32), np.float32(-np.inf)),
                np.nextafter(outer.astype(np.float32), np.float32(-np.inf)), doubts)
    every = np.flatnonzero(doubts > kept)
    if len(every):
        again = search(part[every], book, kept)
        for name in ("code", "error", "near", "low", "outer"):
            getattr(out, name)[every] = getattr(again, name)
    return narrowed(out, b)


def narrowed(known: Parts, b: int) -> Parts:
    """With at most b close entries: the bounds of the others join the outer bound."""
    if b < known.near.shape[1]:
        known.outer = np.minimum(known.outer, known.low[:, b:].min(1))
        known.near, known.low = known.near[:, :b], known.low[:, :b]
    return known


STATE = "vec_id {0}, label {1}, vec array<int>, codes binary, error bigint, state binary, sums array<bigint>"


def _packed(parts: list[Parts]) -> list[bytes]:
    """Per row, for each part: close entries, then their bounds and the outer bound."""
    columns = [c for p in parts for c in (
        p.near, np.ascontiguousarray(np.concatenate([p.low, p.outer[:, None]], 1)).view(np.uint8))]
    return [row.tobytes() for row in np.concatenate(columns, axis=1)]


def _unpacked(state: pa.Array, codes: np.ndarray, b: list[int]) -> list[Parts]:
    n = len(state)
    raw = np.frombuffer(b"".join(state.to_pylist()), np.uint8).reshape(n, -1)
    out, at = [], 0
    for p, kept in enumerate(b):
        near = raw[:, at:at + kept]
        bounds = np.ascontiguousarray(raw[:, at + kept:at + kept + 4 * (kept + 1)]).view(np.float32)
        at += kept + 4 * (kept + 1)
        out.append(Parts(codes[:, p], np.zeros(n, np.int64), near, bounds[:, :kept], bounds[:, kept], np.zeros(n)))
    return out


def assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, had: list[int], keep: list[int]) -> DataFrame:
    """One round over stored rows. ``had``: close entries in the state (none for the first round); ``keep``: in the new one.

    A task also returns, as a last row without id, its sums: per part and entry count and components, then per part how
    many parts had each number of doubts.
    """
    parts, k, width = books.shape
    schema = pa.schema([
        ("codes", pa.binary()), ("error", pa.int64()), ("state", pa.binary()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, doubts = np.zeros((parts, k, width + 1), np.int64), np.zeros((parts, MOST_B + 2), np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema
            n = batch.num_rows
            if not n:
                continue
            vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
            if moved is not None:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts)
                known = _unpacked(batch.column("state"), codes, had)
            found = []
            for p in range(parts):
                part = np.ascontiguousarray(vectors[:, p])
                if moved is None:
                    f = search(part, books[p], keep[p])
                else:
                    f = refresh(part, books[p], moved[p], known[p], keep[p])
                    doubts[p] += np.bincount(np.minimum(f.doubts, MOST_B + 1), minlength=MOST_B + 2)
                np.add.at(sums[p, :, 0], f.code, 1)
                np.add.at(sums[p, :, 1:], f.code, part)
                found.append(f)
            codes = np.stack([f.code for f in found], 1)
            yield _batch(batch, schema, [
                pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array(np.sum([f.error for f in found], axis=0), pa.int64()),
                pa.array(_packed(found), pa.binary()), pa.nulls(n, pa.list_(pa.int64()))])
        if kind is not None:
            empty = pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in kind], schema=kind)
            flat = np.concatenate([sums.ravel(), doubts.ravel()]).tolist()
            yield _batch(empty, schema, [
                pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([flat], schema[3].type)])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    read = ["vec_id", "label", "vec"] + ([] if moved is None else ["codes", "state"])
    return rows.select(*read).mapInArrow(run, STATE.format(*kinds))


def _batch(of: pa.RecordBatch, schema: pa.Schema, columns: list[pa.Array]) -> pa.RecordBatch:
    head = [of.column(c) for c in ("vec_id", "label", "vec")]
    fields = [of.schema.field(c) for c in ("vec_id", "label", "vec")]
    return pa.RecordBatch.from_arrays(head + columns, schema=pa.schema([*fields, *schema]))


def sums_of(state: DataFrame, size: int) -> np.ndarray:
    """The sums of all tasks; one number per place comes back, whatever the number of rows."""
    flat = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x"))
    out = np.zeros(size, dtype=object)
    for r in flat.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r["at"]] = int(r["x"])
    return out


def moved_books(books: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries at the floor of the mean of their parts (unused ones stay), and how far each moved, at least."""
    new = books.copy()
    for p, e in np.ndindex(*books.shape[:2]):
        count = totals[p, e, 0]
        if count:
            new[p, e] = [int(s) // int(count) for s in totals[p, e, 1:]]
    distance = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64)) * (1 + SLACK)
    return new, distance


def wanted_b(doubts: np.ndarray) -> int:
    """The fewest close entries that cover the doubts of COVERED of all parts, within the limits."""
    total = int(doubts.sum())
    seen = 0
    for b, n in enumerate(doubts):
        seen += int(n)
        if seen >= COVERED * total:
            return max(LEAST_B, min(b, MOST_B))
    return MOST_B


@dataclass
class Codes:
    """``rows``: vec_id, label, code, error; ``books``: parts x entries x components; ``kept``: b of each round and part."""

    rows: DataFrame
    books: np.ndarray
    kept: list[list[int]]


def compress(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors and the codebooks; ``entries`` is at most 256."""
    clean = whole_vectors(table, id_col, vector, label, parts)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vec")]
    width = clean.orderBy(*order).select(F.size("vec")).limit(1).collect()
    if not width:
        none = clean.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return Codes(none.limit(0), np.zeros((parts, 0, 0), np.int64), [])
    clean = clean.where(F.size("vec") == width[0][0])
    first = [r["vec"] for r in clean.orderBy(*order).limit(entries).collect()]
    books = np.array(first, dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    shape, k = (*books.shape[:2], books.shape[2] + 1), books.shape[1]
    b = [min(FIRST_B, k - 1)] * parts
    history, moved, had, state = [], None, [], clean
    for _ in range(rounds + 1):
        state = materialise(assign(state, books, moved, had, b), "vector-codes")
        history.append(b)
        if len(history) > rounds:
            break
        flat = sums_of(state, int(np.prod(shape)) + parts * (MOST_B + 2))
        had, doubts = b, flat[int(np.prod(shape)):].reshape(parts, -1)
        books, distance = moved_books(books, flat[:int(np.prod(shape))].reshape(shape))
        if moved is not None:
            b = [min(wanted_b(d), h) for d, h in zip(doubts, had)]
        moved = distance
        state = state.where("sums IS NULL")
    rows = state.where("sums IS NULL").select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    return Codes(rows, books, history)


def books_digest(books: np.ndarray) -> str:
    """Hex digest of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """Stored rows with the sum of ``error`` over equal labels; nulls are one label, and hot labels are spread."""
    keyed = rows.withColumn("__label", F.struct(F.col("label").isNull(), F.coalesce(F.col("label").cast("string"), F.lit(""))))
    keyed = keyed.withColumn("__label", F.to_json("__label"))
    sums = keyed.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__rows"))
    return spread_join(keyed, materialise(sums, "label-errors"), "__label", "__rows").drop("__label")
