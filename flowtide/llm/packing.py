"""Best-fit packing: token pieces into sequences of one capacity, exact complements first.

A document's ids and the end id form one piece, or, when longer than the capacity, full pieces after a shorter first one.
Only how many pieces have each length matters for the plan, so it is made from at most ``capacity`` counts: an index of the
sums of one, two and three lengths gives combinations that fill gaps exactly while they last, and what is left is packed
best fit, longest first. Each piece then finds
its place in the plan by its rank among the pieces of its length.

Cases: a null or empty text is a piece of the end id alone; rows may repeat, each is packed; null ids are kept; columns
other than id and text are not read. An empty table gives an empty result. Texts are packed whole, at any length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.storage import materialise

CAPACITY = 1024
END_ID = 2
#: Pieces per bucket that are ranked in one sort, about.
BUCKET_ROWS = 50_000
#: Signs that libraries and Unicode versions may sort differently into letters, digits, blanks and others.
ODD = re.compile("[^\t\n\r -~\u00a1-\u02af\u2010-\u2027\u20ac]")
#: Where the pre-tokenizer cuts whatever stands around.
CUT = re.compile(r"(?= \S)")


def _as_bytes() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(vocabulary: str) -> dict[bytes, int] | None:
    """The tokens of a byte-level vocabulary file with their ranks, if merging by rank is what its rules say; else None."""
    model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
    rules, pre, known = model["model"], model.get("pre_tokenizer") or {}, _as_bytes()
    plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and not model.get("normalizer") and not rules.get("dropout") and not rules.get("ignore_merges")
             and not rules.get("continuing_subword_prefix") and not rules.get("end_of_word_suffix"))
    if not plain:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in rules["merges"]]
    made = [rules["vocab"].get(a + b, -1) for a, b in pairs]
    special = {t["content"] for t in model.get("added_tokens", [])}
    tokens = {t: i for t, i in rules["vocab"].items() if t not in special}
    if made != sorted(set(made)) or any(c not in known for t in tokens for c in t):
        return None
    return {bytes(known[c] for c in t): i for t, i in tokens.items()}


class TokenIds:
    """Ids of whole texts, as little-endian bytes.

    Merging by rank gives the ids that the library's merge rules give, several times as fast. Words with signs that the
    two may sort differently go to the library, and so does a whole text that holds a special string.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        ranks = ranks_of(vocabulary)
        self.ranked = ranks and tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def by_library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> bytes:
        if not self.ranked or (self.special and self.special.search(text)):
            ids = self.by_library(text)
        elif not ODD.search(text):
            ids = self.ranked(text)
        else:
            ids = []
            for odd, words in groupby(CUT.split(text), lambda w: ODD.search(w) is not None):
                ids += (self.by_library if odd else self.ranked)("".join(words))
        return struct.pack(f"<{len(ids)}I", *ids)


_READERS: dict[str, TokenIds] = {}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("id", pa.string()), ("piece", pa.int32())] + [
        (c, pa.int64()) for c in ("start", "length", "ids_crc32")])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _READERS:
            _READERS[vocabulary] = TokenIds(vocabulary)
        read = _READERS[vocabulary].of
        for batch in batches:
            rows = []
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = read(value.as_py()) + end
                n = len(ids) // 4
                stop = n % capacity or capacity
                start = piece = 0
                while start < n:
                    rows.append((key, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    out = slim.mapInArrow(run, "id string, piece int, start bigint, length bigint, ids_crc32 bigint")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


class SumIndex:
    """Combinations of one, two and three lengths by their sum, under counts ``left`` that only go down.

    Pairs are indexed by their sum as their longer lengths, triples as their longest ones (the rest of a triple is a pair
    of the remaining sum). A combination that has run out never comes back, so each list is read from where the last one
    that had pieces left was found. Of several combinations the one with the longest length comes first.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        have = np.flatnonzero(left)[::-1]
        longer, shorter = np.meshgrid(have, have, indexing="ij")
        fits = (shorter <= longer) & (longer + shorter < len(left))
        self.pairs = self._listed(longer[fits], (longer + shorter)[fits])
        sums = np.array(sorted(self.pairs), dtype=np.int64)
        longest, rest = np.meshgrid(have, sums, indexing="ij")
        # The longer one of the remaining pair is at least half of its sum, and at most the longest one.
        fits = (rest <= 2 * longest) & (longest + rest < len(left))
        self.triples = self._listed(longest[fits], (longest + rest)[fits])
        self.pair_at: dict[int, int] = {}
        self.triple_at: dict[int, int] = {}

    @staticmethod
    def _listed(lengths: np.ndarray, sums: np.ndarray) -> dict[int, list[int]]:
        order = np.lexsort((-lengths, sums))
        keys, begin = np.unique(sums[order], return_index=True)
        return {int(k): part.tolist() for k, part in zip(keys, np.split(lengths[order], begin[1:]))}

    def _has(self, *lengths: int) -> bool:
        return all(self.left[n] >= lengths.count(n) for n in lengths)

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self._has(total) else None

    def pair(self, total: int, taken: tuple[int, ...] = (), most: int | None = None) -> tuple[int, ...] | None:
        """A pair of available lengths of at most ``most``, beside those already ``taken``."""
        longer = self.pairs.get(total, [])
        at = self.pair_at.get(total, 0)
        while at < len(longer) and not self._has(longer[at], total - longer[at]):
            at += 1
        self.pair_at[total] = at
        for a in longer[at:]:
            if (most is None or a <= most) and self._has(a, total - a, *taken):
                return a, total - a
        return None

    def triple(self, total: int, taken: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        longest = self.triples.get(total, [])
        at = self.triple_at.get(total, 0)
        while at < len(longest) and not self.left[longest[at]]:
            at += 1
        self.triple_at[total] = at
        for a in longest[at:]:
            if self._has(a, *taken):
                rest = self.pair(total - a, (*taken, a), a)
                if rest:
                    return a, *rest
        return None

    def fill(self, gap: int, taken: tuple[int, ...] = (), most: int = 3) -> tuple[int, ...] | None:
        """One, two or three (at ``most``) available lengths with the sum ``gap``; fewer ones first."""
        found = self.single(gap) if gap < len(self.left) and self._has(gap, *taken) else None
        if found is None and most >= 2:
            found = self.pair(gap, taken)
        if found is None and most >= 3:
            found = self.triple(gap, taken)
        return found


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) that use up ``counts`` (length to pieces).

    Gaps are filled by combinations of up to three lengths. As gaps filled by many short pieces leave few of them for the
    rest, the plan is also made with pairs and with singles at most, and the one with the fewest sequences counts.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    index = SumIndex(left)
    plan: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            fill = () if length == capacity else index.fill(capacity - length, (length,), most)
            if fill is None:
                break
            pattern = (length, *fill)
            times = min(left[n] // pattern.count(n) for n in set(pattern))
            for n in pattern:
                left[n] -= times
            plan.append((pattern, int(times)))
    # Best fit, longest first, over classes of equal sequences: gap -> [(lengths, how many)].
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g, bins in open_by_gap.items() if g >= length and bins), default=None)
            lengths, bins = open_by_gap[gap].pop() if gap is not None else ((), n)
            gap = capacity if gap is None else gap
            each = min(gap // length, n)
            used = min(bins, n // each)
            if lengths and used < bins:
                open_by_gap[gap].append((lengths, bins - used))
            n -= each * used
            open_by_gap.setdefault(gap - each * length, []).append((lengths + (length,) * each, used))
    return plan + [entry for bins in open_by_gap.values() for entry in bins]


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces in each sequence, first offset), by rank."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rank = used.get(length, 0)
            places.setdefault(length, []).append((rank, sequence, each, offset))
            used[length] = rank + each * times
            offset += each * length
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in places.items()}


def place(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with ``sequence_id`` and ``offset``.

    The driver sees one count per length. Ranks within a length come from buckets of hashed pieces, so a length that a
    third of all pieces share is still sorted in many tasks.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = packing_plan(counts, capacity)
    places = _places(plan)
    buckets = 8 + sum(counts.values()) // BUCKET_ROWS
    keyed = pieces.withColumn(
        "__bucket", F.pmod(F.xxhash64(id_col, "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("length", "__bucket").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("__rank", F.row_number().over(order)).join(offsets, ["length", "__bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("__before") + F.col("__rank") - 1).alias("__rank"))

    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            lengths, ranks = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                table = places[int(length)]
                at = table[np.searchsorted(table[:, 0], ranks[rows], side="right") - 1]
                within = ranks[rows] - at[:, 0]
                sequence[rows] = at[:, 1] + within // at[:, 2]
                offset[rows] = at[:, 3] + within % at[:, 2] * length
            kept = [(f, batch.column(f.name)) for f in batch.schema if f.name != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in kept] + [pa.array(sequence), pa.array(offset)],
                schema=pa.schema([f for f, _ in kept] + list(schema)),
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(put, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialise(token_pieces(docs, vocabulary, capacity, end_id, id_col, text), "pieces"), id_col, capacity)
