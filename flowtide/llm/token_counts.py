"""Token counts of a byte-pair vocabulary, without making the tokens.

Texts are cut into words by the vocabulary's own pre-tokenizer. A word starts as a linked list of symbols; a heap holds
its adjacent pairs by merge rank, and the lowest rank is merged until no pair has one. The count is the number of initial
symbols less the merges. Words that were counted before come from a bounded cache of the Python worker.

Cases: a null or empty text has no tokens; rows may repeat; columns other than id and text are not read. An empty table
gives an empty result. Texts are counted whole; a word without any gap costs n log n steps, at any length. Special strings
of the vocabulary inside a text count as one token each, as its library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a Python worker remembers; then it forgets all and starts anew.
CACHE_WORDS = 400_000
#: Rows of one Arrow batch; long texts make large batches.
BATCH_ROWS = 500
#: A cut before a lone blank never falls inside a word of the pre-tokenizer; other blanks need the slower rule.
CUT = re.compile(r"(?= \S)")
ODD_GAP = re.compile(r" (?!\S)")


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the adjacent pair of the lowest rank (the leftmost among equals) is merged until none is left."""
    n = len(symbols)
    if n < 2:
        return n
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), symbols[:]
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if alive[i] != a or j >= n or alive[j] != b:
            continue  # one of the two has been merged since
        merges += 1
        joined = a + b
        alive[i], alive[j] = joined, None
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            rank = ranks.get((joined, alive[after]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, joined, alive[after]))
        before = left[i]
        if before >= 0:
            rank = ranks.get((alive[before], joined))
            if rank is not None:
                heapq.heappush(heap, (rank, before, alive[before], joined))
    return n - merges


class _Spaced(dict):
    """Counts of a blank and a piece."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.count(" " + piece)
        return n


class TokenCounter(dict):
    """Counts of pieces of text; a piece that is not known yet is cut into words and counted."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            parsed = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in parsed["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.cut_words = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words: dict[str, int] = {}
        self.spaced = _Spaced(self.pieces)

    def pieces(self, piece: str) -> int:
        n = 0
        for word, _ in self.cut_words(piece):
            known = self.words.get(word)
            if known is None:
                known = self.words[word] = merge_count(list(word), self.ranks)
            n += known
        return n

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.pieces(piece)
        return n

    def count(self, text: str) -> int:
        for known in (self, self.spaced, self.words):
            if len(known) > CACHE_WORDS:
                known.clear()
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)

    def plain(self, text: str) -> int:
        if ODD_GAP.search(text):
            return sum(map(self.__getitem__, CUT.split(text)))
        first, *rest = text.split(" ")
        return (self[first] if first else 0) + sum(map(self.spaced.__getitem__, rest))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(vocabulary: str) -> TokenCounter:
    """One per Python worker and vocabulary."""
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = TokenCounter(vocabulary)
    return _COUNTERS[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_bytes`` (UTF-8) and ``n_tokens``. No shuffle; ``vocabulary`` is a path on every machine."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([
        ("id", pa.int64() if slim.schema["id"].dataType.simpleString() == "bigint" else pa.string()),
        ("n_bytes", pa.int64()),
        ("n_tokens", pa.int64()),
    ])
    kind = slim.schema["id"].dataType.simpleString()
    if kind != "bigint":
        slim = slim.withColumn("id", F.col("id").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").cast(schema.field("id").type),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(list(map(count, texts)), pa.int64()),
                    ],
                    schema=schema,
                )

    out = slim.mapInArrow(run, f"id {'bigint' if kind == 'bigint' else 'string'}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_tokens")
