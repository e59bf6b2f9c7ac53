"""Benchmark decontamination: item-sized windows embedded by random walks, sampled-bit hashing, exact edit distance.

Texts and items are sequences of normalised words. The CGK walk copies a word and then moves on or stays, by a random bit of
that word and step, so that two sequences of small edit distance get outputs of small Hamming distance. Tables of sampled
outputs make windows and items meet; the number of tables follows from the measured agreement of items with edited copies
of themselves, so that a window at the largest allowed distance is met with ``TARGET_RECALL`` (``Index.recall`` has what
fresh copies gave, by size). Where the most tables do not reach it, every window of that size is compared with every item of
it. Windows that meet an item are verified by exact word edit distance, of the window and of its end moved by what the edits
allow.

Before the walk, windows that cannot be near any item go: one within k edits of an item of n words has at most k words
outside the benchmark's vocabulary, and holds all but k of the item's words that are rare in the benchmark. Items travel
to the tasks in blocks of bounded size; all texts are read for each block.

Cases: words are runs of letters and digits, lower-cased; a null or empty text has no window; items without words match
nothing, equal items all match; rows may repeat and null ids are kept; columns other than id and text are not read. Empty
tables give an empty result. Texts are read whole.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each word of an item, and the chance that a window at that distance is met.
MAX_EDIT_SHARE = 0.2
TARGET_RECALL = 0.99
#: Sampled outputs that form one key, and the most tables that are built.
SAMPLED = 5
MOST_TABLES = 400
TABLES_PER_WALK = 16
#: Characters of items that one block broadcasts.
BLOCK_CHARS = 500_000
#: Edited copies of the items of one size, at least, on which the number of tables is measured; half as many
#: again are built.
TRIALS = 300
#: Windows whose keys are made at once.
STEP_ROWS = 50_000
#: Windows that walk at once.
CACHED_ROWS = 8_000
#: Texts whose words stand in one row.
BATCH_TEXTS = 128
_WORD = re.compile(r"[^\W_]+")
_SEED = 9176
#: Words in at most so many items are rare ones.
RARE_ITEMS = 3
#: Code of every word outside the benchmark.
UNKNOWN = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distances of ``a`` to the prefixes of ``b`` (row of the usual table, by length of the prefix)."""
    row = np.arange(len(b) + 1)
    steps = row.copy()
    for i, word in enumerate(a, 1):
        best = np.minimum(row[:-1] + (b != word), row[1:] + 1)
        row = np.concatenate([[i], best])
        row = np.minimum.accumulate(row - steps) + steps
        if row.min() > most:
            return np.full(len(b) + 1, most + 1)
    return row


def allowed(n: int) -> int:
    return int(MAX_EDIT_SHARE * n)


class Walks:
    """The random bits: one odd multiplier for each walk and step; a word's bit is the top one of the product."""

    def __init__(self, steps: int, walks: int):
        rng = np.random.default_rng(_SEED)
        self.factors = rng.integers(0, 2**64, (walks, steps), dtype=np.uint64) | np.uint64(1)

    def embed(self, codes: np.ndarray, starts: np.ndarray, n, walk: int, upto: int) -> np.ndarray:
        """The first ``upto`` outputs of the windows of n words (one or one each) at ``starts``; after its end, 0."""
        # An output is a row, so that each step writes one piece of memory; blocks of windows stay in the cache.
        out = np.zeros((upto, len(starts)), np.uint64)
        ends = starts + n
        for a in range(0, len(starts), CACHED_ROWS):
            b = min(a + CACHED_ROWS, len(starts))
            at, end = starts[a:b].astype(np.int64), ends[a:b]
            for step in range(upto):
                # Behind its end a window stays there: its outputs are 0, whatever the bits.
                word = np.where(at < end, codes.take(at, mode="clip"), np.uint64(0))
                out[step, a:b] = word
                at += ((word * self.factors[walk, step]) >> np.uint64(63)).view(np.int64)
        return out.T


class Tables:
    """The tables of one size and walk: sampled places (a row for each table), and the keys of the items in all of them."""

    def __init__(self, places: np.ndarray, outputs: np.ndarray, items: np.ndarray):
        self.places = places
        found = keys(outputs, places)
        order = np.argsort(found, axis=None, kind="stable")
        self.found, self.items = found.ravel()[order], np.repeat(items, len(places))[order]

    def meetings(self, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``outputs`` and items that have a key in common."""
        rows, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(outputs), STEP_ROWS):
            met = keys(outputs[at:at + STEP_ROWS], self.places).ravel()
            low = np.searchsorted(self.found, met)
            hits = np.flatnonzero(self.found[np.minimum(low, len(self.found) - 1)] == met)
            low = low[hits]
            count = np.searchsorted(self.found, met[hits], "right") - low
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rows.append(at + np.repeat(hits // len(self.places), count))
            items.append(self.items[np.repeat(low, count) + within])
        return np.concatenate(rows), np.concatenate(items)


class Index:
    """The tables of one block of items."""

    def __init__(self, items: list[tuple[object, str]]):
        import xxhash

        named = [(key, words_of(text or "")) for key, text in items]
        shared = Counter(w for _, ws in named for w in set(ws))
        self.number = {w: i for i, w in enumerate(shared, 1)}
        self.codes = np.array([UNKNOWN] + [xxhash.xxh3_64_intdigest(w) | 2 for w in shared], np.uint64)
        self.items = [(key, self.codes[[self.number[w] for w in ws]]) for key, ws in named if ws]
        self.word_sets = [set(codes.tolist()) for _, codes in self.items]
        self.by_size: dict[int, list[int]] = {}
        for k, (_, codes) in enumerate(self.items):
            self.by_size.setdefault(len(codes), []).append(k)
        longest = max(self.by_size, default=1)
        walks = -(-MOST_TABLES // TABLES_PER_WALK)
        self.walks = Walks(3 * longest, walks)
        self._rare_words([ws for _, ws in named if ws], shared)
        self.recall: dict[int, float] = {}
        self.all_pairs: set[int] = set()
        self.tables: dict[int, dict[int, Tables]] = {n: self._tables(n, ks) for n, ks in self.by_size.items()}

    def _rare_words(self, texts: list[list[str]], shared: Counter) -> None:
        """For each word number, the items it is rare in; for each item, how many a near window must hold, and its span."""
        owners = [[] for _ in self.codes]
        self.need, self.span = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for k, words in enumerate(texts):
            rare = [w for w in words if shared[w] <= RARE_ITEMS]
            self.need[k] = len(rare) - allowed(len(words))
            self.span[k] = len(words) + allowed(len(words))
            for w in set(rare):
                owners[self.number[w]].append(k)
        # Items with too few rare words take every window of few words outside the vocabulary.
        self.loose = {len(self.items[k][1]) for k in np.flatnonzero(self.need < 2)}
        self.first = np.cumsum([0] + [len(o) for o in owners])
        self.owner = np.array([k for o in owners for k in o], np.int64)

    def _edited(self, item: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A copy with all the edits allowed, at random places, and other words behind."""
        other = rng.integers(2, 2**63, 2 * len(item), dtype=np.uint64)
        copy = list(item)
        for e in range(allowed(len(item))):
            kind, at = rng.integers(3), int(rng.integers(len(copy)))
            if kind == 0:
                copy[at] = other[e]
            elif kind == 1 and len(copy) > 1:
                del copy[at]
            else:
                copy.insert(at, other[e])
        return np.concatenate([np.array(copy, np.uint64), other])[:2 * len(item)]

    def _tables(self, n: int, ks: list[int]) -> dict[int, Tables]:
        rng = np.random.default_rng(_SEED * 31 + n)
        likes = np.resize(np.arange(len(ks)), max(TRIALS, len(ks)))
        rows = [self.items[k][1] for k in ks] + [self._edited(self.items[ks[i]][1], rng) for i in likes]
        starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
        codes = np.concatenate(rows)
        walks = [self.walks.embed(codes, starts, n, w, 2 * n) for w in range(-(-MOST_TABLES // TABLES_PER_WALK))]
        # Fewer sampled outputs make a key easier to meet: the most that reach the target within the tables allowed.
        for size in range(min(SAMPLED, max(1, n // 4)), 0, -1):
            positions = [
                (t // TABLES_PER_WALK, np.sort(rng.choice(2 * n, size, replace=False))) for t in range(MOST_TABLES)
            ]
            met = np.zeros(len(likes), bool)
            for need, (w, p) in enumerate(positions, 1):
                sampled = walks[w][:, p]
                met |= (sampled[likes] == sampled[len(ks):]).all(axis=1)
                if met.mean() >= TARGET_RECALL:
                    break
            if met.mean() >= TARGET_RECALL:
                break
        built = self._enough(n, ks, positions, walks, min(MOST_TABLES, need + need // 2)) if allowed(n) else 1
        by_walk: dict[int, list[np.ndarray]] = {}
        for w, p in positions[:built]:
            by_walk.setdefault(w, []).append(p)
        return {w: Tables(np.stack(p), walks[w][:len(ks)], np.array(ks)) for w, p in by_walk.items()}

    def _enough(self, n: int, ks: list[int], positions: list[tuple[int, np.ndarray]], walks: list[np.ndarray], built: int) -> int:
        """So many tables that fresh copies are met with the target; if even the most do not, no table serves."""
        rng = np.random.default_rng(_SEED * 37 + n)
        likes = np.resize(np.arange(len(ks)), max(TRIALS, len(ks)))
        rows = [self._edited(self.items[ks[i]][1], rng) for i in likes]
        starts, codes = np.cumsum([0] + [len(r) for r in rows[:-1]]), np.concatenate(rows)
        met, at, copies = np.zeros(len(likes), bool), 0, {}
        while at < built:
            w, p = positions[at]
            if w not in copies:
                copies = {w: self.walks.embed(codes, starts, n, w, 2 * n)}
            met |= (walks[w][likes][:, p] == copies[w][:, p]).all(axis=1)
            at += 1
            if at == built and met.mean() < TARGET_RECALL and built < MOST_TABLES:
                built = min(MOST_TABLES, built + max(1, built // 4))
        self.recall[n] = float(met.mean())
        if self.recall[n] < TARGET_RECALL:
            self.all_pairs.add(n)
            return 0
        return built

    def windows(self, numbers: np.ndarray) -> dict[int, np.ndarray]:
        """Per item size, the starts of the windows that may be near an item, in a row of word numbers."""
        out: dict[int, list[np.ndarray]] = {}
        count = self.first[numbers + 1] - self.first[numbers]
        places = np.flatnonzero(count)
        count = count[places]
        at = np.repeat(places, count)
        within = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        item = self.owner[np.repeat(self.first[numbers[places]], count) + within]
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        need = np.maximum(self.need[item], 1)
        last = np.arange(len(at)) + need - 1
        inside = last < len(at)
        last = np.minimum(last, len(at) - 1)
        good = np.flatnonzero(inside & (item[last] == item) & (at[last] - at < self.span[item])) if len(at) else []
        for g in good:
            low = max(0, at[last[g]] - self.span[item[g]] + 1)
            out.setdefault(len(self.items[item[g]][1]), []).append(np.arange(low, at[g] + 1))
        for n in self.loose:
            out.setdefault(n, []).append(np.arange(len(numbers)))
        # Each word outside the vocabulary is an edit; so is each word by which a window hangs over its text's end.
        outside = np.concatenate([[0], np.cumsum(numbers == 0)])
        near = {}
        for n, parts in out.items():
            starts = np.unique(np.concatenate(parts))
            ends = np.minimum(starts + n, len(numbers))
            near[n] = starts[outside[ends] - outside[starts] <= allowed(n)]
        return near

    def stretches(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Windows that may be near an item: rows (text, first word, size, words left in the text), and their codes.

        The texts stand in one row, with unknown words between them that no window near an item can span.
        """
        width = int(self.span.max(initial=0))
        sizes = np.array([len(t) + width + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        numbers = np.zeros(int(sizes.sum()), np.int64)
        for begin, words in zip(begins, texts):
            numbers[begin:begin + len(words)] = np.fromiter(
                map(self.number.get, words, itertools.repeat(0)), np.int64, len(words))
        rows = [np.empty((0, 4), np.int64)]
        for n, starts in self.windows(numbers).items():
            t = np.searchsorted(begins, starts, side="right") - 1
            left = begins[t] + sizes[t] - width - 1 - starts
            rows.append(np.stack([t, starts - begins[t], np.full(len(starts), n), left], axis=1)[left > 0])
        found = np.concatenate(rows)
        at = begins[found[:, 0]] + found[:, 1]
        return found, self.codes[numbers[at[:, None] + np.arange(width)]]

    def candidates(self, sizes: np.ndarray, codes: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) pairs that meet in some table; ``codes`` has a row for each window."""
        # Pairs as one number: window times the items, and item.
        found, many = [np.empty(0, np.int64)], len(self.items)
        flat, starts = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        of_size = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        for n in self.all_pairs & of_size.keys():
            found.append((of_size.pop(n)[:, None] * many + np.array(self.by_size[n])).ravel())
        for walk in sorted({w for n in of_size for w in self.tables[n]}):
            tables = {n: self.tables[n][walk] for n in of_size if walk in self.tables[n]}
            rows = np.concatenate([of_size[n] for n in tables])
            upto = max(int(t.places.max()) for t in tables.values()) + 1
            outputs, end = self.walks.embed(flat, starts[rows], sizes[rows], walk, upto), 0
            for n, table in tables.items():
                begin, end = end, end + len(of_size[n])
                row, item = table.meetings(outputs[begin:end])
                found.append(np.unique(of_size[n][row] * many + item))
        window, item = np.divmod(np.unique(np.concatenate(found)), many)
        return list(zip(window.tolist(), item.tolist()))

    def leaks(self, texts: Iterator[list[str]]) -> list[tuple[int, object, int, int, int]]:
        """(text, item, first word, end word, edits) of the nearest window of each text and item that are near."""
        rows, codes, seen = [], [], 0
        while part := list(itertools.islice(texts, BATCH_TEXTS)):
            found, stretch = self.stretches(part)
            found[:, 0] += seen
            seen += len(part)
            rows.append(found)
            codes.append(stretch)
        if not rows or not self.items:
            return []
        windows, stretch = np.concatenate(rows), np.concatenate(codes)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for w, k in self.candidates(windows[:, 2], stretch):
            t, first, n, left = windows[w].tolist()
            # Windows of a text and item come by their start: behind an exact copy no better one follows, and one that lacks
            # more of the item's words than edits are allowed is not near.
            if best.get((t, k), (1,))[0] == 0 or len(self.word_sets[k].difference(
                    stretch[w, :min(n + allowed(n), left)].tolist())) > allowed(n):
                continue
            row = edit_distance(self.items[k][1], stretch[w, :min(n + allowed(n), left)], allowed(n))
            end = int(row.argmin())
            if row[end] <= allowed(n):
                hit = (int(row[end]), first, first + end)
                best[t, k] = min(best.get((t, k), hit), hit)
        return [(t, self.items[k][0], a, b, d) for (t, k), (d, a, b) in sorted(best.items())]


def keys(outputs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The key of each row in each table, from its outputs at the table's places; tables have different keys."""
    out = np.arange(1, len(places) + 1, dtype=np.uint64) * np.uint64(0xC4CEB9FE1A85EC53) + np.zeros((len(outputs), 1), np.uint64)
    for column in places.T:
        out = (out ^ outputs[:, column]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def item_blocks(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items, in blocks of at most ``BLOCK_CHARS`` characters (or one item), read one block at a time."""
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        if block and size + len(row["t"] or "") > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"] or "")
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
               text: str = "text", item_text: str = "text") -> DataFrame:
    """(id, item, first_word, end_word, edits): the nearest window of each text for each item that it leaks. No shuffle."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")
    schema = "id string, item string, first_word bigint, end_word bigint, edits bigint"
    out = None
    for block in item_blocks(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                docs = batch.column("id").to_pylist()
                texts = (words_of(value.as_py()) for value in batch.column("text"))
                rows = [(docs[t], None if item is None else str(item), a, b, d)
                        for t, item, a, b, d in index.leaks(texts)]
                columns = list(zip(*rows)) if rows else [()] * 5
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                names = ["id", "item", "first_word", "end_word", "edits"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        found = slim.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = slim.select("id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("item", "string"), ("first_word", "bigint"), ("end_word", "bigint"), ("edits", "bigint"))]).limit(0)
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("item").cast(item_kind).alias(item_col),
                      "first_word", "end_word", "edits")


def without_leaks(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text: str = "text",
                  item_text: str = "text") -> DataFrame:
    """The documents whose text leaks no item, with all their columns. No shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block in item_blocks(items, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = (words_of(value.as_py() or "") for value in batch.column(text))
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in shared.value.leaks(texts)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
