"""Scores of texts under a hierarchical Pitman-Yor model, learned from the documents themselves.

A restaurant for each preceding word stands on a restaurant of words, and that on restaurants of bytes: the customers of a
context are the words that follow it, its tables are customers of the word restaurant, whose tables are draws of spellings
from context restaurants of two bytes, one byte and none, over equal chances. The word before a text is the end token.

Seatings are sampled by Gibbs: given all others, the customers of a dish are seated anew as in a Chinese restaurant (only
how many tables they take matters for the chances). Contexts begin with one table for each word that follows them. Words and
bytes are then swept, the contexts seated anew given the words' chances, and their tables sent back as the words' customers;
words and bytes take ``BURN_IN`` more sweeps, and the predictive probabilities of ``SAMPLES`` further ones are averaged.

What grows with the corpus stays in Spark. Texts become chunks of bounded size. A chunk sends its distinct words and the
hashes of its distinct word pairs once, packed by part of all words or pairs, and gets the answers in the same order: the
rows of a part are counted where they meet, and a word that a third of all rows hold is one entry of each chunk. The driver
holds the byte restaurants alone: at most 257 ** 3 counts, whatever the input.

Cases: a null or empty text is its end token alone; a null id counts as the empty text when documents are drawn to be held
out; rows may repeat, each is learned from and scored; columns other than id and text are not read. An empty table gives an
empty result; without training documents every chance is that of a word that training lacks, 1. Texts are scored whole. Two
word pairs share a count if 48 bits of their hashes are equal, which befalls a pair with a chance of 2^-48 for each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.storage import materialise, release_shuffles

#: Characters of the texts of one chunk (one longer text is a chunk by itself).
CHUNK_CHARS = 16_000_000
#: Words and word pairs that the chunks ask one part for, about.
PART_WORDS, PART_PAIRS = 500_000, 2_000_000
BURN_IN, SAMPLES, PROPOSALS = 1, 2, 3
#: Customers of a dish up to which its tables are drawn from a table of weights.
EXACT_CUSTOMERS = 256
#: Tables of dishes of more customers that are listed with their weights, and rows of the list for twice the customers.
LISTED, GRID = 256, 16
#: Byte that stands for a word's start and end, and how many there are with it.
EDGE, SYMBOLS = 256, 257
BYTE_DISCOUNT, BYTE_STRENGTH, WORD_STRENGTH, PAIR_STRENGTH = 0.5, 1.0, 1.0, 1.0
BYTE_SWEEPS = 3
PAIR_BITS = 48
#: Pairs whose tables are drawn at once, and words that are spelled at once.
PAIRS_AT_ONCE, WORDS_AT_ONCE = 500_000, 50_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (series after a shift by eight)."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


@cache
def _log_stirling(discount: float) -> list[np.ndarray]:
    """For c customers, the logarithm of the weight of all seatings at 1 to c tables, but for the openings."""
    rows = [np.zeros(0), np.zeros(1)]
    for n in range(1, EXACT_CUSTOMERS):
        row = np.full(n + 1, -np.inf)
        row[:n] = rows[n] + np.log(n - discount * np.arange(1, n + 1))
        row[1:] = np.logaddexp(row[1:], rows[n])
        rows.append(row)
    return rows


@cache
def _steps(discount: float, customers: int) -> tuple[np.ndarray, np.ndarray]:
    """What the weight of one more table is over that of t = 1, 2... tables, but for the opening, by t and number of
    customers (it falls with t); and, by number of customers, an opening below which products of all steps are numbers."""
    logs, most = np.full((customers + 1, customers + 1), -np.inf), np.zeros(customers + 1)
    for n in range(2, customers + 1):
        logs[n, :n - 1] = np.diff(_log_stirling(discount)[n])
        low, high = -50.0, 600.0
        while high - low > 0.1:
            middle = (low + high) / 2
            low, high = (middle, high) if np.maximum(logs[n, :n - 1] + middle, 0).sum() < 600 else (low, middle)
        most[n] = math.exp(low)
    return np.exp(logs).T.copy(), most


def _drawn(c, base, others, discount, strength, uniform) -> np.ndarray:
    """Tables of dishes of up to ``EXACT_CUSTOMERS`` customers, drawn from their exact distribution by uniform numbers."""
    out = np.ones(len(c), np.int64)
    rows = np.flatnonzero(c > 1)
    if not len(rows):
        return out
    steps, most = _steps(discount, EXACT_CUSTOMERS)
    n, base, others, uniform = c[rows].astype(np.int64), base[rows], others[rows], uniform[rows]
    first, more = (strength + discount * others) * base, discount * base
    # Dishes of about as many tables go together.
    direct = first + n * more < most[n]
    expected = np.log2(np.clip(steps[0][n] * first, 1e-9, 1e9)) * 64
    order = np.argsort(expected.astype(np.int16), kind="stable")
    order = order[direct[order]]
    for part in np.array_split(order, 1 + len(order) // 8192):
        out[rows[part]] = _by_products(n[part], steps, first[part], more[part], uniform[part])
    for size in np.unique(n[~direct]):
        alike = np.flatnonzero(~direct & (n == size))
        for part in np.array_split(alike, 1 + len(alike) * size // 200_000):
            opening = first[part, None] + more[part, None] * np.arange(size)
            logits = _log_stirling(discount)[size] + np.cumsum(np.log(np.maximum(opening, 1e-290)), axis=1)
            out[rows[part]] = _picked(logits, uniform[part])
    return out


def _picked(logits: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """The number from 1 that a uniform number picks by weights, for each row of their logarithms."""
    weight = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
    return 1 + (weight < uniform[:, None] * weight[:, -1:]).sum(axis=1)


def _by_products(n, steps, first, more, uniform) -> np.ndarray:
    """Tables of dishes of n customers, by running products of the steps, until what is left is below 1e-12 of the whole."""
    weight, out = np.ones(len(n)), np.ones(len(n), np.int64)
    sums, most = [weight], int(n.max(initial=1))
    for t in range(1, most):
        weight = weight * steps[t - 1][n] * (first + t * more)
        sums.append(sums[-1] + weight)
        if t % 2 == 0 and (weight * most < 1e-12 * sums[-1]).all() and (steps[t][n] * (first + n * more) < 1).all():
            break
    target = uniform * sums[-1]
    for at in sums[:-1]:
        out += at < target
    return out


@cache
def _log_stirling_many(discount: float) -> np.ndarray:
    """As ``_log_stirling`` (but for a constant a row) for 1 to ``LISTED`` tables of 256 * 2**(g / ``GRID``) customers,
    g = 0, 1..., up to 2**48.

    By the chances of t tables in a restaurant of this discount and strength 0: customer by customer up to 2**14, then as
    the birth process that they become, whose steps from one g to the next are alike.
    """
    t = np.arange(1, LISTED + 1)
    chance, n, rows = np.eye(1, LISTED)[0], 1, []
    for g in range(6 * GRID + 1):
        upto = round(256 * 2 ** (g / GRID))
        for k in range(n, upto):
            opened = chance * (discount * t / k)
            chance = chance - opened
            chance[1:] += opened[:-1]
        n = upto
        rows.append(chance)
    stays = 2 ** (-discount / GRID)
    log_choose = np.tril(log_gamma(t[:, None] * 1.0) - log_gamma(t * 1.0) - log_gamma(np.maximum(t[:, None] - t + 1.0, 1)))
    births = np.tril(np.exp(np.tril(log_choose + t * math.log(stays) + (t[:, None] - t) * math.log1p(-stays))))
    while len(rows) <= 40 * GRID:
        rows.append(births @ rows[-1])
    return np.log(np.maximum(np.stack(rows), 1e-300)) - (t - 1) * math.log(discount) - log_gamma(t * 1.0)


def _drawn_many(c, base, others, discount, strength, uniform, other_uniform) -> np.ndarray:
    """Tables of dishes of more than ``EXACT_CUSTOMERS`` customers, drawn by uniform numbers.

    From their distribution, with its weights between two numbers of customers of a grid, while ``LISTED`` tables hold it;
    beyond, where it is close to one, from the normal distribution of the same mode and width.
    """
    listed = _log_stirling_many(discount)
    out = np.ones(len(c), np.int64)
    place = np.clip(np.log2(c / 256) * GRID, 0, len(listed) - 1.001)
    todo = np.arange(len(c))
    for upto in (16, LISTED):
        wide = []
        for rows in np.array_split(todo, 1 + len(todo) * upto // 400_000):
            g, f = place[rows].astype(np.int64), (place[rows] % 1)[:, None]
            opening = (strength + discount * (others[rows, None] + np.arange(upto))) * base[rows, None]
            opening[:, 0] = 1
            logits = (1 - f) * listed[g, :upto] + f * listed[g + 1, :upto] + np.cumsum(np.log(np.maximum(opening, 1e-290)), axis=1)
            narrow = (logits[:, -1] < logits.max(axis=1) - 20) & (logits[:, -1] < logits[:, -2] - 0.1)
            out[rows[narrow]] = _picked(logits[narrow], uniform[rows[narrow]])
            wide.append(rows[~narrow])
        todo = np.concatenate(wide)
    if len(todo):
        c, base, alpha = c[todo], np.maximum(base[todo], 1e-290), strength / discount + others[todo]
        plain = _strength_of(c, base, alpha, discount)
        mean = _mean_tables(c, plain, discount)
        # The plain restaurant's spread, less what the openings of the true one grow slower with each table.
        x = plain / discount
        square = (x + 1) / discount * np.exp(log_gamma(plain + 2 * discount + c) + log_gamma(plain + 1) - log_gamma(
            plain + 2 * discount) - log_gamma(plain + c))
        spread = np.maximum(square - (x + mean) - (x + mean) ** 2, 1e-9 * mean)
        spread = 1 / np.maximum(1 / spread + 1 / (x + mean) - 1 / (alpha + mean), 1e-300)
        normal = np.sqrt(-2 * np.log(1 - uniform[todo])) * np.cos(2 * np.pi * other_uniform[todo])
        out[todo] = np.clip(np.round(mean + np.sqrt(spread) * normal), 1, c)
    return out


def _strength_of(c, base, alpha, discount) -> np.ndarray:
    """Strength of the plain restaurant whose seatings come closest: its openings weigh the same at its mean tables."""
    low, high = np.full(len(c), -0.999 * discount), discount * alpha
    for _ in range(30):
        middle = (low + high) / 2
        mean = _mean_tables(c, middle, discount)
        above = middle / discount + (1 - base) * mean > base * alpha
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return low


def _mean_tables(c, strength, discount) -> np.ndarray:
    """Mean tables of c customers in a plain restaurant."""
    return (np.exp(log_gamma(strength + discount + c) + log_gamma(strength + 1) - log_gamma(strength + discount)
                   - log_gamma(strength + c)) - strength) / discount


def _seated(c, strength, discount, rng) -> np.ndarray:
    """Tables when c customers sit down one after another in a plain restaurant of each dish.

    The number of customers who join tables before the next one opens one is geometric with a beta chance.
    """
    tables = np.ones(len(c), np.int64)
    rows = np.arange(len(c))
    n, t = np.ones(len(c)), np.ones(len(c))
    while len(rows):
        chance = np.clip(rng.beta(strength[rows] + discount * t, n - discount * t), 1e-300, 1 - 1e-16)
        joins = np.floor(np.log(rng.random(len(rows))) / np.log1p(-chance))
        more = joins < c[rows] - n
        n, t = np.where(more, n + joins + 1, c[rows]), np.where(more, t + 1, t)
        tables[rows] = t
        on = n < c[rows]
        rows, n, t = rows[on], n[on], t[on]
    return tables


def seat(c, base, others, discount, strength, rng, now=None) -> np.ndarray:
    """Gibbs step of many dishes: new tables of each, given the tables of all others.

    ``c`` customers each, ``base`` its chance in the parent, ``others`` the tables of the restaurant's other dishes. Up to
    ``EXACT_CUSTOMERS`` the step is an exact draw. Beyond, a whole seating in a plain restaurant of about the same
    openings is proposed ``PROPOSALS`` times and accepted by the ratio of weights (which depend on the tables alone), from
    ``now`` if given: the distribution stays the exact one.
    """
    c = np.asarray(c, float)
    out = np.ones(len(c), np.int64)
    few = np.flatnonzero(c <= EXACT_CUSTOMERS)
    out[few] = _drawn(c[few], base[few], others[few], discount, strength, rng.random(len(few)))
    many = np.flatnonzero(c > EXACT_CUSTOMERS)
    if len(many):
        c, base, alpha = c[many], np.maximum(base[many], 1e-290), strength / discount + others[many]
        plain = _strength_of(c, base, alpha, discount)

        def log_weight(t):
            return t * np.log(base) + log_gamma(alpha + t) - log_gamma(plain / discount + t)

        # Proposals do not depend on what was accepted: all are seated together, in one loop over their tables.
        times = PROPOSALS + (now is None)
        proposed = list(_seated(np.tile(c, times), np.tile(plain, times), discount, rng).reshape(times, -1))
        t = proposed.pop() if now is None else np.asarray(now)[many]
        for new in proposed:
            accept = np.log(rng.random(len(c))) < log_weight(new) - log_weight(t)
            t = np.where(accept, new, t)
        out[many] = t
    return out


class ByteModel:
    """Restaurants of the contexts of two, one and no bytes, seated for given counts of byte triples."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        d, s = BYTE_DISCOUNT, BYTE_STRENGTH
        pair, symbol = keys // SYMBOLS, keys % SYMBOLS
        contexts, at = np.unique(pair, return_inverse=True)
        last = contexts % SYMBOLS
        # Levels from no context (0) to two bytes (2); dense tables (context, symbol) of customers and tables.
        customers = [np.zeros((1, SYMBOLS)), np.zeros((SYMBOLS, SYMBOLS)), np.zeros((len(contexts), SYMBOLS))]
        customers[2][at, symbol] = counts
        up = [None, np.zeros(SYMBOLS, np.int64), last]
        tables = [None, None, np.minimum(customers[2], 1)]
        for level in (1, 0):
            np.add.at(customers[level], up[level + 1], tables[level + 1])
            tables[level] = np.minimum(customers[level], 1)
        for _ in range(BYTE_SWEEPS):
            chances = self._chances(customers, tables, up, d, s)
            for level in (2, 1, 0):
                c = customers[level]
                held = c > 0
                rows, columns = np.nonzero(held)
                parent = chances[level - 1][up[level]] if level else np.full((1, SYMBOLS), 1 / SYMBOLS)
                others = tables[level].sum(axis=1)[rows] - tables[level][rows, columns]
                seated = np.zeros_like(c)
                now = np.minimum(tables[level][rows, columns], c[rows, columns])
                seated[rows, columns] = seat(c[rows, columns], parent[rows, columns], others, d, s, rng, now)
                tables[level] = seated
                if level:
                    customers[level - 1] = np.zeros_like(customers[level - 1])
                    np.add.at(customers[level - 1], up[level], seated)
        chances = self._chances(customers, tables, up, d, s)
        # Rows: seen contexts of two bytes, then for the others the context of one byte.
        self.row = np.full(SYMBOLS * SYMBOLS, -1, np.int32)
        self.row[contexts] = np.arange(len(contexts))
        unseen = self.row < 0
        self.row[unseen] = len(contexts) + np.flatnonzero(unseen) % SYMBOLS
        self.log = np.log(np.concatenate([chances[2], chances[1]]))

    @staticmethod
    def _chances(customers, tables, up, d, s) -> list[np.ndarray]:
        out = []
        for level in range(3):
            parent = out[level - 1][up[level]] if level else np.full((1, SYMBOLS), 1 / SYMBOLS)
            total, used = customers[level].sum(axis=1, keepdims=True), tables[level].sum(axis=1, keepdims=True)
            own = np.maximum(customers[level] - d * tables[level], 0)
            out.append((own + (s + d * used) * parent) / (s + total))
        return out

    def log_spelling(self, words: pa.Array) -> np.ndarray:
        """Natural logarithm of the chance of each spelling."""
        out = [np.zeros(0)]
        for begin in range(0, len(words), WORDS_AT_ONCE):
            keys, lengths = triples(words[begin:begin + WORDS_AT_ONCE])
            values = self.log[self.row[keys // SYMBOLS], keys % SYMBOLS]
            out.append(np.add.reduceat(values, np.cumsum(lengths) - lengths))
        return np.concatenate(out)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, and how many each has."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]], np.diff(offsets).astype(np.int64)


def triples(words: pa.Array, symbols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(byte before the last, last, byte) of each byte and of the end of each word, as numbers; and how many per word. With
    ``symbols``, a list in order of all that occur, the numbers are made of places in it."""
    data, lengths = _bytes_of(words)
    code, base = np.arange(SYMBOLS, dtype=np.int32), SYMBOLS
    if symbols is not None:
        code[symbols], base = np.arange(len(symbols), dtype=np.int32), len(symbols)
    line = np.full(len(data) + 3 * len(lengths), code[EDGE], np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    line[np.arange(len(data)) + 3 * row + 2] = code[data]
    begin = np.cumsum(lengths + 3) - (lengths + 3)
    here = np.ones(len(line), bool)
    here[begin] = here[begin + 1] = False
    at = np.flatnonzero(here)
    return (line[at - 2] * np.int32(base) + line[at - 1]) * np.int32(base) + line[at], lengths + 1


def weighted_triples(words: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct triples of words, in order, and the sums of their weights. What is held grows with the bytes
    that occur, not with all that could."""
    symbols = np.append(np.flatnonzero(np.bincount(_bytes_of(words)[0], minlength=EDGE)), EDGE)
    size = len(symbols)
    sums = np.zeros(size**3)
    for begin in range(0, len(words), WORDS_AT_ONCE):
        keys, lengths = triples(words[begin:begin + WORDS_AT_ONCE], symbols)
        counts = np.bincount(keys, np.repeat(weights[begin:begin + WORDS_AT_ONCE], lengths))
        sums[:len(counts)] += counts
    found = np.flatnonzero(sums)
    numbers = (symbols[found // size**2] * SYMBOLS + symbols[found // size % size]) * SYMBOLS + symbols[found % size]
    return numbers, sums[found].astype(np.int64)


@dataclass
class State:
    """A sample of the model: what the word restaurant needs beside each word's customers and tables."""

    spelling: ByteModel
    customers: int
    tables: int
    discount: float

    def log_chances(self, c: np.ndarray, t: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        new = np.log(WORD_STRENGTH + self.discount * self.tables) + spelled
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(c - self.discount * t, 0))
        return np.logaddexp(own, new) - np.log(WORD_STRENGTH + self.customers)


def squeezed(data) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def loosened(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    return squeezed(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(loosened(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).ravel()


def word_blob(words: pa.Array) -> bytes:
    """Words, which hold no white space, as one row."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()))
    return squeezed(pc.binary_join(lists, b"\n")[0].as_py())


def word_array(data: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([loosened(data)], pa.binary()), b"\n").values


def tokens_of(texts: pa.Array) -> pa.ListArray:
    """Words of each text and the empty word as its end, which is what stands behind a last space."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), "", pc.binary_join_element_wise(trimmed, " ", "")))


def chunked(docs: DataFrame, id_col: str, text: str, held_out: Column) -> DataFrame:
    """Rows of whole documents: ids, what is held out, tokens per document, distinct words with their training count,
    the tokens as numbers of those words, and the distinct pairs of them with their training count. The empty word is the
    end token."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), held_out.alias("held"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, chars, pieces = TaskContext.get().partitionId(), 0, 0, []

        def finished() -> pa.RecordBatch:
            rows = pa.Table.from_batches(pieces).combine_chunks()
            words = tokens_of(rows["text"].combine_chunks().cast(pa.string()))
            lengths, coded = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
            tokens, held = coded.indices.to_numpy().astype(np.uint32), rows["held"].to_pylist()
            trained = _trained(held, lengths)
            seen = np.bincount(tokens[trained], minlength=len(coded.dictionary)).astype(np.uint32)
            pairs, at = keyed(tokens, len(seen))
            pair_seen = np.bincount(at[trained], minlength=len(pairs)).astype(np.uint32)
            words = word_blob(coded.dictionary)
            del coded
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([(task << 32) + made], pa.int64()),
                "ids": pa.array([rows["id"].to_pylist()], pa.list_(pa.string())),
                "held": pa.array([held], pa.list_(pa.bool_())),
                "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())),
                "n_words": pa.array([len(seen)], pa.int64()),
                "words": pa.array([words], pa.binary()),
                "seen": pa.array([packed(seen)], pa.binary()),
                "tokens": pa.array([packed(tokens)], pa.binary()),
                "pairs": pa.array([packed(np.diff(pairs, prepend=np.uint64(0)))], pa.binary()),
                "pair_seen": pa.array([packed(pair_seen)], pa.binary()),
            })

        for batch in batches:
            begin = 0
            for at, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                if chars and chars + size > CHUNK_CHARS:
                    pieces.append(batch.slice(begin, at - begin))
                    yield finished()
                    made, chars, pieces, begin = made + 1, 0, [], at
                chars += size
            pieces.append(batch.slice(begin))
        if any(piece.num_rows for piece in pieces):
            yield finished()

    return slim.mapInArrow(run, "chunk bigint, ids array<string>, held array<boolean>, lengths array<bigint>, "
                           "n_words bigint, words binary, seen binary, tokens binary, pairs binary, pair_seen binary")


def word_list(data: bytes) -> list[bytes]:
    return loosened(data).split(b"\n")


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _part(hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The part of hashes of so many bits: equal ranges, in order."""
    return ((hashes >> np.uint64(bits - 24)) * np.uint64(parts)) >> np.uint64(24)


def _by_part(part: np.ndarray, parts: int) -> list[np.ndarray]:
    """Places of each part, in order."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


@dataclass
class Pairs:
    """Distinct pairs of a chunk by the order of their hashes: words (local numbers), and the pair of each token if asked."""

    hashes: np.ndarray
    before: np.ndarray
    word: np.ndarray
    at: np.ndarray | None = None


def order_of(values: np.ndarray) -> np.ndarray:
    """Places in order of the values (but for their last bits, where values and places do not fit one number)."""
    bits = max(len(values) - 1, 1).bit_length()
    low, high = values.min(), values.max()
    drop = np.uint64(max(0, int(high - low).bit_length() + bits - 64))
    joint = ((values - low) >> drop) << np.uint64(bits) | np.arange(len(values), dtype=np.uint64)
    return (np.sort(joint) & np.uint64((1 << bits) - 1)).astype(np.int64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and which of them each value is; by one plain sort where that fits."""
    if int(values.max() - values.min()).bit_length() + max(len(values) - 1, 1).bit_length() > 64:
        return np.unique(values, return_index=True, return_inverse=True)
    order = order_of(values)
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.empty(len(values), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], order[new], at


def keyed(tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a token and the one before, as numbers in order, and the pair of each token. Before the first text's
    first word stands the end token, as before all others."""
    before = np.concatenate([tokens[-1:], tokens[:-1]])
    found, _, at = distinct(before.astype(np.uint64) * np.uint64(n) + tokens)
    return found, at


def hashed(keys: np.ndarray, hashes: np.ndarray) -> tuple[Pairs, np.ndarray]:
    """Pairs of numbers of ``keyed`` by the order of their hashes, and that order."""
    before, word = (x.astype(np.uint32) for x in np.divmod(keys, np.uint64(len(hashes))))
    h = _mixed(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[word]) >> np.uint64(64 - PAIR_BITS)
    order = order_of(h)
    return Pairs(h[order], before[order], word[order]), order


def pairs_of(tokens: np.ndarray, hashes: np.ndarray) -> Pairs:
    keys, at = keyed(tokens, len(hashes))
    pairs, order = hashed(keys, hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs.at = rank[at]
    return pairs


def pairs_kept(data: bytes, hashes: np.ndarray) -> tuple[Pairs, np.ndarray]:
    return hashed(np.cumsum(unpacked(data, np.uint64), dtype=np.uint64), hashes)


def _trained(held, lengths) -> np.ndarray:
    return np.repeat(~np.asarray(held, bool), np.asarray(lengths, np.int64))


def ask_words(chunks: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, words, seen): what each chunk asks each part of the words for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, seen in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "seen"))):
                words, counts = word_array(data), unpacked(seen, np.uint32)
                places = _by_part(_part(word_hashes(word_list(data)), parts, 64), parts)
                rows = [(p, word_blob(words.take(pa.array(at))), packed(counts[at]))
                        for p, at in enumerate(places) if len(at)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()),
                    "words": pa.array([r[1] for r in rows], pa.binary()), "seen": pa.array([r[2] for r in rows], pa.binary()),
                })

    asked = chunks.select("chunk", "words", "seen").mapInArrow(run, "part int, chunk bigint, words binary, seen binary")

    def meet(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        coded = pa.chunked_array([word_array(data) for data in frame["words"]]).combine_chunks().dictionary_encode()
        counts = [unpacked(seen, np.uint32) for seen in frame["seen"]]
        numbers = coded.indices.to_numpy().astype(np.uint32)
        places = np.split(numbers, np.cumsum([len(n) for n in counts])[:-1])
        c = np.bincount(numbers, np.concatenate(counts), minlength=len(coded.dictionary)).astype(np.int64)
        once, twice = int((c == 1).sum()), int((c == 2).sum())
        return pd.DataFrame({
            "part": [key[0]], "words": [word_blob(coded.dictionary)], "c": [packed(c)],
            "chunks": [frame["chunk"].tolist()], "places": [[packed(p) for p in places]],
            "n": [int(c.sum())], "v": [int((c > 0).sum())], "once": [once], "twice": [twice]})

    return asked.groupBy("part").applyInPandas(
        meet, "part int, words binary, c binary, chunks array<bigint>, places array<binary>, n bigint, v bigint, "
        "once bigint, twice bigint")


def ask_pairs(chunks: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, c, own, once, twice): training counts of the pairs of each chunk, by part and in order of their hashes,
    and which of them the chunk is to count as distinct; once and twice are sums for a part, on one of its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, kept, seen in zip(*(batch.column(c) for c in ("chunk", "words", "pairs", "pair_seen"))):
                pairs, order = pairs_kept(kept.as_py(), word_hashes(word_list(words.as_py())))
                counts = unpacked(seen.as_py(), np.uint32)[order]
                rows = [(p, packed(np.diff(pairs.hashes[at], prepend=np.uint64(0))), packed(counts[at]))
                        for p, at in enumerate(_by_part(_part(pairs.hashes, parts, PAIR_BITS), parts)) if len(at)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([r[0] for r in rows], pa.int32()),
                    "chunk": pa.array([chunk.as_py()] * len(rows), pa.int64()),
                    "steps": pa.array([r[1] for r in rows], pa.binary()), "seen": pa.array([r[2] for r in rows], pa.binary()),
                })

    asked = chunks.select("chunk", "words", "pairs", "pair_seen").mapInArrow(
        run, "part int, chunk bigint, steps binary, seen binary")

    def meet(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        hashes = [np.cumsum(unpacked(s, np.uint64), dtype=np.uint64) for s in frame["steps"]]
        seen = [unpacked(s, np.uint32) for s in frame["seen"]]
        found, _, at = distinct(np.concatenate(hashes))
        c = np.bincount(at, np.concatenate(seen), minlength=len(found)).astype(np.int64)
        claimed, rows, begin = np.zeros(len(found), bool), [], 0
        for n in seen:
            mine = at[begin:begin + len(n)]
            own = (n > 0) & ~claimed[mine]
            claimed[mine[own]] = True
            rows.append((packed(np.minimum(c[mine], 2**32 - 1).astype(np.uint32)), squeezed(np.packbits(own).tobytes())))
            begin += len(n)
        first = np.arange(len(rows)) == 0
        return pd.DataFrame({
            "chunk": frame["chunk"].to_numpy(), "part": key[0], "c": [r[0] for r in rows], "own": [r[1] for r in rows],
            "once": np.where(first, (c == 1).sum(), 0), "twice": np.where(first, (c == 2).sum(), 0)})

    return asked.groupBy("part").applyInPandas(
        meet, "chunk bigint, part int, c binary, own binary, once bigint, twice bigint")


def _pair_counts(answers: pd.DataFrame, sizes: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ownership of all pairs of a chunk, in order of their hashes."""
    answers = answers.sort_values("part")
    counts = [unpacked(c, np.uint32) for c in answers["c"]]
    own = [np.unpackbits(np.frombuffer(loosened(o), np.uint8))[:len(c)] for o, c in zip(answers["own"], counts)]
    c, mine = np.concatenate(counts).astype(np.int64), np.concatenate(own).astype(bool)
    assert len(c) == sizes
    return c, mine


@dataclass
class Asked:
    """What a chunk knows of its words and pairs once it has answers, in the order of its own numbers.

    ``base``: chances of words in the word restaurant (words that training lacks together); ``spelled``: logarithms, of
    their very spelling; ``c``: training tokens; ``followed``: tables of the context that a word is; ``seen`` and ``own``:
    training counts of pairs, and which of them this chunk counts; ``tables``: tables of pairs, once they are kept.
    """

    hashes: np.ndarray
    tokens: np.ndarray | None
    pairs: Pairs
    seen: np.ndarray
    own: np.ndarray
    c: np.ndarray | None = None
    followed: np.ndarray | None = None
    spelled: np.ndarray | None = None
    base: np.ndarray | None = None
    tables: np.ndarray | None = None


OF_PAIRS, OF_WORDS, KEPT = range(3)


def _kind(rows: DataFrame, kind: int, turn: int = 0, **columns: str) -> DataFrame:
    """Rows as answers: of pairs (c, a: own), of words (c, a: chances, b: followed), or tables kept (a); ``turn`` is the
    sweep of the contexts that they belong to."""
    values = [F.col(columns[k]) if k in columns else F.lit(None).cast("binary") for k in ("c", "a", "b")]
    return rows.select(F.lit(kind).alias("kind"), F.lit(turn).alias("turn"), F.col("chunk").alias("asker"), "part",
                       *[v.alias(k) for v, k in zip(values, ("c", "a", "b"))])


def read_answers(row: pd.Series, answers: pd.DataFrame) -> Asked:
    hashes = word_hashes(word_list(row["words"]))
    tokens = unpacked(row["tokens"], np.uint32) if "tokens" in row else None
    pairs = pairs_kept(row["pairs"], hashes)[0] if tokens is None else pairs_of(tokens, hashes)
    of_pairs = answers[answers["kind"] == OF_PAIRS].rename(columns={"a": "own"})
    return Asked(hashes, tokens, pairs, *_pair_counts(of_pairs, len(pairs.hashes)))


def read_turn(out: Asked, answers: pd.DataFrame, turn: int, parts: int, novel: float) -> None:
    """What the sweep before left of words and, if there was one, of the pairs' tables."""
    answers = answers[(answers["kind"] != OF_PAIRS) & (answers["turn"] == turn)]
    by_kind = {k: rows for k, rows in answers.groupby("kind")}
    if OF_WORDS in by_kind:
        told = by_kind[OF_WORDS].set_index("part")
        out.c, out.followed, out.spelled = (np.zeros(len(out.hashes), k) for k in (np.int64, np.int64, np.float64))
        for part, at in enumerate(_by_part(_part(out.hashes, parts, 64), parts)):
            if len(at):
                a = told.loc[part]
                out.c[at], out.followed[at] = unpacked(a["c"], np.int64), unpacked(a["b"], np.int64)
                out.spelled[at] = unpacked(a["a"], np.float32)
        out.base = np.where(out.c > 0, np.exp(out.spelled), novel)
    if KEPT in by_kind:
        out.tables = unpacked(by_kind[KEPT].iloc[0]["a"], np.uint32).astype(float)


def seat_pairs(chunks: DataFrame, answers: DataFrame, parts: int, discount: float, novel: float = 0.0,
               turn: int = 0) -> DataFrame:
    """Tables of all pairs: one each while the chunks have no answers about words, else drawn given those and, but in the
    first sweep, the tables that pairs have.

    Rows (part, chunk, followed, follows): sums over the pairs that a chunk counts, of the tables at which its words stand
    first and second, in the order it asked; and with a part of -1 the tables of all its pairs (followed).
    """
    def run(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = read_answers(chunk.iloc[0], answers)
        read_turn(known, answers, turn, parts, novel)
        pairs, t = known.pairs, np.minimum(known.seen, 1)
        rows = []
        if known.c is not None:
            now = t if known.tables is None else known.tables
            others = np.maximum(known.followed[pairs.before] - now, 0)
            t = pair_tables(known.seen, known.base[pairs.word], others, discount, pairs.hashes, turn)
            rows.append((-1, packed(t.astype(np.uint32)), None))
        n, own = len(known.hashes), known.own
        sums = [np.bincount(w[own], t[own], n).astype(np.int64) for w in (pairs.before, pairs.word)]
        rows += [(p, *(packed(s[at]) for s in sums))
                 for p, at in enumerate(_by_part(_part(known.hashes, parts, 64), parts)) if len(at)]
        return pd.DataFrame({"part": [r[0] for r in rows], "chunk": key[0], "followed": [r[1] for r in rows],
                             "follows": [r[2] for r in rows]})

    slim = chunks.select("chunk", "words", "pairs").groupBy("chunk")
    return slim.cogroup(answers.groupBy("asker")).applyInPandas(
        run, "part int, chunk bigint, followed binary, follows binary")


def opened(words: DataFrame, sums: DataFrame, seated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The word restaurant (part, words, c: its customers, which are the tables of contexts), and (part, followed). With
    ``seated`` (part, t), the restaurant has those tables (t) still, as far as its customers fill them; else each word with
    customers is to have one. Sums of a part: of customers and tables, and of words with one and two customers."""
    sums = sums.select("part", "chunk", "followed", "follows")
    if seated is not None:
        # No chunk has a number below 0.
        sums = sums.unionByName(seated.select("part", F.lit(-1).cast("bigint").alias("chunk"), F.col("t").alias("followed"),
                                              F.lit(None).cast("binary").alias("follows")))

    def run(key, word: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        row, sums = word.iloc[0], sums.sort_values("chunk")
        n = len(unpacked(row["c"], np.int64))
        kept, sums = sums[sums["chunk"] < 0], sums[sums["chunk"] >= 0]
        places = np.concatenate([unpacked(p, np.uint32) for p in row["places"]])
        totals = []
        for name in ("followed", "follows"):
            values = np.concatenate([unpacked(s, np.int64) for s in sums[name]])
            totals.append(np.bincount(places, values, minlength=n).astype(np.int64))
        c, t = totals[1], np.minimum(totals[1], 1)
        if not kept.empty:
            t = np.clip(unpacked(kept.iloc[0]["followed"], np.int64), t, c)
        return pd.DataFrame({"part": [key[0]], "words": [row["words"]], "followed": [packed(totals[0])], "c": [packed(c)],
                             "t": [None if kept.empty else packed(t)], "customers": [int(c.sum())], "tables": [int(t.sum())],
                             "once": [int((c == 1).sum())], "twice": [int((c == 2).sum())]})

    joined = words.select("part", "words", "c", "places").groupBy("part").cogroup(sums.groupBy("part")).applyInPandas(
        run, "part int, words binary, followed binary, c binary, t binary, customers bigint, tables bigint, once bigint, "
        "twice bigint")
    stored = materialise(joined, "opened")
    kept = [] if seated is None else ["t"]
    return (stored.select("part", "words", "c", *kept, "customers", "tables", "once", "twice"),
            stored.select("part", "followed"))


def _tables(t: bytes | None, c: bytes) -> np.ndarray:
    """Tables of words: one for each with customers, where none have been seated yet."""
    return np.minimum(unpacked(c, np.int64), 1) if t is None else unpacked(t, np.int64)


def spelling_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Byte triples of (words, c, t) with the tables as weights; summed in the tasks, then by Spark, then at most 257 ** 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, c, t in zip(*(batch.column(x) for x in ("words", "c", "t"))):
                t = _tables(t.as_py(), c.as_py())
                held = np.flatnonzero(t > 0)
                if not len(held):
                    continue
                found, counts = weighted_triples(word_array(data.as_py()).take(pa.array(held)), t[held])
                yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.int64()), "n": pa.array(counts, pa.int64())})

    counted = words.select("words", "c", "t").mapInArrow(run, "key bigint, n bigint")
    table = counted.groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    return table["key"].to_numpy(), table["n"].to_numpy().astype(float)


def sweep(words: DataFrame, state: State, count_in: bool, reseat: bool, fresh: bool, seed: int) -> DataFrame:
    """One pass over the parts (part, words, c, t, p): adds the sample's chances to exp(p), 0 while p is null, if
    ``count_in``; seats the customers if ``reseat``. ``tables`` and ``spelled`` are sums of the part: of tables, and of the chances that the sampled
    state spells a word that training holds. Chances are kept in single precision, a relative 1e-7."""
    shared = words.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                listed = word_array(row["words"])
                c, t = unpacked(row["c"], np.int64).astype(float), _tables(row["t"], row["c"])
                p = np.full(len(c), -np.inf) if row["p"] is None else unpacked(row["p"], np.float32).astype(float)
                spelled = state.spelling.log_spelling(listed)
                held = np.flatnonzero(c > 0)
                known = float(np.exp(spelled[held]).sum()) if count_in else 0.0
                if count_in:
                    p = np.logaddexp(p, state.log_chances(c, t, spelled))
                if reseat:
                    # The seed follows from the part, so a lost task seats its words the same way again.
                    rng = np.random.default_rng([seed, row["part"]])
                    now = t[held]
                    t = np.zeros(len(c), np.int64)
                    t[held] = seat(c[held], np.exp(spelled[held]), state.tables - now, state.discount, WORD_STRENGTH,
                                   rng, None if fresh else now)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]], pa.int32()), "words": pa.array([row["words"]], pa.binary()),
                    "c": pa.array([row["c"]], pa.binary()), "t": pa.array([packed(t)], pa.binary()),
                    "p": pa.array([packed(p.astype(np.float32))], pa.binary()),
                    "tables": pa.array([int(t.sum())], pa.int64()), "spelled": pa.array([known], pa.float64()),
                })

    return words.select("part", "words", "c", "t", "p").mapInArrow(
        run, "part int, words binary, c binary, t binary, p binary, tables bigint, spelled double")


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def learn(words: DataFrame, seed: int, burn_in: int, samples: int) -> tuple[DataFrame, float]:
    """Chances of the words of ``opened`` (part, words, c), averaged over samples: (part, p: their natural logarithms and that of
    ``samples``, t: tables at last), and the chance that a token is any word that the training documents lack. Without a sweep
    of burn-in, the first sample is the first seating; that is of the tables t where the words have such."""
    carried, none = "t" in words.columns, F.lit(None).cast("binary")
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("customers", "tables", "once", "twice")]).first()
    discount, tables, novel = _discount(*total[2:]), total[1], 0.0
    words = words.select("part", "words", "c", (F.col("t") if carried else none).alias("t"), none.alias("p"))
    for turn in range(1, burn_in + samples + 1):
        state = State(ByteModel(*spelling_counts(words), seed + turn), total[0], tables, discount)
        sampled, last = turn > burn_in, turn == burn_in + samples
        swept = sweep(words, state, sampled, not last, turn == 1 and not carried, seed + 100 + turn)
        words = materialise(swept.drop("words", "c") if last else swept, f"seated-{turn}")
        tables, spelled = words.agg(F.coalesce(F.sum("tables"), F.lit(0)), F.coalesce(F.sum("spelled"), F.lit(0.0))).first()
        if sampled:
            new = WORD_STRENGTH + state.discount * state.tables
            novel += new / (WORD_STRENGTH + state.customers) * max(1 - spelled, 1e-12)
    return words.select("part", "p", "t"), novel / samples


def answer_words(words: DataFrame, facts: DataFrame, chances: DataFrame, samples: int) -> DataFrame:
    """(chunk, part, p, c, followed): for each chunk and part, in the order asked, the chance of each word, its training
    tokens, and the tables of the context that it is."""
    def run(key, word: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = word.iloc[0]
        p = unpacked(found["p"].dropna().iloc[0], np.float32) - np.float32(math.log(samples))
        c, followed = unpacked(row["c"], np.int64), unpacked(found["followed"].dropna().iloc[0], np.int64)
        places = [unpacked(x, np.uint32) for x in row["places"]]
        return pd.DataFrame({
            "chunk": list(row["chunks"]), "part": key[0], "p": [packed(p[x]) for x in places],
            "c": [packed(c[x]) for x in places], "followed": [packed(followed[x]) for x in places]})

    found = facts.unionByName(chances.select("part", "p"), allowMissingColumns=True)
    asked = words.select("part", "c", "chunks", "places").groupBy("part")
    return asked.cogroup(found.groupBy("part")).applyInPandas(run, "chunk bigint, part int, p binary, c binary, followed binary")


def pair_tables(c, base, others, discount: float, hashes: np.ndarray, turn: int = 0) -> np.ndarray:
    """Tables of pairs, drawn by uniform numbers that follow from their hashes and the sweep: every chunk draws the same."""
    if len(c) > PAIRS_AT_ONCE:
        blocks = [slice(at, at + PAIRS_AT_ONCE) for at in range(0, len(c), PAIRS_AT_ONCE)]
        return np.concatenate([pair_tables(c[b], base[b], others[b], discount, hashes[b], turn) for b in blocks])
    c = c.astype(float)
    out = np.minimum(c, 1)

    def uniform(at, salt):
        return (_mixed(hashes[at] + np.uint64((0x9E3779B97F4A7C15 * (1 + 3 * turn + salt)) % 2**64)) >> np.uint64(11)) * 2.0**-53

    few = np.flatnonzero((c > 1) & (c <= EXACT_CUSTOMERS))
    out[few] = _drawn(c[few], base[few], others[few], discount, PAIR_STRENGTH, uniform(few, 0))
    many = np.flatnonzero(c > EXACT_CUSTOMERS)
    if len(many):
        out[many] = _drawn_many(
            c[many], base[many], others[many], discount, PAIR_STRENGTH, uniform(many, 2), uniform(many, 1))
    return out


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", sweeps: int = 1,
          samples: int = 1) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score and perplexity.

    The contexts take ``sweeps`` sweeps in turn with words and bytes; the chances after the last ``samples`` are averaged.

    ``score`` takes all words that the training documents lack as one, as the base does: its chance is what the model
    leaves for them together. ``spelled_score`` has each of them with the chance of its very spelling instead.
    ``perplexity`` is that of ``score``, per token.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = materialise(chunked(docs, id_col, text, held_out), "chunks")
    n_words, n_tokens = chunks.agg(
        F.coalesce(F.sum("n_words"), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()
    word_parts, pair_parts = 1 + n_words // PART_WORDS, 1 + n_tokens // PART_PAIRS
    words = materialise(ask_words(chunks, word_parts), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    pairs = materialise(ask_pairs(chunks, pair_parts), "pairs")
    discount = _discount(*pairs.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first())
    counted = _kind(pairs, OF_PAIRS, c="c", a="own")
    first, facts = opened(words, seat_pairs(chunks, counted, word_parts, discount))
    chances, novel = learn(first, 1, 0, 1)
    told = _kind(answer_words(words, facts, chances, 1), OF_WORDS, c="c", a="p", b="followed")
    answers, novels, averaged = counted, {}, max(1, SAMPLES // samples)
    for turn in range(sweeps):
        release_shuffles(docs.sparkSession)
        drawn = seat_pairs(chunks, counted.unionByName(told), word_parts, discount, novel, *([turn] if turn else []))
        seated = materialise(drawn, f"pair-tables-{turn}")
        restaurant, facts = opened(words, seated.where("part >= 0"), chances if turn else None)
        chances, novel = learn(restaurant, 1001 * (turn + 1), BURN_IN, averaged)
        told = _kind(answer_words(words, facts, chances, averaged), OF_WORDS, turn + 1, c="c", a="p", b="followed").unionByName(
            _kind(seated.where("part < 0"), KEPT, turn + 1, a="followed"))
        if turn >= sweeps - samples:
            answers, novels[turn + 1] = answers.unionByName(told), novel
    release_shuffles(docs.sparkSession)

    def run(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        known = read_answers(row, answers)
        pairs, tokens = known.pairs, known.tokens
        chance, spelled = np.zeros(len(pairs.hashes)), np.zeros(len(pairs.hashes))
        for turn, novel in novels.items():
            read_turn(known, answers, turn, word_parts, novel)
            context, tables = known.c[pairs.before], known.followed[pairs.before]
            own = np.maximum(known.seen - discount * known.tables, 0)
            one = (own + (PAIR_STRENGTH + discount * tables) * known.base[pairs.word]) / (PAIR_STRENGTH + context)
            lack = np.where(known.c > 0, 0.0, known.spelled - math.log(max(novel, 1e-300)))
            chance += one / len(novels)
            spelled += one * np.exp(lack)[pairs.word] / len(novels)
        c = known.c
        with np.errstate(divide="ignore"):
            logs, spelled_logs = np.log10(chance), np.log10(spelled)
        lengths = np.asarray(row["lengths"], np.int64)
        begin = np.cumsum(lengths) - lengths
        out = pd.DataFrame({
            "id": list(row["ids"]),
            "held_out": np.asarray(row["held"], bool),
            "n_tokens": lengths,
            "n_known": np.add.reduceat((c > 0).astype(np.int64)[tokens], begin),
            "train_tokens": n,
            "base_score": np.add.reduceat(np.log10((c + 1) / (n + v + 1))[tokens], begin),
            "score": np.add.reduceat(logs[pairs.at], begin),
            "spelled_score": np.add.reduceat(spelled_logs[pairs.at], begin),
        })
        out["perplexity"] = 10 ** np.minimum(-out["score"] / out["n_tokens"], 300)
        return out

    schema = ("id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
              "score double, spelled_score double, perplexity double")
    slim = chunks.select("chunk", "ids", "held", "lengths", "words", "tokens")
    out = slim.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInPandas(run, schema)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
