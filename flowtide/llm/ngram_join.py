"""N-gram Jaccard join: all pairs of texts whose word shingles overlap by a threshold, by pruned MinHash comparison.

Equal texts are one node. Nodes that share a band of MinHash values are candidates; each connected set of candidates is
compared block by block: hash values are compared a few at a time, and a pair goes as soon as the posterior probability
(uniform prior) that its similarity reaches the threshold falls below ``TOLERANCE``. What stays is verified exactly on the
shingle sets. A block task gives link counts and a spanning forest of its links, never the pairs, so large groups of near
copies cost comparisons but no rows. Sets larger than a block, in texts or in bytes, are dealt out as pairs of blocks.

Cases: shingles are ``SHINGLE`` words in a row; a text of fewer words is one shingle of them all; a null, empty or blank
text has no shingle and is a class of its own; rows may repeat and belong to the same class; null ids are kept; the class
id is the least id of the class. Columns other than id and text are not read. An empty table gives an empty result. Texts
are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.storage import materialise

from .common import partitions, salted_join, spread_join

SHINGLE = 5
THRESHOLD = 0.8
#: 32 bands of 6 values miss a pair of similarity 0.8 with probability 6e-5, and pairs above it far less often.
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
#: Hash values compared between two looks at the posterior, and the probability below which a pair goes.
STEP = 16
TOLERANCE = 1e-6
#: Nodes of one side of a block comparison, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 256, 32_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MULTIPLIERS, _SHIFTS = (
    np.random.default_rng(20240501).integers(1, 2**32, (2, HASHES), dtype=np.uint32) | np.array([[1], [0]], np.uint32)
)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit hashes so that every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    words = _WORD.findall(text)
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(digest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if n == 1 and len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a shingle set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):
        part = low[at:at + 512, None] * _MULTIPLIERS
        part += _SHIFTS
        np.minimum(best, part.min(axis=0), out=best)
    return best


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step, the fewest equal values with which a pair may stay.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def surviving_pairs(a: np.ndarray, b: np.ndarray, threshold: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (signatures) that no look at the posterior drops; ``upper``: a is b, each pair once."""
    equal = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        equal += a[:, k, None] == b[None, :, k]
    good = equal >= least_matches(threshold)[0]
    if upper:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    counts = equal[i, j]
    for step, least in enumerate(least_matches(threshold)[1:], 1):
        for at in range(0, len(i), 200_000):
            part = slice(at, at + 200_000)
            cut = slice(step * STEP, (step + 1) * STEP)
            counts[part] += (a[i[part], cut] == b[j[part], cut]).sum(axis=1, dtype=np.int16)
        keep = counts >= least
        i, j, counts = i[keep], j[keep], counts[keep]
    return i, j


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (places in ``sets``) reach the threshold, exactly.

    Shingles get dense numbers; the overlaps of many pairs come from a matrix product over slices of the shingles that
    two or more sets hold, those of few pairs from merging.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    used = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(used):
        overlap = np.array([
            len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    else:
        place = np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        values = np.concatenate([sets[x] for x in used])
        owner = np.repeat(np.arange(len(used)), sizes[used])
        _, code, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[code] > 1
        owner, code = owner[shared], code[shared]
        _, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        total = np.zeros((len(used), len(used)), np.float32)
        width = 4096
        last = int(code[-1]) + 1 if len(code) else 0
        for at in range(0, last, width):
            a, b = np.searchsorted(code, [at, at + width])
            held = np.zeros((len(used), min(width, last - at)), np.float32)
            held[owner[a:b], code[a:b] - at] = 1
            total += held @ held.T
        overlap = total[place[i], place[j]].astype(np.int64)
    # Written with integers where the threshold is a ratio of small ones: no pair is lost to rounding.
    return overlap * 1_000_000 >= round(threshold * 1_000_000) * (sizes[i] + sizes[j] - overlap)


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same nodes without circles."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = top(x), top(y)
        if a != b:
            parent[a] = b
            out.append((x, y))
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node of each connected set; ``edges`` are pairs (a, b) of nodes, stored.

    First each node hands its smaller neighbours on to the least of them: a group of near copies, whose members share many
    of them, shrinks to about one edge a member. Then, each round, every node takes the least root among its own and its
    neighbours', and then that root's root. Tables are written each round, so a lost executor costs no more than a round.
    """
    ordered = edges.where("a != b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    ordered = materialise(ordered, f"{name}-ordered")
    least = ordered.groupBy("high").agg(F.min("low").alias("least"))
    handed = salted_join(ordered, least, ["high"], ["low"]).where("low != least")
    both = least.select(F.col("least").alias("a"), F.col("high").alias("b")).unionByName(
        handed.select(F.col("least").alias("a"), F.col("low").alias("b")).distinct())
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                       f"{name}-edges")
    roots = materialise(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        # Hubs and common roots are hot keys of these joins, so they are spread by the other node.
        named = roots.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = salted_join(both, named, ["b"], ["a"]).groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        hooked = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        moved = salted_join(hooked, jump, ["low"], ["node"], "left").select(
            "node", F.coalesce("lower", "low").alias("root"), (F.coalesce("lower", "low") != F.col("root")).alias("moved"))
        moved = materialise(moved, f"{name}-{turn}")
        roots = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return roots


def _signatures(texts: DataFrame) -> DataFrame:
    """(node, bands, sig) of texts (node, text) with a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, bands, sigs = [], [], []
                for node, text in zip(part.column("node").to_pylist(), part.column("text")):
                    found = shingles(text.as_py())
                    if not len(found):
                        continue
                    sig = signature(found)
                    codes = np.arange(BANDS, dtype=np.uint64)
                    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
                        codes = _mixed(codes * np.uint64(0x9E3779B97F4A7C15) + column)
                    nodes.append(node)
                    bands.append(codes.view(np.int64))
                    sigs.append(sig.tobytes())
                flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
                offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(nodes, pa.binary()),
                    "bands": pa.ListArray.from_arrays(offsets, pa.array(flat)),
                    "sig": pa.array(sigs, pa.binary()),
                })

    return texts.mapInArrow(run, "node binary, bands array<bigint>, sig binary")


def _compare(threshold: float):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Links inside one bin of small sets, or between (or inside) two blocks of a large one."""
        links, edges = {}, []
        for (_, x, y), part in frame.groupby(["root", "x", "y"], sort=False):
            part = part.sort_values("block", kind="stable")
            nodes = part["node"].to_numpy()
            sigs = np.stack([np.frombuffer(s, np.uint32) for s in part["sig"]])
            first = int((part["block"] == x).sum())
            if x == y:
                i, j = surviving_pairs(sigs, sigs, threshold, upper=True)
            else:
                i, j = surviving_pairs(sigs[:first], sigs[first:], threshold, upper=False)
                j = j + first
            if not len(i):
                continue
            sets: list[np.ndarray] = [np.empty(0, np.uint64)] * len(nodes)
            texts = part["text"].to_numpy()
            for k in np.unique(np.concatenate([i, j])):
                sets[k] = shingles(texts[k])
            good = exact_links(sets, i, j, threshold)
            i, j = i[good], j[good]
            for k, n in zip(*np.unique(np.concatenate([i, j]), return_counts=True)):
                links[nodes[k]] = links.get(nodes[k], 0) + int(n)
            edges += [(nodes[a], nodes[b]) for a, b in _forest(i, j)]
        rows = [(n, n, k) for n, k in links.items()] + [(a, b, 0) for a, b in edges]
        return pd.DataFrame(rows, columns=["a", "b", "links"]).astype({"links": "int64"})

    return compare


def _classes(docs: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    slim = slim.withColumn("worded", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    digest = F.sha2("text", 256)

    # Nodes are texts, known by 128 bits of their digest.
    def node_of(sha):
        return F.unhex(F.substring(sha, 1, 32))

    ids = materialise(slim.select(
        "id", "worded", F.when(F.col("worded"), digest).alias("sha"), F.octet_length("text").alias("bytes")), "text-ids")
    texts = ids.where("worded").groupBy("sha").agg(
        F.min("id").alias("least"), F.count("*").alias("n_copies"), F.first("bytes").alias("bytes"))
    texts = materialise(texts.withColumn("node", node_of(F.col("sha"))), "texts")

    sigs = _signatures(slim.where("worded").select(
        node_of(digest).alias("node"), "text"))
    sigs = materialise(sigs, "signatures")
    in_band = sigs.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    least = in_band.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = spread_join(in_band, materialise(least, "bands"), "band", "n", salt_by=["node"]).where("node != a")
    roots = components(materialise(stars.select("a", F.col("node").alias("b")).distinct(), "stars"), "candidates")

    # Each set of candidates in blocks; a node goes to every pair of blocks that its own is part of.
    held_bytes = F.sum(F.col("bytes").cast("bigint"))
    sizes = roots.join(texts.select("node", "bytes"), "node").groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(held_bytes / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"),
        held_bytes.alias("bytes"))
    sizes = materialise(sizes, "sizes")
    in_small = sizes.where("blocks = 1").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bins = max(partitions(spark), 1 + roots.count() // (2 * BLOCK), 1 + in_small // BLOCK_BYTES)
    sizes = sizes.drop("bytes")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = salted_join(roots, sizes, ["root"], ["node"]).withColumn("block", block)
    signed = dealt.join(sigs.select("node", "sig").dropDuplicates(["node"]), "node")
    wanted = dealt.join(texts.select("node", "least"), "node").select(F.col("node").alias("n"), "least")
    held = slim.where("worded").select(
        "id", node_of(digest).alias("node"), "text")
    # One row of each text: its least id; the copies' rows spread, as the id is part of the key.
    held = held.join(wanted.hint("shuffle_hash"), (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("least")),
                     "left_semi").select("node", "text").dropDuplicates(["node"])
    ready = signed.join(held, "node").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ready = ready.select(
        "root", "node", "block", "sig", "text",
        F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins)))
        .otherwise(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))).alias("bin"),
        (F.col("blocks") == 1).alias("small"),
    )
    found = materialise(
        ready.groupBy("small", "bin").applyInPandas(_compare(threshold), "a binary, b binary, links bigint"), "links")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    classes = components(found.where("a != b").select("a", "b"), "classes")

    named = texts.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The first text of a class: that of the least id, a null one last; of texts that share it, the lower node.
    lowest = named.groupBy("root").agg(
        F.min("least").alias("class_id"),
        F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))["node"].alias("first_node"))
    judged = salted_join(named, lowest, ["root"], ["node"]).join(links, "node", "left").select(
        "sha", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies",
        (F.col("node") == F.col("first_node")).alias("first_text"))
    out = salted_join(ids, judged, ["sha"], ["id"], "left", salts=4)
    return out.select(
        "id",
        "sha",
        F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
        (~F.col("worded") | (F.col("first_text") & F.col("class_id").eqNullSafe(F.col("id")))).alias("is_first"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of ``docs``: id, ``class_id``, ``n_links`` (other texts it reaches the threshold with), ``n_copies``
    (rows of its very text) and ``is_first`` (its id is the class id; where texts of a class share that id, or all ids are
    null, only rows of one of them)."""
    return _classes(docs, id_col, text, threshold).drop("sha").withColumnRenamed("id", id_col)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each class, with all its columns; of rows that repeat its id and text, one."""
    first = _classes(docs, id_col, text, threshold).where("is_first")
    first = materialise(first.groupBy(F.col("id").alias("__id"), F.col("sha").alias("__sha")).agg(
        F.count("*").alias("__rows")), "first")
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumn("__digest", F.when(worded, F.sha2(text, 256)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col("__digest").eqNullSafe(F.col("__sha"))
    kept = keyed.join(first, same, "left_semi")
    if not first.where("__rows > 1 and __sha is not null").isEmpty():
        blank = F.col("__digest").isNull()
        kept = kept.where(~blank).dropDuplicates([id_col, "__digest"]).unionByName(kept.where(blank))
    return kept.drop("__digest")
