"""Line dedup by content-defined chunks: lines group into chunks at boundaries that the lines themselves choose.

Each line has a hash; a rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is 0 modulo ``DIVISOR``,
and a line of ``LONG_WORDS`` or more words is a chunk by itself. So a passage is cut the same way wherever it stands.
Chunks that come more than once in the table are removed but for the first (least id, text hash, line), after their bytes
have been compared. Only chunks of two or more lines with words, or of ``LONG_WORDS`` words, count. A document left
with nothing but lines that are repeated elsewhere is emptied: its text was all copies.

With ``passages`` every run of lines goes too that has ``LONG_WORDS`` words or more and stands, byte for byte, at an earlier
place. For that, each line begins the shortest run of so many words and ends another; these windows cover just the same
lines as all repeated runs, so where a run begins, and how it is cut into chunks, does not matter. Windows that share a hash
are compared by SHA-256. Where a passage overlaps its own repetition, its first period stays.

Cases: a null text counts as empty and stays null; rows of equal id and text count as one document and stay or change
alike; ties go to the smaller text hash, then the earlier line; other columns pass through, but for old ones named
``removed_lines``, ``emptied`` or ``cut_share``. An empty table gives an empty result. Texts are cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.storage import materialise

from .common import WORD_GAP, let, salted_join, sums_before

WINDOW = 2
BASE = 31
DIVISOR = 4
LONG_WORDS = 50
_BITS = 28


def line_hash(line: Column) -> Column:
    """28 bits of a digest, the same in any engine."""
    return F.conv(F.substring(F.md5(line), 1, _BITS // 4), 16, 10).cast("bigint")


def _word_count(line: Column) -> Column:
    """Words of a line: gaps between a word character and its follower, counted without making the words."""
    return F.size(F.filter(F.split(line, f"[{WORD_GAP}]+"), lambda w: w != F.lit("")))


def chunks(text: Column) -> Column:
    """Array of (start, n_lines, n_worded, n_words, hash, body) of the text's chunks; ``start`` is a line number from 0."""

    def cut(lines):
        facts = F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), _word_count(x).alias("n")))

        def with_facts(f):
            def is_long(i):
                return F.coalesce(F.get(f, i)["n"] >= LONG_WORDS, F.lit(True))

            def rolled(i):
                total = F.get(f, i)["h"]
                for back in range(1, WINDOW):
                    total = total + F.coalesce(F.get(f, i - back)["h"], F.lit(0).cast("bigint")) * BASE**back
                return total % DIVISOR == 0

            starts = F.filter(
                F.sequence(F.lit(0), F.size(lines) - 1),
                lambda i: (i == 0) | is_long(i) | is_long(i - 1) | rolled(i - 1),
            )

            def with_starts(s):
                def chunk(start, k):
                    n = F.coalesce(F.get(s, k + 1), F.size(lines)) - start
                    own = F.slice(f, start + 1, n)
                    body = F.array_join(F.slice(lines, start + 1, n), "\n")
                    return F.struct(
                        start.alias("start"),
                        n.alias("n_lines"),
                        F.size(F.filter(own, lambda x: x["n"] > 0)).alias("n_worded"),
                        F.aggregate(own, F.lit(0), lambda acc, x: acc + x["n"]).alias("n_words"),
                        F.xxhash64(body).alias("hash"),
                        body.alias("body"),
                    )

                return F.transform(s, chunk)

            return let(starts, with_starts)

        return let(facts, with_facts)

    return let(F.split(text, "\n", -1), cut)


def _counts(piece) -> Column:
    """Whether a repeated chunk goes by itself; shorter ones go only with the whole document."""
    return (piece["n_worded"] >= 2) | (piece["n_words"] >= LONG_WORDS)


def windows(text: Column) -> Column:
    """Array of (start, n_lines, hash): for each line with words the shortest run of ``LONG_WORDS`` words that it begins and
    the shortest that it ends, if of two or more lines (a longer line is a chunk)."""

    def find(lines):
        def with_counts(n):
            # The line of each word of the text, and how many words stand before each line.
            line_of = F.flatten(F.transform(n, lambda x, i: F.array_repeat(i, x)))

            def with_places(at, before):
                def end(i):
                    return F.get(at, (F.get(before, i) + (LONG_WORDS - 1)).cast("int"))

                def start(j):
                    word = (F.get(before, j) + F.get(n, j) - LONG_WORDS).cast("int")
                    return F.when(word >= 0, F.get(at, word))

                worded = F.filter(F.sequence(F.lit(0), F.size(n) - 1), lambda i: F.get(n, i) > 0)
                begun = F.transform(worded, lambda i: F.struct(i.alias("a"), end(i).alias("z")))
                ended = F.transform(worded, lambda j: F.struct(start(j).alias("a"), j.alias("z")))
                ended = F.filter(ended, lambda w: w["a"].isNotNull() & (end(w["a"]) != w["z"]))
                both = F.filter(F.concat(begun, ended), lambda w: w["z"] > w["a"])
                return F.transform(both, lambda w: let(w["z"] - w["a"] + 1, lambda k: F.struct(
                    w["a"].alias("start"), k.alias("n_lines"),
                    F.xxhash64(F.array_join(F.slice(lines, w["a"] + 1, k), "\n"), F.lit(1)).alias("hash"))))

            return let(F.struct(line_of.alias("at"), sums_before(n).alias("before")),
                       lambda s: with_places(s["at"], s["before"]))

        return let(F.transform(lines, _word_count), with_counts)

    return let(F.split(text, "\n", -1), find)


def repeated_chunks(docs: DataFrame, id_col: str, text: str, passages: bool = False) -> DataFrame:
    """(id, th, total, removed): per document, its worded chunks and the (start, n_lines, counts, window) of those whose
    bytes are also those of an earlier chunk of the table; with ``passages``, of such windows too."""
    slim = docs.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    slim = slim.withColumn("chunks", F.filter(chunks(F.col("text")), lambda c: c["n_worded"] > 0))
    facts = F.transform("chunks", lambda c: F.struct(
        c["start"].alias("start"), c["n_lines"].alias("n_lines"), c["hash"].alias("hash"), _counts(c).alias("counts"),
        F.lit(False).alias("window")))
    if passages:
        facts = F.concat(facts, F.transform(windows(F.col("text")), lambda w: F.struct(
            w["start"].alias("start"), w["n_lines"].alias("n_lines"), w["hash"].alias("hash"), F.lit(True).alias("counts"),
            F.lit(True).alias("window"))))
    stored = materialise(slim.select("id", "th", F.size("chunks").alias("total"), facts.alias("chunks")), "chunks")
    places = stored.select("id", "th", "total", F.explode("chunks").alias("c"))
    places = places.select("id", "th", "total", "c.*").distinct()
    first = places.groupBy("hash").agg(
        F.count("*").alias("n"),
        F.min(F.struct(F.col("id").alias("first_id"), F.col("th").alias("first_th"),
                       F.col("start").alias("first_start"))).alias("first"),
    ).where("n > 1").select("hash", "first.*")
    marked = salted_join(places, first, ["hash"], ["id", "th", "start"])
    marked = marked.withColumn("is_first", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
                               & (F.col("start") == F.col("first_start")))
    per_doc = marked.groupBy("id", "th", "total").agg(
        F.collect_list(F.struct("start", "n_lines", "hash", "counts", "window", "is_first")).alias("marks"))
    per_doc = materialise(per_doc, "marked")

    # The bytes: each marked chunk's text, against the text of the first chunk of its hash. Windows overlap, so theirs
    # would be many times the text; their digests stand for them.
    texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    with_text = per_doc.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))

    def body(lines, m):
        whole = F.array_join(F.slice(lines, m["start"] + 1, m["n_lines"]), "\n")
        return F.when(m["window"], F.sha2(whole, 256)).otherwise(whole)

    with_bodies = let(F.split("text", "\n", -1), lambda lines: F.transform("marks", lambda m: F.struct(
        m.alias("m"), body(lines, m).alias("body"))))
    bodies = with_text.select("id", "th", "total", F.explode(with_bodies).alias("b")).select(
        "id", "th", "total", "b.m.*", "b.body")
    bodies = materialise(bodies, "bodies")
    originals = bodies.where("is_first").select("hash", F.col("body").alias("first_body")).distinct()
    same = salted_join(bodies.where("not is_first"), originals, ["hash"], ["id", "th", "start"], salts=4)
    same = same.where("body = first_body")
    return same.groupBy("id", "th", "total").agg(
        F.array_sort(F.collect_set(F.struct("start", "n_lines", "counts", "window"))).alias("removed"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", passages: bool = False) -> DataFrame:
    """``docs`` with the repeated chunks (with ``passages``, also the repeated runs of ``LONG_WORDS`` words) cut from the
    text, ``removed_lines`` (line numbers from 0), ``emptied`` and ``cut_share`` (of the text's words)."""
    found = repeated_chunks(docs, id_col, text, passages).select(
        F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("total").alias("__total"),
        F.col("removed").alias("__removed"))
    keyed = docs.withColumn("__h", F.xxhash64(text))
    joined = keyed.join(
        found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    counted = F.filter("__removed", lambda r: r["counts"])
    copies = F.filter("__removed", lambda r: ~r["window"])
    all_copies = (F.size(copies) == F.col("__total")) & (F.size(counted) > 0)
    gone = F.when(all_copies, F.col("__removed")).otherwise(counted)
    numbers = F.flatten(F.transform(gone, lambda r: F.sequence(r["start"], r["start"] + r["n_lines"] - 1)))
    if passages:
        numbers = F.array_sort(F.array_distinct(numbers))
    numbers = F.coalesce(numbers, F.array().cast("array<int>"))
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(F.col("__gone"), i))
    cut = joined.withColumn("__gone", numbers).withColumns({
        "__emptied": F.coalesce(all_copies, F.lit(False)),
        "__text": F.when(F.size("__gone") == 0, F.col(text)).otherwise(F.array_join(kept, "\n")),
    })
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "removed_lines", "emptied", "cut_share")]
    before, after = _word_count(F.col(text)), _word_count(F.col("__text"))
    share = F.when(F.col("__emptied"), 1.0).when(F.size("__gone") == 0, 0.0).otherwise(1.0 - after / before)
    return cut.select(
        *others,
        F.when(F.col("__emptied"), F.lit("")).otherwise(F.col("__text")).alias(text),
        F.col("__gone").alias("removed_lines"),
        F.col("__emptied").alias("emptied"),
        share.alias("cut_share"),
    )
