"""Secret scans: known forms by pattern, the rest by two character Markov models.

One model learns random strings, the other ordinary identifiers, both from labelled samples; a run of key-like characters
is a secret when the log-likelihood ratio of the two exceeds ``MIN_LOG_ODDS``. Everything is built from column functions.

Cases: a null text counts as empty and has no spans; rows may repeat, each is scanned by itself; columns other than id and
text are not read. An empty table gives an empty result. Texts are scanned whole, in time that grows as they do. With no
samples of a class its model is flat. Of a run that touches spans of known forms, the parts outside them are judged.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, sums_before, whole_text, words_of

#: Known forms: kind, pattern, group that must be long, its least length.
FORMS = [
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so a run that must be long is found the same with the length in the pattern.
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
KINDS = [kind for kind, *_ in FORMS] + ["markov"]
#: Runs that the models judge, and the log odds from which they are secrets.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
MIN_LOG_ODDS = 14.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Stand-ins for the alphabet's characters, from the code points that are left to private use.
STAND_INS = "".join(chr(0xE000 + i) for i in range(len(ALPHABET)))
#: Distinct texts that labelled samples are taken from, at most (by smallest hash).
SAMPLE_TEXTS = 4000
SMOOTHING = 0.5


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches whose group is long enough."""

    none = F.array().cast("array<struct<start: int, kind: int, end: int, value: string>>")

    def located(gaps):
        hits = F.arrays_zip(
            F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        return F.when(F.size(gaps) == 1, none).otherwise(let(hits, with_hits))

    def with_hits(hits):
        lengths = F.transform(hits, lambda m: (F.length(m["gap"]) + F.length(m["hit"])).cast("bigint"))
        return let(sums_before(lengths), lambda before: F.filter(
            F.transform(hits, lambda m, i: span(m, F.get(before, i).cast("int") + F.length(m["gap"]))),
            lambda s: F.length(s["value"]) >= least))

    def span(m, start):
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m["hit"])).alias("end"),
                        m["value"].alias("value"))

    return let(F.split(text, pattern, -1), located)


def base_spans(text: Column) -> Column:
    return F.concat(*[spans(text, k, p, g, n) for k, (_, p, g, n) in enumerate(FORMS)])


def labelled_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(sample, random): values of known forms and digests as random strings, long words as ordinary identifiers.

    They come from at most ``SAMPLE_TEXTS`` distinct texts, those of the smallest hash; equal texts count once.
    """
    hashed = docs.select(whole_text(text).alias("t")).withColumn("h", F.xxhash64("t"))
    smallest = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).first()[0]
    if smallest is None:
        chosen = hashed.limit(0)
    else:
        chosen = hashed.where(F.col("h") <= smallest)
    digest = F.sha2("t", 256)
    strings = F.concat(
        F.transform(base_spans(F.col("t")), lambda s: F.struct(s["value"].alias("sample"), F.lit(True).alias("random"))),
        F.array(
            F.struct(F.base64(F.unhex(digest)).alias("sample"), F.lit(True).alias("random")),
            F.struct(digest.alias("sample"), F.lit(True).alias("random")),
        ),
        F.transform(
            F.filter(words_of(F.col("t")), lambda w: w.rlike(r"^[A-Za-z+/_=-]{6,}$")),
            lambda w: F.struct(w.alias("sample"), F.lit(False).alias("random")),
        ),
    )
    return chosen.select(F.explode(strings).alias("s")).select("s.*").distinct()


def character_codes(string: Column) -> Column:
    """Places in the alphabet, from 1; other characters are left out."""
    known = F.filter(F.split(string, ""), lambda c: c != F.lit(""))
    return F.filter(F.transform(known, lambda c: F.instr(F.lit(ALPHABET), c)), lambda c: c > 0)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters (row: the first one or the start), as one flat list.

    Pairs are counted in Spark; at most 2 * SIZE * SIZE counts reach the driver.
    """
    import math

    codes = character_codes(F.col("sample"))
    pairs = let(codes, lambda x: F.transform(
        x, lambda c, i: F.coalesce(F.get(x, i - 1), F.lit(0)) * F.lit(SIZE) + c))
    counted = samples.where("sample != ''").select("random", F.explode(pairs).alias("pair"))
    counts = [[SMOOTHING] * (SIZE * SIZE) for _ in range(2)]
    for random, pair, n in counted.groupBy("random", "pair").count().collect():
        counts[int(random)][pair] += n
    out = [0.0] * (SIZE * SIZE)
    for a in range(SIZE):
        row = slice(a * SIZE, (a + 1) * SIZE)
        plain, random = sum(counts[0][row]), sum(counts[1][row])
        for p in range(row.start, row.stop):
            out[p] = math.log(counts[1][p] / random) - math.log(counts[0][p] / plain)
    return out


def log_odds(run: Column, ratios: list[float]) -> Column:
    """Sum of the ratios over the characters of a run."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        character_codes(run),
        start,
        lambda acc, c: F.struct(
            c.alias("last"),
            (acc["sum"] + F.get(F.lit(ratios), acc["last"] * F.lit(SIZE) + c)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )


def _hide(pattern: str, group: int, least: int):
    """A function of a text that moves the characters of long enough matches to their stand-ins."""
    def hidden(text):
        return let(F.split(text, pattern, -1), lambda gaps: moved(text, gaps))

    def moved(text, gaps):
        hits = F.arrays_zip(
            F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        parts = F.transform(hits, lambda m: F.concat(m["gap"], F.when(
            F.length(m["value"]) >= least, F.translate(m["hit"], ALPHABET, STAND_INS)).otherwise(m["hit"])))
        return F.array_join(F.concat(parts, F.array(F.element_at(gaps, -1))), "")

    return hidden


def _seen_through(pattern: str) -> str:
    """A pattern of plain characters and sets of ranges that also takes stand-ins for them."""
    def either(c: str) -> str:
        return STAND_INS[ALPHABET.index(c)]

    def ranges(found: re.Match) -> str:
        more = re.sub(r"([A-Za-z0-9])-([A-Za-z0-9])", lambda m: f"{either(m[1])}-{either(m[2])}", found[1])
        return f"[{found[1]}{more}]"

    head, rest = re.fullmatch(r"([A-Z]*)(.*)", pattern).groups()
    return "".join(f"[{c}{either(c)}]" for c in head) + re.sub(r"\[([^\]]*)\]", ranges, rest)


def outside_known(text: Column) -> Column:
    """The text, equally long, with no character left that a run could have inside a span of a known form.

    Characters are moved to stand-ins one form after the other, and later forms see through them, so that each form hides
    what it matches in the text itself.
    """
    out = F.translate(text, STAND_INS, "\ufffd" * len(STAND_INS))
    for i, (_, pattern, group, least) in enumerate(FORMS):
        out = let(out, _hide(pattern if i == 0 else _seen_through(pattern), group, least))
    return out


def markov_spans(text: Column, known: Column, ratios: list[float]) -> Column:
    """Runs with letters, or their parts outside known spans, that look random."""
    rest = F.when(F.size(known) > 0, outside_known(text)).otherwise(text)
    random = let(rest, lambda t: spans(t, len(FORMS), RUN, 0, 16))
    return F.filter(random, lambda s: s["value"].rlike("[A-Za-z]") & (log_odds(s["value"], ratios) > F.lit(MIN_LOG_ODDS)))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(found), lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``known`` and ``found`` as arrays of (start, kind, end, value)."""
    t = whole_text(text)
    both = let(base_spans(t), lambda known: F.struct(
        known.alias("known"), markov_spans(t, known, ratios).alias("found")))
    return docs.select(F.col(id_col), both.alias("__s")).select(id_col, "__s.known", "__s.found")
