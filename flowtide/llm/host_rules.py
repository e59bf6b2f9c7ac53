"""Quality rules judged by host: documents vote, hosts get a shrunken failure rate, verdicts return to the documents.

Cases: a null text counts as empty; a null host is a host of its own, apart from the empty name; rows may repeat, each is
judged and counted by itself; columns other than id, text and host are not read. An empty table gives an empty result.
Texts are measured whole, at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.storage import materialise

from .common import WORD_GAP, let, salted_join, whole_text, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules that a document breaks for its host: share of symbols per word, of repeated lines, and the mean word length.
MAX_SYMBOLS_PER_100_WORDS = 10
MAX_DUP_LINES_PERCENT = 30
MEAN_WORD_CHARS = (2, 12)
#: A host goes when the shrunken rate of one rule is above this.
MAX_HOST_RATE = 0.5
RULES = ["rule_base", "rule_symbols", "rule_lines", "rule_length"]


def _covered(hashes: Column) -> Column:
    """Number of words inside the windows whose hash comes more than once; windows start at the hash's place."""

    def repeated(s):
        def twin(k, other):
            return F.coalesce(F.get(s, k)["h"] == F.get(s, other)["h"], F.lit(False))

        places = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda k: twin(k, k - F.lit(1)) | twin(k, k + F.lit(1))
        )
        return F.array_sort(F.transform(places, lambda k: F.get(s, k)["i"]))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return let(ordered, lambda s: F.aggregate(
        repeated(s),
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    ))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that come twice or more in the text, the first one included."""

    def count(t):
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(_covered(t))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, count))


def measures(text: Column) -> Column:
    """Struct of the counts of one text."""

    def all_counts(words):
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{WORD_GAP}]"))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            repeat_words(words).cast("bigint").alias("n_repeat_words"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.size(lines).cast("bigint").alias("n_lines"),
        )

    return let(words_of(text), all_counts)


def measure_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their counts and the four rule columns."""
    t = whole_text(text)
    counted = docs.withColumns({
        "__m": measures(t),
        "word_chars": F.length(F.regexp_replace(t, f"[{WORD_GAP}]+", "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint"),
    })
    counted = counted.withColumns({c: F.col("__m")[c] for c in ("n_words", "n_repeat_words", "n_dup_lines", "n_lines")})
    n = F.col("n_words")
    low, high = MEAN_WORD_CHARS
    return counted.drop("__m").withColumns({
        "rule_base": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "rule_symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * n,
        "rule_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines"),
        "rule_length": (F.col("word_chars") < low * n) | (F.col("word_chars") > high * n),
    })


def shrunken_rates(hosts: DataFrame) -> DataFrame:
    """``hosts`` (n, and failures per rule) with ``rate_<rule>``: the mean of a beta posterior.

    The prior of each rule comes from all hosts: its mean is the overall rate, its strength follows from how much more
    the hosts' rates spread than chance alone would make them.
    """
    parts = [F.sum("n").alias("n"), F.count("*").alias("hosts")]
    for r in RULES:
        p = F.col(r) / F.col("n")
        parts += [F.sum(r).alias(r), F.sum(F.col("n") * p * p).alias(f"square_{r}")]
    total = hosts.agg(*parts).first()
    rates = {}
    for r in RULES:
        alpha, strength = 0.0, 0.0
        if total["n"]:
            mean = total[r] / total["n"]
            spread, chance = total[f"square_{r}"] / total["n"] - mean * mean, mean * (1 - mean)
            if chance > 0:
                noise = total["hosts"] / total["n"]
                excess = (spread / chance - noise) / (1 - noise) if noise < 1 else 0.0
                strength = 1 / min(max(excess, 1e-4), 0.999) - 1
            alpha = mean * strength
        rates[f"rate_{r}"] = (F.col(r) + F.lit(float(alpha))) / (F.col("n") + F.lit(float(strength)))
    return hosts.withColumns(rates)


def host_verdicts(measured: DataFrame, host_key: str) -> DataFrame:
    """One row per host: documents, failures and shrunken rate per rule, and ``host_kept``."""
    hosts = measured.groupBy(host_key).agg(
        F.count("*").alias("n"), *[F.sum(F.col(r).cast("bigint")).alias(r) for r in RULES]
    )
    rated = shrunken_rates(hosts)
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return rated.withColumn("host_kept", worst <= F.lit(MAX_HOST_RATE))


def _host_key(host: str) -> Column:
    return F.concat(F.when(F.col(host).isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(host, F.lit("")))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """(id, text hash, host key, counts, rules, host_kept, host_rate), a row for each document.

    The counts are written once to the shared folder; the text is read once. Hosts are counted before the shuffle, and
    the join back spreads each host over several partitions.
    """
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"), _host_key(host).alias("__host"))
    measured = measure_documents(slim, "__text").withColumn("__th", F.xxhash64("__text"))
    measured = materialise(measured.select("__id", "__th", "__host", *COUNTS, *RULES), "host-rules")
    hosts = host_verdicts(measured, "__host")
    verdict = hosts.select(
        "__host", "host_kept", F.greatest(*[F.col(f"rate_{r}") for r in RULES]).alias("host_rate")
    )
    return salted_join(measured, verdict, ["__host"], ["__id", "__th"])


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: id, counts, ``base_failed``, ``host_rate`` (the worst rule's) and ``kept``."""
    return _judged(docs, id_col, text, host).select(
        F.col("__id").alias(id_col),
        *COUNTS,
        F.col("rule_base").alias("base_failed"),
        "host_rate",
        (~F.col("rule_base") & F.col("host_kept")).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns."""
    good = _judged(docs, id_col, text, host).where(~F.col("rule_base") & F.col("host_kept"))
    good = good.select("__id", "__th", "__host").distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th"))
    return docs.join(good, same & (_host_key(host) == F.col("__host")), "left_semi")
