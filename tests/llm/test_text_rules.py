"""Token counts, host rules and secret scans against plain Python."""

import hashlib
import random
import re
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowtide.llm import host_rules, secret_scan, token_counts
from flowtide.llm.queries import QUERIES

from .helpers import SF, documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", None, " ", "   ", "a  b   c \n\n d\t e", "it's we'll I'M", "x" * 5000, "naïve café 你好世界 🙂🙂",
    "a<|endoftext|>b", "a  <|endoftext|> <|endoftext|>", "12 345 6789", " a b \u0085c", "a \x1c b", "tab\t\t x",
    "a   ", " \n a", "a \n\n  b", "!!! ??? ##",
]


def test_token_counts_equal_the_library(spark):
    rng = random.Random(1)
    texts = HARD + [prose(rng, 300) for _ in range(10)]
    texts += ["".join(rng.choice(" \n\ta.é'1s<|") for _ in range(200)) for _ in range(60)]
    tokenizer = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(tokenizer.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[i].n_bytes == len((t or "").encode())


def test_token_counts_of_all_documents(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_token_counts"](spark, SF).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 512)


def test_token_counts_of_an_empty_table_and_other_columns(spark):
    empty = documents(spark, [])
    assert token_counts.count_tokens(empty, PATH).collect() == []
    clash = documents(spark, ["a b", "a b"], ids=[None, None]).withColumnRenamed("lang", "n_tokens")
    assert [tuple(r) for r in token_counts.count_tokens(clash, PATH).collect()] == [(None, 3, 2)] * 2


def plain_repeat_words(words):
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    return len({i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)})


def test_measures_equal_plain_python(spark):
    rng = random.Random(2)
    texts = HARD + [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(80)]
    texts += ["a b\n\na b\n \n# x\nc", "a b c a b c", "a b c d a b c", "a a a a", "l1\nl1\r\nl1"]
    got = {r.doc_id: r for r in host_rules.measure_documents(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                plain_repeat_words(words))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)


def test_bad_host_goes_and_null_host_is_its_own(spark):
    rng = random.Random(3)
    good = [prose(rng, 80) for _ in range(30)]
    bad = ["#### " + " ### ".join(prose(rng, 80).split()) for _ in range(29)] + [prose(rng, 80)]
    sources = ["good"] * 30 + ["bad"] * 30 + [None, ""]
    docs = documents(spark, good + bad + [good[0], good[1]], sources).withColumnRenamed("lang", "kept")
    got = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    assert all(got[i].kept for i in range(30)) and got[60].kept and got[61].kept
    assert not any(got[i].kept for i in range(30, 60)) and not got[59].base_failed


def test_host_rules_of_odd_tables(spark):
    assert host_rules.judge(documents(spark, [])).collect() == []
    one = host_rules.judge(documents(spark, [None, None], [None, None], [None, None])).collect()
    assert len(one) == 2 and all(r.base_failed and not r.kept for r in one)


BASE = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]+)", 1, 16),
]


def plain_spans(text):
    out = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_base_spans_equal_plain_python(spark):
    rng = random.Random(4)
    pieces = ["token", "=", "secret:", "API_KEY", "apikey ", " : ", '"', "'", "abcdef0123456789", "AKIA", "Z9" * 8, "é🙂",
              "\n", "deadbeef", "passwd=", "hunter2hunter2", ".", " ", "x-y_z+/"]
    texts = HARD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(300)]
    texts += ["token=secret:abcdefghijklmno", "AKIAAKIA" * 3 + "z", "🙂" * 5 + "password='abcdefghijkl'"]
    from pyspark.sql import functions as F

    found = documents(spark, texts).select(
        "doc_id", secret_scan.listed(secret_scan.base_spans(F.coalesce("text", F.lit("")))).alias("s"))
    got = {r.doc_id: r.s for r in found.collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t or ""), repr(t)


@pytest.fixture(scope="module")
def ratios(spark):
    return secret_scan.train(secret_scan.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet")))


def plain_odds(run, ratios):
    last, total = 0, 0.0
    for c in run:
        code = secret_scan.ALPHABET.find(c) + 1
        total += ratios[last * secret_scan.SIZE + code]
        last = code
    return total


def test_markov_spans_equal_plain_python_and_find_random_strings(spark, ratios):
    rng = random.Random(5)
    runs = ["".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(32)) for _ in range(60)]
    texts = [f"the {r} of" for r in runs] + ["thndblention " * 40, "attestation_of_the_thing " * 5, "1" * 30]
    texts += [f"id=0123456789abcdef/sig={runs[0]}", f"{runs[1]}api_key={runs[2]}", f"AKIA{'Z9' * 8}0123456789abcdef{runs[3]}",
              f"x/0123456789abcdeapi_key=ABCDEFGHIJKL/{runs[4]}", "\ue000" * 20 + f"token={runs[5]}.{runs[6]}", "0123456789abcdef " * 40]
    pieces = [*runs[:9], "token=", "/", "AKIA", "0123456789abcdef", "api_key: ", " ", "é", "secret='", "\ue005", ".", "="]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(2, 12))) for _ in range(150)]
    got = {r.doc_id: r.found for r in secret_scan.scan(documents(spark, texts), ratios).collect()}
    hits = 0
    for i, t in enumerate(texts):
        rest = list(t)
        for _, p, g, n in BASE:
            for m in re.finditer(p, t):
                if len(m[g]) >= n:
                    rest[m.start():m.end()] = " " * len(m[0])
        want = [
            (m.start(), m.end()) for m in re.finditer(secret_scan.RUN, "".join(rest))
            if re.search("[A-Za-z]", m[0]) and plain_odds(m[0], ratios) > secret_scan.MIN_LOG_ODDS
        ]
        assert [(s.start, s.end) for s in got[i]] == want
        hits += i < 60 and bool(want)
    assert hits >= 57 and not got[60] and not got[61] and not got[62] and got[63]


def test_held_out_accuracy(ratios):
    rng = random.Random(6)
    plain = ["".join(rng.choice(["th", "er", "on", "an", "in", "tion", "st"]) for _ in range(9)) for _ in range(300)]
    wrong = sum(plain_odds(w, ratios) > secret_scan.MIN_LOG_ODDS for w in plain)
    assert wrong <= 3


def test_secret_scan_query_and_odd_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op10_secret_scan"](spark, SF).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    empty = documents(spark, [])
    flat = secret_scan.train(secret_scan.labelled_samples(empty))
    assert set(flat) == {0.0} and secret_scan.scan(empty, flat).collect() == []
    assert secret_scan.scan(documents(spark, [None]), flat).collect()[0].known == []


def test_many_spans_in_one_text_take_time_in_proportion(spark, ratios):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(100_000))
    mixed = "/".join(f"{i:016x}" for i in range(20_000)) + " token=abcdefghijklmnop" * 5_000
    start = time.monotonic()
    rows = {r.doc_id: r for r in secret_scan.scan(documents(spark, [text, mixed]), ratios).collect()}
    assert time.monotonic() - start < 60
    assert len(rows[0].known) == 100_000 and rows[0].known[-1].start == 25 * 99_999
    assert len(rows[1].known) == 25_000 and not rows[1].found
