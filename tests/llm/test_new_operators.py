"""Fill-in-middle, vector codes and URL filters against plain versions of themselves."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm import fill_in_middle as fim
from flowtide.llm import queries, url_filter, vector_codes
from flowtide.llm.common import spread_join

from .helpers import SF, documents

TEXTS = [None, "", "a", "1", "<P>x", "a<S>", "x<M>y", "abc def", "héllo wörld ß\n\t x9", "𝔘nicode 🙂🙂 end", "a" * 9000,
         " " * 5000, "ab 1" * 4000, "Z" * 4095 + "é" + "q" * 4097, "\x00a\x00", "A[`{@z"]


def plain_form(key, text):
    """The contract, over a list of all units."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, flags=re.S)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_equal_plain_cutting_and_restore(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab Zé1\n🙂") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    docs = documents(spark, texts).withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    rows = fim.restored(fim.transform(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert tuple(r)[1:6] == plain_form(r["doc_id"], text)
        assert r["restored"] == text == fim.restore(r["form"], r["output"])
    assert {"plain", "psm", "spm"} == {r["form"] for r in rows}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_cuts_do_not_depend_on_blocks(block):
    rng = random.Random(block)
    for _ in range(50):
        text = "".join(rng.choice("abZ 1é") for _ in range(rng.randrange(0, 60)))
        starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        tree = fim.BlockTree(text, block)
        assert tree.units == len(starts)
        assert [tree.cut(k) for k in range(len(starts) + 1)] == [*starts, len(text)]


def test_forms_of_long_texts_repeated_rows_null_ids_and_none(spark):
    long = "word 1\n" * 300_000
    docs = documents(spark, [long, "same text", "same text", "x"], ids=[1, 5, 5, None])
    rows = {(r["doc_id"], r["restored"]): r for r in fim.restored(fim.transform(docs)).collect()}
    assert len(rows) == 3 and rows[1, long]["n"] == 4 * 300_000
    assert rows[None, "x"]["form"] == plain_form("", "x")[1]
    assert fim.transform(documents(spark, [])).count() == 0


VEC = "vec_id bigint, embedding array<float>, label int, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], VEC)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = sorted((r for r in rows if usable(r[1])), key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    whole = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]
    data = np.array(whole).reshape(len(kept), parts, -1)
    books = data[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        squares = ((data[:, :, None, :] - books[None]) ** 2).sum(-1)
        codes, errors = squares.argmin(-1), squares.min(-1).sum(1)
        if step == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = data[codes[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    out = [(r[0], bytes(c.tolist()).hex(), int(e), by_label[r[2]]) for r, c, e in zip(kept, codes, errors)]
    return sorted(out, key=str), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def got_codes(spark, rows, **options):
    codes = vector_codes.compress(vectors(spark, rows).repartition(3), **options)
    out = vector_codes.with_label_error(codes.rows).select("vec_id", "code", "error", "label_error").collect()
    return sorted(map(tuple, out), key=str), vector_codes.books_digest(codes.books)


def random_rows(rng, n, dims=32, spread=0.4):
    return [(i, [rng.gauss(0, spread) for _ in range(dims)], rng.choice([None, 0, 1, 1, 1])) for i in range(n)]


@pytest.mark.parametrize("spread", [0.004, 0.1, 5.0])
def test_codes_equal_exhaustive_search(spark, spread):
    rows = random_rows(random.Random(7), 700, spread=spread)
    assert got_codes(spark, rows) == plain_codes(rows)


def test_codes_after_more_rounds_and_other_sizes(spark):
    rows = random_rows(random.Random(8), 500, dims=12)
    for options in ({"parts": 4, "entries": 10, "rounds": 5}, {"parts": 2, "entries": 3, "rounds": 4}):
        assert got_codes(spark, rows, **options) == plain_codes(rows, **options)


def test_codes_of_gaps_copies_ties_and_few_rows(spark):
    rng = random.Random(9)
    same = [0.25] * 32
    rows = random_rows(rng, 30) + [(100 + i, same, 1) for i in range(200)] + [(7, same, 1), (7, same, 1), (None, same, None)]
    holes = [(500, None, 1), (501, [None] + same[1:], 1), (502, [float("nan")] + same[1:], 1),
             (503, [float("inf")] + same[1:], 0)]
    assert got_codes(spark, rows + holes) == plain_codes(rows)
    odd = [(900, [1.0], 1), (901, same + same, 1)]
    assert got_codes(spark, rows + odd)[0] == plain_codes(rows)[0]
    few = rows[:3]
    assert got_codes(spark, few) == plain_codes(few)
    assert got_codes(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert got_codes(spark, [(1, None, 1)])[0] == []
    huge = [(i, [3e38 * (-1) ** i] * 32, 0) for i in range(3)]
    assert [r[2] for r in got_codes(spark, huge)[0]] == [0, 0, 0]


def test_bounds_save_distances_and_b_adapts(spark):
    rng = np.random.default_rng(1)
    part, book = rng.integers(-200, 200, (4000, 4)), rng.integers(-200, 200, (64, 4))
    known = vector_codes.search(part, book, 8)
    near = book + rng.integers(-2, 3, book.shape)
    moved = np.sqrt(((near - book) ** 2).sum(1).astype(float)) * (1 + 1e-12)
    again = vector_codes.refresh(part, near, moved, known, 8)
    exact = vector_codes.search(part, near, 8)
    assert (again.code == exact.code).all() and (again.error == exact.error).all()
    assert (again.doubts == 0).mean() > 0.5 and (again.doubts > 8).mean() < 0.05
    assert vector_codes.wanted_b(np.array([100, 0, 0, 0])) == vector_codes.LEAST_B
    assert vector_codes.wanted_b(np.array([50, 20, 10, 10, 10])) == 4


def test_spread_join_keeps_all_rows(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 50}", i) for i in range(100)]
    large = spark.createDataFrame(rows, "k string, i int")
    small = large.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    joined = spread_join(large, small, "k", "n")
    want = {}
    for k, i in rows:
        want[k] = want.get(k, 0) + i
    assert sorted((r["k"], r["i"], r["s"]) for r in joined.collect()) == sorted((k, i, want[k]) for k, i in rows)


URLS = [None, "", "no scheme", "http://", "http://COM", "http://com/", "HTTP://A.Com/x?y=http://net/es/", "x://y.net/es/1",
        "x://y.net/es", "x://net/fr/?q", "http://example.com/en/a", "http://b.example.com/en/", "http://www.example.com/en/z",
        "http://a.www.example.com/en/", "http://notexample.com/en/", "http://u@h.com:80/en/", "a://b://c.com/d",
        "http://x.net#/es/", "http://x.net/es/#f", "http://é.com/\n/q", "://net/es/", "http://example.com?/en/"]


def plain_parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3:], flags=re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(rule, verdict) for verdict, rule in queries.URL_RULES
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/"):])]
    return host, path, max(fits, key=lambda f: len(f[0]), default=None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")


def test_hosts_paths_and_rules(spark):
    urls = URLS + [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    table = pages(spark, urls)
    model = url_filter.train(url_filter.labelled_by_rules(table, queries.URL_RULES))
    rows = url_filter.judge(table, model, queries.URL_RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = plain_parts(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]), urls[r["page_id"]]
        assert r["verdict"] == (rule[1] if rule else "block" if r["score"] > 0 else "allow")


def labelled_urls(n, seed):
    rng = random.Random(seed)

    def word(k):
        return "".join(rng.choice("abcdefghij") for _ in range(k))

    out = []
    for _ in range(n):
        bad = rng.random() < 0.3
        host = f"{word(4)}-{word(5)}.{rng.choice(['top', 'top', 'org'])}" if bad else f"www.{word(8)}.{rng.choice(['com', 'org'])}"
        path = f"/{rng.randrange(10 ** 9)}?a={word(2)}&b={rng.randrange(99)}" if bad or rng.random() < 0.2 else f"/{word(6)}/{word(4)}"
        out.append((f"http://{host}{path}", bad))
    return out


def plain_trees(rows):
    """The same boosting over lists: rows of (bins, blocked weight, whole weight)."""
    unit, trees, scores = 2.0 ** -20, [], [0.0] * len(rows)
    width = len(url_filter.FEATURES)

    def go(steps, bins):
        return all((bins[f] > cut) == right for f, cut, right in steps)

    for _ in range(url_filter.TREES):
        graded = []
        for (bins, y, n), s in zip(rows, scores):
            p = 1 / (1 + math.exp(-s))
            graded.append((bins, math.floor((y - n * p) / unit + 0.5), math.floor(n * p * (1 - p) / unit + 0.5)))
        nodes, leaves = [((), None)], []
        for _ in range(url_filter.DEPTH):
            following = []
            for steps, whole in nodes:
                here = [r for r in graded if go(steps, r[0])]
                best, found = 1e-9, None
                for f in range(width):
                    for cut in range(url_filter.BINS - 1):
                        sides = [[sum(r[k] for r in here if (r[0][f] > cut) == right) for k in (1, 2)] for right in (False, True)]
                        if min(s[1] for s in sides) * unit < 1:
                            continue
                        total = [sum(s[k] for s in sides) for k in (0, 1)]
                        gains = [(g * unit) ** 2 / (h * unit + 1) for g, h in (*sides, total)]
                        if gains[0] + gains[1] - gains[2] > best:
                            best, found = gains[0] + gains[1] - gains[2], ((f, cut), sides)
                if found is None:
                    leaves.append((steps, whole))
                else:
                    following += [((*steps, (*found[0], right)), found[1][right]) for right in (False, True)]
            nodes = following
        tree = [(s, 0.5 * w[0] * unit / (w[1] * unit + 1)) for s, w in leaves + nodes if w]
        if not tree:
            break
        trees.append(tree)
        scores = [s + next(v for steps, v in tree if go(steps, r[0])) for r, s in zip(rows, scores)]
    return trees


def test_trees_equal_plain_boosting(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TREES", 2)
    labelled = spark.createDataFrame(labelled_urls(150, 1), "url string, blocked boolean")
    model = url_filter.train(labelled)
    bins = url_filter.with_bins(url_filter.lexical(labelled), model)
    names = [f"b{i}" for i in range(len(url_filter.FEATURES))]
    taken = [(tuple(r[n] for n in names), r["blocked"]) for r in bins.select(*names, "blocked").collect()]
    bad = sum(b for _, b in taken)
    weight = {True: len(taken) / (2 * bad), False: len(taken) / (2 * (len(taken) - bad))}
    rows = {}
    for key, b in taken:
        y, n = rows.get(key, (0.0, 0.0))
        rows[key] = (y + b * weight[True], n + weight[b])
    want = plain_trees([(k, y, n) for k, (y, n) in rows.items()])
    assert [[s for s, _ in t] for t in model.trees] == [[s for s, _ in t] for t in want]
    for got, plain in zip(model.trees, want):
        assert [v for _, v in got] == pytest.approx([v for _, v in plain], abs=1e-4)


def test_held_out_urls_are_told_apart(spark):
    model = url_filter.train(spark.createDataFrame(labelled_urls(2000, 2), "url string, blocked boolean"))
    fresh = labelled_urls(1000, 3)
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id bigint, url string")
    rows = url_filter.judge(table, model, []).collect()
    right = sum((r["verdict"] == "block") == fresh[r["page_id"]][1] for r in rows)
    assert right >= 950
    shuffled = url_filter.train(spark.createDataFrame(labelled_urls(2000, 2)[::-1], "url string, blocked boolean").repartition(5))
    assert shuffled == model


def test_url_models_without_both_classes(spark):
    none = spark.createDataFrame([("http://a.b/c", None)], "url string, blocked boolean")
    table = pages(spark, [None, "http://a.b/c", "http://x.org/" + "long-path/" * 20_000])
    for labelled, want in ((none, "allow"), (none.fillna(True), "block"), (none.fillna(False), "allow"), (none.limit(0), "allow")):
        rows = url_filter.judge(table, url_filter.train(labelled), []).collect()
        assert {r["verdict"] for r in rows} == {want} and len(rows) == 3
    assert url_filter.judge(pages(spark, []), url_filter.Model(), queries.URL_RULES).count() == 0


def test_entropy(spark):
    texts = ["", "a", "aaaa", "ab", "aabbccdd", "hello world"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", url_filter.entropy(F.col("t")).alias("e"))
    for r in rows.collect():
        n = len(r["t"])
        want = -sum(c / n * math.log2(c / n) for c in (r["t"].count(x) for x in set(r["t"])))
        assert r["e"] == pytest.approx(want, abs=1e-12)
