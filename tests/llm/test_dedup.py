"""Line dedup and the n-gram join against brute force."""

import random

import pytest

from flowtide.llm import line_dedup, ngram_join

from .helpers import documents, prose

WORDS = ngram_join._WORD.findall


def plain_chunks(text):
    import hashlib

    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    n = [len(WORDS(x)) for x in lines]
    starts = [
        i for i in range(len(lines))
        if i == 0 or n[i] >= 50 or n[i - 1] >= 50 or (hashes[i - 1] + 31 * (hashes[i - 2] if i > 1 else 0)) % 4 == 0
    ]
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        if worded := sum(x > 0 for x in n[a:b]):
            yield a, b, "\n".join(lines[a:b]), worded >= 2 or sum(n[a:b]) >= 50


def plain_dedup(texts):
    seen, out = set(), []
    for t in texts:
        gone, copies, worded = [], [], 0
        for a, b, body, counts in plain_chunks(t):
            worded += 1
            if body in seen:
                copies.append((a, b))
                if counts:
                    gone.append((a, b))
            seen.add(body)
        emptied = bool(gone) and len(copies) == worded
        spans = copies if emptied else gone
        cut = {i for a, b in spans for i in range(a, b)}
        out.append(("" if emptied else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut), emptied))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(7)
    shared = ["\n".join(prose(rng, 4).replace("\n", " ") for _ in range(8)) for _ in range(4)]
    long_line = " ".join(prose(rng, 60).split())
    texts = []
    for _ in range(60):
        parts = [prose(rng, 30) for _ in range(rng.randrange(3))] + rng.sample(shared, rng.randrange(3))
        parts += [long_line] * rng.randrange(2)
        rng.shuffle(parts)
        texts.append("\n".join(parts) + rng.choice(["", "\n", "\n\n"]))
    texts += [texts[3], texts[4], "", "\n", "one\ntwo\nthree", "x\ny"]
    want = plain_dedup(texts)
    got = {r.doc_id: r for r in line_dedup.deduplicate(documents(spark, texts)).collect()}
    assert [(got[i].text, got[i].emptied) for i in range(len(texts))] == want
    assert any(e for _, e in want) and any(t != a and not e for (t, e), a in zip(want, texts))


def test_a_shifted_passage_is_cut_and_other_text_stays(spark):
    rng = random.Random(8)
    passage = "\n".join(" ".join(prose(rng, 6).split()) for _ in range(30))
    texts = [f"{prose(rng, 40)}\n{passage}\n{prose(rng, 40)}" for _ in range(5)] + [prose(rng, 80) for _ in range(5)]
    got = {r.doc_id: r for r in line_dedup.deduplicate(documents(spark, texts)).collect()}
    assert got[0].text == texts[0]
    for i in range(1, 5):
        assert len(got[i].removed_lines) >= 15
        kept = texts[i].split("\n")
        assert set(kept) - set(passage.split("\n")) <= set(got[i].text.split("\n"))
    assert all(got[i].text == texts[i] and not got[i].removed_lines for i in range(5, 10))


def test_line_dedup_of_odd_tables(spark):
    assert line_dedup.deduplicate(documents(spark, [])).collect() == []
    docs = documents(spark, [None, "a\nb", "a\nb", "a\nb"], ids=[1, 2, 2, None]).withColumnRenamed("lang", "emptied")
    got = sorted(map(tuple, line_dedup.deduplicate(docs).select("doc_id", "text", "emptied").collect()), key=str)
    assert got == sorted([(1, None, False), (2, "", True), (2, "", True), (None, "a\nb", False)], key=str)


def plain_runs(texts):
    """Lines of all runs of 50 words or more that stand at an earlier place, by trying every run."""
    seen, gone = {}, [set() for _ in texts]
    for d, t in enumerate(texts):
        lines = t.split("\n")
        n = [len(WORDS(x)) for x in lines]
        for a in range(len(lines)):
            for z in range(a, len(lines)):
                if n[a] and n[z] and sum(n[a:z + 1]) >= 50:
                    if seen.setdefault("\n".join(lines[a:z + 1]), (d, a)) != (d, a):
                        gone[d] |= set(range(a, z + 1))
    return gone


def test_every_repeated_run_of_50_words_goes_wherever_it_begins(spark):
    rng = random.Random(17)

    def line(n):
        return " ".join(prose(rng, n).split())

    passages = ["\n".join(line(w) for w in sizes) for sizes in (
        (43, 9), (25, 25), (30, 5, 30), (17, 17, 17), (20, 10, 10, 10, 20), (10, 10, 10, 10, 10, 10), (24, 25))]
    passages.append(f"{line(20)}\n\n{line(20)}\n \n{line(20)}")
    texts = []
    for i in range(64):
        parts = [line(rng.randrange(1, 30)) for _ in range(rng.randrange(4))]
        parts += [passages[i % 8]] + rng.sample(passages, rng.randrange(2))
        rng.shuffle(parts)
        texts.append("\n".join(parts) + rng.choice(["", "\n", "\n\n"]))
    texts += [line(1), "", "\n".join([line(3)] * 600), "\n".join(line(rng.randrange(4)) for _ in range(700))]
    texts.append(texts[-1].split("\n", 300)[300])
    runs = plain_runs(texts[:-2]) + [set(), set(range(len(texts[-1].split("\n"))))]
    got = {r.doc_id: r for r in line_dedup.deduplicate(documents(spark, texts), passages=True).collect()}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        chunks = {x for x in got[i].removed_lines} - runs[i]
        worded = {x for x in runs[i] if WORDS(lines[x])}
        assert worded <= set(got[i].removed_lines), i
        assert all(any(lines[x] in u.split("\n") for u in texts[:i]) or lines.index(lines[x]) < x for x in chunks), i
        kept = [x for k, x in enumerate(lines) if k not in set(got[i].removed_lines)]
        assert got[i].text == ("" if got[i].emptied else "\n".join(kept))
    assert any(runs[i] - set(r.removed_lines) for i, r in
               enumerate(sorted(line_dedup.deduplicate(documents(spark, texts)).collect(), key=lambda r: r.doc_id)))


def plain_links(texts, threshold=0.8):
    """Class (least id), links and copies by all pairs."""
    def cut(t):
        w = WORDS(t or "")
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [cut(t) for t in texts]
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(t if sets[i] else (i,), []).append(i)
    reps = [v[0] for v in same.values() if sets[v[0]]]
    links = {a: [b for b in reps if a != b and 10 * len(sets[a] & sets[b]) >= round(threshold * 10) * len(sets[a] | sets[b])]
             for a in reps}
    out = {}
    for members in same.values():
        a = members[0]
        todo, seen = [a], {a}
        while todo:
            for b in links.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        for i in members:
            out[i] = (min(seen), len(links.get(a, [])), len(members) if sets[a] else 1)
    return [out[i] for i in range(len(texts))]


def near_copies(rng, groups, edits):
    texts = []
    for size in groups:
        words = prose(rng, 90).split()
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1024, 16])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(9)
    texts = near_copies(rng, [1] * 30 + [2] * 15 + [5, 12, 60], 4)
    texts += ["", None, " \n", "two words", "two words", "two  words", "five words are one shingle", texts[0], texts[1]]
    want = plain_links(texts)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(documents(spark, texts)).collect()}
    assert [(got[i].class_id, got[i].n_links, got[i].n_copies) for i in range(len(texts))] == want
    assert max(n for _, n, _ in want) > 15


def test_pruning_keeps_similar_pairs_and_drops_others():
    rng = random.Random(10)
    base = prose(rng, 300).split()
    close = base[:]
    close[100] = "other"
    far = base[:150] + prose(rng, 150).split()
    sigs = ngram_join.np.stack([ngram_join.signature(ngram_join.shingles(" ".join(t))) for t in (base, close, far)])
    i, j = ngram_join.surviving_pairs(sigs, sigs, 0.8, upper=True)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1)]
    assert ngram_join.least_matches()[0] >= 1


def test_exact_links_by_product_and_by_merging():
    rng = random.Random(11)
    sets = [ngram_join.shingles(t) for t in near_copies(rng, [12], 6)]
    i, j = ngram_join.np.triu_indices(len(sets), 1)
    many = ngram_join.exact_links(sets, i, j, 0.8)
    one_by_one = [ngram_join.exact_links(sets, i[k:k + 1], j[k:k + 1], 0.8)[0] for k in range(len(i))]
    assert many.tolist() == one_by_one and 0 < sum(one_by_one)


def test_ngram_join_of_odd_tables(spark):
    assert ngram_join.near_duplicates(documents(spark, [])).collect() == []
    assert ngram_join.keep_first(documents(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [text, text, text, None, "", text + " x"], ids=[5, 5, None, 7, 8, 9])
    docs = docs.withColumnRenamed("lang", "class_id")
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies").collect()]
    assert sorted(got, key=str) == sorted(
        [(5, 5, 1, 3), (5, 5, 1, 3), (None, 5, 1, 3), (7, 7, 0, 1), (8, 8, 0, 1), (9, 5, 1, 1)], key=str)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7, 8]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(chain, "a bigint, b bigint"), "t").collect()))
    assert {n: r for n, r in got.items() if n <= 40} == {i: 0 for i in range(41)}
    assert [got[n] for n in (100, 101, 103)] == [100] * 3


def test_long_near_copies_in_one_class(spark, monkeypatch):
    """Texts of a megabyte that are near copies of each other go in blocks of bounded bytes, and lose no link."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 5_000_000)
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150_000)]
    texts = []
    for i in range(20):
        own = list(words)
        own[i * 1000:i * 1000 + 3] = [f"own{i}", "was", "here"]
        texts.append(" ".join(own))
    rows = ngram_join.near_duplicates(documents(spark, [*texts, texts[0], "another text of some words here"])).collect()
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].class_id for i in range(21)} == {0} and by_id[21].class_id == 21
    assert {by_id[i].n_links for i in range(21)} == {19} and by_id[0].n_copies == 2
