"""Language-model scores: counts and base by brute force, seatings against exact small cases, held-out gain."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtide.llm import lm_score
from flowtide.llm.queries import QUERIES

from .helpers import SF, documents, prose


def plain_tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [""]


def plain_base(texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = {}
    for i, t in texts.items():
        for w in plain_tokens(t) if not held[i] else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in texts.items():
        c = [counts.get(w, 0) for w in plain_tokens(t)]
        out[i] = (held[i], len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op5_lm_score"](spark, SF).collect()


def test_counts_and_base_equal_brute_force(spark, scored):
    want = plain_base({r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})
    assert len(scored) == len(want)
    for r in scored:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_held_out_text_is_predicted_better_than_by_the_base(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.95
    assert all(r.spelled_score <= r.score < 0 and math.isfinite(r.perplexity) for r in scored)


def test_odd_texts_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 200)
    monkeypatch.setattr(lm_score, "PART_WORDS", 100)
    monkeypatch.setattr(lm_score, "PART_PAIRS", 300)
    rng = random.Random(19)
    texts = [None, "", " \n", "The the THE É é", "x" * 3000] + [prose(rng, 60) for _ in range(30)]
    docs = documents(spark, texts + texts[:2], ids=[*range(35), 0, 1]).withColumnRenamed("lang", "score")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = lm_score.score(docs, held).collect()
    assert len(got) == 37
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_tokens == 1 and by_id[3].n_tokens == 6
    plain = {}
    for t, i in zip(texts + texts[:2], [*range(35), 0, 1]):
        plain.setdefault(i, []).append(t)
    n = sum(len(plain_tokens(t)) for i, ts in plain.items() for t in ts if zlib.crc32(str(i).encode()) % 7 != 2)
    assert {r.train_tokens for r in got} == {n}


def test_empty_table_and_no_training_documents(spark):
    assert lm_score.score(documents(spark, []), F.lit(False)).collect() == []
    one = lm_score.score(documents(spark, ["a b"], ids=[None]), F.lit(True)).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in one] == [
        (None, 3, 0, 0, 0.0, 0.0)]


def stirling(c, d):
    """Weights of t tables for c customers, over all seatings."""
    row = {1: 1.0}
    for n in range(1, c):
        nxt = {}
        for t, w in row.items():
            nxt[t] = nxt.get(t, 0) + w * (n - d * t)
            nxt[t + 1] = nxt.get(t + 1, 0) + w
        row = nxt
    return row


@pytest.mark.parametrize("proposals", [0, 30])
@pytest.mark.parametrize("c,base,others", [(5, 0.3, 4), (20, 0.05, 30), (3, 0.9, 0), (60, 0.01, 400), (40, 1e-6, 9)])
def test_seatings_follow_the_exact_distribution(c, base, others, proposals, monkeypatch):
    if proposals:  # the way of dishes with very many customers
        monkeypatch.setattr(lm_score, "PROPOSALS", proposals)
        monkeypatch.setattr(lm_score, "EXACT_CUSTOMERS", 1)
    d, s, n = 0.6, 1.0, 20_000
    weights = {t: w * math.prod((s + d * (others + k)) * base for k in range(t)) for t, w in stirling(c, d).items()}
    total = sum(weights.values())
    got = lm_score.seat(np.full(n, c), np.full(n, base), np.full(n, others), d, s, np.random.default_rng(20),
                        np.ones(n) if proposals else None)
    for t, w in weights.items():
        assert abs((got == t).mean() - w / total) < 0.02, t


def test_log_gamma():
    x = np.array([0.05, 0.5, 1.0, 3.3, 40.0, 1e6])
    assert lm_score.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


def test_spellings_are_chances():
    words = pa.array([b"ab", b"", "é".encode(), b"abba"], pa.binary())
    keys, lengths = lm_score.triples(words)
    assert lengths.tolist() == [3, 1, 3, 5]
    e, n = lm_score.EDGE, lm_score.SYMBOLS
    assert keys[:4].tolist() == [(e * n + e) * n + 97, (e * n + 97) * n + 98, (97 * n + 98) * n + e, (e * n + e) * n + e]
    found, counts = np.unique(keys, return_counts=True)
    model = lm_score.ByteModel(found, counts.astype(float), 1)
    assert np.exp(model.log).sum(axis=1) == pytest.approx(np.ones(len(model.log)))
    spelled = model.log_spelling(words)
    assert spelled[1] > spelled[0] > spelled[3] and lm_score.triples(words[1:3])[1].tolist() == [1, 3]


def plain_pairs(texts, held):
    """Training counts of (word before, word), of words, and distinct followers and predecessors."""
    pairs, words = {}, {}
    for t, h in zip(texts, held):
        before = ""
        for w in plain_tokens(t):
            if not h:
                pairs[before, w] = pairs.get((before, w), 0) + 1
                words[w] = words.get(w, 0) + 1
            before = w
    return pairs, words


def test_contexts_equal_a_plain_model(spark, monkeypatch):
    """Counts, customers, tables and chances of a small corpus against plain Python, given the chances of words and the
    seating of pairs; chances of a context sum to one."""
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 300)
    monkeypatch.setattr(lm_score, "PART_WORDS", 15)
    monkeypatch.setattr(lm_score, "PART_PAIRS", 40)
    rng = random.Random(23)
    vocabulary = ["the", "a", "cat", "dog", "runs", "sits", "on", "mat", "and", "then", "old", "new"]
    texts = [" ".join(rng.choices(vocabulary, range(1, 13), k=rng.randrange(3, 25))) for _ in range(40)]
    texts += ["the cat sits on zebra", "the the the the", "the cat barks on the moon"]
    held = [i % 5 == 2 for i in range(len(texts))]
    rounds, drawn = [], {}
    learn, seat_pairs = lm_score.learn, lm_score.seat_pairs

    def learned(words, seed, burn_in, samples):
        rows = words.collect()
        chances, novel = learn(words, seed, burn_in, samples)
        by_part = {r["part"]: lm_score.unpacked(r["p"], np.float32) for r in chances.collect()}
        kept = {}
        for r in rows:
            for w, c, x in zip(lm_score.word_list(r["words"]), lm_score.unpacked(r["c"], np.int64), by_part[r["part"]]):
                kept[w.decode()] = (int(c), math.exp(x - math.log(samples)))
        rounds.append((kept, novel))
        return chances, novel

    def seated(chunks, answers, parts, discount, novel=0.0):
        out = seat_pairs(chunks, answers, parts, discount, novel)
        if novel:
            rows = {r["chunk"]: r for r in chunks.collect()}
            for r in out.where("part < 0").collect():
                words = lm_score.word_list(rows[r["chunk"]]["words"])
                tokens = lm_score.unpacked(rows[r["chunk"]]["tokens"], np.uint32)
                pairs = lm_score.pairs_of(tokens, lm_score.word_hashes(words))
                for u, w, t in zip(pairs.before, pairs.word, lm_score.unpacked(r["followed"], np.uint32)):
                    key = words[u].decode(), words[w].decode()
                    assert drawn.setdefault(key, int(t)) == t  # the same in every chunk
        return out

    monkeypatch.setattr(lm_score, "learn", learned)
    monkeypatch.setattr(lm_score, "seat_pairs", seated)
    docs = documents(spark, texts).repartition(4)
    got = {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id") % 5 == 2).collect()}
    pairs, words = plain_pairs(texts, held)
    assert {k: t for k, t in drawn.items() if t}.keys() == pairs.keys() and all(1 <= drawn[k] <= c for k, c in pairs.items())
    assert any(drawn[k] > 1 for k in pairs)
    (first, _), (kept, novel) = rounds
    assert {w: c for w, (c, _) in first.items() if c} == {w: len({u for u, x in pairs if x == w}) for w in words}
    assert {w: c for w, (c, _) in kept.items() if c} == {w: sum(drawn[u, x] for u, x in pairs if x == w) for w in words}
    assert sum(p for w, (_, p) in kept.items() if w in words) + novel == pytest.approx(1, abs=1e-4)
    counts = sorted(pairs.values())
    once, twice = counts.count(1), counts.count(2)
    d = min(max(once / (once + 2 * twice), 0.05), 0.95)
    tables = {u: sum(drawn[v, x] for v, x in pairs if v == u) for u, _ in pairs}

    def chance(u, w):
        base = kept[w][1] if w in words else novel
        own = max(pairs.get((u, w), 0) - d * drawn.get((u, w), 0), 0) if (u, w) in pairs else 0
        return (own + (1 + d * tables.get(u, 0)) * base) / (1 + words.get(u, 0))

    for i, t in enumerate(texts):
        tokens = plain_tokens(t)
        want = sum(math.log10(chance(u, w)) for u, w in zip(["", *tokens], tokens))
        assert got[i].score == pytest.approx(want, rel=1e-5), t
    for u in ("the", "", "cat", "moon"):
        assert sum(chance(u, w) for w in words) + chance(u, "unseen") == pytest.approx(1, abs=1e-3)


def test_order_of_words_matters_and_repeated_texts_stand_out(spark):
    rng = random.Random(24)
    texts = [prose(rng, 60, words=40) for _ in range(80)]
    mixed = []
    for t in texts[:40]:
        words = t.split()
        rng.shuffle(words)
        mixed.append(" ".join(words))
    rows = lm_score.score(documents(spark, texts + texts[40:60] + mixed), F.col("doc_id") >= 100).collect()
    by_id = {r.doc_id: r for r in rows}
    for i in range(40):
        assert by_id[i].base_score == pytest.approx(by_id[100 + i].base_score) and by_id[i].score > by_id[100 + i].score + 1
    twice = [by_id[i].score / by_id[i].n_tokens for i in range(40, 60)]
    single = [by_id[i].score / by_id[i].n_tokens for i in [*range(40), *range(60, 80)]]
    assert min(twice) > np.median(single)


def test_pair_seatings_follow_the_exact_distribution(monkeypatch):
    hashes = np.arange(1, 20_001, dtype=np.uint64)
    for c, base, others, d in [(2, 0.3, 4, 0.7), (6, 0.02, 30, 0.5), (30, 1e-3, 2, 0.9)]:
        weights = {t: w * math.prod((1 + d * (others + k)) * base for k in range(t)) for t, w in stirling(c, d).items()}
        total = sum(weights.values())
        n = len(hashes)
        got = lm_score.pair_tables(np.full(n, c), np.full(n, base), np.full(n, others), d, hashes)
        assert (got == lm_score.pair_tables(np.full(n, c), np.full(n, base), np.full(n, others), d, hashes)).all()
        for t, w in weights.items():
            assert abs((got == t).mean() - w / total) < 0.02, t
    many = lm_score.pair_tables(np.array([300, 256]), np.array([0.3] * 2), np.array([50] * 2), 0.6, hashes[:2])
    monkeypatch.setattr(lm_score, "EXACT_CUSTOMERS", 400)
    lm_score._log_stirling.cache_clear()
    draws = lm_score.pair_tables(np.full(5000, 300), np.full(5000, 0.3), np.full(5000, 50), 0.6, hashes[:5000])
    lm_score._log_stirling.cache_clear()
    assert many[0] == pytest.approx(draws.mean(), rel=0.15)


def test_packing_of_numbers_and_parts():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 50, 400, dtype=np.uint64), rng.integers(0, 2**64, 400, dtype=np.uint64).repeat(2),
                   np.array([7], np.uint64)):
        found, place, at = lm_score.distinct(values)
        assert (found == np.unique(values)).all() and (found[at] == values).all() and (values[place] == found).all()
        assert sorted(lm_score.order_of(values)) == list(range(len(values)))
        ordered = values[lm_score.order_of(values)]
        assert (ordered[1:] >> np.uint64(10) >= ordered[:-1] >> np.uint64(10)).all()
    for kind in (np.uint32, np.int64, np.float32):
        values = rng.integers(0, 1000, 77).astype(kind)
        assert (lm_score.unpacked(lm_score.packed(values), kind) == values).all()
        assert len(lm_score.unpacked(lm_score.packed(values[:0]), kind)) == 0
    h = np.sort(rng.integers(0, 2**48, 1000, dtype=np.uint64))
    part = lm_score._part(h, 7, 48)
    assert (np.diff(part.astype(int)) >= 0).all() and part.max() < 7
    assert (np.concatenate(lm_score._by_part(part, 7)) == np.arange(1000)).all()
