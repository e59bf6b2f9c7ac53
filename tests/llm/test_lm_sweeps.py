"""Contexts swept again in turn with words, averaged chances, and draws of frequent pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm import lm_score

from .helpers import documents
from .test_lm import plain_pairs, plain_tokens


def test_scores_average_the_sampled_sweeps_of_the_contexts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 300)
    monkeypatch.setattr(lm_score, "PART_WORDS", 15)
    monkeypatch.setattr(lm_score, "PART_PAIRS", 40)
    rng = random.Random(31)
    vocabulary = ["the", "a", "cat", "dog", "runs", "sits", "on", "mat", "and", "then", "old", "new"]
    texts = [" ".join(rng.choices(vocabulary, range(1, 13), k=rng.randrange(3, 25))) for _ in range(30)]
    texts += ["the cat sits on zebra"]
    held = [i % 5 == 2 for i in range(30)] + [True]
    words_at, tables_at, started = [], [], []
    learn, seat_pairs = lm_score.learn, lm_score.seat_pairs

    def learned(words, seed, burn_in, samples):
        started.append("t" in words.columns)
        rows = words.collect()
        chances, novel = learn(words, seed, burn_in, samples)
        by_part = {r["part"]: lm_score.unpacked(r["p"], np.float32) for r in chances.collect()}
        kept = {}
        for r in rows:
            for w, c, x in zip(lm_score.word_list(r["words"]), lm_score.unpacked(r["c"], np.int64), by_part[r["part"]]):
                kept[w.decode()] = (int(c), math.exp(x - math.log(samples)))
        words_at.append((kept, novel))
        return chances, novel

    def seated(chunks, answers, parts, discount, novel=0.0, *turn):
        out, drawn = seat_pairs(chunks, answers, parts, discount, novel, *turn), {}
        if novel:
            rows = {r["chunk"]: r for r in chunks.collect()}
            for r in out.where("part < 0").collect():
                words = lm_score.word_list(rows[r["chunk"]]["words"])
                pairs = lm_score.pairs_of(lm_score.unpacked(rows[r["chunk"]]["tokens"], np.uint32), lm_score.word_hashes(words))
                for u, w, t in zip(pairs.before, pairs.word, lm_score.unpacked(r["followed"], np.uint32)):
                    assert drawn.setdefault((words[u].decode(), words[w].decode()), int(t)) == t
            tables_at.append(drawn)
        return out

    monkeypatch.setattr(lm_score, "learn", learned)
    monkeypatch.setattr(lm_score, "seat_pairs", seated)
    out = F.col("doc_id").isin([i for i, h in enumerate(held) if h])
    rows = lm_score.score(documents(spark, texts).repartition(3), out, sweeps=3, samples=2).collect()
    pairs, words = plain_pairs(texts, held)
    assert len(tables_at) == 3 and started == [False, False, True, True]
    assert tables_at[0] != tables_at[1] != tables_at[2]
    for drawn, (kept, _) in zip(tables_at, words_at[1:]):
        assert {w: c for w, (c, _) in kept.items() if c} == {w: sum(drawn[u, x] for u, x in pairs if x == w) for w in words}
    counts = sorted(pairs.values())
    once, twice = counts.count(1), counts.count(2)
    d = min(max(once / (once + 2 * twice), 0.05), 0.95)

    def chance(u, w):
        total = 0
        for drawn, (kept, novel) in zip(tables_at[1:], words_at[2:]):
            base = kept[w][1] if w in words else novel
            own = max(pairs.get((u, w), 0) - d * drawn.get((u, w), 0), 0) if (u, w) in pairs else 0
            tables = sum(drawn[v, x] for v, x in pairs if v == u)
            total += (own + (1 + d * tables) * base) / (1 + words.get(u, 0)) / 2
        return total

    for r in rows:
        tokens = plain_tokens(texts[r.doc_id])
        want = sum(math.log10(chance(u, w)) for u, w in zip(["", *tokens], tokens))
        assert r.score == pytest.approx(want, rel=1e-5) and r.spelled_score <= r.score


@pytest.mark.parametrize("base,others,d,near", [(0.3, 50, 0.6, 0.03), (1e-3, 400, 0.8, 0.03), (0.05, 30_000, 0.5, 0.08)])
def test_frequent_pairs_are_drawn(base, others, d, near, monkeypatch):
    c, n = 700, 20_000
    hashes = np.arange(1, n + 1, dtype=np.uint64)
    got = lm_score.pair_tables(np.full(n, c), np.full(n, base), np.full(n, others), d, hashes)
    again = lm_score.pair_tables(np.full(n, c), np.full(n, base), np.full(n, others), d, hashes, 1)
    monkeypatch.setattr(lm_score, "EXACT_CUSTOMERS", c)
    lm_score._log_stirling.cache_clear()
    t = np.arange(c)
    logs = lm_score._log_stirling(d)[c] + np.cumsum(np.log((1 + d * (others + t)) * base))
    lm_score._log_stirling.cache_clear()
    weight = np.exp(logs - logs.max())
    for drawn in (got, again):
        assert np.abs(np.bincount(drawn.astype(int), minlength=c + 1)[1:] / n - weight / weight.sum()).sum() / 2 < near
    assert (got != again).any()


def test_tokens_split_as_bytes_do():
    texts = ["", " ", "\t\n\x0b\x0c\r ", "  A  b\n", "A\x1cB\x85 c  É"] + [f"x{chr(i)}Y{chr(i)}" for i in range(1, 256)]
    got = lm_score.tokens_of(lm_score.pa.array(texts)).to_pylist()
    assert got == [[w.decode() for w in t.encode().lower().split()] + [""] for t in texts]
