"""Walks of the decontamination: the same outputs as a plain walk, written step by step; meetings as plain pairs."""

import numpy as np

from flowtide.llm import decontaminate


def test_walks_equal_plain_walks(monkeypatch):
    monkeypatch.setattr(decontaminate, "CACHED_ROWS", 7)
    rng = np.random.default_rng(5)
    codes = rng.integers(2, 2**63, 200, dtype=np.uint64)
    walks = decontaminate.Walks(40, 3)
    starts, sizes = rng.integers(0, 170, 50), rng.integers(1, 20, 50)
    got = walks.embed(codes, starts, sizes, 1, 30)
    for row, (start, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        place, want = 0, []
        for step in range(30):
            word = int(codes[start + place]) if place < n else 0
            want.append(word)
            place += (word * int(walks.factors[1, step]) % 2**64) >> 63
        assert got[row].tolist() == want
    assert got.T.flags.c_contiguous
    assert (walks.embed(codes, starts, 5, 1, 30)[sizes == 5] == got[sizes == 5]).all()


def test_meetings_are_all_pairs_with_a_common_key(monkeypatch):
    monkeypatch.setattr(decontaminate, "STEP_ROWS", 9)
    rng = np.random.default_rng(6)
    items, rows = rng.integers(0, 3, (12, 8), dtype=np.uint64), rng.integers(0, 3, (40, 8), dtype=np.uint64)
    places = np.stack([rng.choice(8, 3, replace=False) for _ in range(4)])
    table = decontaminate.Tables(places, items, np.arange(100, 112))
    row, item = table.meetings(rows)
    want = {(r, 100 + k) for r in range(40) for k in range(12) for p in places if (rows[r, p] == items[k, p]).all()}
    assert set(zip(row.tolist(), item.tolist())) == want and want
    assert [len(x) for x in table.meetings(rows[:0])] == [0, 0]
