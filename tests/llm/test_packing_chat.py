"""Packing and reply trees: exact round trips, bounds and brute force."""

import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowtide.llm import packing, reply_trees
from flowtide.llm.queries import QUERIES, conversation_nodes

from .helpers import SF, documents, prose
from .test_text_rules import HARD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for k, r in enumerate(pieces):
            part = ids[r.start:r.start + r.length]
            assert r.start == at and r.length == len(part) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)), repr(texts[d])[:80]
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(pieces) == 1)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_of_hard_texts(spark):
    rng = random.Random(12)
    texts = HARD + [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    texts += ["".join(rng.choice(" \n\ta.é'1s<|!") for _ in range(200)) for _ in range(60)]
    texts += ["word's, word'!\nNext.\n\nOne.\tTwo\n three", "éè.\nÀ it's\nx"]
    rows = packing.pack(documents(spark, texts), PATH, capacity=64).collect()
    check_packing(rows, dict(enumerate(texts)), 64)


def test_packing_of_all_documents_is_tight(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sequences, tokens = check_packing(QUERIES["op9_packing"](spark, SF).collect(), texts, 1024)
    assert sequences <= 1.05 * -(-tokens // 1024)


def test_packing_of_odd_tables(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []
    docs = documents(spark, ["a", "a", None], ids=[None, None, 4]).withColumnRenamed("lang", "piece")
    rows = packing.pack(docs, PATH).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 1), (True, 2), (True, 2)]
    assert sorted(r.offset for r in rows) in ([0, 1, 3], [0, 2, 3], [0, 2, 4]) and len({r.sequence_id for r in rows}) == 1


def least_bins(lengths, capacity):
    """Fewest bins by search over all ways (few pieces)."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= lengths[i] and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] - lengths[i], *bins[k + 1:]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_plans_use_every_piece_and_come_near_the_best():
    rng = random.Random(13)
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 21) for _ in range(9)), reverse=True)
        counts = {n: lengths.count(n) for n in lengths}
        plan = packing.packing_plan(counts, 20)
        used = [n for pattern, times in plan for n in pattern * times]
        assert sorted(used) == sorted(lengths) and all(sum(p) <= 20 for p, _ in plan)
        assert sum(t for _, t in plan) <= least_bins(lengths, 20) + 1


def test_exact_complements_come_first():
    plan = packing.packing_plan({10: 3, 6: 5, 4: 5, 3: 2, 1: 1}, 10)
    assert ((10,), 3) in plan and ((6, 4), 5) in plan


CHATS = [
    [("user", "hi"), ("assistant", "\\### Assistant: </turn> ok")],
    [("a:b\\", "</turn>\n### user: x"), ("assistant", ""), ("assistant", "\\"), ("", "###")],
    [("user", "\\\\</turn>\n\\</turn>"), ("assistant", "<</turn>\n"), ("user", "é🙂\n")],
]


@pytest.mark.parametrize("turns", CHATS)
def test_format_round_trip(turns):
    text, spans = reply_trees.format_turns(turns)
    assert reply_trees.read_turns(text) == turns
    assert reply_trees.read_loss(text, spans) == "".join(t for r, t in turns if r == "assistant")


def test_format_round_trip_of_random_turns():
    rng = random.Random(14)
    parts = ["\\", "###", "</turn>", "\n", " ", ":", "a", "<", "### assistant: ", "</turn>\n"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "x:y", "\\"]), "".join(rng.choices(parts, k=rng.randrange(9))))
                 for _ in range(rng.randrange(5))]
        text, spans = reply_trees.format_turns(turns)
        assert reply_trees.read_turns(text) == turns
        assert reply_trees.read_loss(text, spans) == "".join(t for r, t in turns if r == "assistant")


def test_conversations_query_reads_back_all_turns(spark):
    chats = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        chats.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    rows = QUERIES["op6_reply_trees"](spark, SF).collect()
    assert sorted(r.conv_id for r in rows) == sorted(chats)
    for r in rows:
        turns = chats[r.conv_id]
        told = "".join(f"{role}\n{text}\n" for role, text in turns)
        learned = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


NODES = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def plain_paths(nodes):
    """All root-to-leaf paths of (tree, node, parent, score), with their rank."""
    by = {(t, n): (p, s) for t, n, p, s in nodes}
    children = {}
    for (t, n), (p, _) in by.items():
        if (t, p) in by:
            children.setdefault((t, p), []).append(n)
    out = {}
    for (t, n) in by:
        if (t, n) in children:
            continue
        path, score, at, ok = [], 0.0, n, True
        while True:
            path.append(at)
            score += by[t, at][1]
            parent = by[t, at][0]
            if (t, parent) not in by:
                break
            at = parent
            if len(path) > len(by):
                ok = False
                break
        if ok:
            out.setdefault(t, []).append((-score, n, path[::-1]))
    return {(t, leaf): (rank, path) for t, paths in out.items()
            for rank, (_, leaf, path) in enumerate(sorted(paths), 1)}


def test_branches_are_ranked_and_formatted(spark):
    rng = random.Random(15)
    rows = []
    for t in range(6):
        for n in range(rng.randrange(1, 25)):
            parent = rng.choice([None, 99]) if n == 0 else rng.randrange(n)
            rows.append((t, n, parent, rng.choice(["user", "assistant"]), f"text {t} {n}", float(rng.randrange(4))))
    rows += [(7, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(70)]
    rows += [(8, 1, 2, "user", "circle", 1.0), (8, 2, 1, "user", "circle", 1.0), (8, 3, None, None, None, None)]
    want = plain_paths([(t, n, p, s or 0.0) for t, n, p, _, _, s in rows])
    text = {(t, n): (role or "", x or "") for t, n, _, role, x, _ in rows}
    got = reply_trees.conversations(spark.createDataFrame(rows, NODES)).collect()
    assert {(r.tree, r.leaf): r["rank"] for r in got} == {k: rank for k, (rank, _) in want.items()}
    for r in got:
        path = want[r.tree, r.leaf][1]
        assert reply_trees.read_turns(r.formatted) == [text[r.tree, n] for n in path] and r.n_turns == len(path)
    best = reply_trees.conversations(spark.createDataFrame(rows, NODES), best=1).collect()
    assert sorted(r.tree for r in best) == sorted({t for t, _ in want}) and {r["rank"] for r in best} == {1}


def test_reply_trees_of_odd_tables(spark):
    assert reply_trees.conversations(spark.createDataFrame([], NODES)).collect() == []
    twice = [(None, 1, None, "user", "b", 0.0), (None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "", 0.0)]
    got = reply_trees.conversations(spark.createDataFrame(twice, NODES)).collect()
    assert [(r.tree, r.n_turns) for r in got] == [(None, 2)] and "a</turn>" in got[0].formatted
    rows = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x")],
                                 "conv_id bigint, turn bigint, role string, text string")
    assert reply_trees.conversations(conversation_nodes(rows)).collect()[0].n_turns == 3


def test_fills_equal_brute_force():
    rng = random.Random(21)
    for _ in range(40):
        capacity = rng.choice([12, 30])
        left = np.array([rng.choice([0, 0, 1, 2, 5]) for _ in range(capacity + 1)])
        left[0] = 0
        index = packing.SumIndex(left)
        for _ in range(30):
            gap = rng.randrange(1, capacity)
            taken = (rng.choice(np.flatnonzero(left).tolist()),) if left.any() and rng.random() < 0.5 else ()
            spare = left.copy()
            np.subtract.at(spare, list(taken), 1)
            ways = [w for size in (1, 2, 3) for w in itertools.combinations_with_replacement(range(capacity, 0, -1), size)
                    if sum(w) == gap and all(spare[n] >= w.count(n) for n in w)]
            found = index.fill(gap, taken)
            assert (found is None) == (not ways)
            if found:
                assert found in ways and len(found) == len(ways[0]) and found[0] == ways[0][0]
                for n in found:
                    left[n] -= 1


def test_ids_equal_those_of_the_library():
    rng = random.Random(22)
    signs = [" ", " ", " ", "\n", "\t", "a", "b", "Z", "é", "ß", "1", "2", "'s", "'", "’", "ll", ".", ",", "<|endoftext|>",
             "日", "本", " ", " ", "́", "🙂", "ʰ", "ɐ", "_", "\r", "\x0b", "\x00", "\u0085", "½", "٣", "Ж"]
    library, ids = Tokenizer.from_file(PATH), packing.TokenIds(PATH)
    assert ids.ranked is not None
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.of(text) == struct.pack(f"<{len(want)}I", *want), repr(text)


def test_vocabularies_of_other_kinds_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, library = packing.TokenIds(path), Tokenizer.from_file(path)
    assert ids.ranked is None
    want = library.encode("Some Words here", add_special_tokens=False).ids
    assert ids.of("Some Words here") == struct.pack(f"<{len(want)}I", *want)
