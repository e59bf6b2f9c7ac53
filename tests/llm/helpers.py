"""Small tables and random texts for the tests of this folder."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, sources=None, ids=None, schema=DOCS):
    ids = ids if ids is not None else range(len(texts))
    sources = sources or ["a"] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, schema)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    """Words of a made-up vocabulary, with line ends now and then."""
    out = []
    for _ in range(n):
        w = "".join(rng.choice("abcdefghijklmnop") for _ in range(3 + rng.randrange(words) % 6))
        out.append(w + rng.choice(["", "", "", ".", ","]) + rng.choice([" "] * 9 + ["\n"]))
    return "".join(out).strip()
