"""What the language model's steps hold at a time."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowtide.llm import lm_score
from flowtide.storage import materialise, release_shuffles

from .helpers import documents


def spelled_words(n):
    rng = random.Random(5)
    return [bytes(rng.choices(range(256), k=rng.randrange(0, 14))) for _ in range(n)]


def test_words_are_spelled_in_blocks(monkeypatch):
    words = pa.array(spelled_words(300), pa.binary())
    keys, lengths = lm_score.triples(words)
    weights = np.arange(300) % 7 + 1
    found, at = np.unique(keys, return_inverse=True)
    expected = np.bincount(at, np.repeat(weights, lengths)).astype(int)
    model = lm_score.ByteModel(found, expected.astype(float), 1)
    whole = model.log_spelling(words)
    monkeypatch.setattr(lm_score, "WORDS_AT_ONCE", 7)
    assert np.array_equal(model.log_spelling(words), whole)
    for some in (words, words[40:41], words[:0], pa.array([b"ab", b"", b"b"], pa.binary())):
        keys, lengths = lm_score.triples(some)
        given = np.arange(len(some)) + 1
        found, at = np.unique(keys, return_inverse=True)
        numbers, sums = lm_score.weighted_triples(some, given)
        assert numbers.tolist() == found.tolist()
        assert sums.tolist() == np.bincount(at, np.repeat(given, lengths)).astype(int).tolist()


def test_spelling_takes_little_beside_the_words():
    words = pa.array([b"w%07d" % i for i in range(400_000)], pa.binary())
    keys, _ = lm_score.triples(words[:1000])
    found, counts = np.unique(keys, return_counts=True)
    model = lm_score.ByteModel(found, counts.astype(float), 1)
    tracemalloc.start()
    try:
        model.log_spelling(words)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_a_task_runs_python_once_at_a_time(spark, monkeypatch):
    """Two Python steps in one task are two workers for each core, which stay."""
    plans, materialise = [], lm_score.materialise

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialise(df, name)

    monkeypatch.setattr(lm_score, "materialise", kept)
    docs = documents(spark, ["the cat sits on the mat " * (1 + i % 3) for i in range(12)])
    assert lm_score.score(docs, F.col("doc_id") % 5 == 2, sweeps=2).count() == 12
    assert any(name.startswith("seated") for name, _ in plans)
    for name, plan in plans:
        for task in plan.split("Exchange"):
            assert sum(task.count(x) for x in ("MapInArrow ", "GroupsInPandas ")) < 2, name


def test_shuffles_of_past_sweeps_are_released(spark, monkeypatch):
    """Before each sweep, and before the scores."""
    done, seat_pairs = [], lm_score.seat_pairs
    monkeypatch.setattr(lm_score, "release_shuffles", lambda s: done.append("release"))
    monkeypatch.setattr(lm_score, "seat_pairs", lambda *args: (done.append("sweep"), seat_pairs(*args))[1])
    docs = documents(spark, ["the cat sits on the mat"] * 3)
    lm_score.score(docs, F.col("doc_id") % 5 == 2, sweeps=2)
    assert done == ["sweep", "release", "sweep", "release", "sweep", "release"]


def test_release_deletes_shuffles_of_past_queries(spark):
    def kept():
        return set(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(tracker.shuffleStatuses().keySet()))

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = kept()
    table = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    made = kept() - before
    assert made
    spark.range(10).count()
    for _ in range(20):
        release_shuffles(spark)
        if not made & kept():
            break
        time.sleep(0.2)
    assert not made & kept() and table.count() == 7
