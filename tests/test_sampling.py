import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowtide.functions.hashing import hash60, uniform, uniform_int
from flowtide.operators.sampling import flag_smallest, repeat_rows, seeded_shuffle, smallest_per_group, stratified_split
from flowtide.sources.labelled import quota_sample, quotas


def h60(seed, *parts):
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:15], 16)


def test_hashes_equal_python(spark):
    r = spark.range(1).select(hash60(7, F.col("id"), "x").alias("h"), uniform(7, F.col("id")).alias("u")).first()
    assert r.h == h60(7, 0, "x")
    assert r.u == int(hashlib.md5(b"7|0").hexdigest()[:8], 16) / 2**32


def test_uniform_int_covers_its_range(spark):
    seen = {r.v for r in spark.range(2000).select(uniform_int(1, 3, 7, F.col("id")).alias("v")).collect()}
    assert seen == {3, 4, 5, 6, 7}


@pytest.fixture
def table(spark):
    """Group a holds most rows, a third of all are copies of one row; group None and a tiny group exist too."""
    rnd = random.Random(5)
    rows = [("a", rnd.randrange(10_000)) for _ in range(2000)] + [("a", 77)] * 1200
    rows += [("b", rnd.randrange(500)) for _ in range(300)] + [(None, i) for i in range(40)] + [("c", 1)]
    return spark.createDataFrame(rows, "g string, v int")


def brute(rows, k_of, seed):
    chosen = Counter()
    for g in {r.g for r in rows}:
        part = sorted((r.v for r in rows if r.g == g), key=lambda v: (h60(seed, v), str(v)))
        chosen.update((g, v) for v in part[: k_of(g, len(part))])
    return chosen


@pytest.mark.parametrize("fraction", [0.0, 0.05, 0.2, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("seed", [1, 42])
def test_split_equals_brute_force_with_copies(table, fraction, seed):
    flagged = flag_smallest(table, ["g"], seed, ["v"], fraction=fraction).collect()
    rows = table.collect()
    assert Counter((r.g, r.v) for r in flagged) == Counter((r.g, r.v) for r in rows)
    assert Counter((r.g, r.v) for r in flagged if r.chosen) == brute(rows, lambda g, n: int(n * fraction), seed)


def test_cut_inside_the_copies(table):
    """The rank is made to fall among the 1200 copies, so that only some of them are wanted."""
    rows = table.collect()
    below = sum(r.g == "a" and (h60(3, r.v), str(r.v)) < (h60(3, 77), "77") for r in rows)
    quota = {"a": below + 500, "b": 0, "c": 9}
    got = quota_sample(table, quota, "g", seed=3, key=["v"]).collect()
    counts = Counter(r.g for r in got)
    assert counts == {"a": below + 500, "c": 1}
    assert sum(r.g == "a" and r.v == 77 for r in got) == 500


def test_split_without_labels(table):
    flagged = stratified_split(table, None, 0.25, key=["g", "v"])
    assert flagged.where("is_val").count() == int(table.count() * 0.25)


def test_sample_does_not_depend_on_partitions(table):
    def picked(df):
        return Counter(map(tuple, smallest_per_group(df, ["g"], 9, ["v"], fraction=0.3).collect()))

    assert picked(table) == picked(table.repartition(13).coalesce(3))


def test_only_narrow_tables_are_shuffled(table):
    """The data themselves pass in one stage: the final plan holds no exchange but the broadcast of limits."""
    plan = flag_smallest(table, ["g"], 42, ["g", "v"], fraction=0.01)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan


def test_repeat_rows(spark):
    table = spark.createDataFrame([(1, 3), (2, 0), (3, 200_000)], "v int, n bigint")
    out = repeat_rows(table, "n")
    assert {r.v: r["count"] for r in out.groupBy("v").count().collect()} == {1: 3, 3: 200_000}


@pytest.mark.parametrize("limit, want", [(10, [4, 3, 3]), (2, [1, 1, 0]), (3, [1, 1, 1])])
def test_quotas(limit, want):
    assert list(quotas(limit, ["x", "y", "z"]).values()) == want


def test_seeded_shuffle_is_repeatable(spark):
    ids = [r.id for r in seeded_shuffle(spark.range(50), 42, ["id"]).collect()]
    assert ids == sorted(range(50), key=lambda i: h60(42, i)) and ids != list(range(50))
