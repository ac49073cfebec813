"""Ordered helpers with tiny blocks against plain Python loops."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.functions import blocks


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for key, n in (("hot", 200), ("a", 1), ("b", 13), ("c", 40)):
        at = 0
        for i in range(n):
            at += rnd.choice([1, 1, 2, 30])
            out.append((key, at, rnd.randint(-5, 9)))
    rnd.shuffle(out)
    return out


def by_key(rows):
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_ordered_pass(spark, rows, size):
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    got = blocks.ordered_pass(df, ["k"], ["t"], size, {"s": F.col("v")}, {"p": F.col("t")}).collect()
    want = {}
    for k, g in by_key(rows).items():
        total, prev = 0, None
        for _, t, v in g:
            want[k, t] = (total, prev)
            total, prev = total + v, t
    assert {(r.k, r.t): (r.s, r.p) for r in got} == want


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
@pytest.mark.parametrize("gap", [1, 2, 29, 1000])
def test_island_ids(spark, rows, size, gap):
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    runs = blocks.island_ids(df, ["k"], ["t"], size, F.struct("t"), lambda p, s: s["t"] - p["t"] > gap, "run")
    got = {(r.k, r.a, r.b, r.n) for r in runs.groupBy("k", "run").agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).collect()}
    want = set()
    for k, g in by_key(rows).items():
        run = [g[0][1]]
        for _, t, _v in g[1:]:
            if t - run[-1] > gap:
                want.add((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.add((k, run[0], run[-1], len(run)))
    assert got == want


def test_join_key_stats_keeps_every_row(spark, rows):
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    stats = df.groupBy("k").agg(F.max("v").alias("top"), F.max("t").alias("_max_index"))
    got = blocks.join_key_stats(df, stats, "k", "t", 25).collect()
    assert len(got) == len(rows)
    tops = {k: max(v for _, _, v in g) for k, g in by_key(rows).items()}
    assert all(r.top == tops[r.k] for r in got)


def test_joined_texts_do_not_depend_on_the_block(spark):
    rows = [("c", i, f"w{i}") for i in range(3000)] + [("d", 0, None), ("d", 5000, "x"), ("d", 9000, None), ("d", 9001, ""), ("e", 1, None)]
    df = spark.createDataFrame(rows, "call_id string, turn_idx bigint, text string")
    want = {"c": " ".join(f"w{i}" for i in range(3000)), "d": "x ", "e": ""}
    for size in (4, 1024, 100_000):
        got = blocks.joined_texts(df, ["call_id"], "turn_idx", "text", "t", size=size).collect()
        assert {r.call_id: r.t for r in got} == want and len(got) == 3
