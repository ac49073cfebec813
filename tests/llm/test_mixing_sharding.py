import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from callweave.llm import mixing, sharding


def shares(sizes, weights=(1, 2, 3), top=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        room = left - sum(top * sizes[s] for s in full)
        for s in open_:
            target[s] = room * weight[s] / sum(weight[x] for x in open_)
        over = [s for s in open_ if target[s] > top * sizes[s]]
        for s in over:
            target[s] = top * sizes[s]
        if not over:
            return target
        full |= set(over)


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1, "b": 1000, "c": 2, None: 50},
    {"a": 0, "b": 10},
    {"": 5, None: 5},
    {"x": 7},
    {"a": 10, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "g": 300},
    {"a": 0},
]


@pytest.mark.parametrize("case", CASES)
def test_targets_equal_repeated_sharing(spark, case):
    rows = spark.createDataFrame([(s or "", s is None, n) for s, n in case.items()], "_source string, _no_source boolean, source_size bigint")
    got = {None if r["_no_source"] else r["_source"]: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(shares(case))


def mixed(df, **kw):
    sized = df.withColumn("size", mixing.word_count("text"))
    return mixing.mix_sources(sized, mixing.mixing_rules(sized, **kw), **{k: v for k, v in kw.items() if k in ("seed", "priority")})


def test_mix_comes_near_targets_and_keeps_columns(spark, calls):
    rows = [(i, "w " * (1 + i * 7 % 40), None, ("a" if i % 3 == 0 else "b" if i % 7 else None)) for i in range(900)]
    df = calls(rows).withColumn("copies", F.lit("clash")).withColumn("target", F.lit(1)).withColumn("source_size", F.lit("x"))
    once, again = (sorted(map(tuple, mixed(df.repartition(n), rows_per_block=40).select("call_id", "size", "copies", "_mix.target", "source").collect())) for n in (1, 7))
    assert once == again and len(once) == 900
    taken, target = Counter(), {}
    for _, size, copies, goal, source in once:
        assert 0 <= copies <= 3
        taken[source] += size * copies
        target[source] = goal
    for s in target:
        assert abs(taken[s] - target[s]) <= 20
    assert sum(target.values()) == pytest.approx(sum(r[1] for r in once))


def walk(rows, open_):
    """Sizes that a mix takes of one source: rounds down the order, one row after another."""
    left, got, most, room = list(rows), [], open_, open_
    while most >= 1:
        stopped, kept, gain = False, [], 0
        for q, i, size in sorted(left):
            if not stopped and size <= most:
                stopped = gain + size > room
                if not stopped:
                    gain += size
                    got.append(i)
                    continue
            kept.append((q, i, size))
        room -= gain
        most, left = (room if gain else most) / 2, kept
    near = [(abs(room - size), q, i) for q, i, size in left if abs(room - size) < room and size]
    return set(got) | ({min(near)[2]} if near else set())


def lengths(seed):
    rng = random.Random(seed)
    some = [rng.choice([0, 1, 3, 20, 21, 22, rng.randint(1, 60)]) for _ in range(120)]
    return some + [[], [sum(some)], [sum(some) // 2, sum(some) // 3], [40] * 50][seed % 4]


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_a_walk_down_the_order(spark, calls, seed):
    """Sources with one or two documents of a large part of the words come near their targets as well."""
    rows = [(1000 * k + i, "w " * n, None, s) for k, s in enumerate("abc") for i, n in enumerate(lengths(seed + k))]
    df = calls(rows)
    sized = df.withColumn("size", mixing.word_count("text"))
    rules = mixing.mixing_rules(sized, rows_per_block=30)
    out = mixing.mix_sources(sized, rules).collect()
    for rule in rules.collect():
        mine = [r for r in out if r.source == rule._source]
        ranked = []
        for r in mine:
            u = (int(hashlib.md5(f"0:{r.call_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if rule.odds > 0 and r.size:
                q = (u / (1 - u)) / rule.odds
                must = r.size > (rule.whole + 1) * rule.source_size - rule.target
                ranked.append((-1 / q if must else q, r.call_id, r.size))
        open_ = rule.target - rule.whole * rule.source_size
        want = walk(ranked, open_)
        assert {r.call_id for r in mine if r.copies > rule.whole} == want
        untaken = [n for _, i, n in ranked if i not in want]
        off = abs(sum(r.copies * r.size for r in mine) - rule.target)
        assert off <= min(untaken, default=0) + 1e-6


def test_one_long_document_does_not_keep_a_source_from_its_target(spark, calls):
    rows = [(1, "w " * 800, None, "a")] + [(10 + i, "w " * 20, None, "a") for i in range(60)] + [(100 + i, "w " * 20, None, "b") for i in range(100)]
    taken, target = Counter(), {}
    for r in mixed(calls(rows)).collect():
        taken[r.source] += r.size * r.copies
        target[r.source] = r["_mix"].target
    assert all(abs(taken[s] - target[s]) <= 10 for s in target), (taken, target)


def test_columns_with_the_names_used_inside_are_kept(spark, calls):
    df = calls([(i, "w " * (i % 9), None, "ab"[i % 2]) for i in range(40)])
    for name in ("_source", "_no_source", "_rule", "_by", "_size", "_key", "odds"):
        df = df.withColumn(name, F.lit("mine"))
    out = mixed(df)
    assert set(out.columns) == {*df.columns, "size", "copies", "_mix"}
    assert all(r[n] == "mine" for r in out.collect() for n in df.columns[4:])


def test_mix_nulls_ties_repeats_and_empty(spark, calls):
    rows = [(1, None, None, None), (None, "a b c", None, "s"), (None, "a b c", None, "s"), (2, "", None, "s"), (2, "", None, "s"), (3, "x " * 5000, None, "t")]
    out = mixed(calls(rows)).collect()
    assert len(out) == len(rows)
    by_id = defaultdict(set)
    for r in out:
        assert r.copies * r.size <= 3 * r.size
        by_id[r.call_id].add(r.copies)
    assert all(len(v) == 1 for v in by_id.values())
    assert mixed(calls([])).collect() == []


def test_block_size_does_not_change_the_sample(spark, calls):
    df = calls([(i, "w " * (i % 11), None, "ab"[i % 2]) for i in range(300)])
    small, large = (sorted((r.call_id, r.copies) for r in mixed(df, rows_per_block=n).collect()) for n in (3, 10_000))
    assert small == large


def test_pareto_sample_prefers_priority(spark, calls):
    df = calls([(i, "w " * 4, None, "a" if i < 400 else "b") for i in range(800)]).withColumn("p", F.when(F.col("call_id") % 2 == 0, 9.0).otherwise(1.0))
    sized = df.withColumn("size", mixing.word_count("text"))
    rules = mixing.mixing_rules(sized, weights=(1, 3), priority="p")
    got = mixing.mix_sources(sized, rules, priority="p").where("source = 'a'")
    even = got.where("call_id % 2 = 0").agg(F.sum("copies")).first()[0]
    odd = got.where("call_id % 2 = 1").agg(F.sum("copies")).first()[0]
    assert even + odd == 200 and even > 2 * odd


def brute_shards(rows, n_shards):
    place = {}
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = []
    for members in groups.values():
        members.sort(key=lambda r: (r["draw"], r["id"]))
        order += [((k + 0.5) / len(members), r["draw"], r["id"]) for k, r in enumerate(members)]
    for i, (_, _, id_) in enumerate(sorted(order)):
        place[id_] = i * n_shards // len(order)
    return place


def test_shards_equal_brute_force_for_any_block(spark, calls):
    from callweave.llm.common import draw

    df = calls([(i, "é" * (i % 5), None, [None, "a", "b", "b", "b"][i % 5]) for i in range(203)]).withColumn("shard", F.lit("clash"))
    rows = [{"id": r.call_id, "source": r.source, "draw": r.d} for r in df.withColumn("d", draw("call_id", 0)).collect()]
    want = brute_shards(rows, 16)
    for block in (4, 10_000):
        out = sharding.interleave_shards(df, rows_per_block=block).collect()
        assert {r.call_id: r.shard for r in out} == want
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
            assert r.size == 2 * (r.call_id % 5) + 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        counts = [len(v) for v in slots.values()]
        assert max(counts) - min(counts) <= 1 and len(counts) == 16


def test_shards_hold_the_mixture(spark, calls):
    df = calls([(i, "t", None, "big" if i % 4 else "small") for i in range(1600)])
    for r in sharding.interleave_shards(df, rows_per_block=50).groupBy("shard", "source").count().collect():
        assert abs(r["count"] - (75 if r.source == "big" else 25)) <= 1


def test_shards_of_nulls_repeats_and_nothing(spark, calls):
    out = sharding.interleave_shards(calls([(None, None), (None, None), (1, "a"), (1, "a"), (1, "b")]), n_shards=2).collect()
    assert sorted(r.shard for r in out) == [0, 0, 0, 1, 1] and sorted(r.slot for r in out) == [0, 0, 1, 1, 2]
    assert {r.size for r in out} == {1, 2}
    assert sharding.interleave_shards(calls([])).collect() == []


def test_more_shards_than_rows(spark, calls):
    out = sharding.interleave_shards(calls([(1, "a"), (2, "b")]), n_shards=16).collect()
    assert len({r.shard for r in out}) == 2 and {r.slot for r in out} == {0}
    assert not math.isnan(out[0].size)
