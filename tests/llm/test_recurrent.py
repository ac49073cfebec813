import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import recurrent
from callweave.llm.recurrent import Network, Shape, Vocabulary, text_log_odds, with_classes

SMALL = Shape(vocabulary=40, own_vectors=12, own_classes=3, other_classes=3, hidden=5, lanes=4, window=4, rounds=2, anchors=3)


def small_network(seed=0, shape=SMALL):
    draw = np.random.default_rng(seed)
    counts = np.sort(draw.integers(1, 50, 30))[::-1].astype(np.int64)
    v = Vocabulary([bytes([65 + i]) for i in range(30)], counts, 12, int(counts.sum()) + 60, 45, 20)
    v = with_classes(v, draw.integers(0, 3, 30), shape)
    network = Network(v, shape)
    network.values[:] = draw.normal(0, 0.4, network.values.size)
    return network


def test_probabilities_of_all_tokens_sum_to_one():
    network = small_network()
    state = np.random.default_rng(1).normal(size=(1, 5)).astype(np.float32)
    every = np.arange(32)
    total = np.exp(network.log_odds(np.repeat(state, 32, axis=0), every)).sum()
    assert total == pytest.approx(1, abs=1e-5)


def test_windows_and_lanes_do_not_change_a_text():
    """Step by step with plain formulas, over the whole text, against windows with the state carried on."""
    network = small_network(2)
    p, hidden = network.parts, 5
    draw = np.random.default_rng(3)
    texts = [draw.integers(1, 32, n).astype(np.int32) for n in (0, 1, 3, 17, 50, 4)]
    want = []
    for text in texts:
        h, before, total = np.zeros(hidden), 0, 0.0
        for token in [*text, 0]:
            x = p["seen"][network.seen_of[before]] + p["bias"]
            inner = h @ p["state"]
            r, z = (1 / (1 + np.exp(-(x[i * hidden : (i + 1) * hidden] + inner[i * hidden : (i + 1) * hidden]))) for i in (0, 1))
            new = np.tanh(x[2 * hidden :] + r * inner[2 * hidden :])
            h = (1 - z) * new + z * h
            total += network.log_odds(h[None].astype(np.float32), np.array([token]))[0]
            before = token
        want.append(total)
    assert text_log_odds(network, texts) == pytest.approx(want, rel=1e-4)


def test_gradient_equals_differences():
    network = small_network(4)
    draw = np.random.default_rng(5)
    seen, goal = draw.integers(0, 32, (3, 2)), draw.integers(0, 32, (3, 2))
    state, fresh = draw.normal(size=(2, 5)).astype(np.float32), seen == 0

    def loss():
        out, _, _ = network.run(seen, state, fresh)
        return -network.log_odds(out.reshape(-1, 5), goal.reshape(-1)).mean()

    slope, _ = network.gradient(seen, goal, state, fresh)
    for i in draw.choice(network.values.size, 60, replace=False):
        old = network.values[i]
        network.values[i] = old + 1e-2
        up = loss()
        network.values[i] = old - 1e-2
        down = loss()
        network.values[i] = old
        assert slope[i] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def brute_base(rows, learn):
    words = {k: [w.lower() for w in (t or "").encode().split()] for k, t in rows}
    counts = Counter(w for k, ws in words.items() if k in learn for w in [*ws, b""])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for k, ws in words.items():
        ws = [*ws, b""]
        out[k] = (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    return out


def test_base_and_counts_equal_brute_force_and_model_learns(calls):
    draw = np.random.default_rng(0)
    rows = []
    for i in range(200):
        # two kinds of texts with own words and a fixed order
        kind = i % 2
        start = draw.integers(0, 6)
        rows.append((i, " ".join(f"{'ab'[kind]}{(start + j) % 6}" for j in range(30)) + (f" rare{i}" if i % 9 == 0 else "")))
    rows += [(200, None), (201, ""), (202, "A0 a0 Ä\x0bneu  ")]
    learn = F.col("call_id") % 7 != 2
    got = {r["call_id"]: r for r in recurrent.score_transcripts(calls(rows), learn, shape=SMALL).collect()}
    want = brute_base(rows, {k for k, _ in rows if k % 7 != 2})
    assert set(got) == set(want)
    for k, (n, known, total, base) in want.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["learned"]) == (n, known, total, k % 7 != 2)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0
    held_out = [k for k in range(200) if k % 7 == 2]
    assert sum(got[k]["score"] for k in held_out) > 0.8 * sum(got[k]["base_score"] for k in held_out)


def test_repeated_null_and_string_keys_empty_table_nothing_learned(spark):
    rows = [("k", "one two"), ("k", "one two"), (None, "one two")]
    calls = spark.createDataFrame(rows, "call_id string, text string").selectExpr("*", "1 AS row", "2 AS key", "3 AS learned")
    got = recurrent.score_transcripts(calls, F.lit(True), shape=SMALL).collect()
    assert sorted((r["call_id"] or "") for r in got) == ["", "k", "k"]
    assert len({round(r["base_score"], 9) for r in got}) == 1
    none = recurrent.score_transcripts(calls, F.lit(None).cast("boolean"), shape=SMALL).collect()
    assert [(r["base_score"], r["train_tokens"], r["n_known"]) for r in none] == [(0.0, 0, 0)] * 3
    assert recurrent.score_transcripts(calls.limit(0), F.lit(True), shape=SMALL).count() == 0
