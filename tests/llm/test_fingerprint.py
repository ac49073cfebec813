import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import fingerprint, queries

SF = "/root/testdata/sf0.01"


def counts(text):
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def likeness(one, other):
    union = sum((one | other).values())
    return sum((one & other).values()) / union if union else 1.0


def test_words_and_weights(spark, calls):
    texts = {1: "a b a  c\ta\n", 2: "", 3: None, 4: " \n", 5: "é\x85é x x", 6: "w " * 70_000}
    rows = fingerprint.with_terms(calls(list(texts.items())).select("call_id", F.col("text").alias("_text"))).collect()
    for i, text in texts.items():
        want = sorted(counts(text).values()) or [None]
        assert sorted(r["_weight"] for r in rows if r.call_id == i and r["_weight"]) == [w for w in want if w]
    assert sum(r["_weight"] is None for r in rows) == 3


@pytest.mark.parametrize("a,b", [("x y z", "x y z"), ("a a a b", "a b b b"), ("p q r s t u", "p q r v w"), ("one", "two"), ("n " * 40 + "m", "n " * 10 + "m")])
def test_collision_rate_is_generalised_jaccard(spark, calls, a, b):
    samples = 1500
    prints = {r.call_id: r.samples for r in fingerprint.fingerprint_texts(calls([(1, a), (2, b)]), samples=samples).collect()}
    rate = np.mean(np.array(prints[1]) == np.array(prints[2]))
    want = likeness(counts(a), counts(b))
    assert abs(rate - want) <= 4 * (want * (1 - want) / samples) ** 0.5 + 1e-12


def test_edits_follow_the_order_of_keys(spark, calls):
    texts = {5: "alpha beta gamma", 9: "delta", -3: None, 700: "epsilon zeta eta théta", 2: "", 10**9: "x" * 11}
    df = calls(list(texts.items())).withColumn("fingerprint", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    ids = sorted(texts, reverse=True)
    for rows_per_block in (1, 2, 100):
        out = {r.call_id: r for r in fingerprint.compare_with_edits(df, rows_per_block=rows_per_block).collect()}
        assert sorted(out) == sorted(texts)
        for k, i in enumerate(ids):
            text, behind = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + behind[:half]
            assert out[i].n_chars == len(text)
            assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (out[i].fingerprint == "") == (not text)
            if text == edited:
                assert out[i].fingerprint == out[i].edited_fingerprint and out[i].near_edited == 1
            if not (text and behind):
                assert out[i].near_next == float(text == behind)


def test_one_row_repeats_nulls_and_nothing(spark, calls):
    one = fingerprint.compare_with_edits(calls([(1, "a b c d")])).first()
    assert one.near_next == 1 and 0 <= one.near_edited <= 1
    out = fingerprint.compare_with_edits(calls([(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).collect()
    assert sorted(str(r.call_id) for r in out) == ["1", "1", "None", "None"]
    assert len({r.fingerprint for r in out if r.call_id == 1}) == 1
    assert fingerprint.compare_with_edits(calls([])).collect() == []
    assert fingerprint.fingerprint_texts(calls([])).collect() == []


def test_query_on_all_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r for r in queries.op9_weighted_samples(spark, SF).collect()}
    assert sorted(out) == sorted(docs)
    ids = sorted(docs, reverse=True)
    near, true, by_text = [], [], {}
    for k, i in enumerate(ids):
        text, behind = docs[i], docs[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + behind[:half]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        near.append(out[i].near_edited), true.append(likeness(counts(text), counts(edited)))
        by_text.setdefault(text, set()).add(out[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert abs(np.mean(near) - np.mean(true)) < 0.02 and np.sqrt(np.mean((np.array(near) - true) ** 2)) < 0.12


def test_no_python_in_the_plan(spark):
    plan = queries.op9_weighted_samples(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def check_order(rows, out):
    """Edits of rows (key, text) against a plain sort: keys descending, none last, equal ones by the MD5 of their texts."""
    order = sorted(rows, key=lambda r: hashlib.md5((r[1] or "").encode()).hexdigest())
    order = sorted((r for r in order if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    want = Counter()
    for k, (key, text) in enumerate(order):
        text, behind = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        want[(key, len(text), hashlib.sha256((text[: len(text) - half] + behind[:half]).encode()).hexdigest())] += 1
    assert Counter((r.call_id, r.n_chars, r.edited_sha256) for r in out) == want


def test_hashed_string_dense_and_equal_keys(spark):
    draw = np.random.default_rng(3)
    texts = [f"t{i} " + "w" * int(draw.integers(0, 9)) for i in range(110)]
    hashed = [int(x) for x in draw.integers(-(2**63), 2**63 - 1, 60)] + [2**63 - 1, -(2**63)]
    dense = [*range(1000, 1050), *[int(x) for x in draw.integers(-(10**15), 10**15, 50)]]
    names = [f"call-2024-{i % 7}-{'é' if i % 5 == 0 else 'x'}{i}" for i in range(90)]
    equal = [None] * 40 + [4] * 60 + [5]
    for keys, kind in ((hashed, "bigint"), (dense, "bigint"), (names, "string"), (equal, "bigint")):
        rows = list(zip(keys, texts))
        df = spark.createDataFrame(rows, f"call_id {kind}, text string")
        check_order(rows, fingerprint.compare_with_edits(df, samples=1, rows_per_block=8).collect())
        sizes = fingerprint.neighbours(df, "call_id", "text", 8).groupBy("_block").count()
        assert max(r["count"] for r in sizes.collect()) <= 34


def test_samples_equal_numpy(spark, calls):
    """Every sample of a few texts, recomputed from the hashes of its words."""
    texts = {i: " ".join(f"w{j % (i + 2)}" for j in range(3 * i + 1)) for i in range(12)}
    terms = fingerprint.with_terms(calls(list(texts.items())).select("call_id", F.col("text").alias("_text")))
    samples = [c.alias(f"s{i}") for i, c in enumerate(fingerprint.weighted_samples(5))]
    got = {r.call_id: list(r)[1:] for r in terms.groupBy("call_id").agg(*samples).collect()}
    words = sorted({w for t in texts.values() for w in t.split()})
    hashes = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("_term"))
    draws = {}
    for i in range(5):
        rows = hashes.select("w", F.xxhash64("_term", F.lit(2 * i)).alias("a"), F.xxhash64("_term", F.lit(2 * i + 1)).alias("b")).collect()
        for r in rows:
            one, two = r.a & (2**64 - 1), r.b & (2**64 - 1)
            u = [((x >> s) & (2**26 - 1)) + 0.5 for x, s in ((one, 0), (one, 26), (two, 0), (two, 26))]
            step, c = (-np.log(u[k] / 2**26 * (u[k + 1] / 2**26)) for k in (0, 2))
            draws[r.w, i] = step, c, ((one >> 52) * 4096 + (two >> 52) + 0.5) / 2**24
    for key, text in texts.items():
        for i in range(5):
            values = []
            for w, n in counts(text).items():
                r, c, b = draws[w, i]
                values.append(r * (np.floor(np.log(n) / r + b) - b + 1) - np.log(c))
            assert got[key][i] == pytest.approx(max(values), rel=1e-12)
