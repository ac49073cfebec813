import random
import re

import pytest
from pyspark.sql import functions as F

from callweave.llm import jaccard, queries

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else {tuple(words)} - {()}


def brute(texts):
    """Smallest id reachable by links, from all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((top(i), top(j)))
                up[high] = low
    return {i: (len(sets[i]), top(i)) for i in ids}


def linked(df):
    return {r.call_id: (r.n_shingles, r.component_id) for r in jaccard.link_near_copies(df).collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Exact copies, chains of near copies, groups at the edge of the threshold, shared passages, common words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 150))]
        chain = base
        for _ in range(rng.randint(1, 12)):
            texts.append(edited(rng, base, rng.randint(0, max(1, len(base) // 20))))
            chain = edited(rng, chain, max(1, len(base) // 40)).split()
            texts.append(" ".join(chain))
        texts.append(" ".join(base + passage))
        texts.append(" ".join(passage + base[: len(base) // 4]))
        texts.append(" ".join(base[: len(base) * 17 // 20]))
    texts += [" ".join(passage)] * 40 + [" ".join(passage).upper()] + ["one two three", "One\ttwo three", "one two", "", " ", "x"] * 2
    rng.shuffle(texts)
    return dict(enumerate(texts, 100))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_all_pairs(spark, calls, seed):
    texts = corpus(seed)
    df = calls(list(texts.items())).withColumn("n_shingles", F.lit("clash")).withColumn("component_id", F.lit(0))
    assert linked(df) == brute(texts)


def test_order_and_chunks_do_not_matter(spark, calls, monkeypatch):
    """No sketch, no broadcast and the smallest chunks give the same links."""
    texts = corpus(4)
    df = calls(list(texts.items()))
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(jaccard, "SKETCH_LEAST", 1 << 40)
    assert linked(df) == brute(texts)


def test_second_round_joins_what_stars_miss(spark, calls):
    """A text between two groups: its links lie in columns whose smallest node is another one."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = {i: edited(rng, base, 6) for i in range(30)}
    texts |= {100 + i: " ".join([*base[:150], *(f"c{i}" for i in range(50))]) for i in range(3)}
    texts |= {200: " ".join([*base[:175], *(f"c{i}" for i in range(25))])}
    assert linked(calls(list(texts.items()))) == brute(texts)


def test_long_chain(spark, calls):
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(words[i * 5 : i * 5 + 100]) for i in range(40)}
    want = brute(texts)
    assert {c for _, c in want.values()} == {0} and linked(calls(list(texts.items()))) == want


def test_nulls_repeated_rows_long_texts_and_nothing(spark, calls):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, "A B C D E"), (6, long), (5, long + " z")]
    out = [(r.call_id, r.n_shingles, r.component_id) for r in jaccard.link_near_copies(calls(rows)).collect()]
    want = [(1, 0, 1), (2, 0, 2), (None, 1, None), (None, 1, None), (3, 1, 3), (3, 1, 3), (4, 1, 3), (5, 59_997, 5), (6, 59_996, 5)]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert jaccard.link_near_copies(calls([])).collect() == []


def test_query_equals_all_pairs_on_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_jaccard_join(spark, SF).collect()}
    assert out == brute(texts)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (20, 9)], "_a bigint, _b bigint")
    first = jaccard.components(edges, None)
    assert {tuple(r) for r in first.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (20, 8)}
    more = spark.createDataFrame([(3, 20), (50, 51), (2, 3)], "_a bigint, _b bigint")
    assert {r[0]: r[1] for r in jaccard.components(more, first).collect()} == {**{i: 1 for i in (1, 2, 3, 8, 9, 20)}, 50: 50, 51: 50}


def test_keys_may_be_names(spark):
    texts = corpus(6)
    want = brute({f"call-{i}": t for i, t in texts.items()})
    df = spark.createDataFrame([(f"call-{i}", t) for i, t in texts.items()], "call_id string, text string")
    assert linked(df) == want


def test_a_key_of_different_texts_loses_no_link(spark, calls):
    rows = [(7, "a b c d e"), (7, "quite another text than that"), (8, "a b c d e"), (9, "a b c d e"), (10, None), (10, "a b c d e"), (None, "a b c d e")]
    out = [(r.call_id, r.n_shingles, r.component_id) for r in jaccard.link_near_copies(calls(rows)).collect()]
    assert sorted(out, key=str) == sorted([(7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7), (10, 0, 10), (10, 1, 7), (None, 1, None)], key=str)


def test_repeated_keys_are_linked_by_their_texts(spark, calls):
    """Rows get their components as if each had a key of its own; the names are the smallest given keys."""
    texts = corpus(7)
    alone = brute(texts)
    key = {i: 100 + i * 7 % 40 for i in texts}
    members = {}
    for i, (_, top) in alone.items():
        members.setdefault(top, []).append(key[i])
    want = sorted((key[i], n, min(members[top])) for i, (n, top) in alone.items())
    got = jaccard.link_near_copies(calls([(key[i], t) for i, t in texts.items()])).collect()
    assert sorted((r.call_id, r.n_shingles, r.component_id) for r in got) == want
