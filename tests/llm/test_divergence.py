import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from callweave.llm import divergence


def brute(rows, min_calls, top):
    docs = [(c or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, c, s in rows]
    out = set()
    for language in {d[0] for d in docs}:
        held, counts, whole = Counter(), defaultdict(Counter), Counter()
        for _, source, terms in (d for d in docs if d[0] == language):
            held.update(set(terms))
            counts[source].update(terms)
            whole.update(terms)
        kept = [t for t in held if held[t] >= min_calls]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = share(whole)
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((language, s, part, item, value, rank))
    return out


def rows_of(df):
    return {(r["language"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


def random_calls(n, seed=3):
    draw = np.random.default_rng(seed)
    words = ["The", "the", "of", "große", "x", "Zeta", "alpha", "beta", "é", "日本", "a1b", "end."]
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(words, draw.integers(0, 12)))
        rows.append((i, None if i % 17 == 0 else text, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3", "Ü"][i % 5]))
    return rows


@pytest.mark.parametrize("min_calls, top", [(1, 50), (8, 2), (10_000, 5)])
def test_equals_brute_force(calls, min_calls, top):
    rows = random_calls(120) + random_calls(40)  # repeated rows count again
    assert rows_of(divergence.audit_sources(calls(rows), min_calls, top)) == brute(rows, min_calls, top)


def test_stripes_do_not_change_results(calls, monkeypatch):
    rows = random_calls(120)
    monkeypatch.setattr(divergence, "_STRIPE", 3)
    assert rows_of(divergence.audit_sources(calls(rows), 2, 50)) == brute(rows, 2, 50)


def test_run_distances_equal_plain_columns():
    draw = np.random.default_rng(1)
    columns = draw.integers(0, 3, (4, 50))
    runs = []
    for c in columns:
        starts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
        runs.append((starts, c[starts]))
    found = divergence._run_distances(runs, 50)
    for a in range(4):
        for b in range(a + 1, 4):
            assert found[a, b] == np.abs(columns[a] - columns[b]).sum()


def test_shares_beyond_64_bits():
    n = 10**15
    assert divergence.shares(np.array([n]), 3 * n, 7).tolist() == [1 + 10**9 * (n + 5) // (3 * n + 35)]


def test_empty_one_source_and_other_columns(spark, calls):
    assert divergence.audit_sources(calls([])).count() == 0
    one = calls([(1, "a b", "en", "s")] * 40).selectExpr("*", "1 AS place", "2 AS term", "3 AS n")
    assert rows_of(divergence.audit_sources(one)) == set()


def test_long_texts_are_cut_between_terms(calls, monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE_BYTES", 5)
    rows = [(i, "große Worte alpha " * 9 + "x", "de", f"s{i % 2}") for i in range(6)]
    assert rows_of(divergence.audit_sources(calls(rows), 2, 50)) == brute(rows, 2, 50)
