import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.llm import quality


def brute(text, lengths=(5, 7, 10)):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    n = len(words)

    def covered(k):
        grams = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        return {j for i in range(n - k + 1) if grams[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}

    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = lambda x: len(re.sub(r"[ \t\n\x0b\x0c\r]", "", x))
    return [
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(dup), len(covered(3)), sum(map(chars, dup)),
        *(sum(len(words[j]) for j in covered(k)) for k in lengths),
    ]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x85\xa0", max_size=120))
def test_counts_equal_brute_force(text):
    assert quality.repeated(text, (5, 7, 10)) == brute(text)


TEXTS = {
    1: None, 2: "", 3: " \n\t ", 4: "word " * 49, 5: " ".join(f"w{i}" for i in range(50)), 6: "again and again " * 40,
    7: " ".join(f"w{i}###" for i in range(80)), 8: "\n".join(["one line of this text"] * 3 + [f"w{i} x{i} y{i}" for i in range(40)]),
    9: " ".join(f"w{i % 5000}" for i in range(60_000)),
}


def test_verdicts(spark, calls):
    df = calls(list(TEXTS.items())).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(0))
    out = {r.call_id: r for r in quality.assess_quality(df).collect()}
    assert {k for k, r in out.items() if r.kept} == {5, 8}
    assert {k for k, r in out.items() if r.base_failed} == {1, 2, 3, 4, 6, 9}
    assert (out[8].n_dup_lines, out[8].dup_line_chars) == (2, 34)
    for k, r in out.items():
        if k < 9:
            assert [r[f] for f in [*quality.COUNTS, "dup_chars_5", "dup_chars_7", "dup_chars_10"]] == brute(TEXTS[k] or "")
    assert out[9].n_repeat_words == out[9].n_words == 60_000


def test_keep_good_keeps_all_columns(spark, calls):
    df = calls([*TEXTS.items(), (5, TEXTS[5], "en", "s")]).withColumn("kept", F.lit("clash"))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.call_id for r in kept.collect()) == [5, 5, 8]
    assert quality.assess_quality(calls([])).collect() == []


@pytest.mark.parametrize("limit,kept", [(100, True), (1, False)])
def test_limits_are_parameters(spark, calls, limit, kept):
    phrase = "this very phrase comes twice"
    df = calls([(1, " ".join([phrase, *(f"w{i}" for i in range(60)), phrase]))])
    assert quality.assess_quality(df, ngram_limits={5: limit}).first().kept is kept
