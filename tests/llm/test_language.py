import numpy as np
from pyspark.sql import functions as F

from callweave.llm import language, queries

SF = "/root/testdata/sf0.01"
TRAIN = [
    (1, "the cat sat on the mat and the dog", "en"), (2, "the weather is nice and the sun shines", "en"),
    (3, "der hund und die katze sind nicht da", "de"), (4, "das wetter ist schön und die sonne scheint", "de"),
    (5, None, "fr"), (6, "text without language", None), (7, "12 34 !!", "en"),
]


def test_known_words_then_backoff(spark, calls):
    model = language.fit_language_model(calls(TRAIN))
    assert model.languages == ["de", "en"]
    scores = language.WordScores(model)
    # a known word has its own log frequency
    n = {"de": 15, "en": 17}
    words = {r for r in model.words}
    the = scores.rows[scores["the"]]
    assert np.isclose(the[1], np.log((5 + 0.5) / (n["en"] + 0.5 * len(words))))
    # an unknown word takes the mean of its longest known n-grams
    grams = [g for g in (" schö", "schön", "chöne", "höner", "öner ") if g in model.grams]
    assert "schöner" not in model.words and grams
    assert np.allclose(scores.rows[scores["schöner"]], model.scores[[model.grams[g] for g in grams]].mean(axis=0))
    # letters that were never seen say nothing
    assert not scores.rows[scores["ж"]].any()


def test_predictions_and_odd_texts(spark, calls):
    model = language.fit_language_model(calls(TRAIN))
    rows = [(1, "the dog"), (2, "die katze"), (3, None), (4, ""), (5, "123 !? ²"), (6, "жж"), (7, "der hund " * 30_000), (7, "the"), (None, "THE CAT")]
    df = calls(rows).withColumn("score", F.lit("clash"))
    out = sorted((tuple(r) for r in language.identify_language(df, model).collect()), key=str)
    got = {(r[0], r[1]) for r in out}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (7, "de"), (7, "en"), (None, "en")}
    assert all(0 <= r[2] <= 1 for r in out) and dict((r[0], r[2]) for r in out)[6] == 0.5


def test_nothing_to_learn_and_nothing_to_judge(spark, calls):
    model = language.fit_language_model(calls([(1, "words", None)]))
    assert [tuple(r) for r in language.identify_language(calls([(1, "words")]), model).collect()] == [(1, "und", 0.0)]
    assert language.identify_language(calls([]), model).collect() == []


def test_memo_can_be_emptied(spark, calls, monkeypatch):
    model = language.fit_language_model(calls(TRAIN))
    monkeypatch.setattr(language, "MEMO_WORDS", 3)
    scores = language.WordScores(model)
    texts = [f"neu{i} wort{i} der hund" for i in range(50)]
    assert [scores.judge(t)[0] for t in texts] == ["de"] * 50
    # words that were met before the memory was emptied have no rows any more
    fresh = language.WordScores(model)
    many = " ".join(f"wort{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghi'[i // 1000]}" for i in range(5000))
    assert len({fresh.judge(many) for _ in range(3)}) == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = queries.op1_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 250 and np.mean([r.lang == r.lang_pred for r in out]) > 0.99
