"""How the rows that models are fitted on and scored over are dealt to tasks."""

from callweave import config as C
from callweave.operators import evaluate, learn


def test_text_baseline_keeps_vectors_not_words(spark, monkeypatch):
    kept = []
    weighted = evaluate.with_class_weights
    monkeypatch.setattr(evaluate, "with_class_weights", lambda df, label: kept.append(df.columns) or weighted(df, label))
    rows = [(f"good day number{i}", "good") for i in range(6)] + [(f"bad night number{i}", "poor") for i in range(6)]
    df = spark.createDataFrame(rows, "text string, label string")
    model = learn.train_text_baseline(df)
    assert kept == [["label", "features"]]
    assert {(r.label, r.predicted) for r in learn.score(model, df).collect()} == {("good", "good"), ("poor", "poor")}


def test_forest_rows_of_one_partition_are_dealt_to_all_cores(spark, monkeypatch):
    dealt = []
    spread = learn._spread
    monkeypatch.setattr(learn, "_spread", lambda df: dealt.append(spread(df)) or dealt[-1])
    rows = [(i, *[float((i * k) % 7) for k in range(len(C.BUSINESS_FEATURES))], "Yes" if i % 3 else "No") for i in range(60)]
    schema = "call_id int, " + ", ".join(f"{n} double" for n in C.BUSINESS_FEATURES) + ", escalation string"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    scored = learn.escalation_probability(learn.train_escalation(df, trees=3), df)
    assert scored.count() == 60
    assert len(dealt) == 2 and all(d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for d in dealt)


def test_long_texts_are_dealt_to_more_tasks_than_cores(spark, monkeypatch):
    """A task of the regression reads vectors of a limited number of characters, however many there are."""
    monkeypatch.setattr(learn, "TASK_CHARS", 20, raising=False)
    dealt, fit = [], learn._fit

    def watched(stages, df, label, deal):
        return fit(stages, df, label, lambda rows: dealt.append(deal(rows)) or dealt[-1])

    monkeypatch.setattr(learn, "_fit", watched)
    rows = [(f"good day number{i}", "good") for i in range(6)] + [(f"bad night number{i}", "poor") for i in range(6)]
    df = spark.createDataFrame(rows, "text string, label string").coalesce(1)
    model = learn.train_text_baseline(df)
    chars = sum(len(t) for t, _ in rows)
    assert dealt[0].rdd.getNumPartitions() == -(-chars // 20) > spark.sparkContext.defaultParallelism
    assert {(r.label, r.predicted) for r in learn.score(model, df).collect()} == {("good", "good"), ("poor", "poor")}
