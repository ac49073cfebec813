"""Features, sentiment, explanations and agents on literal calls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from callweave import config as C
from callweave.functions import text as tx
from callweave.operators import agents, features, quality, rules, sentiment

TURNS = "call_id string, turn_idx bigint, speaker string, start_ms bigint, end_ms bigint, text string, sentiment string, sentiment_confidence double, emotion string, emotion_confidence double, intent string"


def turn(call, i, who, start, end, text, mood="neutral", emotion="joy"):
    return (call, i, who, start, end, text, mood, 0.9, emotion, 0.9, "ORDER")


@pytest.mark.parametrize("p, tier", [(0.0, "Low"), (0.35, "Low"), (0.36, "Medium"), (0.65, "Medium"), (0.66, "High"), (1.0, "High")])
def test_risk_tier(spark, p, tier):
    assert spark.range(1).select(rules.risk_tier(F.lit(p))).first()[0] == tier


def test_risk_tier_custom(spark):
    got = spark.range(1).select(rules.risk_tier(F.lit(0.15), 0.1, 0.2), rules.risk_tier(F.lit(0.25), 0.1, 0.2)).first()
    assert list(got) == ["Medium", "High"]


@pytest.mark.parametrize("delta, value", [(0.0, 0.5), (2.0, 1.0), (-2.0, 0.0), (10.0, 1.0), (None, 0.5)])
def test_normalize_delta(spark, delta, value):
    assert spark.range(1).select(rules.normalize_delta(F.lit(delta).cast("double"))).first()[0] == value


def test_aggregate_sentiment(spark):
    rows = [("c", 0, "negative", 0.9), ("c", 1, "negative", 0.8), ("c", 2, "positive", 0.6), ("t", 0, "positive", 0.5), ("t", 1, "negative", 0.5)]
    df = spark.createDataFrame(rows, "call_id string, turn_idx bigint, sentiment string, sentiment_confidence double")
    got = {r.call_id: r for r in sentiment.aggregate_sentiment(df, ["call_id"]).collect()}
    assert got["c"].label == "negative" and got["c"].score == pytest.approx(-1 / 3) and got["c"].confidence == pytest.approx(0.85)
    assert got["t"].label == "positive"  # same votes and confidence: first seen


def test_equal_means_of_unequal_bits_are_a_tie(spark):
    assert 0.1 + 0.7 < 0.4 + 0.4  # as doubles
    moods = [("negative", 0.1), ("positive", 0.4), ("negative", 0.7), ("positive", 0.4)]
    rows = [("c", i, "CUSTOMER", m, p) for i, (m, p) in enumerate(moods)]
    df = spark.createDataFrame(rows, "call_id string, turn_idx bigint, speaker string, sentiment string, sentiment_confidence double")
    assert sentiment.aggregate_sentiment(df, ["call_id"]).first().label == "negative"
    r = sentiment.conversation_sentiment(df).first()
    assert (r.customer_label, r.conversation_label) == ("negative", "negative")


def test_means_do_not_depend_on_the_order_of_rows(spark):
    draw = random.Random(21)
    points = [draw.randint(50, 99) for _ in range(31)]
    points.append(2417 - sum(points))  # the mean is 0.7553125, a half in the seventh decimal
    orders = [points, sorted(points), points[::-1]]
    added = 0.0
    for x in points:
        added += x / 100
    assert added / 32 < 0.7553125  # as doubles are added
    for order in orders:
        rows = [("c", i, "CUSTOMER", "negative", x / 100) for i, x in enumerate(order)]
        df = spark.createDataFrame(rows, "call_id string, turn_idx bigint, speaker string, sentiment string, sentiment_confidence double").coalesce(1)
        both = sentiment.conversation_sentiment(df).first()
        assert {sentiment.aggregate_sentiment(df, ["call_id"]).first().confidence, both.customer_confidence, both.conversation_confidence} == {0.7553125}


def test_conversation_sentiment_without_customer(spark):
    df = spark.createDataFrame([turn("c", 0, "SPEAKER_00", 0, 10, "hi", "positive")], TURNS)
    r = sentiment.conversation_sentiment(df).first()
    assert r.customer_label is None and r.customer_score is None and r.conversation_label == "positive"


def test_timeline_text(spark):
    rows = [turn("c", 1, "AGENT", 65_000, 70_000, "x", emotion="anger"), turn("c", 0, "CUSTOMER", 0, 10, "y", emotion="neutral")]
    out = sentiment.timeline_text(sentiment.emotion_timeline(spark.createDataFrame(rows, TURNS))).first()
    assert out.timeline == "00:00 Neutral\n01:05 Anger"


def test_business_features(spark):
    rows = [
        turn("c", 0, "AGENT", 0, 2000, "hello how can I help"),
        turn("c", 1, "CUSTOMER", 2000, 61_000, "I want a manager now", "negative", "anger"),
        turn("c", 2, "CUSTOMER", 61_500, 70_000, "this is bad", "negative", "fear"),
        turn("d", 0, "AGENT", 0, 1000, "let me connect"),
        turn("d", 1, "AGENT", 1000, 2000, "you with someone"),
        turn("d", 2, "AGENT", 2000, 3000, "in charge"),
    ]
    got = {r.call_id: r.asDict() for r in features.business_features(spark.createDataFrame(rows, TURNS)).collect()}
    c, d = got["c"], got["d"]
    assert c["num_turns"] == 3 and c["num_customer_turns"] == 2 and c["conversation_duration_seconds"] == 70.0
    assert c["first_customer_sentiment_score"] == -1 and c["sentiment_trend"] == 0 and c["negative_sentiment_fraction"] == 1.0
    assert c["avg_customer_utterance_length"] == 4.0 and c["negative_emotion_count"] == 2 and c["anger_or_frustration_present"] == 1
    assert c["supervisor_request_mentioned"] == 1 and c["transfer_mentioned"] == 0 and c["repeated_complaint_signal"] == 1
    assert d["supervisor_request_mentioned"] == 1 and d["transfer_mentioned"] == 1  # across turns
    assert d["num_customer_turns"] == 0 and d["mean_customer_sentiment_score"] == 0.0 and d["ends_on_negative_sentiment"] == 0
    assert list(c) == ["call_id", *C.BUSINESS_FEATURES]


def test_keyword_flags_on_random_calls(spark):
    rnd = random.Random(7)
    bits = ["someone", "in", "charge", "else", "xsomeone", "manager", "managers", "connect", "you", "connecting", "transfer", "", "a",
            "aaaaaaaaaaaaaaaaaaaaaaaaaa manager", "someone in", "manageraaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "to connect you"]
    rows = [(c, i, rnd.choice(bits)) for c in range(150) for i in range(rnd.choice([1, 3, 8, 45]))]
    df = spark.createDataFrame(rows, "call_id int, turn_idx bigint, text string")
    got = tx.keyword_flags(df, size=20).groupBy("call_id").agg(F.bool_or("supervisor_phrase"), F.bool_or("transfer_phrase"))
    strip = re.compile(r"^\(\?iU\)")
    sup, tra = (re.compile(strip.sub("", p), re.I) for p in (C.SUPERVISOR_PATTERN, C.TRANSFER_PATTERN))
    for call, s, t in got.collect():
        whole = " ".join(x for c, _, x in rows if c == call)
        assert (s, t) == (bool(sup.search(whole)), bool(tra.search(whole))), whole


def test_explanation(spark):
    zero = {n: 0.0 for n in C.BUSINESS_FEATURES}
    base = dict(zero, negative_emotion_count=1.0, sentiment_trend=-1.0, conversation_duration_seconds=60.0,
                transfer_mentioned=1.0, ends_on_negative_sentiment=1.0, num_turns=99.0)
    df = spark.createDataFrame([dict(base, call_id="a", probability=0.9), dict(zero, call_id="b", probability=0.1)])
    weights = {n: 0.1 for n in C.BUSINESS_FEATURES} | {"transfer_mentioned": 0.3}
    got = {r.call_id: r for r in features.explain_escalation(df, features.literal_importances(weights)).collect()}
    assert got["a"].top_factors == ["transfer_mentioned", "conversation_duration_seconds", "sentiment_trend", "negative_emotion_count"]
    assert got["a"].explanation == (
        "Escalation risk: High. Contributing factors: Call was transferred; Unusually long conversation; "
        "Sentiment worsened during the call; Multiple negative-emotion customer turns."
    )
    assert len(got["a"].factor_importances) == 5
    assert got["b"].explanation == "Escalation risk: Low. No strong contributing factors identified."


METRICS = "agent_id int, handling_time_seconds double, resolved boolean, escalated boolean, sentiment_improvement int, talk_listen_ratio double, customer_satisfaction string"


def test_agent_metrics_and_score(spark):
    rows = [(1, 100.0, True, False, 1, 1.2, "Satisfied"), (1, 200.0, False, True, -1, 0.8, "Dissatisfied"), (2, 50.0, True, False, 0, None, "Neutral")]
    dim = spark.createDataFrame([(1,), (2,), (3,)], "agent_id int")
    out = agents.agent_metrics(spark.createDataFrame(rows, METRICS), dim)
    got = {r.agent_id: r for r in out.collect()}
    one = got[1]
    assert (one.num_calls, one.resolution_rate, one.escalation_rate, one.avg_handling_time_seconds) == (2, 0.5, 0.5, 150.0)
    assert one.avg_sentiment_improvement == 0.0 and one.avg_talk_listen_ratio == pytest.approx(1.0)
    assert one.satisfaction_distribution == {"Satisfied": 1, "Dissatisfied": 1}
    assert got[2].avg_talk_listen_ratio is None
    assert got[3].num_calls == 0 and got[3].resolution_rate is None and got[3].satisfaction_distribution == {}
    assert "interruption_frequency" not in out.columns
    score = {r.agent_id: r for r in agents.agent_score(out).collect()}
    assert score[3].score == 0.5 and score[3].components.satisfaction == 0.5
    assert score[1].score == pytest.approx(0.5) and score[1].weights.satisfaction == 0.25


def test_talk_listen_without_customer(spark):
    df = spark.createDataFrame([turn("c", 0, "AGENT", 0, 10, "hi")], TURNS)
    assert features.talk_listen(df).first().talk_listen_ratio is None


def test_agent_states_add_up_in_any_order(spark, tmp_path):
    """Late, repeated and corrected batches give the metrics of the calls as they are in the end."""
    schema = """call_id int, agent_id int, day string, handling_time_seconds double, sentiment_improvement double, talk_listen_ratio double,
      resolved boolean, escalated boolean, customer_satisfaction string"""
    rows = [
        (i, None if i % 9 == 0 else i % 4, f"d{i % 3}" if i % 5 else None, None if i % 4 == 3 else i * 0.1, float(i % 3 - 1),
         None if i % 4 == 2 else 0.1 * i, None if i % 6 == 0 else i % 2 == 0, i % 3 == 0, None if i % 7 == 0 else ("Satisfied", "Neutral")[i % 2])
        for i in range(40)
    ]
    good = spark.createDataFrame(rows, schema)
    wrong = good.withColumns({"resolved": F.lit(True), "day": F.lit("d9"), "talk_listen_ratio": F.lit(0.3)})
    agents_ = spark.createDataFrame([(i,) for i in range(6)], "agent_id int")
    early, late = good.where("call_id < 25"), good.where("call_id >= 25")
    path = str(tmp_path / "states")
    for batch, states in (
        ("c", agents.correction_states(wrong.where("call_id < 25"), early)), ("b", agents.metric_states(late)),
        ("a", agents.metric_states(wrong.where("call_id < 25"))), ("b", agents.metric_states(late)),
    ):
        agents.write_states(states, path, batch)
    states = agents.read_states(agents.metric_states(late), path)
    assert {r.day for r in states.collect()} == {r.day for r in good.collect()}  # what was taken back is gone
    got = {r.agent_id: r for r in agents.metrics_of_states(states, agents_).collect()}
    want = {r.agent_id: r for r in agents.agent_metrics(good, agents_).collect()}
    assert got.keys() == want.keys()
    for a, w in want.items():
        for c in w.asDict():
            assert got[a][c] == (pytest.approx(w[c], abs=1e-9) if isinstance(w[c], float) else w[c]), (a, c)


def test_states_of_nothing(spark):
    none = spark.createDataFrame([], "agent_id int, day string, customer_satisfaction string, handling_time_seconds double, sentiment_improvement double, talk_listen_ratio double, resolved boolean, escalated boolean")
    assert agents.metrics_of_states(agents.metric_states(none)).count() == 0


def test_write_counts_what_it_writes(spark, tmp_path):
    items = spark.createDataFrame([("a", None), ("b", "broken"), ("c", None)], "path string, error string")
    path = str(tmp_path / "items")
    assert quality.write_with_summary(items, path).collect() == quality.batch_summary(items).collect()
    assert [r.path for r in spark.read.parquet(path).where("failed = 'true'").collect()] == ["b"]
    assert quality.write_with_summary(items.limit(0), str(tmp_path / "none")).first() == (0, 0, 0)
