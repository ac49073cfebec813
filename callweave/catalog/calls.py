"""Queries on calls: sentiment, timelines, features, explanations, agents."""

from pyspark.sql import functions as F

from callweave import config as C
from callweave.catalog.base import BARE, ORACLES, SUPPORT, TURNS, WORDS, register, scored, with_ctes
from callweave.functions import text as tx
from callweave.operators import agents, entities, features, rules, sentiment
from callweave.plans import jobs
from callweave.session import scratch_path, settle
from callweave.sources import tables as T

SCORED = TURNS + ",\n" + scored("turns")
SUP_SCORED = SUPPORT + ",\n" + scored("support")


def _r(*names):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def _n(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


@register("w8_running_clock", with_ctes(TURNS) + "SELECT call_id, turn_idx, start_ms, end_ms FROM turns")
def w8(spark, sf):
    return T.turns(spark, sf).select("call_id", "turn_idx", "start_ms", "end_ms")


@register("f3_customer_turns", with_ctes(BARE) + "SELECT call_id, turn_idx, text FROM bare WHERE speaker = 'CUSTOMER'")
def f3(spark, sf):
    return rules.turns_of(T.bare_turns(spark, sf), C.CUSTOMER).select("call_id", "turn_idx", "text")


@register(
    "n6_word_count",
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, {WORDS})) AS BIGINT) AS n_words FROM documents",
)
def n6(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@register(
    "j8_attach_predictions",
    with_ctes(SCORED) + "SELECT call_id, turn_idx, speaker, sentiment, emotion, round(conf, 6) AS sentiment_confidence FROM scored",
)
def j8(spark, sf):
    predictions = T.with_predictions(T.bare_turns(spark, sf)).drop("speaker", "text")
    joined = sentiment.attach_predictions(T.bare_turns(spark, sf), predictions)
    return joined.select("call_id", "turn_idx", "speaker", "sentiment", "emotion", *_r("sentiment_confidence"))


VOTES = """votes AS (
  SELECT call_id, sentiment AS label, count(*) AS n, avg(conf) AS mc, min(turn_idx) AS f FROM scored_s GROUP BY 1, 2),
best AS (
  SELECT call_id, label, mc FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, round(mc, 9) DESC, f) AS r FROM votes)
  WHERE r = 1),
cvotes AS (
  SELECT call_id, sentiment AS label, count(*) AS n, avg(conf) AS mc, min(turn_idx) AS f FROM scored_s
  WHERE speaker = 'CUSTOMER' GROUP BY 1, 2),
cbest AS (
  SELECT call_id, label, mc FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, round(mc, 9) DESC, f) AS r FROM cvotes)
  WHERE r = 1)"""


@register(
    "g1_aggregate_sentiment",
    with_ctes(SCORED, VOTES)
    + """SELECT call_id, label, round(mc, 6) AS confidence, round(avg_s, 6) AS score
FROM best JOIN (SELECT call_id, avg(s) AS avg_s FROM scored_s GROUP BY 1) USING (call_id)""",
)
def g1(spark, sf):
    out = sentiment.aggregate_sentiment(T.scored_turns(spark, sf), ["call_id"])
    return out.select("call_id", "label", *_r("confidence", "score"))


@register(
    "g2_conversation_sentiment",
    with_ctes(SCORED, VOTES)
    + """SELECT a.call_id, c.label AS customer_label, round(c.mc, 6) AS customer_confidence, round(cs, 6) AS customer_score,
  b.label AS conversation_label, round(b.mc, 6) AS conversation_confidence, round(s, 6) AS conversation_score
FROM (SELECT call_id, avg(s) AS s, avg(s) FILTER (WHERE speaker = 'CUSTOMER') AS cs FROM scored_s GROUP BY 1) a
JOIN best b USING (call_id) LEFT JOIN cbest c USING (call_id)""",
)
def g2(spark, sf):
    out = sentiment.conversation_sentiment(T.scored_turns(spark, sf))
    return out.select(
        "call_id", "customer_label", *_r("customer_confidence", "customer_score"),
        "conversation_label", *_r("conversation_confidence", "conversation_score"),
    )


TIMELINE = """timeline AS (
  SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY start_ms, turn_idx) - 1 AS entry_idx,
    start_ms AS time_ms, speaker, emotion AS label, conf FROM scored)"""
LINES = """lines AS (
  SELECT call_id, entry_idx, lpad((time_ms // 60000)::VARCHAR, greatest(2, length((time_ms // 60000)::VARCHAR))::INT, '0') || ':'
    || lpad((time_ms // 1000 % 60)::VARCHAR, 2, '0') || ' ' || upper(label[1]) || lower(label[2:]) AS line FROM timeline)"""


@register(
    "w2_emotion_timeline",
    with_ctes(SCORED, TIMELINE)
    + "SELECT call_id, entry_idx, time_ms, speaker, label, round(conf, 6) AS confidence FROM timeline",
)
def w2(spark, sf):
    out = sentiment.emotion_timeline(T.scored_turns(spark, sf))
    return out.select("call_id", *_n("entry_idx", "time_ms"), "speaker", "label", *_r("confidence"))


@register(
    "w3_timeline_text",
    with_ctes(SCORED, TIMELINE, LINES)
    + "SELECT call_id, string_agg(line, chr(10) ORDER BY entry_idx) AS timeline FROM lines GROUP BY 1",
)
def w3(spark, sf):
    return sentiment.timeline_text(sentiment.emotion_timeline(T.scored_turns(spark, sf)))


@register(
    "n9_intent_text",
    with_ctes(BARE)
    + """SELECT call_id, coalesce(string_agg(text, ' ' ORDER BY turn_idx) FILTER (WHERE speaker = 'CUSTOMER'),
  string_agg(text, ' ' ORDER BY turn_idx)) AS intent_text FROM bare GROUP BY 1""",
)
def n9(spark, sf):
    return sentiment.intent_text(T.bare_turns(spark, sf))


@register(
    "n11_first_customer_text",
    with_ctes(BARE)
    + """SELECT call_id, coalesce(arg_min(text, turn_idx) FILTER (WHERE speaker = 'CUSTOMER'), 'UNKNOWN') AS intent_text
FROM bare GROUP BY 1""",
)
def n11(spark, sf):
    return features.first_customer_text(T.bare_turns(spark, sf))


SUP_RE = r"'(?i)\b(manager|supervisor|someone (else|in charge))\b'"
TRA_RE = r"'(?i)\b(transfer(ring)?|connect(ing)? you)\b'"
JOINED = "joined AS (SELECT call_id, string_agg(text, ' ' ORDER BY turn_idx) AS t FROM support GROUP BY 1)"


@register(
    "n5_keyword_flags",
    with_ctes(SUPPORT, JOINED)
    + f"""SELECT call_id, regexp_matches(t, {SUP_RE}) AS supervisor_request, regexp_matches(t, {TRA_RE}) AS transfer FROM joined""",
)
def n5(spark, sf):
    flags = tx.keyword_flags(T.support_turns(spark, sf))
    return flags.groupBy("call_id").agg(
        F.bool_or("supervisor_phrase").alias("supervisor_request"), F.bool_or("transfer_phrase").alias("transfer")
    )


# Counts entities of the composed sentences, one pattern at a time: they never overlap.
ENTITY_COUNT_SQL = r"""ents AS (
  SELECT call_id, sum(
    len(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b')) + len(regexp_extract_all(text, '(?i)\bINV-\d{4}-\d{3,6}\b'))
    + len(regexp_extract_all(text, '(?i)\b(?:ACC\d{5,8}|A-\d{4,8})\b')) + len(regexp_extract_all(text, '(?i)\bORD-\d{5,8}\b'))
    + len(regexp_extract_all(text, '\(\d{3}\) \d{3}-\d{4}')) + len(regexp_extract_all(text, '\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b'))
    + len(regexp_extract_all(text, 'order number is uh \d{4,8}\b')))::BIGINT AS num_entities
  FROM support GROUP BY 1)"""


@register(
    "g25_entity_count",
    with_ctes(SUPPORT, ENTITY_COUNT_SQL)
    + "SELECT c_custkey AS call_id, coalesce(num_entities, 0) AS num_entities FROM customer LEFT JOIN ents ON call_id = c_custkey",
)
def g25(spark, sf):
    """Every customer is a call; those without orders have no turns and no entities."""
    found = entities.rule_entities(T.support_turns(spark, sf), ["call_id", "turn_idx"])
    calls = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("call_id"))
    return entities.entity_count(found, calls).select("call_id", *_n("num_entities"))


@register(
    "g3_conversation_features",
    with_ctes(SUP_SCORED, ENTITY_COUNT_SQL)
    + f"""SELECT call_id, count(*) AS num_turns, count(*) FILTER (WHERE speaker = 'CUSTOMER') AS num_customer_turns,
  count(*) FILTER (WHERE speaker = 'AGENT') AS num_agent_turns,
  round(avg(len(regexp_extract_all(text, {WORDS}))), 6) AS avg_utterance_length,
  round(coalesce(avg(s) FILTER (WHERE speaker = 'CUSTOMER'), 0), 6) AS customer_avg_sentiment_score,
  round(coalesce(avg(CASE WHEN emotion IN ('anger', 'fear', 'sadness') THEN 1.0 ELSE 0.0 END) FILTER (WHERE speaker = 'CUSTOMER'), 0), 6)
    AS customer_negative_emotion_fraction,
  max(num_entities) AS num_entities,
  CASE WHEN arg_max(sentiment, turn_idx) FILTER (WHERE speaker = 'CUSTOMER') = 'negative' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ends_on_negative_sentiment
FROM scored_s JOIN ents USING (call_id) GROUP BY 1""",
)
def g3(spark, sf):
    turns = T.support_turns(spark, sf)
    out = features.conversation_features(T.with_predictions(turns), jobs.entity_counts(turns))
    return out.select(
        "call_id", *_n("num_turns", "num_customer_turns", "num_agent_turns"),
        *_r("avg_utterance_length", "customer_avg_sentiment_score", "customer_negative_emotion_fraction"),
        *_n("num_entities"), *_r("ends_on_negative_sentiment"),
    )


def features_sql(source: str = "scored_s", turns: str = "support") -> str:
    return f"""fj AS (SELECT call_id AS jid, string_agg(text, ' ' ORDER BY turn_idx) AS t FROM {turns} GROUP BY 1),
fb AS (
  SELECT call_id, count(*) AS num_turns, count(*) FILTER (WHERE speaker = 'CUSTOMER') AS num_customer_turns,
    count(*) FILTER (WHERE speaker = 'AGENT') AS num_agent_turns,
    (max(end_ms) - min(start_ms)) / 1000.0::DOUBLE AS conversation_duration_seconds,
    coalesce(avg(len(regexp_extract_all(text, {WORDS}))) FILTER (WHERE speaker = 'CUSTOMER'), 0) AS avg_customer_utterance_length,
    coalesce(arg_min(s, turn_idx) FILTER (WHERE speaker = 'CUSTOMER'), 0) AS first_customer_sentiment_score,
    coalesce(arg_max(s, turn_idx) FILTER (WHERE speaker = 'CUSTOMER'), 0) AS last_customer_sentiment_score,
    coalesce(avg(s) FILTER (WHERE speaker = 'CUSTOMER'), 0) AS mean_customer_sentiment_score,
    count(*) FILTER (WHERE speaker = 'CUSTOMER' AND s < 0) AS negative_sentiment_turn_count,
    count(*) FILTER (WHERE speaker = 'CUSTOMER' AND emotion IN ('anger', 'fear', 'sadness')) AS negative_emotion_count,
    count(*) FILTER (WHERE speaker = 'CUSTOMER' AND emotion = 'anger') AS angry
  FROM {source} GROUP BY 1),
feats AS (
  SELECT fb.*, CASE WHEN num_customer_turns >= 2 THEN last_customer_sentiment_score - first_customer_sentiment_score ELSE 0 END AS sentiment_trend,
    CASE WHEN num_customer_turns > 0 THEN negative_sentiment_turn_count / num_customer_turns ELSE 0 END AS negative_sentiment_fraction,
    CASE WHEN angry > 0 THEN 1 ELSE 0 END AS anger_or_frustration_present,
    CASE WHEN regexp_matches(t, {SUP_RE}) THEN 1 ELSE 0 END AS supervisor_request_mentioned,
    CASE WHEN regexp_matches(t, {TRA_RE}) THEN 1 ELSE 0 END AS transfer_mentioned,
    CASE WHEN negative_sentiment_turn_count >= 2 THEN 1 ELSE 0 END AS repeated_complaint_signal,
    CASE WHEN num_customer_turns > 0 AND last_customer_sentiment_score < 0 THEN 1 ELSE 0 END AS ends_on_negative_sentiment
  FROM fb JOIN fj ON call_id = jid)"""


FEATURES = features_sql()
ROUNDED = ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in C.BUSINESS_FEATURES)


@register("g4_business_features", with_ctes(SUP_SCORED, FEATURES) + f"SELECT call_id, {ROUNDED} FROM feats")
def g4(spark, sf):
    out = features.business_features(T.with_predictions(T.support_turns(spark, sf)))
    return out.select("call_id", *_r(*C.BUSINESS_FEATURES))


@register(
    "w1_sentiment_trend",
    with_ctes(SCORED)
    + """SELECT call_id, coalesce(arg_min(s, turn_idx) FILTER (WHERE speaker = 'CUSTOMER'), 0)::BIGINT AS first_score,
  coalesce(arg_max(s, turn_idx) FILTER (WHERE speaker = 'CUSTOMER'), 0)::BIGINT AS last_score,
  CASE WHEN count(*) FILTER (WHERE speaker = 'CUSTOMER') >= 2 THEN arg_max(s, turn_idx) FILTER (WHERE speaker = 'CUSTOMER')
    - arg_min(s, turn_idx) FILTER (WHERE speaker = 'CUSTOMER') ELSE 0 END::BIGINT AS trend
FROM scored_s GROUP BY 1""",
)
def w1(spark, sf):
    out = features.business_features(T.scored_turns(spark, sf))
    return out.select(
        "call_id",
        F.col("first_customer_sentiment_score").cast("bigint").alias("first_score"),
        F.col("last_customer_sentiment_score").cast("bigint").alias("last_score"),
        F.col("sentiment_trend").cast("bigint").alias("trend"),
    )


@register(
    "g5_talk_listen_ratio",
    with_ctes(TURNS)
    + """SELECT call_id, CASE WHEN c > 0 THEN round(a / c, 6) END AS talk_listen_ratio FROM (
  SELECT call_id, coalesce(sum(end_ms - start_ms) FILTER (WHERE speaker = 'AGENT'), 0) AS a,
    coalesce(sum(end_ms - start_ms) FILTER (WHERE speaker = 'CUSTOMER'), 0) AS c FROM turns GROUP BY 1)""",
)
def g5(spark, sf):
    return features.talk_listen(T.turns(spark, sf)).select("call_id", *_r("talk_listen_ratio"))


@register(
    "f5_risk_tier",
    "SELECT doc_id, CASE WHEN (doc_id % 101) / 100.0 <= 0.35 THEN 'Low' WHEN (doc_id % 101) / 100.0 <= 0.65 THEN 'Medium' ELSE 'High' END AS tier FROM documents",
)
def f5(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", rules.risk_tier((F.col("doc_id") % 101) / 100.0).alias("tier"))


ACTIVE_SQL = " UNION ALL ".join(
    f"SELECT call_id, {i} AS idx, '{n}' AS feature, {round(0.01 * ((i * 7) % 10 + 1), 2)} AS importance FROM feats WHERE {n} {op} {t}"
    for i, n in enumerate(C.BUSINESS_FEATURES)
    if n in C.ACTIVE_RULES
    for op, t in [C.ACTIVE_RULES[n]]
)
# Importances with ties, the same in both engines.
IMPORTANCES = {n: round(0.01 * ((i * 7) % 10 + 1), 2) for i, n in enumerate(C.BUSINESS_FEATURES)}


@register(
    "f6_active_factors",
    with_ctes(SUP_SCORED, FEATURES, f"act AS ({ACTIVE_SQL})") + "SELECT call_id, feature FROM act",
)
def f6(spark, sf):
    feats = features.business_features(T.with_predictions(T.support_turns(spark, sf)))
    active = features.active_factors(features.literal_importances(IMPORTANCES))
    return feats.select("call_id", F.explode(active).alias("x")).select("call_id", "x.feature")


@register(
    "j9_factor_importances",
    with_ctes(SUP_SCORED, FEATURES, f"act AS ({ACTIVE_SQL})")
    + "SELECT call_id, feature, importance::DOUBLE AS importance FROM act",
)
def j9(spark, sf):
    feats = features.business_features(T.with_predictions(T.support_turns(spark, sf)))
    table = spark.createDataFrame(list(IMPORTANCES.items()), "feature string, importance double")
    active = features.active_factors(F.col("_imp"))
    return (
        feats.withColumn("_imp", features.importance_map(table))
        .select("call_id", F.explode(active).alias("x"))
        .select("call_id", "x.feature", "x.importance")
    )


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY importance DESC, idx) AS r FROM act)"


@register(
    "t2_top_factors",
    with_ctes(SUP_SCORED, FEATURES, f"act AS ({ACTIVE_SQL})", RANKED)
    + "SELECT call_id, string_agg(feature, ',' ORDER BY r) AS factors FROM ranked WHERE r <= 4 GROUP BY 1",
)
def t2(spark, sf):
    feats = features.business_features(T.with_predictions(T.support_turns(spark, sf)))
    top = features.top_factors(features.active_factors(features.literal_importances(IMPORTANCES)))
    return feats.select("call_id", F.array_join(top, ",").alias("factors")).filter("factors <> ''")


DISPLAY_SQL = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FEATURE_DISPLAY.items()) + " ELSE feature END"
VERDICT = f"""verdict AS (
  SELECT call_id, probability, CASE WHEN probability <= 0.35 THEN 'Low' WHEN probability <= 0.65 THEN 'Medium' ELSE 'High' END AS risk_tier,
    coalesce(fs, '') AS top_factors, names FROM (SELECT call_id, (call_id % 101) / 100.0 AS probability FROM feats)
  LEFT JOIN (SELECT call_id, string_agg(feature, ',' ORDER BY r) AS fs, string_agg({DISPLAY_SQL}, '; ' ORDER BY r) AS names
    FROM ranked WHERE r <= 4 GROUP BY 1) USING (call_id))"""
SENTENCE = """CASE WHEN names IS NULL THEN 'Escalation risk: ' || risk_tier || '. No strong contributing factors identified.'
  ELSE 'Escalation risk: ' || risk_tier || '. Contributing factors: ' || names || '.' END"""


def _verdicts(spark, sf):
    feats = features.business_features(T.with_predictions(T.support_turns(spark, sf)))
    scored_calls = feats.withColumn("probability", (F.col("call_id") % 101) / 100.0)
    return features.explain_escalation(scored_calls, features.literal_importances(IMPORTANCES))


@register(
    "n8_explanation",
    with_ctes(SUP_SCORED, FEATURES, f"act AS ({ACTIVE_SQL})", RANKED, VERDICT)
    + f"SELECT call_id, {SENTENCE} AS explanation FROM verdict",
)
def n8(spark, sf):
    return _verdicts(spark, sf).select("call_id", "explanation")


@register(
    "m9_escalation_verdict",
    with_ctes(SUP_SCORED, FEATURES, f"act AS ({ACTIVE_SQL})", RANKED, VERDICT)
    + f"SELECT call_id, probability::DOUBLE AS probability, risk_tier, top_factors, {SENTENCE} AS explanation FROM verdict",
)
def m9(spark, sf):
    return _verdicts(spark, sf).select(
        "call_id", *_r("probability"), "risk_tier", F.array_join("top_factors", ",").alias("top_factors"), "explanation"
    )


@register(
    "f9_normalize_delta",
    """SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 0.5 ELSE
  (least(greatest((n_chars % 13 - 6) / 2.0, -2), 2) + 2) / 4 END::DOUBLE AS normalized FROM documents""",
)
def f9(spark, sf):
    delta = F.when(F.col("n_chars") % 5 != 0, (F.col("n_chars") % 13 - 6) / 2.0)
    return T.read(spark, sf, "documents").select("doc_id", rules.normalize_delta(delta).alias("normalized"))


OUTCOME_SQL = """outcome AS (
  SELECT DISTINCT conv_id AS call_id, ['RESOLVED_SATISFIED', 'RESOLVED_NEUTRAL', 'PARTIALLY_RESOLVED', 'UNRESOLVED_DISSATISFIED',
    'UNRESOLVED_ESCALATED'][1 + conv_id % 5] AS outcome FROM conversations),
labelled AS (
  SELECT *, CASE WHEN outcome LIKE 'RESOLVED%' THEN 'Resolved' WHEN outcome LIKE 'PART%' THEN 'Partially Resolved' ELSE 'Unresolved' END AS resolution,
    CASE WHEN outcome = 'RESOLVED_SATISFIED' THEN 'Satisfied' WHEN outcome LIKE 'UNRESOLVED%' THEN 'Dissatisfied' ELSE 'Neutral' END AS satisfaction,
    CASE WHEN outcome = 'UNRESOLVED_ESCALATED' THEN 'Yes' ELSE 'No' END AS escalation FROM outcome)"""


@register("f10_outcome_labels", with_ctes(OUTCOME_SQL) + "SELECT call_id, resolution, satisfaction, escalation FROM labelled")
def f10(spark, sf):
    return rules.outcome_labels(T.outcomes(spark, sf)).drop("outcome")


# Stand-ins for the models: resolution and satisfaction from the outcome, risk from the call id.
METRICS_SQL = """metrics AS (
  SELECT call_id, call_id % 7 AS agent_id, conversation_duration_seconds AS handling_time_seconds, resolution = 'Resolved' AS resolved,
    (call_id % 101) / 100.0 > 0.65 AS escalated,
    last_customer_sentiment_score - first_customer_sentiment_score AS sentiment_improvement,
    CASE WHEN c > 0 THEN a / c END AS talk_listen_ratio, satisfaction AS customer_satisfaction
  FROM feats JOIN labelled USING (call_id) JOIN (
    SELECT call_id, coalesce(sum(end_ms - start_ms) FILTER (WHERE speaker = 'AGENT'), 0) AS a,
      coalesce(sum(end_ms - start_ms) FILTER (WHERE speaker = 'CUSTOMER'), 0) AS c FROM turns GROUP BY 1) USING (call_id))"""
CALL_CTES = (SCORED, features_sql("scored_s", "turns"), OUTCOME_SQL, METRICS_SQL)


def _metrics(spark, sf):
    scored_turns = T.scored_turns(spark, sf)
    feats = features.business_features(scored_turns)
    labels = rules.outcome_labels(T.outcomes(spark, sf))
    risk = T.outcomes(spark, sf).select("call_id", rules.risk_tier((F.col("call_id") % 101) / 100.0).alias("risk_tier"))
    return agents.call_metrics(
        feats, features.talk_listen(scored_turns), labels, risk, labels, T.agents_of_calls(spark, sf)
    )


@register(
    "g6_call_metrics",
    with_ctes(*CALL_CTES)
    + """SELECT agent_id, call_id, round(handling_time_seconds, 6) AS handling_time_seconds, resolved, escalated,
  sentiment_improvement::BIGINT AS sentiment_improvement, round(talk_listen_ratio, 6) AS talk_listen_ratio, customer_satisfaction FROM metrics""",
)
def g6(spark, sf):
    return _metrics(spark, sf).select(
        "agent_id", "call_id", *_r("handling_time_seconds"), "resolved", "escalated", *_n("sentiment_improvement"),
        *_r("talk_listen_ratio"), "customer_satisfaction",
    )


# Agents 0..9: the last three have no calls.
AGENTS_SQL = """agent_ids AS (SELECT DISTINCT conv_id % 10 AS agent_id FROM conversations),
per_agent AS (
  SELECT agent_id, count(call_id) AS num_calls, avg(resolved::INT) AS resolution_rate, avg(handling_time_seconds) AS avg_handling_time_seconds,
    avg(escalated::INT) AS escalation_rate, avg(sentiment_improvement) AS avg_sentiment_improvement,
    avg(talk_listen_ratio) AS avg_talk_listen_ratio,
    count(*) FILTER (WHERE customer_satisfaction = 'Satisfied') AS satisfied,
    count(*) FILTER (WHERE customer_satisfaction = 'Neutral') AS neutral,
    count(*) FILTER (WHERE customer_satisfaction = 'Dissatisfied') AS dissatisfied
  FROM agent_ids LEFT JOIN metrics USING (agent_id) GROUP BY 1)"""


def _agent_dimension(spark, sf):
    return T.read(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("agent_id")).distinct()


def _agents(spark, sf):
    return agents.agent_metrics(_metrics(spark, sf), _agent_dimension(spark, sf))


def _agent_columns(metrics):
    def n(label):
        return F.coalesce(F.element_at("satisfaction_distribution", F.lit(label)), F.lit(0)).alias(label.lower())

    return metrics.select("agent_id", *_n("num_calls"), *_r(*RATES), n("Satisfied"), n("Neutral"), n("Dissatisfied"))


RATES = ["resolution_rate", "avg_handling_time_seconds", "escalation_rate", "avg_sentiment_improvement", "avg_talk_listen_ratio"]


@register(
    "g7_agent_metrics",
    with_ctes(*CALL_CTES, AGENTS_SQL)
    + f"SELECT agent_id, num_calls, {', '.join(f'round({r}, 6) AS {r}' for r in RATES)}, satisfied, neutral, dissatisfied FROM per_agent",
)
def g7(spark, sf):
    return _agent_columns(_agents(spark, sf))


@register("g7_rolled_up_by_batches", ORACLES["g7_agent_metrics"])
def g7_batches(spark, sf):
    """The metrics of agents from states of batches: the last comes first, one is sent twice, one was wrong and is corrected."""
    metrics = settle(_metrics(spark, sf).withColumn("day", F.col("call_id") % 5))
    first, rest = metrics.where("call_id % 3 = 0"), metrics.where("call_id % 3 <> 0")
    wrong = first.withColumns({"resolved": F.lit(True), "handling_time_seconds": F.col("handling_time_seconds") + 0.1})
    path = scratch_path(spark, "agent-states")
    for batch, states in (
        ("correction", agents.correction_states(wrong, first)), ("rest", agents.metric_states(rest)),
        ("first", agents.metric_states(wrong)), ("rest", agents.metric_states(rest)),
    ):
        agents.write_states(states, path, batch)
    rolled = agents.metrics_of_states(agents.read_states(agents.metric_states(rest), path), _agent_dimension(spark, sf))
    return _agent_columns(rolled)


@register(
    "g8_satisfaction_distribution",
    with_ctes(*CALL_CTES) + "SELECT agent_id, customer_satisfaction, count(*) AS n_calls FROM metrics GROUP BY 1, 2",
)
def g8(spark, sf):
    return agents.satisfaction_distribution(_metrics(spark, sf))


SCORE_SQL = """parts AS (
  SELECT agent_id, coalesce(resolution_rate, 0.5) AS resolution_rate, coalesce(1 - escalation_rate, 0.5) AS non_escalation_rate,
    CASE WHEN avg_sentiment_improvement IS NULL THEN 0.5 ELSE (least(greatest(avg_sentiment_improvement, -2), 2) + 2) / 4 END AS sentiment_improvement,
    CASE WHEN satisfied + neutral + dissatisfied > 0 THEN satisfied / (satisfied + neutral + dissatisfied) ELSE 0.5 END AS satisfaction
  FROM per_agent)"""
PARTS = list(C.SCORE_WEIGHTS)


@register(
    "g9_agent_score",
    with_ctes(*CALL_CTES, AGENTS_SQL, SCORE_SQL)
    + f"""SELECT agent_id, round(0.25 * ({' + '.join(PARTS)}), 6) AS score, {', '.join(f'round({p}, 6) AS {p}' for p in PARTS)},
  {', '.join(f'0.25::DOUBLE AS weight_{p}' for p in PARTS)} FROM parts""",
)
def g9(spark, sf):
    out = agents.agent_score(_agents(spark, sf))
    return out.select(
        "agent_id", *_r("score"), *[F.round(F.col(f"components.{p}"), 6).alias(p) for p in PARTS],
        *[F.col(f"weights.{p}").alias(f"weight_{p}") for p in PARTS],
    )


@register(
    "s10_score_weights",
    f"""SELECT conv_id AS call_id, turn AS turn_idx, {', '.join(f'0.25::DOUBLE AS {p}' for p in PARTS)} FROM conversations""",
)
def s10(spark, sf):
    weights = rules.config_df(spark, C.SCORE_WEIGHTS).select(F.struct("*")).scalar()
    return (
        T.bare_turns(spark, sf).select("call_id", "turn_idx").withColumn("_w", weights)
        .select("call_id", "turn_idx", *[F.col(f"_w.{p}").alias(p) for p in PARTS])
    )


@register(
    "c2_conversation_nlp",
    with_ctes(SCORED, VOTES)
    + """SELECT a.call_id, intent_text, c.label AS customer_label, b.label AS conversation_label,
  round(s, 6) AS conversation_score, n_entries
FROM (SELECT call_id, avg(s) AS s, count(*) AS n_entries, coalesce(string_agg(text, ' ' ORDER BY turn_idx) FILTER (WHERE speaker = 'CUSTOMER'),
    string_agg(text, ' ' ORDER BY turn_idx)) AS intent_text FROM scored_s GROUP BY 1) a
JOIN best b USING (call_id) LEFT JOIN cbest c USING (call_id)""",
)
def c2(spark, sf):
    result = jobs.analyze_nlp(T.scored_turns(spark, sf))
    entries = result["emotion_timeline"].groupBy("call_id").agg(F.count(F.lit(1)).alias("n_entries"))
    return (
        result["intent_text"].join(result["sentiment"], "call_id").join(entries, "call_id")
        .select("call_id", "intent_text", "customer_label", "conversation_label", *_r("conversation_score"), "n_entries")
    )
