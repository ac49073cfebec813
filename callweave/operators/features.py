"""Per-call features and the explanation of a risk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import config as C
from callweave.functions import blocks
from callweave.functions import text as tx
from callweave.operators import rules


def sentiment_score(label: Column) -> Column:
    return F.coalesce(rules.lookup(C.SENTIMENT_SCORES, label), F.lit(0))


def _is(role: str) -> Column:
    return F.col("speaker") == role


def add_clock(turns: DataFrame, ms_per_word: int = 400, gap_ms: int = C.TURN_GAP_MS) -> DataFrame:
    """Start and end for turns without times: each starts a gap after the one before."""
    timed = turns.withColumn("_dur", tx.word_count(F.col("text")) * ms_per_word)
    return (
        blocks.running_sum(timed, ["call_id"], ["turn_idx"], blocks.TURN_BLOCK, F.col("_dur") + gap_ms, "start_ms")
        .withColumn("end_ms", F.col("start_ms") + F.col("_dur"))
        .drop("_dur")
    )


def conversation_features(scored: DataFrame, entity_counts: DataFrame) -> DataFrame:
    """The eight conversation features. `entity_counts`: call_id, num_entities."""
    cust = _is(C.CUSTOMER)
    per_call = scored.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("num_turns"),
        F.count_if(cust).alias("num_customer_turns"),
        F.count_if(_is(C.AGENT)).alias("num_agent_turns"),
        F.avg(tx.word_count(F.col("text"))).alias("avg_utterance_length"),
        F.coalesce(F.avg(F.when(cust, sentiment_score(F.col("sentiment")))), F.lit(0.0)).alias(
            "customer_avg_sentiment_score"
        ),
        F.coalesce(
            F.avg(F.when(cust, F.col("emotion").isin(C.NEGATIVE_EMOTIONS).cast("int"))), F.lit(0.0)
        ).alias("customer_negative_emotion_fraction"),
        F.max_by("sentiment", F.when(cust, F.col("turn_idx"))).alias("_last"),
    )
    return (
        per_call.join(entity_counts.select("call_id", "num_entities"), "call_id", "left")
        .withColumn("num_entities", F.coalesce("num_entities", F.lit(0)).cast("bigint"))
        .withColumn(
            "ends_on_negative_sentiment",
            F.when(F.col("num_customer_turns") > 0, (F.col("_last") == "negative").cast("double")).otherwise(0.0),
        )
        .select("call_id", *C.CONVERSATION_FEATURES)
    )


def business_features(scored: DataFrame, size: int = blocks.TURN_BLOCK) -> DataFrame:
    """The seventeen business features, one row per call.

    The texts are read once. What a turn contributes is reduced to numbers, flags
    and short text ends where it is scanned; those are placed by (call, block) for
    the phrases that cross turns and then aggregated by call.
    """
    turns = tx.keyword_flags(
        scored,
        size,
        keep={
            "_cust": F.coalesce(_is(C.CUSTOMER), F.lit(False)),
            "_agent": F.coalesce(_is(C.AGENT), F.lit(False)),
            "start_ms": F.col("start_ms"),
            "end_ms": F.col("end_ms"),
            "_words": F.when(_is(C.CUSTOMER), tx.word_count(F.col("text"))),
            "_score": F.when(_is(C.CUSTOMER), sentiment_score(F.col("sentiment"))),
            "_bad": _is(C.CUSTOMER) & F.col("emotion").isin(C.NEGATIVE_EMOTIONS),
            "_angry": _is(C.CUSTOMER) & (F.col("emotion") == "anger"),
        },
    )
    turn_if_cust = F.when(F.col("_cust"), F.col("turn_idx"))
    base = turns.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("num_turns"),
        F.count_if("_cust").alias("num_customer_turns"),
        F.count_if("_agent").alias("num_agent_turns"),
        ((F.max("end_ms") - F.min("start_ms")) / 1000.0).alias("conversation_duration_seconds"),
        F.coalesce(F.avg("_words"), F.lit(0.0)).alias("avg_customer_utterance_length"),
        F.coalesce(F.min_by("_score", turn_if_cust), F.lit(0)).alias("first_customer_sentiment_score"),
        F.coalesce(F.max_by("_score", turn_if_cust), F.lit(0)).alias("last_customer_sentiment_score"),
        F.coalesce(F.avg("_score"), F.lit(0.0)).alias("mean_customer_sentiment_score"),
        F.count_if(F.col("_score") < 0).alias("negative_sentiment_turn_count"),
        F.count_if("_bad").alias("negative_emotion_count"),
        F.coalesce(F.bool_or("_angry"), F.lit(False)).cast("int").alias("anger_or_frustration_present"),
        F.bool_or("supervisor_phrase").cast("int").alias("supervisor_request_mentioned"),
        F.bool_or("transfer_phrase").cast("int").alias("transfer_mentioned"),
    )
    negatives, customers = F.col("negative_sentiment_turn_count"), F.col("num_customer_turns")
    first, last = F.col("first_customer_sentiment_score"), F.col("last_customer_sentiment_score")
    return (
        base.withColumns(
            {
                "sentiment_trend": F.when(customers >= 2, last - first).otherwise(0),
                "negative_sentiment_fraction": F.when(customers > 0, negatives / customers).otherwise(0.0),
                "repeated_complaint_signal": (negatives >= 2).cast("int"),
                "ends_on_negative_sentiment": ((customers > 0) & (last < 0)).cast("int"),
            }
        )
        .select("call_id", *C.BUSINESS_FEATURES)
    )


def first_customer_text(turns: DataFrame) -> DataFrame:
    """Text of the first customer turn per call, UNKNOWN without one."""
    return turns.groupBy("call_id").agg(
        F.coalesce(
            F.min_by("text", F.when(_is(C.CUSTOMER), F.col("turn_idx"))), F.lit(C.UNKNOWN)
        ).alias("intent_text")
    )


def first_customer_intent(scored: DataFrame) -> DataFrame:
    """Intent label of the first customer turn per call, UNKNOWN without one."""
    return scored.groupBy("call_id").agg(
        F.coalesce(F.min_by("intent", F.when(_is(C.CUSTOMER), F.col("turn_idx"))), F.lit(C.UNKNOWN)).alias("intent")
    )


def talk_listen(turns: DataFrame) -> DataFrame:
    """Agent talk time over customer talk time, NULL without customer time."""
    span = F.col("end_ms") - F.col("start_ms")
    return turns.groupBy("call_id").agg(
        F.coalesce(F.sum(F.when(_is(C.AGENT), span)), F.lit(0)).alias("_agent"),
        F.coalesce(F.sum(F.when(_is(C.CUSTOMER), span)), F.lit(0)).alias("_cust"),
    ).select(
        "call_id", F.when(F.col("_cust") > 0, F.col("_agent") / F.col("_cust")).alias("talk_listen_ratio")
    )


# --- explanation ------------------------------------------------------------


def importance_map(importances: DataFrame) -> Column:
    """A (feature, importance) table as one map value; as long as the feature list."""
    return importances.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("feature"), F.col("importance").cast("double"))))
    ).scalar()


def literal_importances(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def active_factors(importances: Column) -> Column:
    """Active features with their importance, most important first.

    Works on the feature columns of one row: seventeen values need no unpivot
    and no shuffle. Ties keep the feature order.
    """
    candidates = F.array_compact(
        F.array(
            *[
                F.when(
                    rules.is_active(name, F.col(name)),
                    F.struct(
                        (-F.element_at(importances, name)).alias("rank"),
                        F.lit(i).alias("idx"),
                        F.lit(name).alias("feature"),
                    ),
                )
                for i, name in enumerate(C.BUSINESS_FEATURES)
                if name in C.ACTIVE_RULES
            ]
        )
    )
    return F.transform(
        F.array_sort(candidates),
        lambda x: F.struct(x["feature"].alias("feature"), (-x["rank"]).alias("importance")),
    )


def top_factors(factors: Column, n: int = C.TOP_FACTORS) -> Column:
    return F.transform(F.slice(factors, 1, n), lambda x: x["feature"])


def explanation(tier: Column, factors: Column) -> Column:
    """The sentence built from tier and factor names."""
    display = F.create_map(*[F.lit(x) for kv in C.FEATURE_DISPLAY.items() for x in kv])
    named = F.array_join(F.transform(factors, lambda f: F.coalesce(F.element_at(display, f), f)), "; ")
    return F.when(
        F.size(factors) == 0,
        F.concat(F.lit("Escalation risk: "), tier, F.lit(". No strong contributing factors identified.")),
    ).otherwise(
        F.concat(F.lit("Escalation risk: "), tier, F.lit(". Contributing factors: "), named, F.lit("."))
    )


def explain_escalation(
    scored: DataFrame,
    importances: Column,
    low_max: float = C.RISK_LOW_MAX,
    medium_max: float = C.RISK_MEDIUM_MAX,
) -> DataFrame:
    """Tier, factors and sentence for rows of features plus `probability`."""
    return (
        scored.withColumn("_imp", importances)
        .withColumn("_active", active_factors(F.col("_imp")))
        .withColumn("risk_tier", rules.risk_tier(F.col("probability"), low_max, medium_max))
        .withColumn("top_factors", top_factors(F.col("_active")))
        .withColumn("factor_importances", F.map_from_entries("_active"))
        .withColumn("explanation", explanation(F.col("risk_tier"), F.col("top_factors")))
        .drop("_imp", "_active")
    )
