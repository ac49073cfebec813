"""Per-call metrics, agent roll-ups and the agent score.

No interruption metric exists: overlapping speech is not observed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave import config as C
from callweave.operators import rules


def call_metrics(
    features: DataFrame,
    talk_listen: DataFrame,
    resolution: DataFrame,
    escalation: DataFrame,
    satisfaction: DataFrame,
    agents_of_calls: DataFrame,
) -> DataFrame:
    """One row per call. All inputs are keyed by call_id, one row each.

    resolution: resolution; escalation: risk_tier; satisfaction: satisfaction;
    agents_of_calls: agent_id.
    """
    return (
        features.select(
            "call_id",
            F.col("conversation_duration_seconds").alias("handling_time_seconds"),
            (F.col("last_customer_sentiment_score") - F.col("first_customer_sentiment_score")).alias(
                "sentiment_improvement"
            ),
        )
        .join(talk_listen, "call_id", "left")
        .join(resolution.select("call_id", (F.col("resolution") == "Resolved").alias("resolved")), "call_id", "left")
        .join(escalation.select("call_id", (F.col("risk_tier") == "High").alias("escalated")), "call_id", "left")
        .join(satisfaction.select("call_id", F.col("satisfaction").alias("customer_satisfaction")), "call_id", "left")
        .join(agents_of_calls.select("call_id", "agent_id"), "call_id", "left")
    )


def agent_metrics(metrics: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Counts, rates and averages per agent, with the satisfaction distribution.

    The first aggregation is by (agent, satisfaction), the second by agent over
    those few rows, so one scan gives both. Agents of the dimension without a
    call get 0 calls, NULL metrics and an empty distribution.
    """
    per_label = metrics.groupBy("agent_id", "customer_satisfaction").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("resolved").cast("int")).alias("resolved"),
        F.sum(F.col("escalated").cast("int")).alias("escalated"),
        F.count("resolved").alias("resolved_n"),
        F.count("escalated").alias("escalated_n"),
        F.sum("handling_time_seconds").alias("handling"),
        F.sum("sentiment_improvement").alias("improvement"),
        F.sum("talk_listen_ratio").alias("ratio"),
        F.count("talk_listen_ratio").alias("ratio_n"),
    )
    return _with_dimension(_rolled(per_label), agents)


def _rolled(per_label: DataFrame) -> DataFrame:
    n = F.sum("n")
    return per_label.groupBy("agent_id").agg(
        n.alias("num_calls"),
        F.try_divide(F.sum("resolved"), F.sum("resolved_n")).alias("resolution_rate"),
        (F.sum("handling") / n).alias("avg_handling_time_seconds"),
        F.try_divide(F.sum("escalated"), F.sum("escalated_n")).alias("escalation_rate"),
        (F.sum("improvement") / n).alias("avg_sentiment_improvement"),
        F.when(F.sum("ratio_n") > 0, F.sum("ratio") / F.sum("ratio_n")).alias("avg_talk_listen_ratio"),
        F.map_from_entries(
            F.collect_list(
                F.when(F.col("customer_satisfaction").isNotNull(), F.struct("customer_satisfaction", "n"))
            )
        ).alias("satisfaction_distribution"),
    )


def _with_dimension(rolled: DataFrame, agents: DataFrame | None) -> DataFrame:
    if agents is None:
        return rolled
    empty = F.create_map().cast("map<string,bigint>")
    return (
        agents.select("agent_id")
        .join(rolled, "agent_id", "left")
        .withColumn("num_calls", F.coalesce("num_calls", F.lit(0)))
        .withColumn("satisfaction_distribution", F.coalesce("satisfaction_distribution", empty))
    )


# Sums are kept as decimals: they come out the same in any order, and what is taken back leaves nothing behind.
_EXACT = "decimal(38, 12)"
_STATE_COUNTS = ["n", "resolved", "escalated", "resolved_n", "escalated_n", "handling_n", "improvement_n", "ratio_n"]
_STATE_SUMS = ["handling", "improvement", "ratio"]


def metric_states(metrics: DataFrame, day: str = "day", sign: int = 1) -> DataFrame:
    """Partial states of agent metrics, one row per agent, day and satisfaction label.

    States add up: those of disjoint sets of calls give the states of all of them, and `sign` -1 takes calls
    back, as when a call is corrected. A null agent, day or label is a group of its own.
    """
    counts = {
        "n": F.count(F.lit(1)), "resolved": F.coalesce(F.sum(F.col("resolved").cast("int")), F.lit(0)),
        "escalated": F.coalesce(F.sum(F.col("escalated").cast("int")), F.lit(0)), "resolved_n": F.count("resolved"),
        "escalated_n": F.count("escalated"),
    }
    values = {"handling": "handling_time_seconds", "improvement": "sentiment_improvement", "ratio": "talk_listen_ratio"}
    counts |= {f"{n}_n": F.count(v) for n, v in values.items()}
    sums = {n: F.coalesce(F.sum(F.col(v).cast(_EXACT)), F.lit(0)).cast(_EXACT) for n, v in values.items()}
    states = metrics.groupBy("agent_id", F.col(day).alias("day"), "customer_satisfaction").agg(*[c.alias(n) for n, c in (counts | sums).items()])
    return states.withColumns(
        {n: (F.col(n) * sign).cast("bigint") for n in _STATE_COUNTS} | {n: (F.col(n) * sign).cast(_EXACT) for n in _STATE_SUMS}
    )


def correction_states(before: DataFrame, after: DataFrame, day: str = "day") -> DataFrame:
    """States that replace calls as they were counted by the same calls as they are now."""
    return merge_states(metric_states(before, day, -1).unionByName(metric_states(after, day)))


def merge_states(states: DataFrame) -> DataFrame:
    """Adds states up; groups that were taken back whole disappear."""
    keys = ["agent_id", "day", "customer_satisfaction"]
    merged = states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _STATE_COUNTS], *[F.sum(c).cast(_EXACT).alias(c) for c in _STATE_SUMS]
    )
    return merged.where(F.greatest(*[F.abs(c) for c in _STATE_COUNTS], *[F.abs(c).cast("double") for c in _STATE_SUMS]) > 0)


def write_states(states: DataFrame, path: str, batch: str) -> None:
    """Stores the states of one batch of calls; a batch that is written again replaces itself.

    The table is partitioned by batch and day, so a late batch touches no other file.
    """
    (
        states.withColumn("batch", F.lit(batch)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path)
    )


def read_states(like: DataFrame, path: str) -> DataFrame:
    """The merged states of all batches; `like` is any table of states, for the types."""
    schema = like.schema.add("batch", "string")
    return merge_states(like.sparkSession.read.schema(schema).parquet(path).drop("batch"))


def metrics_of_states(states: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """The agent metrics of all days in `states`, as `agent_metrics` gives them for the calls behind."""
    per_label = states.groupBy("agent_id", "customer_satisfaction").agg(
        *[F.sum(c).alias(c) for c in _STATE_COUNTS],
        *[F.when(F.sum(f"{c}_n") > 0, F.sum(c).cast("double")).alias(c) for c in _STATE_SUMS],
    )
    return _with_dimension(_rolled(per_label.where("n <> 0")), agents)


def satisfaction_distribution(metrics: DataFrame) -> DataFrame:
    """Calls per agent and satisfaction label, one row each."""
    return metrics.groupBy("agent_id", "customer_satisfaction").agg(F.count(F.lit(1)).alias("n_calls"))


def agent_score(metrics: DataFrame, weights: Mapping[str, float] = C.SCORE_WEIGHTS) -> DataFrame:
    """The weighted score with its components and weights; missing data counts 0.5."""
    dist = F.col("satisfaction_distribution")
    total = F.aggregate(F.map_values(dist), F.lit(0).cast("bigint"), lambda a, x: a + x)
    satisfied = F.coalesce(F.element_at(dist, F.lit("Satisfied")), F.lit(0))
    parts = {
        "resolution_rate": F.coalesce("resolution_rate", F.lit(0.5)),
        "non_escalation_rate": F.coalesce(1 - F.col("escalation_rate"), F.lit(0.5)),
        "sentiment_improvement": rules.normalize_delta(F.col("avg_sentiment_improvement")),
        "satisfaction": F.when(total > 0, satisfied / total).otherwise(F.lit(0.5)),
    }
    score = sum((F.lit(float(weights[name])) * value for name, value in parts.items()), F.lit(0.0))
    return metrics.select(
        "agent_id",
        score.alias("score"),
        F.struct(*[value.alias(name) for name, value in parts.items()]).alias("components"),
        rules.config_struct({name: weights[name] for name in parts}).alias("weights"),
    )
