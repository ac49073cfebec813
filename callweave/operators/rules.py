"""Row rules: validation, tiers, active factors, label mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import config as C
from callweave.config import AudioConfig


def lookup(mapping: Mapping[str, object], key: Column) -> Column:
    """Value of a short fixed mapping, NULL for other keys."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def config_df(spark, values: Mapping[str, float]) -> DataFrame:
    """A settings mapping as a one-row table."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def config_struct(values: Mapping[str, float]) -> Column:
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()])


def validate(manifest: DataFrame, cfg: AudioConfig = C.DEFAULTS.audio) -> DataFrame:
    """Adds errors, warnings, is_valid and has_info.

    Missing, empty, wrong type, unreadable and zero-frame files stop at that
    error; the two duration limits and the warnings are all checked.

    Columns read: exists, size_bytes, extension, readable, frames,
    duration_seconds, sample_rate, channels. A NULL flag counts as true.
    """
    duration = F.col("duration_seconds")
    stop = (
        F.when(~F.coalesce("exists", F.lit(True)), F.lit("File does not exist"))
        .when(F.col("size_bytes") == 0, F.lit("File is empty (0 bytes)"))
        .when(
            ~F.col("extension").isin(list(cfg.supported_formats)),
            F.concat(F.lit("Unsupported format '."), F.col("extension"), F.lit("'")),
        )
        .when(~F.coalesce("readable", F.lit(True)), F.lit("Corrupted or unreadable audio"))
        .when((F.col("frames") == 0) | (duration <= 0), F.lit("Audio contains zero frames"))
    )
    limits = F.array_compact(
        F.array(
            F.when(
                duration < cfg.min_duration_seconds,
                F.concat(
                    F.lit("Duration "),
                    F.format_string("%.3f", duration),
                    F.lit(f"s is below minimum {cfg.min_duration_seconds}s"),
                ),
            ),
            F.when(
                duration > cfg.max_duration_seconds,
                F.concat(
                    F.lit("Duration "),
                    F.format_string("%.1f", duration),
                    F.lit(f"s exceeds maximum {cfg.max_duration_seconds}s"),
                ),
            ),
        )
    )
    notes = F.array_compact(
        F.array(
            F.when(
                F.col("sample_rate") != cfg.target_sample_rate,
                F.concat(
                    F.lit("Sample rate "),
                    F.col("sample_rate").cast("string"),
                    F.lit(f"Hz differs from target {cfg.target_sample_rate}Hz"),
                ),
            ),
            F.when(
                F.col("channels") != cfg.target_channels,
                F.concat(
                    F.col("channels").cast("string"),
                    F.lit(f" channel(s) found, target is {cfg.target_channels}"),
                ),
            ),
        )
    )
    none = F.array().cast("array<string>")
    checked = manifest.withColumn("_stop", stop)
    return (
        checked.withColumn("errors", F.when(F.col("_stop").isNotNull(), F.array("_stop")).otherwise(limits))
        .withColumn("warnings", F.when(F.col("_stop").isNotNull(), none).otherwise(notes))
        .withColumn("is_valid", F.size("errors") == 0)
        # sample rate, channels and duration are known for files that could be opened
        .withColumn(
            "has_info",
            F.col("_stop").isNull() | (F.col("_stop") == "Audio contains zero frames"),
        )
        .drop("_stop")
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows; a bad row never affects another."""
    return validated.filter("is_valid"), validated.filter(~F.col("is_valid"))


def turns_of(turns: DataFrame, role: str) -> DataFrame:
    return turns.filter(F.col("speaker") == role)


def clip_to_duration(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """Turn times never pass the end of the call. `calls`: call_id, duration_ms."""
    return (
        turns.join(calls.select("call_id", "duration_ms"), "call_id", "left")
        .withColumn("start_ms", F.least("start_ms", "duration_ms"))
        .withColumn("end_ms", F.least("end_ms", "duration_ms"))
        .drop("duration_ms")
    )


def risk_tier(
    probability: Column, low_max: float = C.RISK_LOW_MAX, medium_max: float = C.RISK_MEDIUM_MAX
) -> Column:
    return (
        F.when(probability.isNull(), F.lit(None).cast("string"))
        .when(probability <= low_max, F.lit("Low"))
        .when(probability <= medium_max, F.lit("Medium"))
        .otherwise(F.lit("High"))
    )


def is_active(name: str, value: Column) -> Column:
    """Does a feature value count as a factor? Features without a rule never do."""
    if name not in C.ACTIVE_RULES:
        return F.lit(False)
    op, threshold = C.ACTIVE_RULES[name]
    return F.coalesce(value >= threshold if op == ">=" else value <= threshold, F.lit(False))


def map_labels(
    df: DataFrame, column: str, mapping: Mapping[str, str], default: str | None, out: str | None = None
) -> DataFrame:
    """Renames labels; others become `default`, or their rows go when it is None."""
    target = lookup(mapping, F.col(column))
    if default is not None:
        return df.withColumn(out or column, F.coalesce(target, F.lit(default)))
    return df.withColumn(out or column, target).filter(F.col(out or column).isNotNull())


def has_target(bio: DataFrame) -> DataFrame:
    """Rows of the sentences that have at least one tag other than O."""
    hits = bio.filter(F.col("tag") != "O").select("sent_id").distinct()
    return bio.join(hits, "sent_id", "left_semi")


def normalize_delta(delta: Column) -> Column:
    """[-2, 2] to [0, 1], clamped; 0.5 without data."""
    clamped = F.least(F.greatest(delta, F.lit(-2.0)), F.lit(2.0))
    return F.when(delta.isNull(), F.lit(0.5)).otherwise((clamped + 2.0) / 4.0)


def outcome_labels(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Resolution, satisfaction and escalation of a call outcome."""
    out = df
    for i, name in enumerate(("resolution", "satisfaction", "escalation")):
        out = out.withColumn(name, lookup({k: v[i] for k, v in C.OUTCOMES.items()}, F.col(outcome)))
    return out


def pii_entities(entities: DataFrame, types: Sequence[str] = tuple(C.PII_TYPES)) -> DataFrame:
    return entities.filter(F.col("label").isin(list(types)))
