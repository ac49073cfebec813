"""Transcripts and speakers: interval alignment, roles, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import config as C

ALIGN_BIN_MS = 60_000


def _bins(start: Column, end: Column, width: int) -> Column:
    """Numbers of the time bins an interval touches (none for an empty interval)."""
    first = F.floor(start / width).cast("bigint")
    last = F.floor((end - 1e-9) / width).cast("bigint")
    return F.when(end > start, F.sequence(first, F.greatest(first, last)))


def binned(df: DataFrame, width: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Cuts intervals at bin borders: one row per touched bin, clipped to it."""
    return (
        df.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), width)))
        .withColumn("_s", F.greatest(F.col(start), F.col("_bin") * width))
        .withColumn("_e", F.least(F.col(end), (F.col("_bin") + 1) * width))
    )


def overlap_times(left: DataFrame, right: DataFrame, width: int = ALIGN_BIN_MS) -> DataFrame:
    """Overlapping pieces of two interval tables of the same call.

    Both sides carry `_bin`, `_s`, `_e`; joining on (call, bin) keeps a very long
    call in many tasks, and because the pieces are clipped to their bin the
    overlaps of the bins add up to the whole overlap.
    """
    a = left.select("call_id", "_bin", F.col("_s").alias("_as"), F.col("_e").alias("_ae"),
                    *[c for c in left.columns if c not in ("call_id", "_bin", "_s", "_e")])
    b = right.select("call_id", "_bin", F.col("_s").alias("_bs"), F.col("_e").alias("_be"),
                     *[c for c in right.columns if c not in ("call_id", "_bin", "_s", "_e")])
    return (
        a.join(b, ["call_id", "_bin"])
        .filter((F.col("_as") < F.col("_be")) & (F.col("_bs") < F.col("_ae")))
        .withColumn("overlap_ms", F.least("_ae", "_be") - F.greatest("_as", "_bs"))
        .drop("_as", "_ae", "_bs", "_be", "_bin")
    )


def align(asr: DataFrame, speakers: DataFrame, width: int = ALIGN_BIN_MS) -> DataFrame:
    """The speaker with the most overlap per transcript segment, UNKNOWN without any.

    On a tie the speaker whose overlapping segment comes first wins.
    `asr`: call_id, seg_idx, start_ms, end_ms, text; `speakers`: call_id, spk_idx,
    speaker, start_ms, end_ms.
    """
    left = binned(asr.select("call_id", "seg_idx", "start_ms", "end_ms"), width).select(
        "call_id", "seg_idx", "_bin", "_s", "_e"
    )
    right = binned(speakers, width).select("call_id", "spk_idx", "speaker", "_bin", "_s", "_e")
    per_speaker = (
        overlap_times(left, right)
        .groupBy("call_id", "seg_idx", "speaker")
        .agg(F.sum("overlap_ms").alias("ov"), F.min("spk_idx").alias("first"))
    )
    best = per_speaker.groupBy("call_id", "seg_idx").agg(
        F.max_by("speaker", F.struct("ov", -F.col("first"))).alias("speaker")
    )
    return asr.join(best, ["call_id", "seg_idx"], "left").withColumn(
        "speaker", F.coalesce("speaker", F.lit(C.UNKNOWN))
    )


def infer_roles(speakers: DataFrame) -> DataFrame:
    """Earliest speaker AGENT, others CUSTOMER; no rows for calls with one speaker.

    Two aggregations: first appearance per (call, speaker), then the earliest and
    the number of speakers per call.
    """
    first = speakers.groupBy("call_id", "speaker").agg(
        F.min(F.struct("start_ms", "spk_idx")).alias("at")
    )
    per_call = first.groupBy("call_id").agg(
        F.min_by("speaker", "at").alias("_opener"), F.count(F.lit(1)).alias("_n")
    )
    return (
        first.join(per_call.filter(F.col("_n") >= 2), "call_id")
        .select(
            "call_id",
            "speaker",
            F.when(F.col("speaker") == F.col("_opener"), C.AGENT).otherwise(C.CUSTOMER).alias("role"),
        )
    )


def ordered_speakers(speakers: DataFrame) -> DataFrame:
    """Distinct speakers per call with their order of first appearance."""
    from callweave.functions import blocks

    first = (
        speakers.groupBy("call_id", "speaker")
        .agg(F.min(F.struct("start_ms", "spk_idx")).alias("at"))
        .select("call_id", "speaker", F.col("at.start_ms").alias("first_ms"), F.col("at.spk_idx").alias("first_idx"))
    )
    return blocks.dense_index(
        first, ["call_id"], ["first_ms", "first_idx"], blocks.TIME_BLOCK_MS, "speaker_order"
    ).drop("first_idx")


def apply_roles(segments: DataFrame, roles: DataFrame) -> DataFrame:
    """Replaces speakers by their role; unmapped ones keep their label."""
    return (
        segments.join(roles.select("call_id", "speaker", "role"), ["call_id", "speaker"], "left")
        .withColumn("speaker", F.coalesce("role", "speaker"))
        .drop("role")
    )


def pair_for_eval(manifest: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of reference and hypothesis, and the manifest rows without a transcript."""
    pairs = manifest.join(transcripts, "call_id")
    missing = manifest.join(transcripts.select("call_id"), "call_id", "left_anti")
    return pairs, missing
