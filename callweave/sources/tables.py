"""Views of the shared test tables as calls, turns, frames, segments and predictions.

There is no classifier for invented prose, so predictions are functions of text
length and position; they exercise the roll-ups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import config as C
from callweave.functions import blocks
from callweave.operators import features


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def bare_turns(spark: SparkSession, sf: str) -> DataFrame:
    role = F.col("role")
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("turn_idx"),
        F.when(role == "user", C.CUSTOMER).when(role == "assistant", C.AGENT).otherwise(F.upper(role)).alias("speaker"),
        "text",
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with a running clock."""
    return features.add_clock(bare_turns(spark, sf))


def agents_of_calls(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("call_id"), (F.col("conv_id") % 7).alias("agent_id")
    ).distinct()


def with_predictions(turns: DataFrame) -> DataFrame:
    size = F.length("text")
    confidence = (50 + size % 50) / F.lit(100.0)
    return turns.withColumns(
        {
            "sentiment": pick(["negative", "neutral", "positive"], size % 3),
            "sentiment_confidence": confidence,
            "emotion": pick(sorted(C.EMOTIONS), (size + F.col("turn_idx")) % 6),
            "emotion_confidence": confidence,
            "intent": pick(C.INTENTS, size % 11),
        }
    )


def scored_turns(spark: SparkSession, sf: str) -> DataFrame:
    return with_predictions(turns(spark, sf))


def support_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Support sentences composed from orders; a call is a customer."""
    k = F.col("o_orderkey")

    def pad(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    sentence = (
        F.when(k % 8 == 0, F.concat(F.lit("my order number is uh "), pad(k, 6)))
        .when(k % 8 == 1, F.concat(F.lit("it is ORD-"), pad(k, 6), F.lit(" on INV-2024-"), pad(k % 1000, 4)))
        .when(
            k % 8 == 2,
            F.concat(
                F.lit("account ACC"), pad(k, 6), F.lit(" was charged $"), (1 + k % 9).cast("string"), F.lit(","),
                pad(k * 7 % 1000, 3), F.lit("."), pad(k % 100, 2),
            ),
        )
        .when(
            k % 8 == 3,
            F.concat(
                F.lit("write to user"), k.cast("string"), F.lit("@example.com or call (415) 555-"), pad(k % 10000, 4)
            ),
        )
        .when(k % 8 == 4, F.lit("please let me speak to someone"))
        .when(k % 8 == 5, F.lit("else about order"))
        .when(k % 8 == 6, F.concat(pad(k, 6), F.lit(" is the number, let me transfer you now")))
        .otherwise(F.concat(F.lit("thank you, A-"), pad(k, 6), F.lit(" is closed")))
    )
    rows = (
        read(spark, sf, "orders")
        .join(read(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_custkey").alias("call_id"), F.col("o_orderkey").alias("order_key"), sentence.alias("text"))
    )
    numbered = blocks.dense_index(rows, ["call_id"], ["order_key"], 1 << 22, "turn_idx")
    return features.add_clock(
        numbered.withColumn("speaker", F.when(F.col("turn_idx") % 2 == 0, C.CUSTOMER).otherwise(C.AGENT))
    )


def support_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The same sentences keyed by order, for work that looks at one text at a time."""
    return support_turns(spark, sf).select(F.col("order_key").alias("doc_id"), "text")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly energy per user in cents; a call is a user, a frame an hour."""
    hour = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    return (
        read(spark, sf, "events")
        .select(
            F.col("user_id").alias("call_id"),
            hour.cast("bigint").alias("frame"),
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        )
        .groupBy("call_id", "frame")
        .agg(F.sum("cents").alias("cents"))
    )


SPEECH_CENTS = 300


def speech_frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).filter(F.col("cents") > SPEECH_CENTS)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as two-channel samples: a call is a user, order by event."""
    rows = read(spark, sf, "events").select(F.col("user_id").alias("call_id"), "event_id", F.col("value").alias("v"))
    return blocks.dense_index(rows, ["call_id"], ["event_id"], 1 << 22, "_n").select(
        "call_id", (F.col("_n") % 2).alias("channel"), F.floor(F.col("_n") / 2).alias("idx"), "v"
    )


def asr_segments(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("call_id", F.col("turn_idx").alias("seg_idx"), "start_ms", "end_ms", "text")


def call_durations(spark: SparkSession, sf: str, cut_ms: int = 0, timed: DataFrame | None = None) -> DataFrame:
    return (turns(spark, sf) if timed is None else timed).groupBy("call_id").agg((F.max("end_ms") - cut_ms).alias("duration_ms"))


def speaker_segments(spark: SparkSession, sf: str, timed: DataFrame | None = None) -> DataFrame:
    """Tiles of seven seconds with alternating speakers, every fifth one missing.

    Calls are few bytes beside their tiles and may all be in one task, so the tiles are dealt anew.
    `timed` has the turns with times where they are at hand.
    """
    tiles = call_durations(spark, sf, timed=timed).select(
        "call_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("duration_ms") / 7000) - 1)).alias("spk_idx")
    )
    dealt = tiles.filter(F.col("spk_idx") % 5 != 4).repartition("call_id", F.floor(F.col("spk_idx") / blocks.TURN_BLOCK))
    return dealt.select(
        "call_id",
        "spk_idx",
        F.when(F.col("spk_idx") % 2 == 0, "SPEAKER_00").otherwise("SPEAKER_01").alias("speaker"),
        (F.col("spk_idx") * 7000).alias("start_ms"),
        (F.col("spk_idx") * 7000 + 7000).alias("end_ms"),
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Space-separated tokens of the conversation turns; a sentence is a turn."""
    return (
        read(spark, sf, "conversations")
        .select(
            (F.col("conv_id") * 100000 + F.col("turn")).alias("sent_id"),
            F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("pos", "token"),
        )
        .select("sent_id", F.col("pos").cast("bigint").alias("pos"), "token")
    )


TAGS = ["O", "B-PERSON", "I-PERSON", "B-PRODUCT", "I-PRODUCT"]


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """True tags from token length; the source alternates by sentence."""
    return words(spark, sf).select(
        "sent_id",
        "pos",
        "token",
        pick(TAGS, F.length("token") % 5).alias("tag"),
        F.when(F.col("sent_id") % 2 == 0, "real").otherwise("synthetic").alias("source"),
    )


def predicted_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(spark, sf).withColumn("tag", F.when(F.col("pos") % 7 == 0, "O").otherwise(F.col("tag")))


def doc_labels(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Language as truth; the prediction swaps some of them."""
    lang = F.col("lang")
    return read(spark, sf, "documents").select(
        "doc_id",
        lang.alias("y_true"),
        F.when(F.col("n_chars") % 4 == 0, F.lit("en")).when(F.col("n_chars") % 7 == 0, F.lit("fr")).otherwise(lang).alias("y_pred"),
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as audio files: language gives type and rate, length the duration."""
    lang, n = F.col("lang"), F.col("n_chars")
    ext = F.when(lang == "en", "wav").when(lang == "fr", "flac").when(lang == "de", "mp3").otherwise("ogg")
    return read(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("audio/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        ext.alias("extension"),
        ext.alias("format"),
        (F.col("doc_id") % 97 != 0).alias("exists"),
        F.when(F.col("doc_id") % 89 == 0, 0).otherwise(n).alias("size_bytes"),
        (F.col("doc_id") % 83 != 0).alias("readable"),
        n.alias("frames"),
        (n / 10.0).alias("duration_seconds"),
        F.when(F.col("source") == "src1", 8000).otherwise(16000).alias("sample_rate"),
        F.when(F.col("source") == "src2", 2).otherwise(1).alias("channels"),
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A call outcome per conversation, and its labels' inputs."""
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("call_id")).distinct().withColumn(
        "outcome", pick(list(C.OUTCOMES), F.col("call_id") % 5)
    )
