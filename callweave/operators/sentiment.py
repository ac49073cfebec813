"""Sentiment roll-ups, emotion timelines and the text an intent is read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import config as C
from callweave.functions import blocks
from callweave.functions import text as tx
from callweave.operators.features import sentiment_score

MEAN_DIGITS = 12


def _mean(confidence: Column) -> Column:
    """Mean without the bits that depend on the order of the rows, so that a half is one when it is rounded again."""
    return F.round(F.avg(confidence), MEAN_DIGITS)


def attach_predictions(turns: DataFrame, predictions: DataFrame) -> DataFrame:
    """Turns with their predictions, matched by call and position."""
    return turns.join(predictions, ["call_id", "turn_idx"])


def aggregate_sentiment(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Majority label per key: most votes, then mean confidence, then first seen.

    Votes are counted per (key, label) first, so a large key is already reduced
    to one row per label when the second aggregation sees it. Means are compared
    with nine decimals: the last bits of a sum depend on the order of its rows.
    For the same reason they are returned with `MEAN_DIGITS` decimals.
    """
    votes = scored.groupBy(*keys, F.col("sentiment").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        _mean(F.col("sentiment_confidence")).alias("conf"),
        F.min("turn_idx").alias("first"),
        F.sum(sentiment_score(F.col("sentiment"))).alias("points"),
    )
    best = F.struct("n", F.round("conf", 9), -F.col("first"))
    return votes.groupBy(*keys).agg(
        F.max_by("label", best).alias("label"),
        F.max_by("conf", best).alias("confidence"),
        (F.sum("points") / F.sum("n")).alias("score"),
    )


def conversation_sentiment(scored: DataFrame) -> DataFrame:
    """Customer-level and conversation-level sentiment in one pass over the votes.

    The customer columns are NULL for calls without a CUSTOMER turn. Means are
    compared as in `aggregate_sentiment`.
    """
    cust = F.col("speaker") == C.CUSTOMER
    conf, turn = F.col("sentiment_confidence"), F.col("turn_idx")
    points = sentiment_score(F.col("sentiment"))
    votes = scored.groupBy("call_id", F.col("sentiment").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        _mean(conf).alias("conf"),
        F.min(turn).alias("first"),
        F.sum(points).alias("points"),
        F.count_if(cust).alias("cn"),
        _mean(F.when(cust, conf)).alias("cconf"),
        F.min(F.when(cust, turn)).alias("cfirst"),
        F.sum(F.when(cust, points)).alias("cpoints"),
    )
    best = F.struct("n", F.round("conf", 9), -F.col("first"))
    cbest = F.when(F.col("cn") > 0, F.struct("cn", F.round("cconf", 9), -F.col("cfirst")))
    return votes.groupBy("call_id").agg(
        F.max_by(F.col("label"), cbest).alias("customer_label"),
        F.max_by(F.col("cconf"), cbest).alias("customer_confidence"),
        F.when(F.sum("cn") > 0, F.sum("cpoints") / F.sum("cn")).alias("customer_score"),
        F.max_by("label", best).alias("conversation_label"),
        F.max_by("conf", best).alias("conversation_confidence"),
        (F.sum("points") / F.sum("n")).alias("conversation_score"),
    )


def emotion_timeline(scored: DataFrame) -> DataFrame:
    """One emotion per turn with its place in time order (stable by turn)."""
    rows = scored.select(
        "call_id",
        "turn_idx",
        F.col("start_ms").alias("time_ms"),
        "speaker",
        F.col("emotion").alias("label"),
        F.col("emotion_confidence").alias("confidence"),
    )
    return blocks.dense_index(rows, ["call_id"], ["time_ms", "turn_idx"], blocks.TIME_BLOCK_MS, "entry_idx")


def timeline_lines(timeline: DataFrame) -> DataFrame:
    """Each entry as `mm:ss Label`; minutes may have more than two digits."""
    seconds = F.floor(F.col("time_ms") / 1000)
    line = F.format_string(
        "%02d:%02d %s", F.floor(seconds / 60), seconds % 60, tx.capitalized(F.col("label"))
    )
    return timeline.select("call_id", "entry_idx", line.alias("line"))


def timeline_text(timeline: DataFrame) -> DataFrame:
    """The lines of a call joined by newlines, one row per call; `timeline_lines` keeps them apart."""
    return blocks.joined_texts(timeline_lines(timeline), ["call_id"], "entry_idx", "line", "timeline", "\n")


def intent_text(turns: DataFrame) -> DataFrame:
    """Customer turns joined by a space, or all turns of calls without a customer, one row per call.

    Both texts are gathered in one aggregation per block of turns, so a text is
    shuffled once.
    """
    is_customer = F.coalesce(F.col("speaker") == C.CUSTOMER, F.lit(False))

    def texts(place: str, value: str, keep: Column) -> Column:
        entry = F.struct(F.col(place).alias("i"), F.col(value).alias("t"))
        gathered = F.array_sort(F.collect_list(F.when(keep & F.col(value).isNotNull(), entry)))
        return F.when(F.size(gathered) > 0, F.array_join(F.transform(gathered, lambda x: x["t"]), " "))

    per_block = blocks.with_block(turns, "turn_idx", blocks.TEXT_BLOCK).groupBy("call_id", blocks.BLOCK).agg(
        F.bool_or(is_customer).alias("_has"),
        texts("turn_idx", "text", is_customer).alias("_customer"),
        texts("turn_idx", "text", ~is_customer).alias("_others"),
    )
    # the turns of others matter only where no customer speaks, so they are all turns there
    chosen = F.when(F.bool_or("_has"), texts(blocks.BLOCK, "_customer", F.lit(True))).otherwise(texts(blocks.BLOCK, "_others", F.lit(True)))
    return per_block.groupBy("call_id").agg(F.coalesce(chosen, F.lit("")).alias("intent_text"))
