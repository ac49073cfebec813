"""Proportional stratified interleaving of calls into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import DRAW_BITS, SOURCE_KEY, draw, source_key
from callweave.session import settle


def interleave_shards(
    calls: DataFrame,
    n_shards: int = 16,
    seed: int = 0,
    key: str = "call_id",
    text: str = "text",
    source: str = "source",
    rows_per_block: int = 5_000,
) -> DataFrame:
    """Deals transcripts into shards that all have the mixture of the whole.

    Rows are shuffled by a seeded draw inside their source; the k-th of n rows gets
    the fractional rank (k - 1/2) / n. All rows in the order of that rank, cut into
    `n_shards` equal runs, give shards whose row counts differ by one at most and
    that hold every source in proportion.

    Ranks need no global sort: rows fall into blocks of about `rows_per_block` by
    their draw (then by their fractional rank), a count per block gives the rank of
    its first row, and only the rows of one block are sorted together, so a source
    with a third of all rows is spread over many tasks.

    Returns `key`, `source`, size (UTF-8 bytes of the text plus 1), text_crc32,
    shard and slot (position in the shard, from 0). Other columns are not read.
    A null text counts as an empty one, null sources are one source, null keys
    draw alike. Rows equal in key, text and source are interchangeable. An empty
    table gives an empty result.
    """
    rows = settle(
        calls.select(
            F.col(key),
            F.col(source),
            *source_key(source),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            draw(key, seed).alias("_draw"),
        )
    )
    sources = settle(rows.groupBy(SOURCE_KEY).agg(F.count("*").alias("_n")).repartition(1))
    everything = Window.partitionBy(F.lit(0))
    sources = sources.withColumns(
        {"_total": F.sum("_n").over(everything), "_blocks": F.ceil(F.col("_n") / rows_per_block)}
    )
    drawn = F.col("_draw") / F.lit(float(2**DRAW_BITS))
    placed = rows.join(sources, SOURCE_KEY).withColumn("_block", F.floor(drawn * F.col("_blocks")))

    order = [F.col("_draw"), F.col(key), F.col("text_crc32"), F.col("size")]
    block = [*SOURCE_KEY, "_block"]
    starts = _starts(placed.groupBy(block).agg(F.count("*").alias("_rows")), SOURCE_KEY, "_block")
    rank = F.row_number().over(Window.partitionBy(block).orderBy(*order)) + F.col("_start") - F.lit(0.5)
    ranked = settle(
        placed.join(starts, block)
        .withColumn("_fraction", rank / F.col("_n"))
        .withColumn("_block", F.floor(F.col("_fraction") * F.ceil(F.col("_total") / rows_per_block)))
        .drop("_start", "_blocks", "_n")
    )

    starts = _starts(ranked.groupBy("_block").agg(F.count("*").alias("_rows")), [F.lit(0)], "_block")
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_fraction", *order)) + F.col("_start") - 1
    return (
        ranked.join(starts, "_block")
        .withColumn("_place", place)
        .withColumn("shard", F.expr(f"_place * {n_shards} div _total").cast("int"))
        .withColumn("slot", F.expr(f"_place - (shard * _total + {n_shards - 1}) div {n_shards}"))
        .select(key, source, "size", "text_crc32", "shard", "slot")
    )


def _starts(counts: DataFrame, group: list, block: str) -> DataFrame:
    """Rows of the group before each block."""
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
