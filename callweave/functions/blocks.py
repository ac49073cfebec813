"""Ordered computations per key that never gather a whole key in one task.

A window partitioned by `call_id` puts every row of a call in one task, which
fails when one call holds a large share of the table. The helpers here cut each
key into blocks of the ordering column, work inside `(key, block)`, and carry
one small row per block across the blocks. Only that block table (rows / block
size) is ever windowed per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_blk"
TURN_BLOCK = 4096
TEXT_BLOCK = 1024  # texts that the first of two steps joins
FRAME_BLOCK = 1 << 16
TIME_BLOCK_MS = 1 << 22  # a little over an hour


def with_block(df: DataFrame, order: str, size: float) -> DataFrame:
    """Adds the block number of the ordering column."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(size)).cast("bigint"))


def ordered_pass(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    size: float,
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Prefix sums and values of the row before, per key in the order of `order`.

    Each entry of `sums` adds a prefix sum (exclusive unless asked), each entry of
    `previous` the value the expression has in the row before (NULL for the first).
    """
    sums, previous = sums or {}, previous or {}
    inputs = {f"_v_{n}": v for n, v in sums.items()} | {f"_s_{n}": v for n, v in previous.items()}
    blocked = with_block(df, order[0], size).withColumns(inputs)
    ordered = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = blocked.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0)) for n in sums}
        | {f"_p_{n}": F.lag(f"_s_{n}").over(ordered) for n in previous}
        | ({"_first": F.row_number().over(ordered) == 1} if previous else {})
    )

    position = F.struct(*order)
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocked.groupBy(*keys, BLOCK)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
            *[F.max_by(f"_s_{n}", position).alias(f"_t_{n}") for n in previous],
        )
        .withColumns(
            {"_rows_before": F.sum("_rows").over(before)}
            | {f"_c_{n}": F.sum(f"_t_{n}").over(before) for n in sums}
            | {f"_c_{n}": F.lag(f"_t_{n}").over(by_block) for n in previous}
        )
        .filter(F.col("_rows_before") > 0)
        .select(*keys, BLOCK, *[f"_c_{n}" for n in [*sums, *previous]])
    )
    added = {n: F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums} | {
        n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(f"_p_{n}")) for n in previous
    }
    return local.join(carry, [*keys, BLOCK], "left").select(*df.columns, *[v.alias(n) for n, v in added.items()])


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], size: float, value: Column, out: str, inclusive: bool = False
) -> DataFrame:
    return ordered_pass(df, keys, order, size, sums={out: value}, inclusive=inclusive)


def dense_index(df: DataFrame, keys: list[str], order: list[str], size: float, out: str) -> DataFrame:
    """0-based position per key in the order of `order`."""
    return running_sum(df, keys, order, size, F.lit(1).cast("bigint"), out)


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], size: float, state: Column, out: str
) -> DataFrame:
    """`lag(state)` per key: the state of the row before this one, NULL for the first."""
    return ordered_pass(df, keys, order, size, previous={out: state})


def island_ids(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    size: float,
    state: Column,
    breaks: Callable[[Column, Column], Column],
    out: str,
) -> DataFrame:
    """Labels runs of rows per key; `breaks(prev_state, state)` starts a new run.

    The label is a struct (block of origin, number inside it), unique per key
    and increasing along the order. Inside a block the runs are numbered by a
    window; a run that continues from the block before takes its label from the
    block table.
    """
    blocked = with_block(df, order[0], size).withColumn("_s", state)
    ordered = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = blocked.withColumn("_p", F.lag("_s").over(ordered)).withColumn(
        "_run_no",
        F.sum(F.when(F.col("_p").isNotNull() & breaks(F.col("_p"), F.col("_s")), 1).otherwise(0)).over(
            ordered.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )

    position = F.struct(*order)
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    label = F.struct(F.col(BLOCK).alias("blk"), F.col("_n").alias("run"))
    carry = (
        local.groupBy(*keys, BLOCK)
        .agg(
            F.min_by("_s", position).alias("_head"),
            F.max_by("_s", position).alias("_tail"),
            F.max("_run_no").alias("_n"),
        )
        .withColumn("_before", F.lag("_tail").over(by_block))
        .withColumn(
            "_joins",
            F.col("_before").isNotNull() & ~F.coalesce(breaks(F.col("_before"), F.col("_head")), F.lit(False)),
        )
        .withColumn(
            "_from",
            F.last(F.when((F.col("_n") > 0) | ~F.col("_joins"), label), ignorenulls=True).over(
                by_block.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .filter("_joins")
        .select(*keys, BLOCK, "_from")
    )
    own = F.struct(F.col(BLOCK).alias("blk"), F.col("_run_no").alias("run"))
    return (
        local.join(carry, [*keys, BLOCK], "left")
        .withColumn(out, F.when((F.col("_run_no") == 0) & F.col("_from").isNotNull(), F.col("_from")).otherwise(own))
        .drop(BLOCK, "_s", "_p", "_run_no", "_from")
    )


def with_halo(df: DataFrame, index: str, size: int, before: int) -> DataFrame:
    """Copies the last `before` rows of each block into the next block as well.

    `index` must be dense. A window over `(key, block)` then sees every row it
    needs behind it; rows marked `_halo` are context only and are dropped by the
    caller.
    """
    blk = F.floor(F.col(index) / F.lit(size)).cast("bigint")
    near_end = (F.col(index) % size) >= size - before
    targets = F.when(near_end, F.array(blk, blk + 1)).otherwise(F.array(blk))
    return df.withColumn(BLOCK, F.explode(targets)).withColumn("_halo", F.col(BLOCK) != blk)


def join_key_stats(df: DataFrame, stats: DataFrame, key: str, index: str, size: int) -> DataFrame:
    """Attaches one row of per-key numbers to every row of the key.

    `stats` holds `key` and `_max_index`. Its rows are repeated per block, so the
    big side is partitioned on `(key, block)` and a hot key spreads over tasks.
    """
    repeated = stats.withColumn(
        BLOCK, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_max_index") / size).cast("bigint")))
    ).drop("_max_index")
    return with_block(df, index, size).join(repeated, [key, BLOCK]).drop(BLOCK)


def joined_texts(
    df: DataFrame, keys: list[str], index: str, text: str, out: str, sep: str = " ", size: int = TEXT_BLOCK
) -> DataFrame:
    """The texts of a key joined in order, one row per key.

    Texts are joined per block of `size` positions first, so the second step
    gathers one cell per block; the result does not depend on `size`. NULL texts are left out.
    """

    def texts(place: str, value: str) -> Column:
        return F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(place).alias("i"), F.col(value).alias("t"))))

    def ordered(place: str, value: str) -> Column:
        return F.array_join(F.transform(F.array_sort(texts(place, value)), lambda x: x["t"]), sep)

    # a block without any text is NULL and adds no separator
    block = F.when(F.count(text) > 0, ordered(index, text)).alias("_t")
    return with_block(df, index, size).groupBy(*keys, BLOCK).agg(block).groupBy(*keys).agg(ordered(BLOCK, "_t").alias(out))
