"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import DRAW_BITS, SOURCE_KEY, WORD, draw, free_name, source_key
from callweave.session import settle

# Weights of the sources in their order, repeating.
WEIGHT_CYCLE = (1, 2, 3)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHT_CYCLE, max_copies: int = 3) -> DataFrame:
    """Shares the sum of all sizes among sources by weight, none above `max_copies` times its size.

    `sizes` has one row per source: the source key and source_size. In the order of
    size per weight the small sources fill up first; what they can't take goes to
    the others, so one level per weight holds for all that are not full. The sorts
    are over sources, not rows.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("_no_source", "_source")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    filled = sizes.withColumn("weight", weight.cast("double")).withColumn("_cap", max_copies * F.col("source_size"))
    by_fill = everything.orderBy(F.col("_cap") / F.col("weight"), "_no_source", "_source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    room = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = room / F.sum("weight").over(rest)
    filled = filled.withColumns({"_level": level, "_place": F.row_number().over(by_fill)})
    full = F.col("_cap") <= F.col("_level") * F.col("weight")
    first_open = F.min(F.when(~full, F.col("_place"))).over(everything)
    filled = filled.withColumns({"_full": full, "_first_open": first_open})
    shared = F.max(F.when(F.col("_place") == F.col("_first_open"), F.col("_level"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("weight") * shared)
    return filled.withColumn("target", target).select(*SOURCE_KEY, "source_size", "weight", "target")


def mixing_rules(
    calls: DataFrame,
    weights: tuple = WEIGHT_CYCLE,
    max_copies: int = 3,
    seed: int = 0,
    key: str = "call_id",
    size: str = "size",
    source: str = "source",
    priority: str | None = None,
    rows_per_block: int = 5_000,
) -> DataFrame:
    """One row per source that says which of its rows the mix takes, and how often.

    Every row gets floor(target / source_size) whole copies. The words still
    missing come from a Pareto order sample: with U the row's draw and p its
    inclusion probability, rows are ranked by (U / (1-U)) / (p / (1-p)). p is what is left of
    target / source_size, its odds multiplied by `priority` where one is given
    (a positive column; sampling stays of fixed size). A row longer than all that the source leaves out comes before
    the others, since without it the target can't be met. The order is gone through in
    rounds. In the first, rows no longer than the words open are taken from the
    smallest rank on until one does not fit; each further round does the same with the rows
    not taken that have at most half of the words then open. A round that stops leaves less than half
    open, so there are at most as many as the words have binary digits. At last the one row whose size
    comes closest to the words still open is taken if it brings the sum nearer, so a source misses its
    target by no more than the size of its shortest row not taken.

    Returns the source key, source_size, target, whole, odds, cuts (most_size, rank and
    key of each round; no key stands for all rows of the rank), extra_rank, extra_key and extra_size. Only sums per block of the draw are
    formed, and the one block per source in which a round stops is sorted, so
    rows of a source are never sorted in one task. Rows with one key have one rank and are
    taken together; where those of one key do not fit together, a round stops at them.
    """
    named = calls.select(
        F.col(key).alias("_key"), F.col(size).alias("_size"), *source_key(source), _chance(key, seed, priority).alias("_chance")
    )
    # tables of one row per source are kept in one file, so that their size is seen for what it is
    sizes = settle(named.groupBy(SOURCE_KEY).agg(F.sum("_size").alias("source_size"), F.count("*").alias("_n")).repartition(1))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = (
        source_targets(sizes, weights, max_copies)
        .withColumn("whole", F.floor(ratio).cast("bigint"))
        .withColumn("_part", ratio - F.col("whole"))
        .withColumn("odds", F.col("_part") / (1 - F.col("_part")))
        .withColumn("_open", F.col("target") - F.col("whole") * F.col("source_size"))
        .join(sizes.select(*SOURCE_KEY, F.ceil(F.col("_n") / rows_per_block).alias("_blocks")), SOURCE_KEY)
        .withColumn("_most", F.col("_open"))
        .withColumn("cuts", F.array().cast(f"array<struct<most_size: double, rank: double, key: {named.schema['_key'].dataType.simpleString()}>>"))
    )
    targets = settle(targets.repartition(1))
    ranked = settle(
        named.where("_size > 0")
        .join(targets.where("odds > 0").select(*SOURCE_KEY, "odds", "_blocks", left_out(F.col).alias("_out")), SOURCE_KEY)
        .withColumn("_first", F.col("_size") > F.col("_out"))
        .select(
            *SOURCE_KEY, "_key", "_size", place(pareto_rank(F.col("_chance"), F.col("odds")), F.col("_first")).alias("_rank"),
            (F.floor(F.col("_chance") * F.col("_blocks")) - F.when(F.col("_first"), F.col("_blocks")).otherwise(0)).alias("_block"),
        )
    )
    rules, rest = targets, ranked
    while not rest.isEmpty():
        rules, rest = _round(rules, rest)
    left = ranked.join(rules.select(*SOURCE_KEY, "cuts", "_open"), SOURCE_KEY).where(~within_cuts("cuts", F.col("_size"), F.col("_rank"), F.col("_key")))
    off = F.abs(F.col("_open") - F.col("_size"))
    extras = (
        left.where(off < F.col("_open"))
        .groupBy(SOURCE_KEY)
        .agg(F.min(F.struct(off.alias("_off"), "_rank", "_key", "_size")).alias("_extra"))
    )
    return settle(
        rules.join(extras, SOURCE_KEY, "left")
        .select(
            *SOURCE_KEY, "source_size", "target", "whole", "odds", "cuts",
            F.col("_extra._rank").alias("extra_rank"), F.col("_extra._key").alias("extra_key"), F.col("_extra._size").alias("extra_size"),
        )
        .repartition(1)
    )


def _round(rules: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One passage down the order: the rules with another cut where rows were taken, and the rows that the next round may take."""
    state = rules.select(*SOURCE_KEY, F.col("_open").alias("_room"), F.col("_most").alias("_limit"))
    short = rest.join(state, SOURCE_KEY).where(F.col("_size") <= F.col("_limit"))
    before = Window.partitionBy(*SOURCE_KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*SOURCE_KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = settle(
        short.groupBy(*SOURCE_KEY, "_block")
        .agg(F.sum("_size").alias("_words"), F.max("_rank").alias("_last"), F.max("_room").alias("_room"))
        .withColumns({"_start": F.coalesce(F.sum("_words").over(before), F.lit(0)), "_end": F.sum("_words").over(upto)})
    )
    whole = blocks.where("_end <= _room").groupBy(SOURCE_KEY).agg(F.max("_last").alias("_rank"), F.max("_end").alias("_got"))
    # the block in which the words run out, one per source; rows of one key are one step
    torn = blocks.where("_start <= _room AND _end > _room").select(*SOURCE_KEY, "_block", "_start")
    steps = short.join(torn, [*SOURCE_KEY, "_block"]).groupBy(*SOURCE_KEY, "_rank", "_key").agg(F.sum("_size").alias("_words"), F.max("_room").alias("_room"), F.max("_start").alias("_start"))
    inside = Window.partitionBy(*SOURCE_KEY).orderBy("_rank", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = (
        steps.withColumn("_end", F.col("_start") + F.sum("_words").over(inside))
        .where("_end <= _room")
        .groupBy(SOURCE_KEY)
        .agg(F.max(F.struct("_rank", "_key")).alias("_at"), F.max("_end").alias("_part_got"))
    )
    kind = rules.schema["cuts"].dataType.elementType
    upto_key = F.struct(F.col("_most").alias("most_size"), F.col("_at._rank").alias("rank"), F.col("_at._key").alias("key")).cast(kind)
    upto_rank = F.struct(F.col("_most").alias("most_size"), F.col("_rank").alias("rank"), F.lit(None).alias("key")).cast(kind)
    cut = F.when(F.col("_at").isNotNull(), upto_key).when(F.col("_rank").isNotNull(), upto_rank)
    after = settle(
        rules.join(whole, SOURCE_KEY, "left").join(part, SOURCE_KEY, "left")
        .withColumns({"_cut": cut, "_left": F.col("_open") - F.coalesce("_part_got", "_got", F.lit(0))})
        .withColumns({
            "cuts": F.when(F.col("_cut").isNotNull(), F.array_append("cuts", F.col("_cut"))).otherwise(F.col("cuts")),
            "_most": F.when(F.col("_cut").isNotNull(), F.col("_left")).otherwise(F.col("_most")) / 2,
            "_open": F.col("_left"),
        })
        .select(*rules.columns)
        .repartition(1)
    )
    fresh = after.select(*SOURCE_KEY, "cuts", "_most")
    left = settle(
        rest.join(fresh, SOURCE_KEY)
        .where((F.col("_size") <= F.col("_most")) & ~within_cuts("cuts", F.col("_size"), F.col("_rank"), F.col("_key")))
        .select(*rest.columns)
    )
    return after, left


def within_cuts(cuts: str | Column, size: Column, rank: Column, key: Column) -> Column:
    """Whether a round took the row: it was short enough, and not behind the place where the round stopped."""

    def taken(cut: Column) -> Column:
        at = (rank == cut["rank"]) & (cut["key"].isNull() | key.isNull() | F.coalesce(key <= cut["key"], F.lit(False)))
        return (size <= cut["most_size"]) & ((rank < cut["rank"]) | at)

    return F.exists(cuts, taken)


def mix_sources(
    calls: DataFrame,
    rules: DataFrame,
    seed: int = 0,
    key: str = "call_id",
    size: str = "size",
    source: str = "source",
    priority: str | None = None,
    copies: str = "copies",
    goal: str = "_mix",
) -> DataFrame:
    """Adds the number of times the mix takes each row, by the rules of its source.

    Only key, size and source are read, so texts stay where they are; `rules` has a row
    per source. All columns of `calls` are kept; columns with the names of
    `copies` and `goal` (a struct of source_size and target) are replaced. Null sources are one source; rows with one key (or with
    none), one size and one source are taken together. Rows of size 0 are taken with the whole copies only.
    Empty tables give empty results.
    """
    by, rule = free_name(calls, "_by"), free_name(calls, "_rule")
    packed = rules.select(F.struct(*SOURCE_KEY).alias(by), F.struct(*[c for c in rules.columns if c not in SOURCE_KEY]).alias(rule))
    of = lambda name: F.col(f"{rule}.{name}")
    words = F.col(size)
    rank = place(pareto_rank(_chance(key, seed, priority), of("odds")), words > left_out(of))
    extra = (rank == of("extra_rank")) & (words == of("extra_size")) & F.col(key).eqNullSafe(of("extra_key"))
    sampled = (of("odds") > 0) & (words > 0) & (F.coalesce(within_cuts(of("cuts"), words, rank, F.col(key)), F.lit(False)) | F.coalesce(extra, F.lit(False)))
    return (
        calls.withColumn(by, F.struct(*source_key(source)))
        .join(packed, by)
        .withColumns({
            copies: of("whole") + F.coalesce(sampled, F.lit(False)).cast("bigint"),
            goal: F.struct(of("source_size"), of("target")),
        })
        .drop(by, rule)
    )


def _chance(key: str, seed: int, priority: str | None) -> Column:
    """The draw as a number in (0, 1), its odds divided by the priority."""
    u = (draw(key, seed) + F.lit(0.5)) / F.lit(float(2**DRAW_BITS))
    if priority is None:
        return u
    odds = u / (1 - u) / F.col(priority)
    return odds / (1 + odds)


def pareto_rank(chance: Column, odds: Column) -> Column:
    return F.when(odds > 0, (chance / (1 - chance)) / odds)


def left_out(of: Callable[[str], Column]) -> Column:
    """Words of a source that its sample leaves out."""
    return (of("whole") + 1) * of("source_size") - of("target")


def place(rank: Column, first: Column) -> Column:
    """Ranks in their order, those of the rows that come first below 0."""
    return F.when(first, -1 / rank).otherwise(rank)
