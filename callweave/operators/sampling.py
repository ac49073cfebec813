"""Reproducible samples and splits.

Rows are ordered by the MD5 of id and seed. To take the first k rows of a class
nothing is sorted as a whole: counts per hash prefix tell in which prefix the
k-th row lies, counts per longer prefix tell the same inside it, only what is left
is ranked, and its k-th hash becomes a threshold that every row is compared with.
The exact first k rows come out; one row in 16 million of a class is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.session import join_short

PREFIX = 3  # hex digits per step


def sample_hash(ids: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("-", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def union_tagged(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    return real.withColumn("source", F.lit("real")).unionByName(synthetic.withColumn("source", F.lit("synthetic")))


def _thresholds(hashed: DataFrame, keys: list[str], cuts: dict[str, Column]) -> DataFrame:
    """The hash at each cut, one row per (keys, cut).

    Each cut is a column over `n` (rows of the class) and `total` (all rows),
    telling how many rows lie at or below it. The table of prefix counts has at
    most 4096 rows per class.
    """
    first = F.substring("_h", 1, PREFIX).alias("_p")
    per_prefix = hashed.groupBy(*keys, first).agg(F.count(F.lit(1)).alias("_n"))
    of_class = Window.partitionBy(*keys)
    spans = per_prefix.withColumns(
        {
            "_before": _rows_before(keys, "_p"),
            "n": F.sum("_n").over(of_class),
            "total": per_prefix.agg(F.sum("_n")).scalar(),
        }
    )
    wanted = F.array(*[F.struct(F.lit(k).alias("cut"), v.cast("bigint").alias("rank")) for k, v in cuts.items()])
    located = _holding(spans.withColumn("_c", F.explode(wanted)), F.col("_c.rank")).select(*keys, "_p", "_c.cut", "_within")

    inside = join_short(hashed.select(*keys, "_h", first), located, [*keys, "_p"]).withColumn("_q", F.substring("_h", PREFIX + 1, PREFIX))
    groups = [*keys, "cut"]
    per_prefix = inside.groupBy(*groups, "_within", "_q").agg(F.count(F.lit(1)).alias("_n"))
    spans = per_prefix.withColumn("_before", _rows_before(groups, "_q")).withColumnRenamed("_within", "_rank")
    located = _holding(spans, F.col("_rank")).select(*groups, "_q", "_within")
    return (
        join_short(inside.drop("_within"), located, [*groups, "_q"])
        .withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_q").orderBy("_h")))
        .filter(F.col("_r") == F.col("_within"))
        .select(*keys, "cut", "_h")
    )


def _rows_before(keys: list[str], prefix: str) -> Column:
    """Rows of the key in smaller prefixes; a key has at most 4096 of them."""
    before = Window.partitionBy(*keys).orderBy(prefix).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(before), F.lit(0))


def _holding(spans: DataFrame, rank: Column) -> DataFrame:
    """The prefixes that hold the row of a rank, with its rank inside them."""
    found = (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_n"))
    return spans.filter(found).withColumn("_within", rank - F.col("_before"))


def _with_cuts(df: DataFrame, label: str, ids: Sequence[str], seed: int, cuts: dict[str, Column]) -> DataFrame:
    """Adds `_h` and one threshold column per cut; a cut of 0 rows gives NULL.

    The thresholds are one row per class, so the rows themselves stay where they
    are scanned.
    """
    hashed = df.withColumn("_h", sample_hash(ids, seed))
    limits = _thresholds(hashed.select(label, "_h"), [label], cuts)
    wide = limits.groupBy(label).agg(
        *[F.max(F.when(F.col("cut") == name, F.col("_h"))).alias(f"_cut_{name}") for name in cuts]
    )
    return join_short(hashed, wide, [label], "left")


def stratified_subsample(df: DataFrame, label: str, ids: Sequence[str], max_total: int, seed: int = 42) -> DataFrame:
    """About `max_total` rows with the class shares kept, at least one row per class."""
    keep = F.greatest(F.lit(1), F.bround(F.col("n") / F.col("total") * max_total))
    keep = F.least(keep, F.col("n"))
    cut = _with_cuts(df, label, ids, seed, {"keep": keep})
    return cut.filter(F.col("_h") <= F.col("_cut_keep")).drop("_h", "_cut_keep")


def stratified_split(
    df: DataFrame, label: str, ids: Sequence[str], val_frac: float = 0.15, test_frac: float = 0.15, seed: int = 42
) -> DataFrame:
    """Adds `split` (train, val, test) within each class; classes under 3 rows are all train."""
    n = F.col("n")
    n_test = F.when(n >= 3, F.greatest(F.lit(1), F.floor(n * test_frac))).otherwise(0)
    n_val = F.when(n >= 3, F.greatest(F.lit(1), F.floor(n * val_frac))).otherwise(0)
    cut = _with_cuts(df, label, ids, seed, {"test": n_test, "val": n_test + n_val})
    split = (
        F.when(F.col("_h") <= F.col("_cut_test"), "test").when(F.col("_h") <= F.col("_cut_val"), "val").otherwise("train")
    )
    return cut.withColumn("split", split).drop("_h", "_cut_test", "_cut_val")


def holdout_split(
    df: DataFrame, ids: Sequence[str], fracs: dict[str, float], seed: int = 42, at_least: int = 0
) -> DataFrame:
    """Adds `split` without regard to classes: `fracs` in order, the rest is train.

    The hash thresholds are single values here and enter the plan as scalar
    subqueries.
    """
    hashed = df.withColumn("_h", sample_hash(ids, seed))
    cuts, taken = {}, F.lit(0).cast("bigint")
    for name, frac in fracs.items():
        taken = taken + F.greatest(F.lit(at_least), F.floor(F.col("n") * frac))
        cuts[name] = taken
    limits = _thresholds(hashed.select("_h"), [], cuts)
    by_name = limits.agg(F.map_from_entries(F.collect_list(F.struct("cut", "_h")))).scalar()
    split = F.lit("train")
    for name in reversed(list(fracs)):
        split = F.when(F.col("_h") <= F.element_at("_limits", F.lit(name)), name).otherwise(split)
    return hashed.withColumn("_limits", by_name).withColumn("split", split).drop("_h", "_limits")
