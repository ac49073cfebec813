"""Dataset reports: distributions, duplicates, histograms, batch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from callweave.functions import text as tx
from callweave.session import join_short, settle


def report_base(validated: DataFrame) -> DataFrame:
    """Counts and duration figures per (sample rate, channels, format).

    The one pass over the files; the report's groupings are all taken from it.
    Only files that could be opened count in the distributions.
    """
    known = validated.withColumns(
        {c: F.when(F.col("has_info"), F.col(c)) for c in ("sample_rate", "channels", "format", "duration_seconds")}
    )
    return known.groupBy("sample_rate", "channels", "format").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_valid").alias("valid"),
        F.min("duration_seconds").alias("min_duration"),
        F.max("duration_seconds").alias("max_duration"),
        F.sum("duration_seconds").alias("total_seconds"),
    )


def dataset_report(validated: DataFrame) -> DataFrame:
    """Totals and distributions in one tall table.

    Row kinds: `all`, `sample_rate`, `channels`, `format`.
    """
    base = report_base(validated)
    agg = [
        F.sum("n").alias("n_files"),
        F.sum("valid").alias("n_valid"),
        F.min("min_duration").alias("min_duration"),
        F.max("max_duration").alias("max_duration"),
        F.sum("total_seconds").alias("total_seconds"),
    ]
    grouped = base.groupingSets(
        [[F.col("sample_rate")], [F.col("channels")], [F.col("format")], []],
        F.col("sample_rate"),
        F.col("channels"),
        F.col("format"),
    ).agg(*agg, F.grouping_id().alias("g"))
    kind = (
        F.when(F.col("g") == 3, "sample_rate").when(F.col("g") == 5, "channels").when(F.col("g") == 6, "format")
        .otherwise("all")
    )
    value = F.coalesce(F.col("sample_rate").cast("string"), F.col("channels").cast("string"), F.col("format"))
    return grouped.select(
        kind.alias("kind"),
        value.alias("value"),
        "n_files",
        "n_valid",
        (F.col("n_files") - F.col("n_valid")).alias("n_invalid"),
        "min_duration",
        "max_duration",
        "total_seconds",
    ).filter((F.col("kind") == "all") | F.col("value").isNotNull())


def dataset_issues(validated: DataFrame) -> DataFrame:
    return validated.filter((F.size("errors") > 0) | (F.size("warnings") > 0)).select("path", "errors", "warnings")


def duplicate_groups(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files whose content occurs more than once, one row per file.

    The content is scanned once and hashed there; only (hash, path) is kept. Copies
    are counted before they are shuffled, and the repeated hashes are joined as a
    table of known size, so copies of one content do not meet in one task.
    """
    hashed = settle(files.select(tx.sha256_hex(F.col(content)).alias("content_sha256"), F.col(path).alias("path")))
    repeated = (
        hashed.groupBy("content_sha256")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min("path").alias("first_path"))
        .filter("n_copies > 1")
    )
    return join_short(hashed, repeated, ["content_sha256"])


def duration_histogram(df: DataFrame, column: str, max_bins: int = 20) -> DataFrame:
    """min(max_bins, rows) bins of equal width over [min, max], empty ones included."""
    value = F.col(column).cast("double")
    stats = df.filter(value.isNotNull()).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    bins = F.least(F.lit(max_bins), F.col("n")).cast("int")
    one = stats.select(
        F.struct(
            # a single value gets a bin range of one around it
            F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
            bins.alias("bins"),
        ).alias("_s")
    )
    s = F.col("_s")
    width = (s["hi"] - s["lo"]) / s["bins"]
    placed = (
        df.filter(value.isNotNull())
        .withColumn("_s", one.scalar())
        .select(F.least(F.floor((value - s["lo"]) / width).cast("int"), s["bins"] - 1).alias("bin"))
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = one.filter(s["bins"] > 0).select(
        F.posexplode(F.sequence(F.lit(0), s["bins"] - 1)).alias("bin", "_x"), s["lo"].alias("lo"), width.alias("w")
    )
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def duration_stats(df: DataFrame, column: str) -> DataFrame:
    value = F.col(column)
    return df.agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.sum(value).alias("total"),
    )


def batch_summary(outcomes: DataFrame, error: str = "error") -> DataFrame:
    """Total, succeeded and failed items of a batch; an item failed when it has an error."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(error).isNull()).alias("succeeded"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


def batch_failures(outcomes: DataFrame, error: str = "error") -> DataFrame:
    """The failed items as a table of their own; a batch may have any number of them."""
    return outcomes.filter(F.col(error).isNotNull()).select("path", F.col(error).alias("error"))


def write_with_summary(outcomes: DataFrame, path: str, error: str = "error") -> DataFrame:
    """Writes all items, failed ones apart (`failed=true` and `failed=false` below `path`), and returns their summary.

    The counts are gathered by the tasks that write, so the items are read once; the row equals that of `batch_summary`.
    """
    summary = Observation()
    failed = F.col(error).isNotNull()
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed")]
    outcomes.observe(summary, *counts).withColumn("failed", failed).write.partitionBy("failed").parquet(path)
    numbers = summary.get
    names = ("total", "succeeded", "failed")
    return outcomes.sparkSession.createDataFrame([tuple(numbers[n] for n in names)], ", ".join(f"{n} bigint" for n in names))
