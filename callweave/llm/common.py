"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are what ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"

# A draw has 52 bits, so it is exact as a double.
DRAW_BITS = 52


def draw(key: str, seed: int) -> Column:
    """A pseudo-random whole number of 52 bits that depends on the key and the seed only."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def source_key(source: str) -> list[Column]:
    """Two columns that are equal for equal sources, null included."""
    return [F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), F.col(source).isNull().alias("_no_source")]


def free_name(df: DataFrame, name: str) -> str:
    """The name itself, or with the first number that no column of the table has."""
    used = {c.lower() for c in df.columns}
    return next(n for n in (f"{name}{i or ''}" for i in range(len(used) + 1)) if n.lower() not in used)


# Rows of a batch that goes to Python; they are whole texts.
BATCH_ROWS = 1000


def short_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of this session hold fewer of them than Spark's default of 10 000.

    A text may have a hundred thousand characters, and a worker holds a batch several times.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


SOURCE_KEY = ["_source", "_no_source"]


def documents_as_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `documents` as transcripts: call_id, text, language, source."""
    return as_calls(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def as_calls(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("call_id"), "text", F.col("lang").alias("language"), "source")
