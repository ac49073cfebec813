"""Readers and writers for conversations, manifests, transcripts and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import schema
from callweave.config import DEFAULTS
from callweave.functions import text as tx
from callweave.session import settle


def _ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def explode_turns(calls: DataFrame, column: str = "conversation") -> DataFrame:
    """One row per turn of an array; its place in the array becomes `turn_idx`."""
    return calls.select("call_id", F.posexplode(column).alias("i", "t")).select(
        "call_id", F.col("i").cast("bigint").alias("turn_idx"), "t"
    )


FILE_FOLDERS = 256
READERS_PER_CORE = 16


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; Spark puts only a few small files in a task, so neighbours share tasks."""
    found = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return found.coalesce(READERS_PER_CORE * spark.sparkContext.defaultParallelism)


def write_conversations(calls: DataFrame, path: str, folders: int = FILE_FOLDERS) -> None:
    """One file `<call_id>.json` per call, holding `value`, dealt to a fixed number of folders below `path`.

    The tasks write the files themselves: a partitioned write gives each call a folder of its own, whose files the driver moves and
    lists one by one. A task that is tried again writes the same files. `path` must be one that Arrow's file systems know. Calls: call_id, value.
    """
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for rows in batches:
            for call_id, value, folder in zip(rows["call_id"], rows["value"], rows["folder"]):
                at = f"{base}/{folder:03d}"
                if at not in made:
                    store.create_dir(at, recursive=True)
                    made.add(at)
                with store.open_output_stream(f"{at}/{call_id}.json") as out:
                    out.write(value.encode())
            yield pd.DataFrame({"n": [len(rows)]})

    folder = F.pmod(F.xxhash64("call_id"), F.lit(folders)).cast("int").alias("folder")
    placed = calls.select(F.col("call_id").cast("string").alias("call_id"), "value", folder)
    placed.mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def load_turns(spark: SparkSession, path: str) -> DataFrame:
    """Conversation files, one call each: an object with `conversation` or a bare array.

    The position in the array becomes `turn_idx`; it decides what the first and
    the last turn are. The call id is the file name, or the `call=` folder of a
    file written per call.
    """
    file_path = F.col("path")
    folder = F.regexp_extract(file_path, r"/call=([^/]+)/[^/]*$", 1)
    call_id = F.when(folder != "", folder).otherwise(tx.call_id_of(file_path))
    raw = _whole_files(spark, path)
    body = F.when(
        F.startswith(F.ltrim(F.col("value")), F.lit("[")),
        F.from_json("value", schema.CONVERSATION_JSON["conversation"].dataType),
    ).otherwise(F.from_json("value", schema.CONVERSATION_JSON)["conversation"])
    return (
        raw.select(call_id.alias("call_id"), body.alias("turns"))
        .transform(explode_turns, "turns")
        .select(
            "call_id",
            "turn_idx",
            "t.speaker",
            _ms(F.col("t.start")).alias("start_ms"),
            _ms(F.col("t.end")).alias("end_ms"),
            "t.text",
        )
    )


@dataclass(frozen=True)
class Conversations:
    """`turns` as of `load_turns`; `outcomes` has each file with its call and an error, null for a file that was read."""

    turns: DataFrame
    outcomes: DataFrame


_NOT_JSON, _NO_TURNS, _BAD_TURN = "Not valid JSON", "No list of turns", "A turn is not an object with text"


def read_conversations(spark: SparkSession, path: str) -> Conversations:
    """Conversation files of both shapes, parsed once; files that are broken become rows with an error.

    A file is an object with `conversation` or a bare array; keys that are not known are passed over, and a time or speaker that is
    missing, null or of another type is null. Text that is no JSON, a file without a list of turns, and one with a turn that is no object with
    text fail as a whole, so no call is read in part. (A file of no bytes at all gives no row: Spark's text source passes it over.) `outcomes` is what `quality.batch_summary` and `batch_failures` take.
    """
    file_path = F.col("path")
    folder = F.regexp_extract(file_path, r"/call=([^/]+)/[^/]*$", 1)
    raw = _whole_files(spark, path).select(
        "path", F.when(folder != "", folder).otherwise(tx.call_id_of(file_path)).alias("call_id"), F.try_parse_json("value").alias("body")
    )
    bare = F.startswith(F.schema_of_variant("body"), F.lit("ARRAY"))
    turns = F.when(bare, F.try_variant_get("body", "$", "array<variant>")).otherwise(F.try_variant_get("body", "$.conversation", "array<variant>"))
    kinds = (("speaker", "string"), ("start", "double"), ("end", "double"), ("text", "string"))
    read = F.transform(turns, lambda t: F.struct(*[F.try_variant_get(t, f"$.{n}", kind).alias(n) for n, kind in kinds]))
    error = (
        F.when(F.col("body").isNull(), _NOT_JSON).when(F.col("turns").isNull(), _NO_TURNS)
        .when(F.exists("turns", lambda t: t["text"].isNull()), _BAD_TURN)
    )
    files = settle(raw.select("path", "call_id", "body", read.alias("turns")).select("path", "call_id", error.alias("error"), "turns"))
    good = explode_turns(files.where("error IS NULL"), "turns").select(
        "call_id", "turn_idx", "t.speaker", _ms(F.col("t.start")).alias("start_ms"), _ms(F.col("t.end")).alias("end_ms"), "t.text"
    )
    return Conversations(good, files.drop("turns"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MANIFEST_JSON).json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.select(*schema.MANIFEST_JSON.fieldNames()).write.mode("overwrite").json(path)


def manifest_from_parquet(spark: SparkSession, path: str, audio_dir: str = "audio") -> DataFrame:
    """Manifest rows from (id, audio{bytes, ...}, text); the bytes are never read."""
    rows = spark.read.parquet(path)
    audio = rows.schema["audio"].dataType
    fields = set(audio.fieldNames())

    def sub(name: str, kind: str) -> Column:
        return (F.col(f"audio.{name}") if name in fields else F.lit(None)).cast(kind)

    call_id = F.col("id").cast("string")
    return rows.select(
        call_id.alias("call_id"),
        F.concat(F.lit(audio_dir + "/"), call_id, F.lit(".flac")).alias("audio_path"),
        F.col("text").alias("reference_transcript"),
        F.round(sub("duration_seconds", "double"), 3).alias("duration_seconds"),
        sub("sample_rate", "int").alias("sample_rate"),
    )


def scan_audio(
    spark: SparkSession,
    folder: str,
    extensions: Sequence[str] = (*DEFAULTS.audio.supported_formats, *DEFAULTS.audio.flagged_formats),
) -> DataFrame:
    """Files below a folder by extension, any letter case.

    The listing carries path and size; `content` is read only where a caller
    selects it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.filter(suffix.isin(list(extensions))).select(
        "path",
        tx.call_id_of(F.col("path")).alias("call_id"),
        suffix.alias("extension"),
        F.col("length").alias("size_bytes"),
        "content",
    )


def load_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts, one JSON object per line or per file."""
    return (
        spark.read.schema(schema.TRANSCRIPT_JSON)
        .option("recursiveFileLookup", True)
        .option("multiLine", True)
        .json(folder)
    )


def load_transcript_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schema.TRANSCRIPT_JSON).json(folder)


def write_transcripts(df: DataFrame, folder: str, per_call: bool = False) -> None:
    """Transcript JSON. One line per call by default; `per_call` gives a folder per call.

    A folder per call suits small exports only: file counts, not bytes, limit it.
    """
    out = df.select(*schema.TRANSCRIPT_JSON.fieldNames())
    if per_call:
        out.select(F.col("call_id").alias("call"), "*").write.mode("overwrite").partitionBy("call").json(folder)
    else:
        out.write.mode("overwrite").json(folder)


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    """One row per segment, times in milliseconds, order kept."""
    return transcripts.select("call_id", F.posexplode("segments").alias("seg_idx", "s")).select(
        "call_id",
        F.col("seg_idx").cast("bigint").alias("seg_idx"),
        _ms(F.col("s.start")).alias("start_ms"),
        _ms(F.col("s.end")).alias("end_ms"),
        "s.text",
    )


def write_report(df: DataFrame, path: str) -> None:
    """A report as a single JSON file, one line per row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def load_labelled(df: DataFrame, text: str, label: str, names: Sequence[str] | None = None) -> DataFrame:
    """(text, label) pairs; integer labels are decoded through the list of names."""
    value = F.col(label)
    if names is not None:
        value = F.get(F.array(*[F.lit(n) for n in names]), value.cast("int"))
    return df.select("*", F.col(text).alias("_t"), value.alias("_l")).select(
        *[c for c in df.columns if c not in (text, label)], F.col("_t").alias("text"), F.col("_l").alias("label")
    )
