"""WARC archives of captures: written, freed of repeated payloads, read again."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import short_batches
from callweave.session import scratch_path, settle

# An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 256 << 20
# Payloads of fewer bytes are never worth a reference.
LEAST_BYTES = 1000
COMPRESSION = 1
RECORDS_PER_BATCH = 2000
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

INDEX = "path string, offset bigint, capture string, payload_digest string, payload_bytes bigint"
RECORDS = "capture string, record_type string, refers_to string, payload_digest string, payload_bytes bigint"


def deduplicated_records(
    captures: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = LEAST_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Archives captures, replaces repeated payloads by revisit records, and reads the archives back.

    General: the call records of this library hold no web pages. Three steps, each
    settled before the next, so a lost executor repeats its own part only:
    `write_captures` archives every capture in full, `resolve_revisits` shuffles
    the headers (never the payloads) by payload digest, `write_resolved` goes through
    each archive once more and writes its successor with fresh headers. Then the new
    archives are read, and each revisit is joined to the response it refers to.

    `folder` must be reachable by all executors through a file system that Arrow
    knows; by default it lies in the session's checkpoint folder.

    Returns `key`, payload_bytes, payload_digest (lower-case hex SHA-1, both of the
    whole payload), record_type (response or revisit) and refers_to. Of captures
    with equal payloads of at least `least_bytes` the one with the largest key is
    the response. Null html is an empty payload. A capture without key is always a
    response. Of rows equal in key and payload one is the response, the others
    refer to the same key. An empty table gives an empty result.
    """
    spark = captures.sparkSession
    folder = folder or scratch_path(spark, "warc")
    index = settle(write_captures(captures, f"{folder}-captured", key, url, html, archive_bytes))
    key_type = captures.schema[key].dataType.simpleString()
    resolved = resolve_revisits(index, key_type, least_bytes)
    archives = settle(write_resolved(resolved, f"{folder}-resolved"))
    return follow_revisits(read_archives(spark, archives)).select(
        F.col("capture").cast(key_type).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(key_type).alias("refers_to"),
    )


def write_captures(captures: DataFrame, folder: str, key: str, url: str, html: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every capture as a response record; returns where each one lies.

    A task names its archives anew at each attempt, and only those of the attempt
    that Spark accepts get into the result, so the result must be settled.
    """
    rows = short_batches(captures).select(F.col(key).cast("string"), F.col(url).cast("string"), F.col(html).cast("binary"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            found = []
            for capture, target, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None or archive.size >= archive_bytes:
                    if archive is not None:
                        archive.close()
                    archive = Archive(folder)
                payload = payload or b""
                digest = hashlib.sha1(payload)
                offset = archive.add(*response(capture, target, payload, digest.digest()))
                found.append((archive.uri, offset, capture, digest.hexdigest(), len(payload)))
            yield table(found, INDEX)
        if archive is not None:
            archive.close()

    return rows.mapInArrow(work, INDEX)


def resolve_revisits(index: DataFrame, key_type: str = "bigint", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds original, the capture whose response a record refers to; null for responses.

    Only digests that occur twice take part in the join: one row for each of them
    meets the headers with that digest. The rows of one very frequent digest are
    counted before the shuffle, and Spark splits their part of the join.
    """
    worth = (F.col("payload_bytes") >= least_bytes) & F.col("capture").isNotNull()
    place = F.struct(F.col("capture").cast(key_type).alias("key"), "capture", "path", "offset")
    originals = settle(
        index.where(worth)
        .groupBy("payload_digest")
        .agg(F.max(place).alias("_original"), F.count("*").alias("_copies"))
        .where("_copies > 1")
        .select("payload_digest", F.col("_original").alias("_original"))
    )
    itself = (F.col("path") == F.col("_original.path")) & (F.col("offset") == F.col("_original.offset"))
    original = F.when(worth & ~itself, F.col("_original.capture"))
    return index.join(originals, "payload_digest", "left").withColumn("original", original).drop("_original")


def write_resolved(resolved: DataFrame, folder: str) -> DataFrame:
    """Writes the successor of each archive, with revisit records in place of repeated payloads.

    The headers of one archive come to one task, which are as many as an archive
    holds; payloads are read from the archive one at a time. There are as many tasks as archives, since their work is
    that of the payloads, not of the few bytes of headers. Returns path and the number of records.
    """
    n_archives = resolved.agg(F.countDistinct("path")).first()[0]

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        archive = Archive(folder)
        records = read_records(group["path"].iloc[0])
        for (head, payload), original in zip(records, group["original"], strict=True):
            capture, target, digest = of_urn(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Payload-Digest"]
            if isinstance(original, str):
                archive.add(*revisit(capture, target, digest, original))
            else:
                archive.add(*response(capture, target, payload, base64.b32decode(digest.removeprefix("sha1:"))))
        archive.close()
        return pd.DataFrame({"path": [archive.uri], "n_records": [len(group)]})

    dealt = resolved.select("path", "offset", "original").repartition(max(1, n_archives), "path")
    return dealt.groupBy("path").applyInPandas(work, "path string, n_records bigint")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """One row per record of the archives in column path; payload_bytes is null for revisits."""
    n = archives.count()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = []
                for head, payload in read_records(path):
                    kind = head["WARC-Type"]
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: payload of {head['WARC-Record-ID']} does not match its digest")
                    refers = of_urn(head["WARC-Refers-To"]) if kind == "revisit" else None
                    found.append((of_urn(head["WARC-Record-ID"]), kind, refers, digest, len(payload) if kind == "response" else None))
                    if len(found) == RECORDS_PER_BATCH:
                        yield table(found, RECORDS)
                        found = []
                yield table(found, RECORDS)

    return archives.select("path").repartition(max(1, n)).mapInArrow(work, RECORDS)


def follow_revisits(records: DataFrame) -> DataFrame:
    """Gives revisits the size of the payload of their response."""
    records = settle(records)
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    wanted = revisits.groupBy("payload_digest", "refers_to").agg(F.count("*").alias("_n"))
    responses = records.where("record_type = 'response'").select("payload_digest", F.col("capture").alias("refers_to"), "payload_bytes")
    sizes = settle(wanted.join(responses, ["payload_digest", "refers_to"]).groupBy("payload_digest", "refers_to").agg(F.max("payload_bytes").alias("payload_bytes")))
    followed = revisits.join(sizes, ["payload_digest", "refers_to"], "left").select(records.columns)
    return records.where("record_type = 'response'").unionByName(followed)


class Archive:
    """A file of records, each a gzip member of its own, so that any of them can be read alone."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        store, path = file_system(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        self.size = 0

    def add(self, head: list[tuple[str, str]], block: bytes) -> int:
        """Appends a record and returns its offset."""
        lines = [VERSION, *(f"{name}: {value}" for name, value in head), f"Content-Length: {len(block)}"]
        packer = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
        record = packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()
        offset, self.size = self.size, self.size + len(record)
        self.out.write(record)
        return offset

    def close(self) -> None:
        self.out.close()


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def urn(capture: str | None) -> str:
    return f"<urn:capture:{quote(capture, safe='')}>" if capture is not None else f"<urn:uuid:{uuid.uuid4()}>"


def of_urn(name: str) -> str | None:
    return unquote(name[len("<urn:capture:") : -1]) if name.startswith("<urn:capture:") else None


def _head(kind: str, capture: str | None, target: str | None) -> list[tuple[str, str]]:
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [("WARC-Type", kind), ("WARC-Record-ID", urn(capture)), ("WARC-Date", now)]
    # a line break would end the header
    return head + ([("WARC-Target-URI", quote(target, safe="%/:=&?~#+!$,;'@()*[]"))] if target else [])


def response(capture: str | None, target: str | None, payload: bytes, digest: bytes) -> tuple[list[tuple[str, str]], bytes]:
    head = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Content-Type", "application/http; msgtype=response")]
    return _head("response", capture, target) + head, HTTP_HEAD.format(len(payload)).encode() + payload


def revisit(capture: str | None, target: str | None, digest: str, original: str) -> tuple[list[tuple[str, str]], bytes]:
    head = [("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(original))]
    return _head("revisit", capture, target) + head, b""


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record, one record in memory at a time."""
    store, path = file_system(uri)
    with store.open_input_stream(path, compression=None) as stream:
        rest = b""
        while rest or (rest := stream.read(1 << 20)):
            member, parts = zlib.decompressobj(31), []
            while not member.eof:
                if not rest and not (rest := stream.read(1 << 20)):
                    raise EOFError(f"{uri} ends inside a record")
                parts.append(member.decompress(rest))
                rest = member.unused_data if member.eof else b""
            lines, _, block = b"".join(parts).partition(b"\r\n\r\n")
            head = dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
            yield head, block[: int(head["Content-Length"])].partition(b"\r\n\r\n")[2]


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])
