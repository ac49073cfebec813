"""Audit of how far the sources of a language differ in their words, on run-length encoded count columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.session import settle

# A share is a whole number of billionths, plus one.
SHARE_UNIT = 1_000_000_000
# Added to each count, so that a term a source never uses has a share too.
PRIOR = 5

# Bytes of a term: ASCII letters and all bytes of other characters; the rest separates terms.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
# Longer texts are split in slices, and a task hands over its counts when it holds this many.
_SLICE_BYTES = 1 << 20
_HELD_TERMS = 400_000
_OUT_ROWS = 50_000
# Terms whose columns are encoded together, and rows of an Arrow batch that brings them.
_STRIPE = 4096

_PARTIAL = "language string, source string, term string, n bigint, n_calls bigint"
_PARTIAL_ARROW = pa.schema(
    [("language", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_calls", pa.int64())]
)
_DISTANCE = "language string, a int, b int, value bigint"


def audit_sources(calls: DataFrame, min_calls: int = 30, top: int = 50) -> DataFrame:
    """Compares the word shares of every source with those of the other sources and of its language.

    `calls` are transcripts with `text`, `language` and `source`; nulls in them read as ''. Terms are runs of letters
    and non-ASCII characters, with A-Z lower-cased. A language keeps the terms that at least `min_calls` of its transcripts hold.
    With c the occurrences of a kept term in a source, N the source's sum over the V kept terms, its share is
    p = 1 + floor(10^9 (c + 5) / (N + 5 V)); all arithmetic is exact.

    Returns (language, source, part, item, value, rank): part `pair` has each other source of the language with the
    sum of |p - q| over all kept terms (0 where nothing is kept); part `term` has the `top` kept terms that the source
    uses more than its language does, with p - q. Ranks start at 1 per source and part, largest value first, then item.

    A source without any term still has its pairs. Repeated rows count as often as they are there; an empty table
    gives no rows; a language with one source has no pairs. Other columns of `calls` are ignored.

    Distances come from run-length columns. The kept terms of a language are ordered by their counts over the sources,
    smallest source first, so equal counts lie together; the order is dealt by range to tasks. In a stripe each source
    is a column of runs, and a pair is the sum over its common runs of |p - q| times run length, added over stripes.
    The table of sources (name, N, V) goes to every task; the result has one row per pair of them.
    """
    partial = settle(_partial_counts(calls))
    kept = settle(
        partial.where("term IS NOT NULL").groupBy("language", "term").agg(F.sum("n_calls").alias("n_calls"))
        .where(F.col("n_calls") >= min_calls).drop("n_calls")
    )
    counts = partial.join(kept, ["language", "term"]).groupBy("language", "source", "term").agg(F.sum("n").alias("n"))
    rows = settle(
        counts.groupBy("language", "term").agg(
            F.collect_list(F.struct("source", "n")).alias("columns"), F.sum("n").alias("n")
        )
    )
    groups = settle(_group_sizes(partial, rows))
    parts = [
        _ranked(_distances(rows, groups), "pair"),
        _ranked(_overused(rows, groups), "term").where(F.col("rank") <= top),
    ]
    return parts[0].unionByName(parts[1])


def _partial_counts(calls: DataFrame) -> DataFrame:
    """Terms with occurrences and transcripts per (language, source), summed within a task; one row without term per group."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    plain = calls.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("language", "source")], text)
    return plain.mapInArrow(_count_terms, _PARTIAL)


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a megabyte at a time."""
    spaced = data.translate(_LETTERS)
    start = 0
    while start < len(spaced):
        end = spaced.find(b" ", start + _SLICE_BYTES)
        end = len(spaced) if end < 0 else end
        yield spaced[start:end].split()
        start = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        languages, sources, texts = batch.columns
        for i in range(batch.num_rows):
            group = held.setdefault((languages[i].as_py(), sources[i].as_py()), (Counter(), Counter()))
            n, n_calls = group
            before = len(n)
            seen: set[bytes] = set()
            for terms in _slices(texts[i].as_py()):
                n.update(terms)
                seen.update(terms)
            n_calls.update(seen)
            size += len(n) - before
            if size >= _HELD_TERMS:
                yield from _hand_over(held)
                held, size = {}, 0
    yield from _hand_over(held)


def _hand_over(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (language, source), (n, n_calls) in held.items():
        terms = [None, *n]
        for start in range(0, len(terms), _OUT_ROWS):
            part = terms[start : start + _OUT_ROWS]
            columns = [
                pa.array([language] * len(part), pa.string()),
                pa.array([source] * len(part), pa.string()),
                pa.array(part, pa.binary()).cast(pa.string()),
                pa.array([n[t] for t in part], pa.int64()),
                pa.array([n_calls[t] for t in part], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_PARTIAL_ARROW)


def _group_sizes(partial: DataFrame, rows: DataFrame) -> DataFrame:
    """Every (language, source) with its N, the V and N of its language, and its place among the language's columns."""
    named = partial.where("term IS NULL").select("language", "source").distinct()
    of_source = (
        rows.select("language", F.explode("columns").alias("_c")).groupBy("language", F.col("_c.source").alias("source"))
        .agg(F.sum("_c.n").alias("total"))
    )
    of_language = rows.groupBy("language").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("language_total"))
    by_size = Window.partitionBy("language").orderBy("total", "source")
    zero = F.lit(0).cast("bigint")
    return (
        named.join(of_source, ["language", "source"], "left").join(of_language, "language", "left")
        .na.fill(0, ["total", "n_terms", "language_total"])
        .withColumn("place", (F.row_number().over(by_size) - 1).cast("int"))
        .select("language", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "n_terms", "language_total")], "place")
    )


def _share(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 V)) in whole decimals; null without terms."""
    whole = f"(CAST({SHARE_UNIT} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(20, 0)))"
    return F.expr(f"1 + {whole} div nullif(CAST({total} + {PRIOR} * n_terms AS DECIMAL(20, 0)), 0)").cast("bigint")


def _overused(rows: DataFrame, groups: DataFrame) -> DataFrame:
    used = rows.select("language", "term", F.col("n").alias("language_n"), F.explode("columns").alias("_c"))
    both = used.select("language", "term", "language_n", "_c.source", "_c.n").join(groups, ["language", "source"])
    value = _share("n", "total") - _share("language_n", "language_total")
    return both.select("language", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")


def _distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Both directions of every pair of sources of a language."""
    sums = _stripes(rows, groups).groupBy("language", "a", "b").agg(F.sum("value").alias("value"))
    first = groups.select("language", F.col("source").alias("_source_a"), F.col("place").alias("a"))
    second = groups.select("language", F.col("source").alias("_source_b"), F.col("place").alias("b"))
    pairs = first.join(second, "language").where("a < b").join(sums, ["language", "a", "b"], "left")
    both = F.explode(
        F.array(
            F.struct(F.col("_source_a").alias("source"), F.col("_source_b").alias("item")),
            F.struct(F.col("_source_b").alias("source"), F.col("_source_a").alias("item")),
        )
    )
    value = F.coalesce("value", F.lit(0).cast("bigint")).alias("value")
    return pairs.select("language", value, both.alias("_p")).select("language", "_p.source", "_p.item", "value")


def _stripes(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Distances of the pairs (a < b by place) over the terms of each task."""
    sizes: dict[str, list[tuple[int, int]]] = {}
    for g in groups.orderBy("language", "place").collect():
        sizes.setdefault(g["language"], []).append((g["total"], g["n_terms"]))

    places = groups.select("language", "source", "place")
    placed = (
        rows.select("language", "term", F.explode("columns").alias("_c"))
        .select("language", "term", "_c.source", "_c.n").join(places, ["language", "source"])
        .groupBy("language", "term").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("columns"))
    )
    ordered = settle(placed).repartitionByRange("language", "columns").sortWithinPartitions("language", "columns")
    flat = ordered.select(
        "language", F.transform("columns", lambda c: c["place"]).alias("places"),
        F.transform("columns", lambda c: c["n"]).alias("counts"),
    )
    return flat.mapInArrow(lambda batches: _measure_stripes(batches, sizes), _DISTANCE)


def _measure_stripes(
    batches: Iterator[pa.RecordBatch], sizes: dict[str, list[tuple[int, int]]]
) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        languages = table.column("language").to_numpy()
        cuts = [0, *(np.flatnonzero(languages[1:] != languages[:-1]) + 1), len(languages)]
        for low, high in zip(cuts, cuts[1:]):
            for start in range(low, high, _STRIPE):
                part = table.slice(start, min(_STRIPE, high - start)).combine_chunks()
                language = languages[start]
                runs = _run_columns(part, sizes[language])
                found = _run_distances(runs, part.num_rows)
                sums[language] = sums[language] + found if language in sums else found
    for language, found in sums.items():
        a, b = np.triu_indices(len(found), 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([language] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                pa.array(found[a, b], pa.int64()),
            ],
            names=["language", "a", "b", "value"],
        )


def shares(counts: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """Shares of counts, exact also where the product leaves 64 bits."""
    if len(counts) and int(counts.max()) + PRIOR >= (1 << 63) // SHARE_UNIT:
        counts = counts.astype(object)
    return (1 + SHARE_UNIT * (counts + PRIOR) // (total + PRIOR * n_terms)).astype(np.int64)


def _run_columns(part: pa.Table, sizes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per source: where its runs of equal counts start, and the share of each run."""
    places, counts = (part.column(c).chunk(0) for c in ("places", "counts"))
    row_of = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
    place_of, count_of = places.flatten().to_numpy(), counts.flatten().to_numpy()
    order = np.argsort(place_of, kind="stable")
    bounds = np.searchsorted(place_of[order], np.arange(len(sizes) + 1))
    columns = []
    for place, (total, n_terms) in enumerate(sizes):
        mine = order[bounds[place] : bounds[place + 1]]
        column = np.zeros(part.num_rows, np.int64)
        column[row_of[mine]] = count_of[mine]
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
        columns.append((starts, shares(column[starts], total, n_terms)))
    return columns


def _run_distances(columns: list[tuple[np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """Sum of |p - q| of every pair, once per run that both have in common."""
    out = np.zeros((len(columns), len(columns)), np.int64)
    for a, (starts_a, p) in enumerate(columns):
        for b in range(a + 1, len(columns)):
            starts_b, q = columns[b]
            starts = np.union1d(starts_a, starts_b)
            f = np.abs(
                p[np.searchsorted(starts_a, starts, "right") - 1] - q[np.searchsorted(starts_b, starts, "right") - 1]
            )
            out[a, b] = f @ np.diff(starts, append=length)
    return out


def _ranked(values: DataFrame, part: str) -> DataFrame:
    best_first = Window.partitionBy("language", "source").orderBy(F.desc("value"), "item")
    return values.select(
        "language", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best_first).alias("rank")
    )
