"""Diarization error rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.operators import align
from callweave.session import settle


EDGES_A_TASK = 1 << 20


def _swept(edges: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Stretches between the times `t` of the edges of a key, with the sums of the edges before.

    Edges at one time may come in any order: what is between them has no length.
    """
    ordered = Window.partitionBy(*keys).orderBy("t")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return (
        edges.withColumns({c: F.sum(c).over(before) for c in sums} | {"_s": F.lag("t").over(ordered), "_e": F.col("t")})
        .filter(F.col("_s") < F.col("_e"))
        .drop("t")
    )


def _edges(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Both ends of every piece: the start adds the values, the end takes them back."""
    ends = F.array(
        F.struct(F.col("_s").alias("t"), *[v.alias(n) for n, v in values.items()]),
        F.struct(F.col("_e").alias("t"), *[(-v).alias(n) for n, v in values.items()]),
    )
    return df.withColumn("_x", F.explode(ends)).select(*[c for c in df.columns if c not in ("_s", "_e")], "_x.*")


def _speaker_time(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Stretches in which a speaker talks: call_id, _bin, is_ref, speaker, _s, _e.

    Segments are cut at the borders of time bins, so a bin is swept by itself. In
    it the overlaps of one speaker with itself are removed. The tasks follow
    the number of pieces, not their bytes, which say little of what a sort needs.
    """
    sides = [
        align.binned(df.filter(F.col("end_ms") > F.col("start_ms")), align.ALIGN_BIN_MS).select(
            "call_id", "_bin", F.lit(is_ref).alias("is_ref"), "speaker", "_s", "_e"
        )
        for df, is_ref in ((reference, True), (hypothesis, False))
    ]
    pieces = settle(sides[0].unionByName(sides[1]))
    edges = _edges(_by_bin(pieces), {"d": F.lit(1)})
    return settle(
        _swept(edges, ["call_id", "_bin", "is_ref", "speaker"], ["d"]).filter(F.col("d") > 0).drop("d")
    )


def _by_bin(pieces: DataFrame) -> DataFrame:
    """Pieces dealt by call and bin to as many tasks as their number asks for."""
    spark = pieces.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-2 * pieces.count() // EDGES_A_TASK))
    return pieces.repartition(tasks, "call_id", "_bin")


def _best_total(matrix: np.ndarray) -> float:
    """Largest total of a one-to-one assignment of rows to columns."""
    if matrix.shape[0] > matrix.shape[1]:
        matrix = matrix.T
    return _assignment_by_potentials(matrix) if matrix.size else 0.0


def _assignment_by_potentials(gain: np.ndarray) -> float:
    """Assignment for wide matrices (rows <= columns) by shortest augmenting paths."""
    n, m = gain.shape
    cost = -gain
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], col = i, 0
        low = np.full(m + 1, np.inf)
        came = np.zeros(m + 1, int)
        used = np.zeros(m + 1, bool)
        while owner[col]:
            used[col] = True
            row = owner[col]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[row - 1, free - 1] - u[row] - v[free]
            better = slack < low[free]
            low[free[better]] = slack[better]
            came[free[better]] = col
            nxt = free[np.argmin(low[free])]
            delta = low[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            col = nxt
        while col:
            owner[col] = owner[came[col]]
            col = came[col]
    taken = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return float(sum(gain[i, j] for i, j in taken))


def _mapped_time(cells: pd.Series) -> pd.Series:
    """Time of the best speaker mapping per call, from its (ref, hyp, ms) cells."""
    out = []
    for call in cells:
        triples = [(c["ref"], c["hyp"], c["ms"]) for c in call]
        refs = {r: i for i, r in enumerate(sorted({t[0] for t in triples}))}
        hyps = {h: i for i, h in enumerate(sorted({t[1] for t in triples}))}
        matrix = np.zeros((len(refs), len(hyps)))
        for r, h, ms in triples:
            matrix[refs[r], hyps[h]] += ms
        out.append(_best_total(matrix))
    return pd.Series(out)


def der(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Error rate and its components per call, times in milliseconds.

    Speaker labels need not agree: the best one-to-one mapping is used. Both
    tables: call_id, speaker, start_ms, end_ms. Calls without reference speech
    have no rate (NULL).
    """
    active = _by_bin(_speaker_time(reference, hypothesis))

    # how many speakers talk in each stretch between two changes
    one = F.lit(1)
    changes = _edges(
        active.drop("speaker"), {"nr": F.when(F.col("is_ref"), one).otherwise(0), "nh": F.when(F.col("is_ref"), 0).otherwise(one)}
    )
    length = F.col("_e") - F.col("_s")
    sums = _swept(changes.drop("is_ref"), ["call_id", "_bin"], ["nr", "nh"]).groupBy("call_id").agg(
        F.sum(length * F.col("nr")).alias("total_ms"),
        F.sum(length * F.greatest(F.col("nr") - F.col("nh"), F.lit(0))).alias("missed_ms"),
        F.sum(length * F.greatest(F.col("nh") - F.col("nr"), F.lit(0))).alias("false_alarm_ms"),
        F.sum(length * F.least("nr", "nh")).alias("both_ms"),
    )

    # how long each pair of speakers talks at the same time
    def side(is_ref: bool, name: str) -> DataFrame:
        return active.filter(F.col("is_ref") == is_ref).select("call_id", F.col("speaker").alias(name), "_bin", "_s", "_e")

    together = (
        align.overlap_times(side(True, "ref"), side(False, "hyp"))
        .groupBy("call_id", "ref", "hyp")
        .agg(F.sum("overlap_ms").cast("double").alias("ms"))
        .groupBy("call_id")
        .agg(F.collect_list(F.struct("ref", "hyp", "ms")).alias("cells"))
        .select("call_id", F.pandas_udf(_mapped_time, T.DoubleType())("cells").alias("correct_ms"))
    )
    joined = sums.join(together, "call_id", "left").withColumn(
        "correct_ms", F.coalesce("correct_ms", F.lit(0.0)).cast("bigint")
    )
    confusion = F.col("both_ms") - F.col("correct_ms")
    return joined.select(
        "call_id",
        F.when(
            F.col("total_ms") > 0,
            (F.col("missed_ms") + F.col("false_alarm_ms") + confusion) / F.col("total_ms"),
        ).alias("der"),
        "correct_ms",
        confusion.alias("confusion_ms"),
        "missed_ms",
        "false_alarm_ms",
        "total_ms",
    )
