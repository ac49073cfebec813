"""Speakers of a call: average-linkage clustering of segment embeddings.

With unit vectors the mean cosine similarity of two clusters is the product of
their vector sums over the product of their sizes, so a cluster is a sum and a
size, and clusters of any age are merged the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import blocks
from callweave.session import settle

GROUP_LIMIT = 4000  # clusters of one call that one task compares
PAIR_BLOCK = 1000
DIGITS = 12  # of a distance; closer ones are ties, and the smaller numbers win
SEGMENT_BLOCK = 1 << 16


def _merge_down(sums: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Group number of every given cluster after merging down to k groups.

    The merges are those of `_round`, made on one matrix: all pairs that are each
    other's nearest merge, but for the k-1 farthest; the closest never waits.
    """
    n, sums, weight = len(sizes), sums.copy(), sizes.astype(float)
    each = np.arange(n)
    group, dead = each.copy(), np.zeros(n, bool)

    def distances(rows: np.ndarray) -> np.ndarray:
        d = np.round(1.0 - (sums[rows] @ sums.T) / np.outer(weight[rows], weight), DIGITS)
        d[:, dead] = np.inf
        d[np.arange(len(rows)), rows] = np.inf
        return d

    dist = distances(each)
    while n - dead.sum() > k:
        near = dist.argmin(axis=1)
        best = dist[each, near]
        pairs = np.flatnonzero((near[near] == each) & (each < near) & np.isfinite(best))
        pairs = pairs[np.lexsort((pairs, best[pairs]))]
        # in order of distance: the closest, then all but the last k-1
        merged = pairs[: max(1, len(pairs) - k + 1)]
        gone = near[merged]
        np.add.at(sums, merged, sums[gone])
        weight[merged] += weight[gone]
        into = each.copy()
        into[gone] = merged
        group = into[group]
        dead[gone] = True
        dist[gone], dist[:, gone] = np.inf, np.inf
        fresh = distances(merged)
        dist[merged], dist[:, merged] = fresh, fresh.T
    return group


def _unit_clusters(segments: DataFrame) -> DataFrame:
    """Every segment as a cluster of one: unit vector and size 1."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(F.col("_v"), F.lit(0.0), lambda a, x: a + x * x))
    return (
        segments.withColumn("_v", v)
        .withColumn("_norm", norm)
        .select(
            "call_id",
            F.col("seg_idx").alias("cid"),
            F.transform("_v", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0)).alias("vec"),
            F.lit(1).cast("bigint").alias("n"),
        )
    )


def _group_calls(clusters: DataFrame, k: int) -> DataFrame:
    """Group number of every cluster, calls as runs of sorted rows.

    A batch holds many calls, so a call of few segments costs its merges only; the
    last call of a batch waits for the next one, as it may go on there.
    """
    kind = clusters.schema["call_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = (table if waiting is None else pa.concat_tables([waiting, table])).combine_chunks()
            starts = _call_starts(rows)
            waiting = rows.slice(starts[-1])
            yield from _grouped(rows.slice(0, starts[-1]), starts, k)
        if waiting is not None:
            yield from _grouped(waiting, np.array([0, len(waiting)]), k)

    return (
        clusters.select("call_id", F.col("cid").cast("bigint").alias("cid"), "vec", "n")
        .repartition("call_id")
        .sortWithinPartitions("call_id", "cid")
        .mapInArrow(run, f"call_id {kind}, cid bigint, cluster bigint")
    )


def _call_starts(rows: pa.Table) -> np.ndarray:
    """Positions of the first rows of the calls in sorted rows."""
    ids = rows["call_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.append(0, np.flatnonzero(np.diff(ids)) + 1)


def _grouped(rows: pa.Table, starts: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Whole calls with their group numbers; `starts` ends with the number of rows."""
    if not len(rows):
        return
    vecs, sizes = rows["vec"].combine_chunks(), rows["n"].to_numpy()
    lengths = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(lengths)).astype(int) if not vecs.null_count else None
    if ends is None or any(np.ptp(lengths[a:b]) for a, b in zip(starts, starts[1:])):
        raise ValueError("the embeddings of a call need the same length")
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    groups = [
        _merge_down(flat[ends[a] : ends[b]].reshape(b - a, -1) if ends[b] > ends[a] else np.zeros((b - a, 0)), sizes[a:b], k)
        for a, b in zip(starts, starts[1:])
    ]
    out = pa.table({"call_id": rows["call_id"], "cid": rows["cid"], "cluster": np.concatenate(groups)})
    yield from out.to_batches()


def _nearest(clusters: DataFrame) -> DataFrame:
    """Nearest other cluster of every cluster: call_id, cid, n, vec, dist, other.

    The clusters of a call are packed into blocks and every pair of blocks is one
    matrix product; only the nearest of each cluster leaves it.
    """
    counts = clusters.groupBy("call_id").agg(F.count(F.lit(1)).alias("_m"))
    numbered = clusters.join(counts, "call_id").withColumn("_nb", F.ceil(F.col("_m") / PAIR_BLOCK).cast("bigint"))
    packed = (
        numbered.withColumn("_b", F.pmod(F.xxhash64("cid"), F.col("_nb")))
        .groupBy("call_id", "_nb", "_b")
        .agg(F.collect_list(F.struct("cid", "vec", "n")).alias("a"))
        .select(
            "call_id",
            "_nb",
            "_b",
            F.transform("a", lambda x: x["cid"]).alias("ids"),
            F.flatten(F.transform("a", lambda x: x["vec"])).alias("vecs"),
            F.transform("a", lambda x: x["n"]).alias("ns"),
        )
    )
    left = packed.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1))).drop("_nb", "_b")
    right = packed.select(
        "call_id", F.col("_b").alias("_o"), F.col("ids").alias("ids2"), F.col("vecs").alias("vecs2"),
        F.col("ns").alias("ns2"),
    )
    kind = clusters.schema["call_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = np.asarray(row.ids), np.asarray(row.ids2)
                u = np.asarray(row.vecs, float).reshape(len(a), -1)
                v = np.asarray(row.vecs2, float).reshape(len(b), -1)
                dist = np.round(1.0 - (u @ v.T) / np.outer(row.ns, row.ns2), DIGITS)
                dist[a[:, None] == b[None, :]] = np.inf
                order = np.argsort(b)
                at = order[dist[:, order].argmin(axis=1)]
                yield pd.DataFrame(
                    {"call_id": row.call_id, "cid": a, "dist": dist[np.arange(len(a)), at], "other": b[at]}
                )

    near = left.join(right, ["call_id", "_o"]).mapInPandas(
        run, f"call_id {kind}, cid bigint, dist double, other bigint"
    )
    return near.groupBy("call_id", "cid").agg(F.min(F.struct("dist", "other")).alias("_x")).select(
        "call_id", "cid", "_x.dist", "_x.other"
    )


def _round(clusters: DataFrame, k: int) -> DataFrame:
    """One round of merges for large calls: (call_id, cid, into).

    Two clusters that are each other's nearest merge in any case, so all such
    pairs of a round merge together. The k-1 farthest pairs of a call wait, as
    they may be merges that the final cut leaves out; the closest never waits.
    """
    near = _nearest(clusters)
    other = near.select("call_id", F.col("cid").alias("other"), F.col("other").alias("cid"), F.lit(True).alias("mutual"))
    pairs = near.join(other, ["call_id", "cid", "other"]).filter(F.col("cid") < F.col("other"))
    far = Window.partitionBy("call_id", "_salt").orderBy(F.desc("dist"), F.desc("cid"))
    farthest = (
        pairs.withColumn("_salt", F.pmod(F.xxhash64("cid"), F.lit(256)))
        .withColumn("_r", F.row_number().over(far))
        .filter(F.col("_r") <= k - 1)
        .withColumn("_r", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("dist"), F.desc("cid"))))
        .filter(F.col("_r") <= k - 1)
        .select("call_id", "cid")
    )
    closest = pairs.groupBy("call_id").agg(F.min(F.struct("dist", "cid")).alias("_c")).select("call_id", "_c.cid")
    waiting = farthest.join(closest, ["call_id", "cid"], "left_anti")
    return pairs.join(waiting, ["call_id", "cid"], "left_anti").select(
        "call_id", F.col("other").alias("cid"), F.col("cid").alias("into")
    )


def _shrink(clusters: DataFrame, k: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Merges the clusters of large calls until each call has at most `limit`.

    Returns the remaining clusters and (call_id, seg_idx, cid). Every round is a
    distributed job whose result is written to the shared folder, so a lost
    executor costs one round at most.
    """
    members = clusters.select("call_id", F.col("cid").alias("seg_idx"), "cid")
    while True:
        busy = clusters.groupBy("call_id").count().filter(F.col("count") > limit).select("call_id")
        if busy.isEmpty():
            return clusters, members
        moves = settle(_round(clusters.join(busy, "call_id", "left_semi"), k))
        members = settle(
            members.join(moves, ["call_id", "cid"], "left").select(
                "call_id", "seg_idx", F.coalesce("into", "cid").alias("cid")
            )
        )
        # Both sides of a merge come as one row each; sums of vectors add up by position.
        moved = clusters.join(moves, ["call_id", "cid"], "left").withColumn("cid", F.coalesce("into", "cid"))
        clusters = settle(
            moved.groupBy("call_id", "cid")
            .agg(F.collect_list("vec").alias("_vs"), F.sum("n").alias("n"))
            .select(
                "call_id",
                "cid",
                F.aggregate(
                    F.slice("_vs", 2, 1), F.get("_vs", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y)
                ).alias("vec"),
                "n",
            )
        )


def cluster_speakers(segments: DataFrame, k: int = 2, limit: int = GROUP_LIMIT) -> DataFrame:
    """Cluster number per segment: call_id, seg_idx, cluster.

    segments: call_id, seg_idx, embedding. A call with up to `limit` segments is
    grouped in one task, many calls a batch. Larger ones are first reduced by distributed rounds
    that make the same merges; a call with no more than k segments keeps them
    apart.
    """
    clusters = _unit_clusters(segments)
    large = (
        segments.groupBy("call_id").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > limit).select("call_id")
    )
    if large.isEmpty():
        return _group_calls(clusters, k).withColumnRenamed("cid", "seg_idx")
    small = _group_calls(clusters.join(large, "call_id", "left_anti"), k).withColumnRenamed("cid", "seg_idx")
    reduced, members = _shrink(clusters.join(large, "call_id", "left_semi"), k, limit)
    grouped = members.join(_group_calls(reduced, k), ["call_id", "cid"]).select("call_id", "seg_idx", "cluster")
    return small.unionByName(grouped)


def relabel_first_seen(clustered: DataFrame) -> DataFrame:
    """SPEAKER_NN per cluster in the order of first appearance in the call."""
    first = clustered.groupBy("call_id", "cluster").agg(F.min("seg_idx").alias("first"))
    numbered = blocks.dense_index(first, ["call_id"], ["first"], SEGMENT_BLOCK, "_n").select(
        "call_id", "cluster", F.format_string("SPEAKER_%02d", F.col("_n")).alias("speaker")
    )
    return clustered.join(numbered, ["call_id", "cluster"])
