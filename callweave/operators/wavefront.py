"""Alignment of pairs of texts too large for one task: blocks of the distance table, one anti-diagonal after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.session import settle

BLOCK_WORDS = 4096

_FAR = np.int32(1 << 29)
_EDGES = "pair bigint, bi int, bj int, bottom array<int>, bottom_ins array<int>, right array<int>, right_ins array<int>"


def trimmed(ref: Column, hyp: Column) -> tuple[Column, Column]:
    """Arrays of words without the equal words at both ends, which always match."""
    for _ in range(2):
        # the second turn trims the other end and puts the words back in order
        same = F.zip_with(ref, hyp, lambda a, b: F.coalesce(a == b, F.lit(False)))
        first = F.array_position(same, False)
        n = F.when(first > 0, first - 1).otherwise(F.least(F.size(ref), F.size(hyp)))
        ref, hyp = (F.reverse(F.slice(w, (n + 1).cast("int"), F.greatest(F.size(w) - n, F.lit(0)).cast("int"))) for w in (ref, hyp))
    return ref, hyp


def align_long(pairs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Distance and insertions of the alignment of each pair: (pair, distance, insertions).

    `pairs`: pair (bigint, unique), ref and hyp (arrays of words, not both empty). The table of a pair is cut in blocks; those
    of an anti-diagonal depend on the last one only, through their edges, and run side by side. Only blocks within a
    band around the diagonal are computed; a pair whose distance is not below its band is done again with twice the band, so the
    result is that of the whole table. Ties are broken as for small pairs.
    """
    spark = pairs.sparkSession
    chunk = lambda words: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / block_words), F.lit(0)).cast("int")),
        lambda i: F.slice(words, i * block_words + 1, block_words),
    )
    words = settle(
        pairs.select("pair", F.explode(F.array(F.lit("ref"), F.lit("hyp"))).alias("side"), "ref", "hyp").select(
            "pair", "side", F.posexplode(chunk(F.when(F.col("side") == "ref", F.col("ref")).otherwise(F.col("hyp")))).alias("i", "words")
        )
    )
    # words that only one side has, repeats counted, must be edited: the band begins there
    bag = words.select("pair", F.explode("words").alias("w"), F.when(F.col("side") == "ref", 1).otherwise(-1).alias("n"))
    surplus = bag.groupBy("pair", "w").agg(F.sum("n").alias("n")).groupBy("pair").agg(
        F.greatest(F.sum(F.greatest("n", F.lit(0))), F.sum(F.greatest(-F.col("n"), F.lit(0)))).alias("apart")
    )
    sizes = words.groupBy("pair").agg(
        *[F.sum(F.when(F.col("side") == s, F.size("words")).otherwise(0)).alias(f"n_{s}") for s in ("ref", "hyp")],
        *[F.max(F.when(F.col("side") == s, F.col("i"))).alias(f"last_{s}") for s in ("ref", "hyp")],
    )
    open_pairs = settle(sizes.join(surplus, "pair", "left").withColumn("band", (F.coalesce("apart", F.lit(0)) * 3 / 2 + block_words).cast("bigint")).drop("apart"))
    done = None
    while not open_pairs.isEmpty():
        results = settle(_table(open_pairs, words, block_words))
        checked = open_pairs.join(results, "pair").withColumn("_good", F.col("distance") < F.col("band"))
        good = checked.where("_good").select("pair", "distance", "insertions")
        done = good if done is None else done.unionByName(good)
        open_pairs = settle(checked.where("NOT _good").withColumn("band", F.col("band") * 2).select(*open_pairs.columns))
    return done if done is not None else spark.createDataFrame([], "pair bigint, distance int, insertions int")


def _table(open_pairs: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Last cells of the tables, block by block within the bands."""
    rounds = open_pairs.agg(F.max(F.col("last_ref") + F.col("last_hyp"))).first()[0] + 1
    last, corners = None, []
    for k in range(rounds):
        blocks = _diagonal(open_pairs, k, size)
        for side, at in (("ref", "bi"), ("hyp", "bj")):
            part = words.where(F.col("side") == side).select("pair", F.col("i").alias(at), F.col("words").alias(side))
            blocks = blocks.join(part, ["pair", at])
        edges = _no_edges(open_pairs) if last is None else last
        above = edges.select("pair", (F.col("bi") + 1).alias("bi"), "bj", F.col("bottom").alias("top"), F.col("bottom_ins").alias("top_ins"))
        beside = edges.select("pair", "bi", (F.col("bj") + 1).alias("bj"), F.col("right").alias("left"), F.col("right_ins").alias("left_ins"))
        ready = blocks.join(above, ["pair", "bi", "bj"], "left").join(beside, ["pair", "bi", "bj"], "left")
        columns = ["pair", "bi", "bj", "ref", "hyp", "top", "top_ins", "left", "left_ins"]
        last = settle(ready.select(*columns).repartition("pair", "bi").mapInPandas(lambda batches: _fill(batches, size), _EDGES))
        corner = last.join(open_pairs, "pair").where((F.col("bi") == F.col("last_ref")) & (F.col("bj") == F.col("last_hyp")))
        corners.append(corner.select("pair", *[F.element_at(c, -1).alias(n) for c, n in (("bottom", "distance"), ("bottom_ins", "insertions"))]))
    out = corners[0]
    for c in corners[1:]:
        out = out.unionByName(c)
    return out


def _no_edges(pairs: DataFrame) -> DataFrame:
    return pairs.sparkSession.createDataFrame([], _EDGES)


def _diagonal(pairs: DataFrame, k: int, size: int) -> DataFrame:
    """Blocks of an anti-diagonal that the band of their pair touches."""
    low = F.greatest(F.lit(0), k - F.col("last_hyp"))
    high = F.least(F.lit(k), F.col("last_ref"))
    bi = F.explode(F.sequence(low, high)).alias("bi")
    on = pairs.where(low <= high).select("pair", "band", bi).withColumn("bj", F.lit(k) - F.col("bi"))
    return on.where((F.abs(F.col("bi") - F.col("bj")) - 1) * size < F.col("band")).drop("band")


def _fill(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for b in frame.itertuples(index=False):
            ref, hyp = list(b.ref), list(b.hyp)
            codes = pd.factorize(np.array([*ref, *hyp], dtype=object))[0]
            # a block without neighbour lies on the border of the table or of the band
            top = _border(b.top, b.top_ins, b.bi == 0, b.bj * size, len(hyp), True)
            left = _border(b.left, b.left_ins, b.bj == 0, b.bi * size, len(ref), False)
            if b.top is None:
                top[0][0], top[1][0] = left[0][0], left[1][0]
            if b.left is None:
                left[0][0], left[1][0] = top[0][0], top[1][0]
            rows.append((b.pair, b.bi, b.bj, *fill_block(codes[: len(ref)], codes[len(ref) :], top, left)))
        yield pd.DataFrame(rows, columns=["pair", "bi", "bj", "bottom", "bottom_ins", "right", "right_ins"])


def _border(edge, inserted, outer: bool, start: int, n: int, along_hyp: bool) -> list[np.ndarray]:
    if edge is not None:
        return [np.array(edge, np.int32), np.array(inserted, np.int32)]
    counts = np.arange(start, start + n + 1, dtype=np.int32)
    if not outer:
        return [np.full(n + 1, _FAR), np.zeros(n + 1, np.int32)]
    return [counts, counts.copy() if along_hyp else np.zeros(n + 1, np.int32)]


def fill_block(ref: np.ndarray, hyp: np.ndarray, top: list[np.ndarray], left: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Bottom and right edge of a block (distances and insertions), corners included, from its top and left edge."""
    steps = np.arange(len(hyp) + 1, dtype=np.int32)
    old, had = top
    right, right_ins = [old[-1]], [had[-1]]
    for i in range(len(ref)):
        best = old + 1
        np.minimum(best[1:], old[:-1] + (hyp != ref[i]), out=best[1:])
        best[0] = left[0][i + 1]
        new = np.minimum.accumulate(best - steps) + steps
        deletion = new == old + 1
        insertion = np.zeros(len(new), bool)
        insertion[1:] = ~deletion[1:] & (new[:-1] < old[:-1])
        carried = np.where(deletion, had, np.concatenate([had[:1], had[:-1]]))
        carried[0] = left[1][i + 1]
        source = np.maximum.accumulate(np.where(insertion, 0, steps))
        had = carried[source] + (steps - source)
        old = new
        right.append(old[-1])
        right_ins.append(had[-1])
    return old, had, np.array(right, np.int32), np.array(right_ins, np.int32)
