"""Word error rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions import blocks
from callweave.functions import text as tx
from callweave.operators import wavefront
from callweave.session import settle

_COUNTS = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions", "hits")]
)


def join_segments(segments: DataFrame) -> DataFrame:
    """One hypothesis per call: its segments joined by a space in order; like the reference in the manifest, it is one cell."""
    return blocks.joined_texts(segments, ["call_id"], "seg_idx", "text", "hypothesis")


CELLS = 1 << 18  # table cells one batch of alignments may keep
PAIRS = 256  # pairs of texts that are words at the same time


def _trimmed(ref: np.ndarray, hyp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the equal words at both ends, which always match."""
    top = min(len(ref), len(hyp))
    differs = np.flatnonzero(ref[:top] != hyp[:top])
    low = int(differs[0]) if len(differs) else top
    ref, hyp = ref[low:], hyp[low:]
    top = min(len(ref), len(hyp))
    differs = np.flatnonzero(ref[::-1][:top] != hyp[::-1][:top])
    cut = int(differs[0]) if len(differs) else top
    return ref[: len(ref) - cut], hyp[: len(hyp) - cut]


def _batch_edits(refs: list[np.ndarray], hyps: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(S, D, I) of minimal alignments of many pairs, longest reference first.

    The distance is unique, its split is not. Read from the end, a deletion is
    taken where one is minimal, then an insertion where the cell to the left is
    below the diagonal one, otherwise the diagonal. One row of the distance tables
    of all pairs is computed at a time; only the number of insertions is carried
    along, the other counts follow from it.
    """
    width = max(len(h) for h in hyps)
    steps = np.arange(width + 1, dtype=np.int32)
    hyp = np.full((len(hyps), width), -2, np.int32)
    ref = np.full((len(refs), max(len(refs[0]), 1)), -1, np.int32)
    for k, (r, h) in enumerate(zip(refs, hyps)):
        ref[k, : len(r)], hyp[k, : len(h)] = r, h
    sizes = np.array([len(r) for r in refs])
    dist = np.tile(steps, (len(refs), 1))
    ins = dist.copy()
    for i in range(len(refs[0])):
        k = int(np.searchsorted(-sizes, -i, side="left"))  # pairs with more than i words
        old, had = dist[:k], ins[:k]
        best = old + 1
        np.minimum(best[:, 1:], old[:, :-1] + (hyp[:k] != ref[:k, i, None]), out=best[:, 1:])
        new = np.minimum.accumulate(best - steps, axis=1) + steps
        deletion = new == old + 1
        insertion = np.zeros_like(deletion)
        insertion[:, 1:] = ~deletion[:, 1:] & (new[:, :-1] < old[:, :-1])
        carried = had.copy()
        carried[:, 1:] = np.where(deletion[:, 1:], had[:, 1:], had[:, :-1])
        source = np.maximum.accumulate(np.where(insertion, 0, steps), axis=1)
        ins[:k] = np.take_along_axis(carried, source, axis=1) + (steps - source)
        dist[:k] = new
    out = []
    for k, (r, h) in enumerate(zip(refs, hyps)):
        inserted, total = int(ins[k, len(h)]), int(dist[k, len(h)])
        deleted = inserted + len(r) - len(h)
        out.append((total - inserted - deleted, deleted, inserted))
    return out


def _word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Edits of pairs whose words come joined by a space; the words of a few pairs exist at the same time."""
    parts = [_some_edits(reference.iloc[i : i + PAIRS], hypothesis.iloc[i : i + PAIRS]) for i in range(0, len(reference), PAIRS)]
    return pd.concat(parts, ignore_index=True) if parts else _some_edits(reference, hypothesis)


def _some_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    pairs, sizes = [], []
    for joined_ref, joined_hyp in zip(reference, hypothesis):
        # no word is empty, and none holds a space
        ref, hyp = (t.split(" ") if t else [] for t in (joined_ref, joined_hyp))
        code: dict[str, int] = {}
        codes = np.array([code.setdefault(w, len(code)) for words in (ref, hyp) for w in words], np.int32)
        sizes.append(len(ref))
        pairs.append(_trimmed(codes[: len(ref)], codes[len(ref) :]))
    order = sorted(range(len(pairs)), key=lambda k: -len(pairs[k][0]))
    edits: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    at = 0
    while at < len(order):
        width, stop = 0, at
        while stop < len(order):
            width = max(width, len(pairs[order[stop]][1]) + 1)
            if stop > at and (stop - at + 1) * width > CELLS:
                break
            stop += 1
        batch = order[at:stop]
        for k, e in zip(batch, _batch_edits([pairs[k][0] for k in batch], [pairs[k][1] for k in batch])):
            edits[k] = e
        at = stop
    frame = pd.DataFrame(edits, columns=["substitutions", "deletions", "insertions"])
    frame["hits"] = np.array(sizes, int) - frame["substitutions"] - frame["deletions"]
    return frame


# A pair with more table cells than this is aligned in blocks by many tasks.
WHOLE_CELLS = 1 << 25


def call_wer(pairs: DataFrame, whole_cells: int = WHOLE_CELLS, block_words: int = wavefront.BLOCK_WORDS) -> DataFrame:
    """Adds word counts of the alignment and the error rate per pair.

    The rate is NULL for an empty reference. pairs: reference, hypothesis. Pairs whose texts could fill more than
    `whole_cells` cells of the distance table are aligned in blocks; the counts do not depend on it.
    """
    room = (F.length(F.coalesce("reference", F.lit(""))) + 1) * (F.length(F.coalesce("hypothesis", F.lit(""))) + 1)
    # a word takes two characters at least
    large = room > 4 * whole_cells
    pairs = settle(pairs)  # read once to look for large ones, once to align the others
    whole = _with_rates(_whole_edits(pairs.where(~large)))
    if pairs.where(large).isEmpty():
        return whole
    return whole.unionByName(_with_rates(_block_edits(pairs.where(large), block_words)))


def _with_words(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({f"_{c[0]}": tx.normal_words(F.coalesce(c, F.lit(""))) for c in ("reference", "hypothesis")})


def _whole_edits(pairs: DataFrame) -> DataFrame:
    words = [F.array_join(c, " ") for c in ("_r", "_h")]
    return _with_words(pairs).withColumn("_e", F.pandas_udf(_word_edits, _COUNTS)(*words))


def _block_edits(pairs: DataFrame, block_words: int) -> DataFrame:
    numbered = settle(_with_words(pairs).withColumn("_pair", F.monotonically_increasing_id()))
    ref, hyp = wavefront.trimmed(F.col("_r"), F.col("_h"))
    cut = settle(numbered.select(F.col("_pair").alias("pair"), ref.alias("ref"), hyp.alias("hyp")))
    edits = wavefront.align_long(cut.where((F.size("ref") > 0) | (F.size("hyp") > 0)), block_words)
    total, inserted = (F.coalesce(c, F.lit(0)) for c in ("distance", "insertions"))
    deleted = inserted + F.size("_r") - F.size("_h")
    counts = (total - inserted - deleted, deleted, inserted, F.size("_r") - (total - inserted))
    named = [c.cast("int").alias(f.name) for c, f in zip(counts, _COUNTS)]
    return numbered.join(edits, F.col("_pair") == F.col("pair"), "left").withColumn("_e", F.struct(*named)).drop("_pair", "pair", "distance", "insertions")


def _with_rates(counted: DataFrame) -> DataFrame:
    names = ("substitutions", "deletions", "insertions", "hits")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return (
        counted.withColumn("reference_words", F.size("_r").cast("bigint"))
        .withColumns({n: F.col(f"_e.{n}").cast("bigint") for n in names})
        .withColumn("wer", F.when(F.col("reference_words") > 0, errors / F.col("reference_words")))
        .drop("_r", "_h", "_e")
    )


def corpus_wer(scored: DataFrame) -> DataFrame:
    """Errors over reference words of all calls with a reference; not a mean of rates."""
    usable = scored.filter(F.col("reference_words") > 0)
    names = ("substitutions", "deletions", "insertions", "hits", "reference_words")
    sums = usable.agg(F.count(F.lit(1)).alias("num_calls"), *[F.sum(n).alias(n) for n in names])
    return sums.withColumn(
        "wer",
        (F.col("substitutions") + F.col("deletions") + F.col("insertions")) / F.col("reference_words"),
    )


def rejected_pairs(scored: DataFrame) -> DataFrame:
    """Pairs whose error rate is undefined because the reference has no words."""
    return scored.filter(F.col("reference_words") == 0)


def worst_calls(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.orderBy(F.desc_nulls_last("wer"), "call_id").limit(n)
