"""Quality rules for transcripts: how much of a text repeats itself."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import WORD, free_name, short_batches

# Most characters in repeated n-grams of a length, in percent of all characters in words.
NGRAM_LIMITS = {5: 30, 7: 28, 10: 25}
LINE_LIMIT = 30
# Most symbols per hundred words.
SYMBOL_LIMIT = 10
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_WORDS, REPEAT_LIMIT = 3, 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def repetition(text: Column, lengths: Iterable[int] = tuple(NGRAM_LIMITS)) -> Column:
    """The counts of a text as a struct; see `assess_quality`."""
    lengths = tuple(sorted(lengths))
    fields = [*COUNTS, *(f"dup_chars_{n}" for n in lengths)]
    return F.arrow_udf(_counter(lengths, fields), f"struct<{', '.join(f'{f}: bigint' for f in fields)}>")(text)


def verdict(
    counts: str, ngram_limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT, symbol_limit: int = SYMBOL_LIMIT
) -> dict[str, Column]:
    """base_failed and kept, from a struct column made by `repetition`."""
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits
    c = {f: F.col(f"{counts}.{f}") for f in [*COUNTS, *(f"dup_chars_{n}" for n in limits)]}
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_LIMIT * c["n_words"])
    bad = (100 * c["dup_line_chars"] > line_limit * c["word_chars"]) | (100 * c["n_symbols"] > symbol_limit * c["n_words"])
    for n, limit in limits.items():
        bad = bad | (100 * c[f"dup_chars_{n}"] > limit * c["word_chars"])
    return {"base_failed": failed, "kept": ~(failed | bad)}


def assess_quality(
    calls: DataFrame, key: str = "call_id", text: str = "text", ngram_limits: dict[int, int] | None = None
) -> DataFrame:
    """Judges whole transcripts by the share of their characters that repeat.

    Words are what ASCII white space separates. Each word is one number; rolling
    hashes of several n-gram lengths run over these numbers, and a word counts for
    a length when it lies in an n-gram that the text holds twice or more, the first
    one included. A line counts when an earlier line equals it.

    Returns `key`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (words in repeated n-grams of 3), dup_line_chars, dup_chars_<n> for each length,
    base_failed (fewer than 50 words, or over half of them in n_repeat_words) and
    kept (not failed, and no share above its limit). Other columns are not read. A
    null text has no words and is not kept; an empty table gives an empty result.
    """
    counted = short_batches(calls).select(F.col(key), repetition(F.col(text), ngram_limits or NGRAM_LIMITS).alias("_counts"))
    return counted.select(key, "_counts.*", *(c.alias(n) for n, c in verdict("_counts", ngram_limits).items()))


def keep_good(calls: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    counts = free_name(calls, "_counts")
    counted = short_batches(calls).withColumn(counts, repetition(F.col(text)))
    return counted.where(verdict(counts)["kept"]).drop(counts)


def _counter(lengths: tuple[int, ...], fields: list[str]) -> Callable[[pa.Array], pa.Array]:
    def count(texts: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), len(fields)), np.int64)
        for i, text in enumerate(texts):
            value = text.as_py()
            if value:
                rows[i] = repeated(value, lengths)
        return pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(len(fields))], names=fields)

    return count


_words = re.compile(WORD).findall
# a random odd number; products wrap around at 64 bits
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeated(text: str, lengths: tuple[int, ...]) -> list[int]:
    """The counts of one text, in the order of the fields."""
    words = _words(text)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            chars = sum(map(len, _words(line)))
            dup_lines += chars > 0
            dup_line_chars += chars
        seen.add(line)
    covered = coverage(words, sorted({REPEAT_WORDS, *lengths}))
    chars = [int(sizes[covered[k]].sum()) if k in covered else 0 for k in lengths]
    repeats = int(covered[REPEAT_WORDS].sum()) if REPEAT_WORDS in covered else 0
    return [n, int(sizes.sum()), symbols, dup_lines, repeats, dup_line_chars, *chars]


def coverage(words: list[str], lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length, which words lie in an n-gram that occurs twice or more; lengths without any are left out."""
    # only equality inside this text matters, so the hash of this process will do
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled, width, found = one, 1, {}
    for n in lengths:
        if len(words) <= n:
            break
        while width < n:
            rolled = rolled[:-1] * _STEP + one[width:]
            width += 1
        ordered = np.sort(rolled)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            break  # a longer n-gram can't repeat where a shorter one doesn't
        starts = np.flatnonzero(np.isin(rolled, twice))
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + n, -1)
        found[n] = np.cumsum(edges)[:-1] > 0
    return found
