"""Fingerprints of transcripts by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.session import settle

SAMPLES = 32
SPACES = r"[\x20\x09-\x0D]+"
ROWS_PER_BLOCK = 250
# bits of a draw, two of which and 12 more make a hash of 64
_BITS = 26
_MASK = (1 << _BITS) - 1
# bytes of a name that make a number, and how many such numbers are looked at
_NAME_BYTES = 7
_NAME_CODES = 4


def fingerprint_texts(calls: DataFrame, key: str = "call_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """The fingerprint of each transcript: one consistent weighted sample per hash function.

    Terms are the words of the whole text, weighted by how often they occur. Two
    texts agree in a sample with a probability equal to the sum over all words of
    the smaller count, divided by that of the larger count.

    Returns `key` and samples, an array of 64-bit numbers, null for a text without
    words. Other columns are not read. Rows with equal keys are taken together. An
    empty table gives an empty result.
    """
    terms = with_terms(calls.select(key, F.col(text).alias("_text")))
    sampled = terms.groupBy(key).agg(*(s.alias(f"_s{i}") for i, s in enumerate(weighted_samples(samples))))
    return sampled.select(key, signature(*(F.col(f"_s{i}") for i in range(samples))).alias("samples"))


def with_terms(rows: DataFrame) -> DataFrame:
    """A row per distinct word of the column _text, in place of it: its hash _term and its count _weight.

    Equal words are runs in the sorted hashes of all words, so counting needs no
    shuffle. A text without words keeps one row with nulls.
    """
    kept = [c for c in rows.columns if c != "_text"]
    words = F.array_remove(F.split(F.coalesce("_text", F.lit("")), SPACES), "")
    hashed = rows.select(*kept, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("_sorted"))
    n = F.size("_sorted")
    last = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == n) | (F.get("_sorted", i - 1) != F.get("_sorted", i)))
    )
    ended = hashed.select(*kept, "_sorted", last.alias("_last"))
    runs = F.arrays_zip("_last", F.slice(F.concat(F.array(F.lit(0)), F.col("_last")), F.lit(1), F.size("_last")).alias("_before"))
    found = ended.select(*kept, "_sorted", F.explode_outer(runs).alias("_run"))
    return found.select(
        *kept, F.get("_sorted", F.col("_run")["_last"] - 1).alias("_term"), (F.col("_run")["_last"] - F.col("_run")["_before"]).alias("_weight")
    )


def weighted_samples(samples: int = SAMPLES) -> list[Column]:
    """Aggregations over _term and _weight that give one sample per hash function.

    For a term of weight w, draws r and c from Gamma(2, 1) and b from (0, 1), all
    fixed by the term and the number of the sample: t = floor(ln w / r + b) is the
    step of w on a log grid, y = exp(r (t - b)) its start, a = c / (y exp(r)). The
    term with the smallest a is the sample. As a follows from the term and t, and no
    two terms have the same, the smallest a itself stands for the sample; here the
    largest -ln a is taken, which saves the powers.
    """
    return [F.max(_priority(i)) for i in range(samples)]


def _priority(i: int) -> Column:
    """-ln a of a term for sample i."""
    one, two = F.xxhash64("_term", F.lit(2 * i)), F.xxhash64("_term", F.lit(2 * i + 1))

    def part(bits: Column, shift: int) -> Column:
        return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(_MASK)) + F.lit(0.5)) / F.lit(float(1 << _BITS))

    # minus the logarithm of a product of two uniforms is a draw from Gamma(2, 1)
    r = -F.log(part(one, 0) * part(one, _BITS))
    c = -F.log(part(two, 0) * part(two, _BITS))
    # the upper 12 bits of both hashes, which the four draws leave over
    b = (F.shiftrightunsigned(one, 52) * 4096 + F.shiftrightunsigned(two, 52) + F.lit(0.5)) / F.lit(float(1 << 24))
    grid = F.floor(F.log(F.col("_weight").cast("double")) / r + b) - b
    return F.when(F.col("_term").isNotNull(), r * (grid + 1) - F.log(c))


def signature(*samples: Column) -> Column:
    """The samples as an array of 64-bit numbers, null where there are none."""
    return F.when(samples[0].isNotNull(), F.array(*[F.xxhash64(s) for s in samples]))


def likeness(one: Column, other: Column) -> Column:
    """Share of equal samples; two texts without words are alike, and unlike all others."""
    same = F.size(F.filter(F.zip_with(one, other, lambda a, b: a == b), lambda equal: equal))
    both, none = one.isNotNull() & other.isNotNull(), one.isNull() & other.isNull()
    return F.when(both, same / F.size(one)).otherwise(none.cast("double"))


def written(samples: Column) -> Column:
    """A fingerprint as text, 16 hexadecimal digits per sample; '' where there is none."""
    return F.coalesce(F.array_join(F.transform(samples, lambda s: F.lpad(F.hex(s), 16, "0")), ""), F.lit(""))


def compare_with_edits(
    calls: DataFrame, key: str = "call_id", text: str = "text", samples: int = SAMPLES, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Fingerprints of transcripts and of the same texts with a new end, and how alike they are.

    In descending order of the key, the first transcript following the last, the
    last floor(n / 2) characters of a text of n are replaced by as many from the
    beginning of the next one, or by all of it. Keys are of any orderable type: numbers,
    strings (compared as UTF-8), dates or timestamps.

    Rows fall into blocks of neighbouring keys, to each of which the first row of
    the block behind is added. So the order needs no global sort, each text is
    shuffled once, and all that follows stays where the block is. A block with too many rows is divided again
    by its own quartiles, at last by the digests of the texts; only equal rows, and names alike in their
    first 28 bytes, stay together.

    Returns `key`, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. Other columns are not read. A null text counts as an
    empty one. Rows without key come last; rows with equal keys follow each other
    in the order of the MD5 of their texts. An empty table gives an empty result.
    """
    pairs = neighbours(calls, key, text, rows_per_block)
    half = F.expr("length(_text) div 2").cast("int")
    edited = F.concat(F.col("_text").substr(F.lit(1), F.length("_text") - half), F.col("_next").substr(F.lit(1), half))
    own = F.struct(F.lit(False).alias("edited"), F.col("_text").alias("text"))
    both = F.array(own, F.struct(F.lit(True).alias("edited"), edited.alias("text")))
    # a row that was only added as a neighbour has no edited text here
    variants = pairs.select(
        "_block", "_row", "_end", "_key", F.length("_text").alias("_chars"), F.explode(F.when(F.col("_end"), F.array(own)).otherwise(both)).alias("_v")
    )
    place = ["_block", "_row"]
    carried = ["_end", "_key", "_chars"]
    digests = [f"_sha{i}" for i in range(4)]
    words = with_terms(
        variants.select(*place, *carried, "_v.edited", *(c.alias(n) for c, n in zip(_digest_parts(F.col("_v.text")), digests)), F.col("_v.text").alias("_text"))
    )
    names = [f"_s{i}" for i in range(samples)]
    sampled = words.groupBy(*place, "edited").agg(
        *(F.max(c).alias(c) for c in [*carried, *digests]), *(s.alias(n) for s, n in zip(weighted_samples(samples), names))
    )
    paired = sampled.groupBy(*place).agg(
        *(F.max(c).alias(c) for c in carried),
        *(F.max(F.when(F.col("edited"), F.col(c))).alias(c) for c in digests),
        *(F.max(F.when(~F.col("edited"), F.col(c))).alias(c) for c in names),
        *(F.max(F.when(F.col("edited"), F.col(c))).alias(f"_e{c}") for c in names),
    )
    prints = paired.select(
        *place, *carried, *digests, signature(*(F.col(c) for c in names)).alias("_own"), signature(*(F.col(f"_e{c}") for c in names)).alias("_edited")
    )
    following = prints.withColumn("_next", F.lead("_own").over(Window.partitionBy("_block").orderBy("_row")))
    return following.where(~F.col("_end")).select(
        F.col("_key").alias(key),
        F.col("_chars").cast("bigint").alias("n_chars"),
        F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in digests])).alias("edited_sha256"),
        written(F.col("_own")).alias("fingerprint"),
        written(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


def neighbours(calls: DataFrame, key: str, text: str, rows_per_block: int) -> DataFrame:
    """Rows in blocks with the text of the next row in descending order of the key."""
    rows = calls.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    blocked = _in_blocks(rows.withColumn("_digest", F.md5(F.col("_text").cast("binary"))), rows_per_block)
    down = [F.desc_nulls_last("_key"), F.asc("_digest")]
    heads = settle(blocked.groupBy("_block").agg(F.max(F.struct(F.col("_key").isNotNull().alias("has"), "_key")).alias("_head")))
    over = Window.partitionBy(F.lit(0)).orderBy(F.desc("_block"))
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # behind the last block comes the first one
    behind = settle(
        heads.select(
            F.col("_block").alias("_before"),
            F.coalesce(F.lead("_block").over(over), F.first("_block").over(whole)).alias("_block"),
        ).join(heads, "_block").select("_before", "_block", F.col("_head._key").alias("_head"))
    )
    at_head = F.col("_key").eqNullSafe(F.col("_head")) & (blocked["_block"] == behind["_block"])
    first_digest = blocked.join(behind, at_head).groupBy("_before", behind["_block"].alias("_in"), "_head").agg(F.min("_digest").alias("_least"))
    first_digest = settle(first_digest)
    first = F.col("_key").eqNullSafe(F.col("_head")) & (F.col("_block") == F.col("_in")) & (F.col("_digest") == F.col("_least"))
    ends = (
        blocked.join(first_digest, first).groupBy("_before").agg(*[F.any_value(c).alias(c) for c in ("_key", "_text", "_digest")])
        .select("_key", "_text", "_digest", F.col("_before").alias("_block"), F.lit(True).alias("_end"))
    )
    order = Window.partitionBy("_block").orderBy("_end", *down)
    return blocked.withColumn("_end", F.lit(False)).unionByName(ends).select(
        "_key", "_text", "_block", "_end", F.coalesce(F.lead("_text").over(order), F.lit("")).alias("_next"), F.row_number().over(order).alias("_row")
    )


def _in_blocks(rows: DataFrame, rows_per_block: int) -> DataFrame:
    """Adds _block, an array of numbers that falls with the order of the rows; blocks hold about `rows_per_block` rows.

    Each number is a monotone function of the key (or, for equal keys, of the digest of the text), so the blocks
    divide the order wherever they are cut.
    """
    digest = -F.conv(F.substring("_digest", 1, 13), 16, 10).cast("bigint")
    blocked = rows.withColumn("_block", F.array(F.col("_key").isNotNull().cast("bigint")))
    # a second look at each number divides what its first quartiles left together
    for code, wanted in [*((c, F.lit(True)) for c in _codes(rows.schema["_key"].dataType) for _ in range(2)), (digest, F.col("_alike")), (digest, F.col("_alike"))]:
        sized = blocked.groupBy("_block").agg(
            F.count(F.lit(1)).alias("_n"), F.percentile_approx(code.cast("double"), [0.25, 0.75]).alias("_q"),
            F.min("_key").eqNullSafe(F.max("_key")).alias("_alike"), (F.min(code) < F.max(code)).alias("_differs"),
        )
        divisible = (F.col("_n") > 4 * rows_per_block) & F.col("_differs") & wanted
        large = settle(sized.where(divisible).drop("_alike", "_differs"))
        if large.isEmpty():
            continue
        # half of the rows lie between the quartiles
        low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
        width = F.greatest((high - low) * 2 * rows_per_block / F.col("_n"), F.lit(1.0))
        part = F.floor(F.least(F.greatest((code.cast("double") - low) / width, F.lit(-1e15)), F.lit(1e15)))
        blocked = blocked.join(large, "_block", "left").select(
            *rows.columns, F.concat("_block", F.array(F.coalesce(part, F.lit(0)))).alias("_block")
        )
    return blocked


def _codes(kind: T.DataType) -> list[Column]:
    """Numbers that grow with the key, the first one first."""
    key = F.col("_key")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        digits = F.rpad(F.hex(key.cast("binary")), 2 * _NAME_BYTES * _NAME_CODES, "0")
        return [F.conv(F.substring(digits, 1 + 2 * _NAME_BYTES * i, 2 * _NAME_BYTES), 16, 10).cast("bigint") for i in range(_NAME_CODES)]
    if isinstance(kind, T.DateType):
        return [F.unix_date(key)]
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(key)]
    return [key.cast("double")]


def _digest_parts(text: Column) -> list[Column]:
    """SHA-256 of a text as four numbers, which aggregate without a sort."""
    digest = F.sha2(text.cast("binary"), 256)

    def number(at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")

    return [F.shiftleft(number(16 * i + 1), 32).bitwiseOR(number(16 * i + 9)) for i in range(4)]
