"""Text functions: words, tokens, keyword flags, names taken from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave import config as C
from callweave.functions import blocks


def normal_words(text: Column) -> Column:
    """Words as compared by the word error rate: lower case, no punctuation."""
    collapsed = F.regexp_replace(F.lower(text), r"(?U)\s\s+", " ")
    stripped = F.regexp_replace(collapsed, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(stripped, r"\p{P}", "")
    return F.filter(F.split(bare, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("bigint")


def tokens(text: Column) -> Column:
    """Words (inner - / . kept) and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(C.TOKEN_PATTERN), F.lit(0))


def capitalized(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def call_id_of(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def rounded_seconds(value: Column) -> Column:
    return F.round(value, 3)


def md5_hex(content: Column) -> Column:
    return F.md5(content)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def keyword_flags(
    turns: DataFrame, size: int = blocks.TURN_BLOCK, keep: dict[str, Column] | None = None
) -> DataFrame:
    """Per turn: does a supervisor / transfer phrase end in it?

    The phrases are looked for in the turns of a call joined by one space, so a
    phrase may begin in an earlier turn. A phrase has at most 17 characters, so
    besides the turn itself only the 18 characters before it matter. Those come
    from at most 18 turns back, which a halo of 18 rows provides; only these
    short pieces are shuffled, never the texts. `keep` adds further short columns
    that a caller computes in the same scan.
    """
    keep = keep or {}
    reach = C.KEYWORD_MAX_CHARS + 1
    body = F.coalesce(F.col("text"), F.lit(""))
    # A cut piece gets a letter at the cut, so that the cut is no word boundary.
    head = F.when(F.length(body) > reach, F.concat(F.substring(body, 1, reach), F.lit("x"))).otherwise(body)
    narrow = turns.select(
        "call_id",
        "turn_idx",
        body.rlike(C.SUPERVISOR_PATTERN).alias("_sup"),
        body.rlike(C.TRANSFER_PATTERN).alias("_tra"),
        head.alias("_head"),
        F.right(body, F.lit(reach)).alias("_tail"),
        *[v.alias(k) for k, v in keep.items()],
    )
    back = Window.partitionBy("call_id", blocks.BLOCK).orderBy("turn_idx").rowsBetween(-reach, -1)
    before = F.array_join(F.collect_list("_tail").over(back), " ")
    context = F.when(F.length(before) >= reach, F.concat(F.lit("x"), F.right(before, F.lit(reach)))).otherwise(before)
    return (
        blocks.with_halo(narrow, "turn_idx", size, reach)
        .withColumn("_joined", F.concat(context, F.lit(" "), F.col("_head")))
        .filter(~F.col("_halo"))
        .select(
            "call_id",
            "turn_idx",
            (F.col("_sup") | F.col("_joined").rlike(C.SUPERVISOR_PATTERN)).alias("supervisor_phrase"),
            (F.col("_tra") | F.col("_joined").rlike(C.TRANSFER_PATTERN)).alias("transfer_phrase"),
            *keep,
        )
    )
