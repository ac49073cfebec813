"""Entity tables: extraction, conflicts between sources, BIO tags, call fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from callweave import config as C
from callweave.functions import blocks, spans
from callweave.session import settle

SPAN_BIN = 1024  # characters
TOKEN_BLOCK = 1 << 16


def rule_entities(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per entity found by the rules, 0-based offsets, source `rule`."""
    found = docs.select(*keys, F.explode(spans.rule_spans(F.col(text))).alias("e"))
    return found.select(*keys, "e.label", "e.text", "e.start", "e.end", F.lit("rule").alias("source"))


def pattern_entities(docs: DataFrame, keys: Sequence[str], label: str, text: str = "text") -> DataFrame:
    """All matches of one of the patterns, before any priority."""
    _, pattern, need = next(p for p in C.ENTITY_PATTERNS if p[0] == label)
    likely = docs.filter(spans.may_match(F.col(text), need))
    found = likely.select(*keys, F.explode(spans.find_all(F.col(text), pattern, label)).alias("e"))
    return found.select(*keys, "e.label", "e.text", "e.start", "e.end")


def order_entities_near_keyword(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Bare order numbers after the word "order", outside all pattern matches."""
    rules = spans.rule_spans(F.col(text))
    found = docs.select(*keys, F.explode(rules).alias("e")).filter(
        (F.col("e.label") == "ORDER_ID") & F.col("e.text").rlike(r"(?U)^\d{4,8}$")
    )
    return found.select(*keys, "e.label", "e.text", "e.start", "e.end")


def entity_count(entities: DataFrame, calls: DataFrame) -> DataFrame:
    """Entities per call, 0 for calls without one."""
    counts = entities.groupBy("call_id").agg(F.count(F.lit(1)).alias("num_entities"))
    return (
        calls.select("call_id")
        .join(counts, "call_id", "left")
        .withColumn("num_entities", F.coalesce("num_entities", F.lit(0)))
    )


# --- two sources on one text --------------------------------------------------


def _span_bins(df: DataFrame, width: int) -> DataFrame:
    first = F.floor(F.col("start") / width)
    last = F.floor((F.col("end") - 1) / width)
    return df.filter(F.col("end") > F.col("start")).withColumn("_bin", F.explode(F.sequence(first, last)))


def _touched(left: DataFrame, right: DataFrame, width: int, condition: Column | None = None) -> DataFrame:
    """Distinct (doc_id, start, end) of left spans overlapping a right span.

    Joined on (doc_id, text bin): a long text is spread over its bins.
    """
    a = _span_bins(left.select("doc_id", "start", "end").distinct(), width)
    b = _span_bins(right.select("doc_id", "start", "end").distinct(), width).select(
        "doc_id", "_bin", F.col("start").alias("o_start"), F.col("end").alias("o_end")
    )
    hit = (F.col("start") < F.col("o_end")) & (F.col("end") > F.col("o_start"))
    if condition is not None:
        hit = hit & condition
    return a.join(b, ["doc_id", "_bin"]).filter(hit).select("doc_id", "start", "end").distinct()


def rules_over_model(model: DataFrame, rules: DataFrame, width: int = SPAN_BIN) -> DataFrame:
    """Model entities that touch no rule entity, plus all rule entities."""
    touched = _touched(model, rules, width)
    return model.join(touched, ["doc_id", "start", "end"], "left_anti").unionByName(rules)


def longest_spans(model: DataFrame, rules: DataFrame, width: int = SPAN_BIN) -> DataFrame:
    """On overlap the longer span stays; an equal span keeps the model's label.

    Equal-length spans at different offsets both stay, as they do by definition.
    """
    other, own = F.col("o_end") - F.col("o_start"), F.col("end") - F.col("start")
    beaten_model = _touched(model, rules, width, other > own)
    beaten_rules = _touched(rules, model, width, other > own)
    kept = (
        model.join(beaten_model, ["doc_id", "start", "end"], "left_anti")
        .withColumn("_pref", F.lit(0))
        .unionByName(
            rules.join(beaten_rules, ["doc_id", "start", "end"], "left_anti").withColumn("_pref", F.lit(1))
        )
    )
    return dedupe_spans(kept, "_pref").drop("_pref")


def dedupe_spans(entities: DataFrame, preference: str) -> DataFrame:
    """One row per (doc, start, end): the lowest preference, then the label."""
    rest = [c for c in entities.columns if c not in ("doc_id", "start", "end")]
    rank = F.struct(preference, "label")
    return (
        entities.groupBy("doc_id", "start", "end")
        .agg(F.min_by(F.struct(*rest), rank).alias("_r"))
        .select("doc_id", "start", "end", *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def structured_fields(entities: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """First entity per type by position, as the six fields; `issue` is NULL."""
    at = F.struct("start", "end")

    def first(label: str) -> Column:
        return F.min_by("text", F.when(F.col("label") == label, at))

    return entities.groupBy(*keys).agg(
        first("PERSON").alias("customer"),
        first("ORDER_ID").alias("order_id"),
        first("PRODUCT").alias("product"),
        F.lit(None).cast("string").alias("issue"),
        first("DATE").alias("date"),
        first("MONEY").alias("amount"),
    )


# --- tokens and tags ----------------------------------------------------------


def token_offsets(tokens: DataFrame) -> DataFrame:
    """Character span of each token in its sentence joined by spaces.

    tokens: sent_id, pos, token.
    """
    return blocks.running_sum(
        tokens, ["sent_id"], ["pos"], TOKEN_BLOCK, F.length("token") + 1, "start"
    ).withColumn("end", F.col("start") + F.length("token"))


def covered_tags(tokens: DataFrame, entities: DataFrame, width: int = SPAN_BIN) -> DataFrame:
    """The B and I tags of the tokens that entity spans cover: sent_id, pos, tag.

    tokens: sent_id, pos, start, end; entities: sent_id, ent_idx, label, start, end.
    The first token an entity covers is B, the others I; where two entities cover
    a token the later one decides.
    """
    t = _span_bins(tokens.select("sent_id", "pos", "start", "end"), width)
    e = _span_bins(entities.select("sent_id", "ent_idx", "label", "start", "end"), width).select(
        "sent_id", "_bin", "ent_idx", "label", F.col("start").alias("e_start"), F.col("end").alias("e_end")
    )
    # A pair that shares several bins is taken in the bin where its overlap starts.
    covered = (
        t.join(e, ["sent_id", "_bin"])
        .filter((F.col("start") < F.col("e_end")) & (F.col("end") > F.col("e_start")))
        .filter(F.floor(F.greatest("start", "e_start") / width) == F.col("_bin"))
        .select("sent_id", "pos", "ent_idx", "label")
    )
    begins = covered.groupBy("sent_id", "ent_idx").agg(F.min("pos").alias("begin"))
    return (
        covered.join(begins, ["sent_id", "ent_idx"])
        .withColumn("_tag", F.concat(F.when(F.col("pos") == F.col("begin"), "B-").otherwise("I-"), F.col("label")))
        .groupBy("sent_id", "pos")
        .agg(F.max_by("_tag", "ent_idx").alias("tag"))
    )


def spans_to_bio(tokens: DataFrame, entities: DataFrame, width: int = SPAN_BIN) -> DataFrame:
    """A BIO tag per token from entity spans, as `covered_tags` gives them; the other tokens are O."""
    return tokens.join(covered_tags(tokens, entities, width), ["sent_id", "pos"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def flat_to_bio(tokens: DataFrame, label: str = "label") -> DataFrame:
    """Token labels to BIO: a run of equal labels is one entity."""
    with_prev = blocks.previous_row(tokens, ["sent_id"], ["pos"], TOKEN_BLOCK, F.col(label), "_before")
    tag = (
        F.when(F.col(label) == "O", F.lit("O"))
        .when(F.col(label) == F.col("_before"), F.concat(F.lit("I-"), F.col(label)))
        .otherwise(F.concat(F.lit("B-"), F.col(label)))
    )
    return with_prev.withColumn("tag", tag).drop("_before")


def _in_block_runs(bio: DataFrame, keys: Sequence[str], block: int, *more: str) -> tuple[DataFrame, WindowSpec]:
    """The tagged tokens of each block in order, with the first row of each run marked.

    Most tokens are O and go first. A run breaks at a gap, at a B tag and where
    the type changes. Rows hold little besides the tag, since all of them are sorted.
    """
    tagged = bio.filter(F.col("tag") != "O").select(*keys, "pos", "tag", *more)
    ordered = Window.partitionBy(*keys, blocks.BLOCK).orderBy("pos")
    before, kind = F.lag("tag").over(ordered), F.substring("tag", 1, 1)
    follows = (F.col("pos") - F.lag("pos").over(ordered) <= 1) & (kind != "B") & (_type_of(F.col("tag")) == _type_of(before))
    rows = blocks.with_block(tagged, "pos", block).withColumn("_starts", ~F.coalesce(follows, F.lit(False)))
    return rows, ordered


def _type_of(tag: Column) -> Column:
    return F.substring(tag, 3, 1 << 30)


def _stitched(pieces: DataFrame, keys: Sequence[str], block: int, merged: Sequence[Column]) -> DataFrame:
    """Joins the pieces of spans that go on from one block to the next.

    pieces: keys, label, first_pos, end_pos, _b (begins with a B tag) and what `merged` aggregates. Only
    pieces at a border of blocks are looked at per key.
    """
    pieces = settle(pieces)
    goes_on = (F.col("first_pos") > 0) & (F.col("first_pos") % block == 0) & ~F.col("_b")
    border = goes_on | (F.col("end_pos") % block == 0)
    cut = pieces.filter(border)
    if cut.isEmpty():
        return pieces
    ordered = Window.partitionBy(*keys).orderBy("first_pos")
    joins = goes_on & (F.lag("end_pos").over(ordered) == F.col("first_pos")) & (F.lag("label").over(ordered) == F.col("label"))
    numbered = cut.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(ordered))
    whole = numbered.groupBy(*keys, "_run", "label").agg(
        F.min("first_pos").alias("first_pos"), F.max("end_pos").alias("end_pos"), F.min_by("_b", "first_pos").alias("_b"), *merged
    )
    return pieces.filter(~border).unionByName(whole.drop("_run"))


def _run_ends(rows: DataFrame, ordered: WindowSpec, *at_end: str) -> DataFrame:
    """The first row of each run, with `end_pos` and the values its last row has in the columns `at_end`.

    Ends are found by looking at the neighbours, so sorted tokens are neither grouped nor joined.
    """
    ends = rows.withColumn("_ends", F.coalesce(F.lead("_starts").over(ordered), F.lit(True))).filter(F.col("_starts") | F.col("_ends"))

    def last(name: str) -> Column:
        return F.when(F.col("_ends"), F.col(name)).otherwise(F.lead(name).over(ordered))

    return ends.withColumns({"end_pos": last("pos") + 1} | {f"_last_{n}": last(n) for n in at_end}).filter("_starts").withColumns(
        {"label": _type_of(F.col("tag")), "first_pos": F.col("pos"), "_b": F.substring("tag", 1, 1) == "B"}
    )


def bio_to_spans_lenient(bio: DataFrame, keys: Sequence[str] = ("sent_id",), block: int = TOKEN_BLOCK) -> DataFrame:
    """Spans (token positions, end exclusive); a stray I starts a span. Used for scoring.

    The result does not depend on `block`.
    """
    pieces = _run_ends(*_in_block_runs(bio, keys, block)).select(*keys, "label", "first_pos", "end_pos", "_b")
    return _stitched(pieces, keys, block, []).drop("_b")


def bio_to_spans_strict(bio: DataFrame, keys: Sequence[str] = ("sent_id",), block: int = TOKEN_BLOCK) -> DataFrame:
    """Spans that begin with a B tag; stray I tags are dropped. Used for extraction.

    bio: keys, pos, tag, start, end (character offsets, which grow with pos), confidence. The text of
    a span is the slice of the source text between its offsets. Its confidence is the mean of those that
    are not NULL, NaN where one of them is no finite number.
    """
    rows, ordered = _in_block_runs(bio, keys, block, "start", "end", "confidence")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    conf, zero = F.col("confidence").cast("double"), F.lit(0.0)
    odd = F.coalesce(F.isnan(conf) | (F.abs(conf) == float("inf")), F.lit(False))
    # sums up to each row; those of a run are differences, so an odd value is only counted
    own = {"_sum": F.when(odd | conf.isNull(), zero).otherwise(conf), "_n": conf.isNotNull().cast("int"), "_odd": odd.cast("int")}
    summed = rows.withColumns({n: F.sum(v).over(upto) for n, v in own.items()})
    pieces = _run_ends(summed, ordered, "end", *own).select(
        *keys, "label", "first_pos", "end_pos", "_b", "start", F.col("_last_end").alias("end"),
        *[(F.col(f"_last_{n}") - F.col(n) + v).alias(n) for n, v in own.items()],
    )
    merged = [F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(n).alias(n) for n in own]]
    mean = F.when(F.col("_odd") > 0, float("nan")).when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    return _stitched(pieces, keys, block, merged).filter("_b").select(*keys, "label", "start", "end", mean.alias("confidence"))


def joined_tokens(tokens: DataFrame) -> DataFrame:
    """The text of each sentence that the token offsets refer to: its tokens joined by a space."""
    return blocks.joined_texts(tokens, ["sent_id"], "pos", "token", "text")


def slice_text(entities: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds the text between the offsets of each entity."""
    return (
        entities.join(docs.select(key, F.col(text).alias("_t")), key)
        .withColumn("text", F.col("_t").substr(F.col("start") + 1, F.col("end") - F.col("start")))
        .drop("_t")
    )


# --- call-level text ------------------------------------------------------------

def call_text(turns: DataFrame) -> DataFrame:
    """The turns of a call joined by a space, one row per call."""
    return blocks.joined_texts(turns, ["call_id"], "turn_idx", "text", "text")


def call_fields(calls: DataFrame, spans_col: str = "spans") -> DataFrame:
    """The six call-level fields from the spans of the text of each call."""
    return calls.select("call_id", spans.structured_fields(F.col(spans_col)).alias("_f")).select(
        "call_id", *[F.col(f"_f.{n}").alias(n) for n in ("customer", "order_id", "product", "issue", "date", "amount")]
    )
