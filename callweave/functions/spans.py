"""Entity spans inside one text, as arrays of (label, text, start, end).

Offsets are 0-based code points, end exclusive. Everything here is a column
expression over one row, so it runs where the text is scanned and needs no
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave import config as C

_MARK = "\u0001"
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u202f\u3000"
SPAN_TYPE = "array<struct<label:string,text:string,start:int,end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def may_match(text: Column, need: str) -> Column:
    """The cheap test before a pattern: a run of four digits, or a literal."""
    return text.rlike(need) if need == C.FOUR_DIGITS else F.contains(text, F.lit(need))


def find_all(text: Column, pattern: str, label: str) -> Column:
    """All matches of a pattern with their offsets.

    The text between matches comes from `split`, the matches from
    `regexp_extract_all`; the running length of both gives the offsets. Both are
    evaluated only where there is a match. `split` compiles its pattern for every
    row, `regexp_replace` once, so the matches become a mark first and the split
    is by that single character (unless the text has it already).
    """

    def located(matches: Column) -> Column:
        marked = F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)
        between = F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(marked)
        pairs = F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b"))
        start = F.struct(F.lit(0).alias("pos"), no_spans().alias("spans"))

        def step(acc: Column, pair: Column) -> Column:
            at = acc["pos"] + F.length(pair["b"])
            end = at + F.length(pair["m"])
            span = F.struct(
                F.lit(label).alias("label"),
                F.trim(pair["m"], F.lit(_BLANKS)).alias("text"),
                at.alias("start"),
                end.alias("end"),
            )
            return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(span)).cast(SPAN_TYPE).alias("spans"))

        return F.aggregate(pairs, start, step, lambda acc: acc["spans"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), bind(found, located)).otherwise(no_spans())


def _accept(accepted: Column, candidates: Column) -> Column:
    """Adds candidates in order, skipping any that overlaps an accepted span."""
    return F.aggregate(
        candidates,
        accepted,
        lambda acc, x: F.when(F.exists(acc, lambda a: overlaps(a, x)), acc).otherwise(
            F.concat(acc, F.array(x)).cast(SPAN_TYPE)
        ),
    )


def order_numbers_near_keyword(text: Column, claimed: Column) -> Column:
    """Bare 4-8 digit numbers in the 30 characters after the word "order".

    The end of the window counts as the end of the text. A number that overlaps
    a claimed span is skipped; the same number found from two keywords is
    reported once.
    """
    keywords = find_all(text, C.ORDER_KEYWORD_PATTERN, "KEYWORD")

    def near(keyword: Column) -> Column:
        window = text.substr(keyword["end"] + 1, F.lit(C.ORDER_WINDOW_CHARS))
        number = F.regexp_extract(window, C.BARE_NUMBER_PATTERN, 0)
        lead = F.regexp_extract(window, r"(?Us)^(.*?)\b\d{4,8}\b", 1)
        start = keyword["end"] + F.length(lead)
        return F.struct(
            F.lit("ORDER_ID").alias("label"),
            number.alias("text"),
            start.alias("start"),
            (start + F.length(number)).alias("end"),
        )

    hits = F.transform(keywords, near)
    return F.array_distinct(
        F.filter(hits, lambda x: (x["text"] != "") & ~F.exists(claimed, lambda c: overlaps(x, c)))
    ).cast(SPAN_TYPE)


def rule_spans(text: Column, patterns: Sequence[tuple[str, str, str]] = tuple(C.ENTITY_PATTERNS)) -> Column:
    """Entities found by pattern, by priority, none overlapping, sorted by start.

    Neighbouring patterns with the same cheap test share it; most prose has no run
    of four digits and none of the literals and is done after those tests.
    """
    groups: list[tuple[str, list[Column]]] = []
    for label, pattern, need in patterns:
        if not groups or groups[-1][0] != need:
            groups.append((need, []))
        groups[-1][1].append(find_all(text, pattern, label))
    candidates = F.concat(
        *[F.when(may_match(text, need), F.concat(*found)).otherwise(no_spans()) for need, found in groups]
    )
    claimed = bind(candidates, lambda c: F.when(F.size(c) > 1, _accept(no_spans(), c)).otherwise(c))
    has_order = may_match(text, C.FOUR_DIGITS) & text.rlike(C.ORDER_KEYWORD_PATTERN)
    return bind(
        claimed,
        lambda got: sort_spans(
            F.when(has_order, F.concat(got, order_numbers_near_keyword(text, got))).otherwise(got)
        ),
    )


def sort_spans(spans: Column) -> Column:
    return F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]),
    )


def with_source(spans: Column, source: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["label"].alias("label"),
            s["text"].alias("text"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(source).alias("source"),
        ),
    )


def rules_over_model(model: Column, rules: Column) -> Column:
    """Model spans that touch no rule span, then the rule spans (with sources)."""
    kept = F.filter(model, lambda m: ~F.exists(rules, lambda r: overlaps(m, r)))
    return sort_spans(F.concat(kept, rules))


def longest_spans(model: Column, rules: Column) -> Column:
    """On overlap the longer span stays; equal spans keep the model's label."""

    def length(s: Column) -> Column:
        return s["end"] - s["start"]

    kept_model = F.filter(
        model, lambda m: ~F.exists(rules, lambda r: overlaps(m, r) & (length(r) > length(m)))
    )
    kept_rules = F.filter(
        rules,
        lambda r: ~F.exists(model, lambda m: overlaps(m, r) & (length(r) < length(m)))
        & ~F.exists(
            model, lambda m: (m["start"] == r["start"]) & (m["end"] == r["end"])
        ),
    )
    return sort_spans(F.concat(kept_model, kept_rules))


def pii_only(spans: Column, types: Sequence[str] = tuple(C.PII_TYPES)) -> Column:
    return F.filter(spans, lambda s: s["label"].isin(list(types)))


def mask(text: Column, spans: Column, types: Sequence[str] = tuple(C.PII_TYPES)) -> Column:
    """Replaces the spans of the given types by [LABEL].

    Overlapping spans are first reduced to the longest, then earliest, so that
    a replacement never cuts into another.
    """
    wanted = F.transform(
        pii_only(spans, types),
        lambda s: F.struct(
            s["label"].alias("label"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")
        ),
    ).cast(SPAN_TYPE)

    def by_length(found: Column) -> Column:
        return F.array_sort(
            found,
            lambda a, b: F.when(
                (b["end"] - b["start"]) != (a["end"] - a["start"]),
                (b["end"] - b["start"]) - (a["end"] - a["start"]),
            ).otherwise(a["start"] - b["start"]),
        )

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("pos"))

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr(acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(
            F.concat(acc["done"], gap, F.lit("["), s["label"], F.lit("]")).alias("done"), s["end"].alias("pos")
        )

    def replaced(found: Column) -> Column:
        disjoint = sort_spans(_accept(no_spans(), by_length(found)))
        return F.aggregate(
            disjoint, start, step, lambda acc: F.concat(acc["done"], text.substr(acc["pos"] + 1, F.length(text)))
        )

    return bind(wanted, lambda found: F.when(F.size(found) > 0, replaced(found)).otherwise(text))


def first_text(spans: Column, label: str) -> Column:
    """Text of the first span of a type by position, NULL without one."""
    of_type = F.filter(sort_spans(spans), lambda s: s["label"] == label)
    return F.get(of_type, F.lit(0))["text"]


def structured_fields(spans: Column) -> Column:
    """The six call fields; `issue` is never derived from entities."""
    return bind(
        spans,
        lambda found: F.struct(
            first_text(found, "PERSON").alias("customer"),
            first_text(found, "ORDER_ID").alias("order_id"),
            first_text(found, "PRODUCT").alias("product"),
            F.lit(None).cast("string").alias("issue"),
            first_text(found, "DATE").alias("date"),
            first_text(found, "MONEY").alias("amount"),
        ),
    )


# --- normalisation ----------------------------------------------------------


def money_value(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double")


def phone_digits(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^\d]", "")
    return F.when(F.length(digits).between(7, 15), digits)


def iso_date(text: Column) -> Column:
    """ISO date; `--MM-DD` without a year; NULL when no format fits.

    Formats in order: month name day, year; month name day; m/d/yyyy; m/d/yy;
    y-m-d. Two-digit years from 69 on belong to the 1900s.
    """

    def parsed(value: Column, fmt: str) -> Column:
        return F.try_to_date(value, fmt)

    def shaped(pattern: str, value: Column) -> Column:
        return F.when(text.rlike(pattern), value)

    name = r"(?i)^[a-z]+\s+\d{1,2}"
    tidy = F.concat_ws(
        " ", F.initcap(F.regexp_extract(text, r"^(\S+)\s", 1)), F.regexp_extract(text, r"^\S+\s+(.*)$", 1)
    )
    spaced = F.regexp_replace(tidy, r"\s+", " ")
    full = shaped(name + r",\s+\d{4}$", parsed(spaced, "MMMM d, yyyy"))
    no_year = shaped(name + "$", parsed(F.concat(spaced, F.lit(", 1900")), "MMMM d, yyyy"))
    slash4 = shaped(r"^\d{1,2}/\d{1,2}/\d{4}$", parsed(text, "M/d/yyyy"))
    two = parsed(text, "M/d/yy")
    slash2 = shaped(
        r"^\d{1,2}/\d{1,2}/\d{2}$", F.when(F.year(two) >= 2069, F.add_months(two, -1200)).otherwise(two)
    )
    dashed = shaped(r"^\d{4}-\d{1,2}-\d{1,2}$", parsed(text, "yyyy-M-d"))
    return F.coalesce(
        F.date_format(full, "yyyy-MM-dd"),
        F.date_format(no_year, "--MM-dd"),
        F.date_format(slash4, "yyyy-MM-dd"),
        F.date_format(slash2, "yyyy-MM-dd"),
        F.date_format(dashed, "yyyy-MM-dd"),
    )


def normalized(label: Column, text: Column) -> Column:
    """The standard value of an entity as text, NULL for types without one."""
    return (
        F.when(label == "MONEY", money_value(text).cast("string"))
        .when(label == "PHONE", phone_digits(text))
        .when(label == "DATE", iso_date(text))
    )


def with_normalized(spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["label"].alias("label"), s["text"].alias("text"), normalized(s["label"], s["text"]).alias("normalized")
        ),
    )
