"""Extraction, masking, normalisation and conflicts on literal texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from callweave import config as C
from callweave.functions import spans
from callweave.operators import entities, evaluate
from callweave.plans import jobs


def found(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [tuple(s) for s in df.select(spans.rule_spans(F.col("text"))).first()[0]]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("reach me at jane.doe@example.com please", [("EMAIL", "jane.doe@example.com", 12, 32)]),
        ("call 555-123-4567 today", [("PHONE", "555-123-4567", 5, 17)]),
        ("John Smith called regarding order 45821.", [("ORDER_ID", "45821", 34, 39)]),
        ("that invoice was for $1,240.50", [("MONEY", "$1,240.50", 21, 30)]),
        ("it cost $1240 in all", []),
        ("invoice INV-2024-0091 for account acc123456",
         [("INVOICE_ID", "INV-2024-0091", 8, 21), ("ACCOUNT_ID", "acc123456", 34, 43)]),
        ("Thank you for calling, how can I help you today?", []),
        ("order ORD-99887 confirmed", [("ORDER_ID", "ORD-99887", 6, 15)]),
        ("order the order 12345", [("ORDER_ID", "12345", 16, 21)]),
        # the window of 30 characters ends inside the number, so it is read short
        ("order xxxxxxxxxxxxxxxxxxxxxxxx 12345678", [("ORDER_ID", "1234", 31, 35)]),
        ("né 😀 order 12345 über (415) 555-0199",
         [("ORDER_ID", "12345", 11, 16), ("PHONE", "(415) 555-0199", 22, 36)]),
        # one character between two numbers ends the first and begins the second
        ("at +1 (269) 555-3296 +1 (578) 555-6437 or",
         [("PHONE", "+1 (269) 555-3296", 3, 20), ("PHONE", "+1 (578) 555-6437", 21, 38)]),
        ("a\u0001b x@y.zz \u0001 order 12345", [("EMAIL", "x@y.zz", 4, 10), ("ORDER_ID", "12345", 19, 24)]),
        ("", []),
    ],
)
def test_rule_spans(spark, text, expected):
    assert found(spark, text) == expected


def reference_spans(text):
    """The same rules as a plain loop over Python's own regular expressions."""
    taken, out = [], []

    def free(a, b):
        return not any(a < d and b > c for c, d in taken)

    for label, pattern, _ in C.ENTITY_PATTERNS:
        flags = re.I if pattern.startswith("(?i") else 0
        for m in re.finditer(re.sub(r"^\(\?i?U\)", "", pattern), text, flags):
            if free(*m.span()):
                taken.append(m.span())
                out.append((label, m.group().strip(), *m.span()))
    near = set()
    for word in re.finditer(r"\border\b", text, re.I):
        m = re.compile(r"\b\d{4,8}\b").search(text, word.end(), min(len(text), word.end() + 30))
        if m and free(*m.span()):
            near.add(("ORDER_ID", m.group(), *m.span()))
    return sorted(out + list(near), key=lambda e: e[2:])


def test_rule_spans_on_random_texts(spark):
    rnd = random.Random(11)
    bits = ["order", "Order", "12345", "999", "ORD-12345", "inv-2024-001", "A-1234", "ACC12345", "$", "1,200.50", "$5",
            "+1", "(415)", "555", "0199", "555-0199", "a.b@c.de", "@", "é", "ß@x.com", "-", ".", "x", "😀", "12", "20240101"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", " ", "-"]) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", spans.rule_spans(F.col("text")).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == reference_spans(text), text


def spans_of(rows):
    return F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(t).alias("text"), F.lit(s).alias("start"), F.lit(e).alias("end"))
        for a, t, s, e in rows
    ]) if rows else spans.no_spans()


def test_mask(spark):
    one = spark.range(1)
    text = F.lit("John Smith, order 45821, paid $5")
    rows = [("PERSON", "John Smith", 0, 10), ("ORDER_ID", "45821", 18, 23), ("MONEY", "$5", 30, 32)]
    assert one.select(spans.mask(text, spans_of(rows))).first()[0] == "[PERSON], order [ORDER_ID], paid $5"
    overlapping = [("PERSON", "John", 0, 4), ("PERSON", "John Smith", 0, 10)]
    assert one.select(spans.mask(text, spans_of(overlapping))).first()[0].startswith("[PERSON], order")
    assert one.select(spans.mask(text, spans_of([]))).first()[0].startswith("John Smith")


@pytest.mark.parametrize(
    "text, iso",
    [("March 5, 2024", "2024-03-05"), ("march 5", "--03-05"), ("3/4/1975", "1975-03-04"), ("3/4/75", "1975-03-04"),
     ("12/31/68", "2068-12-31"), ("1/2/69", "1969-01-02"), ("2024-1-9", "2024-01-09"), ("next Tuesday", None),
     ("February 30, 2024", None), ("March 5th", None)],
)
def test_iso_date(spark, text, iso):
    assert spark.range(1).select(spans.iso_date(F.lit(text))).first()[0] == iso


def test_money_and_phone(spark):
    row = spark.range(1).select(
        spans.money_value(F.lit("$1,240.50")), spans.phone_digits(F.lit("(415) 555-0199")), spans.phone_digits(F.lit("123")),
        spans.money_value(F.lit("none")),
    ).first()
    assert list(row) == [1240.5, "4155550199", None, None]


def test_structured_fields_take_the_first_and_no_issue(spark):
    rows = [("ORDER_ID", "222", 9, 12), ("ORDER_ID", "111", 0, 3), ("MONEY", "$5", 4, 6)]
    got = spark.range(1).select(spans.structured_fields(spans_of(rows))).first()[0]
    assert got.order_id == "111" and got.amount == "$5" and got.issue is None and got.customer is None


def source_rows(rows, source):
    return [("d", *r, source) for r in rows]


SCHEMA = "doc_id string, label string, text string, start int, end int, source string"


def test_longest_span_wins(spark):
    model = [("ORDER_ID", "45", 9, 11), ("PERSON", "Ann", 20, 23), ("DATE", "May", 30, 33)]
    rules_ = [("ORDER_ID", "45821", 9, 14), ("ACCOUNT_ID", "Ann", 20, 23), ("MONEY", "a", 31, 32)]
    want = {(9, 14, "rule"), (20, 23, "model"), (30, 33, "model")}
    table = entities.longest_spans(
        spark.createDataFrame(source_rows(model, "model"), SCHEMA), spark.createDataFrame(source_rows(rules_, "rule"), SCHEMA), 8
    )
    assert {(r.start, r.end, r.source) for r in table.collect()} == want
    inline = spark.range(1).select(
        spans.longest_spans(spans.with_source(spans_of(model), "model"), spans.with_source(spans_of(rules_), "rule"))
    ).first()[0]
    assert {(r.start, r.end, r.source) for r in inline} == want


def test_rules_win_over_model(spark):
    model = [("DATE", "45821", 16, 21), ("PERSON", "Ann", 30, 33)]
    rules_ = [("ORDER_ID", "45821", 16, 21)]
    table = entities.rules_over_model(
        spark.createDataFrame(source_rows(model, "model"), SCHEMA), spark.createDataFrame(source_rows(rules_, "rule"), SCHEMA), 4
    )
    assert {(r.label, r.start) for r in table.collect()} == {("ORDER_ID", 16), ("PERSON", 30)}
    inline = spark.range(1).select(
        spans.rules_over_model(spans.with_source(spans_of(model), "model"), spans.with_source(spans_of(rules_), "rule"))
    ).first()[0]
    assert {(r.label, r.start) for r in inline} == {("ORDER_ID", 16), ("PERSON", 30)}


def test_call_text_and_fields(spark):
    rnd = random.Random(5)
    bits = ["hello there", "my order", "is 12345", "call 415", "555 0199", "pay $", "5 now", "ok", "", "order number", "(415)",
            "something much longer than forty characters to reset it"]
    turns = [(c, i, rnd.choice(bits)) for c in range(6) for i in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(turns, "call_id int, turn_idx bigint, text string")
    whole = {c: " ".join(t for k, _, t in turns if k == c) for c in range(6)}
    assert {r.call_id: r.text for r in entities.call_text(df).collect()} == whole
    fields = entities.call_fields(entities.call_text(df).withColumn("spans", spans.rule_spans(F.col("text"))))
    for r in fields.collect():
        ents = reference_spans(whole[r.call_id])
        assert r.order_id == next((e[1] for e in ents if e[0] == "ORDER_ID"), None)
        assert r.amount == next((e[1] for e in ents if e[0] == "MONEY"), None)


def test_bio_decoding(spark):
    tags = ["B-X", "I-X", "O", "I-X", "B-Y", "I-X", "B-X", "B-X"]
    df = spark.createDataFrame(
        [("s", i, t, i * 2, i * 2 + 1, 0.5) for i, t in enumerate(tags)],
        "sent_id string, pos bigint, tag string, start int, end int, confidence double",
    )
    strict = {(r.label, r.start, r.end) for r in entities.bio_to_spans_strict(df).collect()}
    assert strict == {("X", 0, 3), ("Y", 8, 9), ("X", 12, 13), ("X", 14, 15)}
    lenient = {(r.label, r.first_pos, r.end_pos) for r in entities.bio_to_spans_lenient(df).collect()}
    assert lenient == {("X", 0, 2), ("X", 3, 4), ("Y", 4, 5), ("X", 5, 6), ("X", 6, 7), ("X", 7, 8)}


def test_spans_to_bio_later_entity_decides(spark):
    tokens = spark.createDataFrame([("s", 0, "John"), ("s", 1, "Smith"), ("s", 2, "called")], "sent_id string, pos bigint, token string")
    ents = spark.createDataFrame([("s", 0, "PERSON", 0, 10), ("s", 1, "DATE", 5, 17)], "sent_id string, ent_idx int, label string, start int, end int")
    got = {r.pos: r.tag for r in entities.spans_to_bio(entities.token_offsets(tokens), ents, 3).collect()}
    assert got == {0: "B-PERSON", 1: "B-DATE", 2: "I-DATE"}


def test_analyze_text(spark):
    df = spark.createDataFrame([("order 45821 for $5",)], "text string")
    r = jobs.analyze_text(df).first()
    assert r.masked_text == "order [ORDER_ID] for $5"
    assert r.structured_fields.order_id == "45821"
    assert [(e.label, e.normalized) for e in r.entities] == [("ORDER_ID", None), ("MONEY", "5.0")]


@pytest.mark.parametrize("block", [1, 3, 5, 1 << 16])
def test_spans_do_not_depend_on_blocks(spark, block):
    """Runs over many blocks against a plain scan; the sorted tokens of a block are not joined to anything."""
    rng = random.Random(block)
    rows = [(s, p, rng.choice(["O", "B-X", "I-X", "I-X", "I-X", "I-Y"]), 3 * p, 3 * p + 2, rng.random()) for s in range(4) for p in range(60) if rng.random() < 0.95]
    want, run = [], None
    for s, p, tag, start, end, conf in rows:
        if tag == "O":
            run = None
        elif run and (run[0], run[2], run[4]) == (s, tag[2:], p) and tag[0] == "I":
            run[4], run[6], run[7] = p + 1, end, [*run[7], conf]
        else:
            run = [s, tag[0], tag[2:], p, p + 1, start, end, [conf]]
            want.append(run)
    df = spark.createDataFrame(rows, "sent_id bigint, pos bigint, tag string, start bigint, end bigint, confidence double").repartition(3)
    lenient = entities.bio_to_spans_lenient(df, block=block)
    assert sorted(map(tuple, lenient.select("sent_id", "label", "first_pos", "end_pos").collect())) == sorted((r[0], r[2], r[3], r[4]) for r in want)
    strict = {(r.sent_id, r.label, r.start, r.end): r.confidence for r in entities.bio_to_spans_strict(df, block=block).collect()}
    assert strict == {(r[0], r[2], r[5], r[6]): pytest.approx(sum(r[7]) / len(r[7])) for r in want if r[1] == "B"}


def test_spans_are_found_without_joins(spark):
    df = spark.createDataFrame([(1, 0, "B-X"), (1, 1, "I-X"), (1, 2, "O")], "sent_id bigint, pos bigint, tag string")
    assert "Join" not in entities.bio_to_spans_lenient(df)._jdf.queryExecution().toString()


def test_only_covered_tokens_are_tagged(spark):
    tokens = spark.createDataFrame([("s", 0, 0, 4), ("s", 1, 5, 10), ("s", 2, 11, 17)], "sent_id string, pos bigint, start int, end int")
    ents = spark.createDataFrame([("s", 0, "PERSON", 0, 10)], "sent_id string, ent_idx int, label string, start int, end int")
    tags = entities.covered_tags(tokens, ents, 3)
    assert sorted((r.pos, r.tag) for r in tags.collect()) == [(0, "B-PERSON"), (1, "I-PERSON")]
    truth = spark.createDataFrame([("s", 0, "B-PERSON", "a"), ("s", 1, "I-PERSON", "a"), ("s", 2, "O", "a")], "sent_id string, pos bigint, tag string, source string")
    words = spark.createDataFrame([("s", 0, "John"), ("s", 1, "Smith"), ("s", 2, "called")], "sent_id string, pos bigint, token string")
    out = jobs.evaluate_ner(words, truth, {"m": ents})
    assert {(r.model, r.source, r.label, r.f1, r.support) for r in out.collect()} == {
        ("m", s, x, 1.0, 1) for s in ("a", "all") for x in ("PERSON", "micro avg")
    }


def test_spans_without_a_source_still_match(spark):
    bio = spark.createDataFrame([("s", 0, "B-X", None), ("t", 0, "B-X", "a")], "sent_id string, pos bigint, tag string, source string")
    got = {(r.source, r.n_true, r.n_pred, r.n_hit) for r in evaluate.span_counts(bio, bio, ["source"]).collect()}
    assert got == {(None, 1, 1, 1), ("a", 1, 1, 1)}
