"""Queries on texts: entities, masking, normalisation, tags and their metrics."""

import re

from pyspark.sql import functions as F

from callweave import config as C
from callweave.catalog.base import SUPPORT, TAGGED, TOKENS, register, tag_runs, with_ctes
from callweave.catalog.calls import _n, _r
from callweave.functions import spans
from callweave.functions import text as tx
from callweave.operators import entities, evaluate, rules, sampling
from callweave.plans import jobs
from callweave.sources import tables as T

# Word characters and boundaries for DuckDB, whose \w and \b are ASCII only.
W = r"\p{L}\p{M}\p{Nd}_\x{203f}\x{2040}\x{200c}\x{200d}"
EMAIL_SQL = rf"[{W}][{W}.+-]*@[{W}-]+\.[{W}.-]*[{W}]"


def offsets_sql(source: str, key: str, pattern: str, label: str, out: str) -> str:
    """All matches of a pattern with offsets, from split pieces and matches."""
    return f"""{out} AS (
  SELECT {key}, '{label}' AS label, m[i] AS text, (list_sum(list_transform(p[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS "start" FROM (
    SELECT {key}, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT {key}, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM {source})))"""


@register(
    "n2a_email_entities",
    with_ctes(offsets_sql("documents", "doc_id", EMAIL_SQL, "EMAIL", "found"))
    + """SELECT doc_id, label, text, "start", "start" + length(text) AS "end" FROM found""",
)
def n2a(spark, sf):
    return entities.pattern_entities(T.read(spark, sf, "documents"), ["doc_id"], "EMAIL").select(
        "doc_id", "label", "text", *_n("start", "end")
    )


# Word boundaries around phone numbers as neighbouring characters that are no word characters.
PHONE_CORE = r"(?:\+?\d{1,2}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
PHONE_PADDED = rf"(?:^|[^{W}])({PHONE_CORE})(?:$|[^{W}])"
PHONE_DOCS = f"""doc_phones AS (
  SELECT doc_id, 'PHONE' AS label, trim(g[i]) AS text, (list_sum(list_transform(p[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + strpos(m[i], g[i]) - 1)::BIGINT AS "start" FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{PHONE_PADDED}') AS m, regexp_extract_all(text, '{PHONE_PADDED}', 1) AS g,
        regexp_split_to_array(text, '{PHONE_PADDED}') AS p FROM documents)))"""


@register(
    "n2b_phone_entities_documents",
    with_ctes(PHONE_DOCS) + """SELECT doc_id, label, text, "start", "start" + length(text) AS "end" FROM doc_phones""",
)
def n2b_docs(spark, sf):
    return entities.pattern_entities(T.read(spark, sf, "documents"), ["doc_id"], "PHONE").select(
        "doc_id", "label", "text", *_n("start", "end")
    )


SENTENCES = SUPPORT + ",\nsentences AS (SELECT order_key AS doc_id, text FROM support)"
PHONE_SQL = r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]\d{4}\b"


@register(
    "n2b_phone_entities",
    with_ctes(SENTENCES, offsets_sql("sentences", "doc_id", PHONE_SQL, "PHONE", "found"))
    + """SELECT doc_id, label, text, "start", "start" + length(text) AS "end" FROM found""",
)
def n2b(spark, sf):
    return entities.pattern_entities(T.support_sentences(spark, sf), ["doc_id"], "PHONE").select(
        "doc_id", "label", "text", *_n("start", "end")
    )


MONEY_SQL = r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b"


@register(
    "n2c_money_entities",
    with_ctes(SENTENCES, offsets_sql("sentences", "doc_id", MONEY_SQL, "MONEY", "found"))
    + """SELECT doc_id, label, text, "start", "start" + length(text) AS "end" FROM found""",
)
def n2c(spark, sf):
    return entities.pattern_entities(T.support_sentences(spark, sf), ["doc_id"], "MONEY").select(
        "doc_id", "label", "text", *_n("start", "end")
    )


ID_CTES = (
    offsets_sql("sentences", "doc_id", r"(?i)\bINV-\d{4}-\d{3,6}\b", "INVOICE_ID", "inv"),
    offsets_sql("sentences", "doc_id", r"(?i)\b(?:ACC\d{5,8}|A-\d{4,8})\b", "ACCOUNT_ID", "acc"),
    offsets_sql("sentences", "doc_id", r"(?i)\bORD-\d{5,8}\b", "ORDER_ID", "ord"),
)


@register(
    "n2d_identifier_entities",
    with_ctes(SENTENCES, *ID_CTES, "found AS (SELECT * FROM inv UNION ALL SELECT * FROM acc UNION ALL SELECT * FROM ord)")
    + """SELECT doc_id, label, text, "start", "start" + length(text) AS "end" FROM found""",
)
def n2d(spark, sf):
    docs = T.support_sentences(spark, sf)
    found = [entities.pattern_entities(docs, ["doc_id"], x) for x in ("INVOICE_ID", "ACCOUNT_ID", "ORDER_ID")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("doc_id", "label", "text", *_n("start", "end"))


# A bare number within 30 characters after "order"; claimed numbers all follow a dash.
NEAR = r"""near AS (
  SELECT doc_id, 'ORDER_ID' AS label, num AS text, (kw + 5 + length(lead))::BIGINT AS "start" FROM (
    SELECT doc_id, kw, regexp_extract(win, '^(.*?)\b\d{4,8}\b', 1) AS lead, regexp_extract(win, '\b\d{4,8}\b') AS num FROM (
      SELECT w.doc_id, "start" AS kw, substr(s.text, "start" + 6, 30) AS win FROM words_order w JOIN sentences s USING (doc_id)))
  WHERE num <> '' AND lead NOT LIKE '%-')"""
ORDER_WORD = offsets_sql("sentences", "doc_id", r"(?i)\border\b", "KEYWORD", "words_order")


@register(
    "n2e_order_near_keyword",
    with_ctes(SENTENCES, ORDER_WORD, NEAR)
    + """SELECT DISTINCT doc_id, label, text, "start", "start" + length(text) AS "end" FROM near""",
)
def n2e(spark, sf):
    return entities.order_entities_near_keyword(T.support_sentences(spark, sf), ["doc_id"]).select(
        "doc_id", "label", "text", *_n("start", "end")
    )


ALL_RULES = (
    SENTENCES,
    *ID_CTES,
    offsets_sql("sentences", "doc_id", EMAIL_SQL, "EMAIL", "eml"),
    offsets_sql("sentences", "doc_id", PHONE_SQL, "PHONE", "phn"),
    offsets_sql("sentences", "doc_id", MONEY_SQL, "MONEY", "mny"),
    ORDER_WORD,
    NEAR,
    """ents AS (
  SELECT *, "start" + length(text) AS "end" FROM (
    SELECT * FROM inv UNION ALL SELECT * FROM acc UNION ALL SELECT * FROM ord UNION ALL SELECT * FROM eml
    UNION ALL SELECT * FROM phn UNION ALL SELECT * FROM mny UNION ALL SELECT * FROM near))""",
)


@register("n2f_rule_entities", with_ctes(*ALL_RULES) + """SELECT doc_id, label, text, "start", "end" FROM ents""")
def n2f(spark, sf):
    return entities.rule_entities(T.support_sentences(spark, sf), ["doc_id"]).select(
        "doc_id", "label", "text", *_n("start", "end")
    )


# The same on whole documents, by priority: a span that meets one of a higher rank goes.
DOC_RULES = (
    PHONE_DOCS,
    offsets_sql("documents", "doc_id", EMAIL_SQL, "EMAIL", "d1"),
    offsets_sql("documents", "doc_id", r"(?i)\bINV-\d{4}-\d{3,6}\b", "INVOICE_ID", "d2"),
    offsets_sql("documents", "doc_id", r"(?i)\b(?:ACC\d{5,8}|A-\d{4,8})\b", "ACCOUNT_ID", "d3"),
    offsets_sql("documents", "doc_id", r"(?i)\bORD-\d{5,8}\b", "ORDER_ID", "d4"),
    offsets_sql("documents", "doc_id", MONEY_SQL, "MONEY", "d6"),
    offsets_sql("documents", "doc_id", r"(?i)\border\b", "KEYWORD", "words_order"),
    NEAR.replace("JOIN sentences s", "JOIN documents s").replace("AND lead NOT LIKE '%-'", ""),
    """ranked AS (
  SELECT *, "start" + length(text) AS "end" FROM (
    SELECT *, 1 AS rank FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3 UNION ALL SELECT *, 4 FROM d4
    UNION ALL SELECT *, 5 FROM doc_phones UNION ALL SELECT *, 6 FROM d6 UNION ALL SELECT DISTINCT *, 7 FROM near))""",
)


@register(
    "n2f_rule_entities_documents",
    with_ctes(*DOC_RULES)
    + """SELECT doc_id, label, text, "start", "end" FROM ranked a WHERE NOT EXISTS (
  SELECT 1 FROM ranked b WHERE b.doc_id = a.doc_id AND b.rank < a.rank AND b."start" < a."end" AND b."end" > a."start")""",
)
def n2f_docs(spark, sf):
    return entities.rule_entities(T.read(spark, sf, "documents"), ["doc_id"]).select(
        "doc_id", "label", "text", *_n("start", "end")
    )


@register(
    "f11_pii_entities",
    with_ctes(*ALL_RULES) + """SELECT doc_id, label, "start" FROM ents WHERE label <> 'MONEY'""",
)
def f11(spark, sf):
    found = entities.rule_entities(T.support_sentences(spark, sf), ["doc_id"])
    return rules.pii_entities(found).select("doc_id", "label", *_n("start"))


# Every kind of identifier in these sentences can be replaced where it stands.
MASKED = r"""masked AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '[\w.+-]+@[\w-]+\.[\w.-]*\w', '[EMAIL]', 'g'), '\bINV-\d{4}-\d{3,6}\b', '[INVOICE_ID]', 'g'),
    '\b(?:ACC\d{5,8}|A-\d{4,8})\b', '[ACCOUNT_ID]', 'g'), '\bORD-\d{5,8}\b', '[ORDER_ID]', 'g'),
    '\(\d{3}\) \d{3}-\d{4}', '[PHONE]', 'g'), 'order number is uh \d{4,8}\b', 'order number is uh [ORDER_ID]', 'g') AS masked_text
  FROM sentences)"""


@register("n3_mask_pii", with_ctes(SENTENCES, MASKED) + "SELECT doc_id, masked_text FROM masked")
def n3(spark, sf):
    text = F.col("text")
    return T.support_sentences(spark, sf).select("doc_id", spans.mask(text, spans.rule_spans(text)).alias("masked_text"))


@register(
    "n3_mask_emails_documents",
    rf"""SELECT doc_id, sha256(regexp_replace(text, '{EMAIL_SQL}', '[EMAIL]', 'g')) AS masked_sha FROM documents""",
)
def n3_docs(spark, sf):
    """E-mails of whole documents; the hash stands for the text."""
    text = F.col("text")
    found = spans.find_all(text, C.EMAIL_PATTERN, "EMAIL")
    return T.read(spark, sf, "documents").select("doc_id", F.sha2(spans.mask(text, found), 256).alias("masked_sha"))


@register(
    "n4a_money_value",
    with_ctes(SENTENCES, offsets_sql("sentences", "doc_id", MONEY_SQL, "MONEY", "found"))
    + r"""SELECT doc_id, TRY_CAST(regexp_replace(text, '[^\d.]', '', 'g') AS DOUBLE) AS value FROM found""",
)
def n4a(spark, sf):
    found = entities.pattern_entities(T.support_sentences(spark, sf), ["doc_id"], "MONEY")
    return found.select("doc_id", spans.money_value(F.col("text")).alias("value"))


@register(
    "n4b_phone_digits",
    r"""SELECT doc_id, CASE WHEN length(d) BETWEEN 7 AND 15 THEN d END AS digits FROM (
  SELECT doc_id, regexp_replace('+1 (' || (doc_id % 1000)::VARCHAR || ') ' || n_chars::VARCHAR || '-x' || doc_id::VARCHAR, '[^\d]', '', 'g') AS d FROM documents)""",
)
def n4b(spark, sf):
    raw = F.concat(
        F.lit("+1 ("), (F.col("doc_id") % 1000).cast("string"), F.lit(") "), F.col("n_chars").cast("string"),
        F.lit("-x"), F.col("doc_id").cast("string"),
    )
    return T.read(spark, sf, "documents").select("doc_id", spans.phone_digits(raw).alias("digits"))


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
DATE_TEXT_SQL = f"""dates AS (
  SELECT o_orderkey AS doc_id, CASE o_orderkey % 6
    WHEN 0 THEN mon || ' ' || dd || ', ' || yy WHEN 1 THEN mon || ' ' || dd WHEN 2 THEN mm || '/' || dd || '/' || yy
    WHEN 3 THEN mm || '/' || dd || '/' || yy[3:4] WHEN 4 THEN yy || '-' || mm || '-' || dd ELSE 'next ' || mon END AS text
  FROM (SELECT o_orderkey, ['{"', '".join(MONTHS)}'][month(o_orderdate)] AS mon, month(o_orderdate)::VARCHAR AS mm,
    day(o_orderdate)::VARCHAR AS dd, (year(o_orderdate) + CASE WHEN o_orderkey % 4 = 1 THEN 70 ELSE 0 END)::VARCHAR AS yy FROM orders))"""


def _date_texts(spark, sf):
    d = F.col("o_orderdate")
    mon = T.pick(MONTHS, F.month(d) - 1)
    mm, dd = F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    yy = (F.year(d) + F.when(F.col("o_orderkey") % 4 == 1, 70).otherwise(0)).cast("string")
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(mon, F.lit(" "), dd, F.lit(", "), yy))
        .when(k == 1, F.concat(mon, F.lit(" "), dd))
        .when(k == 2, F.concat_ws("/", mm, dd, yy))
        .when(k == 3, F.concat_ws("/", mm, dd, yy.substr(3, 2)))
        .when(k == 4, F.concat_ws("-", yy, mm, dd))
        .otherwise(F.concat(F.lit("next "), mon))
    )
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


ISO_SQL = r"""coalesce(strftime(try_strptime(text, '%B %d, %Y'), '%Y-%m-%d'), strftime(try_strptime(text || ', 1900', '%B %d, %Y'), '--%m-%d'),
  CASE WHEN regexp_matches(text, '/\d{4}$') THEN strftime(try_strptime(text, '%m/%d/%Y'), '%Y-%m-%d') END, strftime(try_strptime(text, '%m/%d/%y'), '%Y-%m-%d'),
  strftime(try_strptime(text, '%Y-%m-%d'), '%Y-%m-%d'))"""


@register("n4c_iso_date", with_ctes(DATE_TEXT_SQL) + f"SELECT doc_id, text, {ISO_SQL} AS iso FROM dates")
def n4c(spark, sf):
    return _date_texts(spark, sf).select("doc_id", "text", spans.iso_date(F.col("text")).alias("iso"))


@register(
    "n4d_normalize_entity",
    with_ctes(*ALL_RULES)
    + r"""SELECT doc_id, label, text, CASE label WHEN 'MONEY' THEN regexp_replace(text, '[^\d.]', '', 'g')::DOUBLE
  WHEN 'PHONE' THEN regexp_replace(text, '[^\d]', '', 'g')::DOUBLE END AS normalized FROM ents""",
)
def n4d(spark, sf):
    found = entities.rule_entities(T.support_sentences(spark, sf), ["doc_id"])
    value = spans.normalized(F.col("label"), F.col("text"))
    return found.select("doc_id", "label", "text", value.try_cast("double").alias("normalized"))


@register(
    "n7_tokenize",
    rf"""SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha FROM (
  SELECT doc_id, regexp_extract_all(text, '[{W}]+(?:[-/.][{W}]+)*|[^\s\p{{Z}}\x{{85}}\x0b]') AS t FROM documents)""",
)
def n7(spark, sf):
    t = tx.tokens(F.col("text"))
    return T.read(spark, sf, "documents").select(
        "doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha")
    )


@register(
    "n10_call_id_of_path",
    r"""SELECT doc_id, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]*$', '') AS call_id, round(n_chars / 7.0, 3) AS seconds
FROM (SELECT *, 'raw/' || source || '/' || lang || '.' || doc_id::VARCHAR || '.wav' AS path FROM documents)""",
)
def n10(spark, sf):
    path = F.concat(F.lit("raw/"), "source", F.lit("/"), "lang", F.lit("."), F.col("doc_id").cast("string"), F.lit(".wav"))
    return T.read(spark, sf, "documents").select(
        "doc_id", tx.call_id_of(path).alias("call_id"), tx.rounded_seconds(F.col("n_chars") / 7.0).alias("seconds")
    )


@register("n12_content_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def n12(spark, sf):
    return T.read(spark, sf, "documents").select(
        "doc_id", tx.md5_hex(F.col("text")).alias("md5"), tx.sha256_hex(F.col("text")).alias("sha256")
    )


# --- conflicts between two sources of spans --------------------------------------

PLACED = TOKENS + """,
placed AS (
  SELECT sent_id, pos, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY sent_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start" FROM tokens),
model AS (
  SELECT sent_id AS doc_id, CASE WHEN length(token) % 2 = 0 THEN 'PERSON' ELSE 'DATE' END AS label, "start", "start" + length(token) AS "end",
    'model' AS source FROM placed WHERE pos % 3 = 0),
rules AS (
  SELECT sent_id AS doc_id, 'ORDER_ID' AS label, CASE WHEN pos % 8 = 0 THEN "start" ELSE greatest("start" - 2, 0) END AS "start",
    CASE WHEN pos % 8 = 0 THEN "start" + length(token) ELSE "start" + 3 END AS "end", 'rule' AS source
  FROM placed WHERE pos % 4 = 0)"""


def _two_sources(spark, sf):
    placed = entities.token_offsets(T.words(spark, sf)).withColumnRenamed("sent_id", "doc_id")
    start, end, exact = F.col("start"), F.col("end"), F.col("pos") % 8 == 0
    model = placed.filter(F.col("pos") % 3 == 0).select(
        "doc_id", F.when(F.length("token") % 2 == 0, "PERSON").otherwise("DATE").alias("label"), "start", "end",
        F.lit("model").alias("source"),
    )
    found = placed.filter(F.col("pos") % 4 == 0).select(
        "doc_id", F.lit("ORDER_ID").alias("label"),
        F.when(exact, start).otherwise(F.greatest(start - 2, F.lit(0))).alias("start"),
        F.when(exact, end).otherwise(start + 3).alias("end"), F.lit("rule").alias("source"),
    )
    return model, found


OVER = 'm.doc_id = r.doc_id AND m."start" < r."end" AND m."end" > r."start"'


@register(
    "j5_rules_over_model",
    with_ctes(PLACED)
    + f"""SELECT doc_id, label, "start", "end", source FROM rules UNION ALL
SELECT doc_id, label, "start", "end", source FROM model m WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE {OVER})""",
)
def j5(spark, sf):
    return entities.rules_over_model(*_two_sources(spark, sf)).select("doc_id", "label", *_n("start", "end"), "source")


LONGEST = f"""kept AS (
  SELECT *, 0 AS pref FROM model m WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE {OVER} AND r."end" - r."start" > m."end" - m."start")
  UNION ALL
  SELECT *, 1 FROM rules r WHERE NOT EXISTS (SELECT 1 FROM model m WHERE {OVER} AND m."end" - m."start" > r."end" - r."start")),
chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, "start", "end" ORDER BY pref, label) AS rn FROM kept) WHERE rn = 1)"""


@register(
    "j6_longest_spans",
    with_ctes(PLACED, LONGEST) + """SELECT doc_id, label, "start", "end", source FROM chosen""",
)
def j6(spark, sf):
    return entities.longest_spans(*_two_sources(spark, sf)).select("doc_id", "label", *_n("start", "end"), "source")


@register(
    "u2_dedupe_spans",
    with_ctes(PLACED, """stacked AS (SELECT *, 0 AS pref FROM model UNION ALL SELECT *, 1 FROM rules)""")
    + """SELECT doc_id, label, "start", "end", source FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, "start", "end" ORDER BY pref, label) AS rn FROM stacked) WHERE rn = 1""",
)
def u2(spark, sf):
    model, found = _two_sources(spark, sf)
    both = model.withColumn("pref", F.lit(0)).unionByName(found.withColumn("pref", F.lit(1)))
    return entities.dedupe_spans(both, "pref").select("doc_id", "label", *_n("start", "end"), "source")


@register(
    "u1_union_tagged",
    with_ctes(TOKENS)
    + """SELECT sent_id, pos, token, CASE WHEN sent_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS source FROM tokens""",
)
def u1(spark, sf):
    words = T.words(spark, sf)
    even = F.col("sent_id") % 2 == 0
    return sampling.union_tagged(words.filter(even), words.filter(~even))


# Entities that cover a token and the beginning of the next; neighbours overlap.
COVER = """cover AS (SELECT sent_id, pos AS ent_idx, CASE WHEN pos % 2 = 0 THEN 'PERSON' ELSE 'PRODUCT' END AS label,
  "start", "start" + length(token) + 3 AS "end" FROM placed WHERE pos % 5 < 2),
covered AS (
  SELECT t.sent_id, t.pos, c.ent_idx, c.label, min(t.pos) OVER (PARTITION BY c.sent_id, c.ent_idx) AS begin
  FROM placed t JOIN cover c ON t.sent_id = c.sent_id AND t."start" < c."end" AND t."start" + length(t.token) > c."start"),
bio AS (
  SELECT sent_id, pos, arg_max(CASE WHEN pos = begin THEN 'B-' ELSE 'I-' END || label, ent_idx) AS tag FROM covered GROUP BY 1, 2)"""


def _cover(placed):
    return placed.filter(F.col("pos") % 5 < 2).select(
        "sent_id", F.col("pos").alias("ent_idx"), F.when(F.col("pos") % 2 == 0, "PERSON").otherwise("PRODUCT").alias("label"),
        "start", (F.col("end") + 3).alias("end"),
    )


@register(
    "j7_spans_to_bio",
    with_ctes(PLACED, COVER)
    + "SELECT sent_id, pos, coalesce(tag, 'O') AS tag FROM placed LEFT JOIN bio USING (sent_id, pos)",
)
def j7(spark, sf):
    placed = entities.token_offsets(T.words(spark, sf))
    return entities.spans_to_bio(placed, _cover(placed)).select("sent_id", "pos", "tag")


@register(
    "w4_flat_to_bio",
    with_ctes(
        TOKENS,
        """flat AS (SELECT sent_id, pos, ['O', 'PERSON', 'PRODUCT'][1 + length(token) % 3] AS label FROM tokens),
prev AS (SELECT *, lag(label) OVER (PARTITION BY sent_id ORDER BY pos) AS before FROM flat)""",
    )
    + "SELECT sent_id, pos, CASE WHEN label = 'O' THEN 'O' WHEN label = before THEN 'I-' || label ELSE 'B-' || label END AS tag FROM prev",
)
def w4(spark, sf):
    flat = T.words(spark, sf).withColumn("label", T.pick(["O", "PERSON", "PRODUCT"], F.length("token") % 3))
    return entities.flat_to_bio(flat).select("sent_id", "pos", "tag")


@register(
    "f7_map_labels",
    with_ctes(TOKENS)
    + """SELECT sent_id, pos, ['PERSON', 'ORGANIZATION', 'LOCATION', 'PRODUCT', 'O', 'O'][1 + length(token) % 6] AS label FROM tokens""",
)
def f7(spark, sf):
    coarse = ["person", "organization", "location", "product", "art", "O"]
    rows = T.words(spark, sf).withColumn("label", T.pick(coarse, F.length("token") % 6))
    return rules.map_labels(rows, "label", C.CORPUS_TYPE_MAP, "O").select("sent_id", "pos", "label")


@register(
    "f7_map_labels_drop",
    with_ctes(TOKENS)
    + """SELECT * FROM (SELECT sent_id, pos, ['PERSON', 'ORGANIZATION', 'LOCATION', 'LOCATION', NULL, 'DATE'][1 + length(token) % 6] AS label FROM tokens)
WHERE label IS NOT NULL""",
)
def f7_drop(spark, sf):
    fine = ["PERSON", "ORG", "GPE", "LOC", "NORP", "DATE"]
    rows = T.words(spark, sf).withColumn("label", T.pick(fine, F.length("token") % 6))
    return rules.map_labels(rows, "label", C.TAGGER_TYPE_MAP, None).select("sent_id", "pos", "label")


@register(
    "f8_has_target",
    with_ctes(TOKENS, "rare AS (SELECT sent_id, pos, CASE WHEN length(token) > 12 THEN 'B-PERSON' ELSE 'O' END AS tag FROM tokens)")
    + "SELECT sent_id, pos, tag FROM rare WHERE sent_id IN (SELECT sent_id FROM rare WHERE tag <> 'O')",
)
def f8(spark, sf):
    rare = T.words(spark, sf).withColumn("tag", F.when(F.length("token") > 12, "B-PERSON").otherwise("O"))
    return rules.has_target(rare).select("sent_id", "pos", "tag")


@register(
    "w5a_bio_to_spans_strict",
    with_ctes(
        TAGGED,
        tag_runs("true_tags", "runs"),
        """sized AS (
  SELECT sent_id, pos, token, length(token) AS len, (50 + length(token) % 50) / 100.0::DOUBLE AS conf, coalesce(sum(length(token) + 1) OVER (
    PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start" FROM true_tags)""",
    )
    + """SELECT r.sent_id, r.label, min("start") AS "start", max("start" + len)::BIGINT AS "end", round(avg(conf), 6) AS confidence,
  string_agg(token, ' ' ORDER BY s.pos) AS text
FROM runs r JOIN sized s ON r.sent_id = s.sent_id AND s.pos >= r.first_pos AND s.pos < r.end_pos
WHERE r.first_tag LIKE 'B-%' GROUP BY r.sent_id, r.label, r.first_pos""",
)
def w5a(spark, sf):
    placed = entities.token_offsets(T.tagged(spark, sf)).withColumn(
        "confidence", (50 + F.length("token") % 50) / F.lit(100.0)
    )
    found = entities.slice_text(entities.bio_to_spans_strict(placed), entities.joined_tokens(placed), "sent_id")
    return found.select("sent_id", "label", *_n("start", "end"), *_r("confidence"), "text")


@register(
    "w5b_bio_to_spans_lenient",
    with_ctes(TAGGED, tag_runs("true_tags", "runs")) + "SELECT sent_id, label, first_pos, end_pos FROM runs",
)
def w5b(spark, sf):
    return entities.bio_to_spans_lenient(T.tagged(spark, sf)).select("sent_id", "label", "first_pos", "end_pos")


HITS = """hits AS (SELECT t.source, t.label FROM t JOIN p USING (sent_id, label, first_pos, end_pos)),
per AS (
  SELECT source, label, sum(nt)::BIGINT AS nt, sum(np)::BIGINT AS np, sum(nh)::BIGINT AS nh FROM (
    SELECT source, label, 1 AS nt, 0 AS np, 0 AS nh FROM t UNION ALL SELECT source, label, 0, 1, 0 FROM p
    UNION ALL SELECT source, label, 0, 0, 1 FROM hits) GROUP BY 1, 2)"""


def prf(keys: str, source: str) -> str:
    return f"""SELECT {keys}, CASE WHEN np > 0 THEN round(nh / np, 6) ELSE 0 END AS precision, CASE WHEN nt > 0 THEN round(nh / nt, 6) ELSE 0 END AS recall,
  CASE WHEN np + nt > 0 THEN round(2 * nh / (np + nt), 6) ELSE 0 END AS f1, nt AS support FROM {source}"""


@register(
    "g18_entity_metrics",
    with_ctes(
        TAGGED, tag_runs("true_tags", "t"), tag_runs("pred_tags", "p"), HITS,
        "one AS (SELECT label, sum(nt)::BIGINT AS nt, sum(np)::BIGINT AS np, sum(nh)::BIGINT AS nh FROM per GROUP BY 1)",
        "tot AS (SELECT 'micro avg' AS label, sum(nt)::BIGINT AS nt, sum(np)::BIGINT AS np, sum(nh)::BIGINT AS nh FROM one)",
        f"types AS ({prf('label', 'one').replace('round(', '(').replace(', 6)', ')')})",
    )
    + f"""SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM types
UNION ALL {prf('label', 'tot')}
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM types
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM types""",
)
def g18(spark, sf):
    out = evaluate.span_metrics(T.tagged(spark, sf), T.predicted_tags(spark, sf))
    return out.select("label", *_r("precision", "recall", "f1"), *_n("support"))


BY_SOURCE = """every AS (
  SELECT source, label, nt, np, nh FROM per UNION ALL
  SELECT 'all', label, sum(nt)::BIGINT, sum(np)::BIGINT, sum(nh)::BIGINT FROM per GROUP BY 2),
sums AS (SELECT source, 'micro avg' AS label, sum(nt)::BIGINT AS nt, sum(np)::BIGINT AS np, sum(nh)::BIGINT AS nh FROM every GROUP BY 1)"""


@register(
    "g19_entity_metrics_by_source",
    with_ctes(TAGGED, tag_runs("true_tags", "t"), tag_runs("pred_tags", "p"), HITS, BY_SOURCE)
    + prf("source, label", "every") + " UNION ALL " + prf("source, label", "sums"),
)
def g19(spark, sf):
    out = evaluate.span_metrics_by(T.tagged(spark, sf), T.predicted_tags(spark, sf))
    return out.select("source", "label", *_r("precision", "recall", "f1"), *_n("support"))


# --- fields and composed analyses ---------------------------------------------------

FIELDS_SQL = """SELECT doc_id, arg_min(text, "start") FILTER (WHERE label = 'PERSON') AS customer,
  arg_min(text, "start") FILTER (WHERE label = 'ORDER_ID') AS order_id, arg_min(text, "start") FILTER (WHERE label = 'PRODUCT') AS product,
  NULL::VARCHAR AS issue, arg_min(text, "start") FILTER (WHERE label = 'DATE') AS date,
  arg_min(text, "start") FILTER (WHERE label = 'MONEY') AS amount FROM ents GROUP BY 1"""


@register("t3_structured_fields", with_ctes(*ALL_RULES) + FIELDS_SQL)
def t3(spark, sf):
    return entities.structured_fields(entities.rule_entities(T.support_sentences(spark, sf), ["doc_id"]))


@register(
    "c3_analyze_text",
    with_ctes(*ALL_RULES, MASKED)
    + r"""SELECT doc_id, masked_text, coalesce(n, 0) AS n_entities, order_id, amount FROM masked LEFT JOIN (
  SELECT doc_id, count(*) AS n, arg_min(text, "start") FILTER (WHERE label = 'ORDER_ID') AS order_id,
    arg_min(text, "start") FILTER (WHERE label = 'MONEY') AS amount FROM ents GROUP BY 1) USING (doc_id)""",
)
def c3(spark, sf):
    out = jobs.analyze_text(T.support_sentences(spark, sf))
    return out.select(
        "doc_id", "masked_text", F.size("entities").cast("bigint").alias("n_entities"),
        "structured_fields.order_id", "structured_fields.amount",
    )


# Call level: the sentences of a customer joined, so "order" may meet the next turn's number.
CALL_FIELDS = r"""joined AS (SELECT call_id AS doc_id, string_agg(text, ' ' ORDER BY turn_idx) AS text FROM support GROUP BY 1),
""" + ",\n".join(
    [
        offsets_sql("joined", "doc_id", r"(?i)\bORD-\d{5,8}\b", "ORDER_ID", "cord"),
        offsets_sql("joined", "doc_id", MONEY_SQL, "MONEY", "cmny"),
        offsets_sql("joined", "doc_id", r"(?i)\border\b", "KEYWORD", "ckey"),
        NEAR.replace("near AS", "cnear AS").replace("words_order", "ckey").replace("sentences", "joined"),
    ]
)


@register(
    "c4_call_fields",
    with_ctes(SUPPORT, CALL_FIELDS)
    + """SELECT j.doc_id AS call_id, order_id, amount FROM joined j LEFT JOIN (
  SELECT doc_id, arg_min(text, "start") AS order_id FROM (SELECT * FROM cord UNION ALL SELECT * FROM cnear) GROUP BY 1) o ON j.doc_id = o.doc_id
LEFT JOIN (SELECT doc_id, arg_min(text, "start") AS amount FROM cmny GROUP BY 1) m ON j.doc_id = m.doc_id""",
)
def c4(spark, sf):
    return jobs.analyze_entities(T.support_turns(spark, sf))["calls"].select("call_id", "order_id", "amount")


@register(
    "c4_turn_masks",
    with_ctes(SENTENCES, MASKED) + "SELECT call_id, turn_idx, masked_text FROM support JOIN masked ON order_key = doc_id",
)
def c4_turns(spark, sf):
    return jobs.analyze_entities(T.support_turns(spark, sf))["turns"].select("call_id", "turn_idx", "masked_text")


def _model_ctes(model: str, bio: str) -> list[str]:
    """Counts of one extractor against the truth, under names of its own."""
    tags = f"""{model}_tags AS (SELECT sent_id, pos, coalesce(b.tag, 'O') AS tag, source FROM true_tags LEFT JOIN {bio} b USING (sent_id, pos))"""
    own = [re.sub(r"\bp\b", f"{model}_p", HITS.replace("hits", f"{model}_hits").replace("per AS", f"{model}_per AS")),
           BY_SOURCE.replace("every", f"{model}_every").replace("sums", f"{model}_sums").replace("FROM per", f"FROM {model}_per")]
    return [tags, tag_runs(f"{model}_tags", f"{model}_p"), *own]


# A second extractor: every token of six letters is a product.
LONG_WORDS = """long_bio AS (SELECT sent_id, pos, 'B-PRODUCT' AS tag FROM placed WHERE length(token) = 6)"""


@register(
    "c10_evaluate_ner",
    with_ctes(
        PLACED,
        COVER,
        LONG_WORDS,
        """true_tags AS (
  SELECT sent_id, pos, ['O', 'B-PERSON', 'I-PERSON', 'B-PRODUCT', 'I-PRODUCT'][1 + length(token) % 5] AS tag,
    CASE WHEN sent_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS source FROM tokens)""",
        tag_runs("true_tags", "t"),
        *_model_ctes("cover", "bio"),
        *_model_ctes("long", "long_bio"),
    )
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, * FROM ({prf('source, label', f'{m}_every')} UNION ALL {prf('source, label', f'{m}_sums')})" for m in ("cover", "long")
    ),
)
def c10(spark, sf):
    """Two extractors side by side."""
    words = T.words(spark, sf)
    placed = entities.token_offsets(words)
    long = placed.where("length(token) = 6").select("sent_id", F.col("pos").alias("ent_idx"), F.lit("PRODUCT").alias("label"), "start", "end")
    out = jobs.evaluate_ner(words, T.tagged(spark, sf), {"cover": _cover(placed), "long": long})
    return out.select("model", "source", "label", *_r("precision", "recall", "f1"), *_n("support"))
