"""The queries of this package over the shared tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bpe, divergence, fingerprint, html, jaccard, language, mixing, quality, recurrent, repair, sharding, toxicity, warc
from callweave.llm.common import documents_as_calls
from callweave.session import settle


def _remainder(n: int) -> Column:
    return F.crc32(F.col("call_id").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = documents_as_calls(spark, sf_dir)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = language.fit_language_model(calls.where(~held_out))
    return language.identify_language(calls, model).select(
        F.col("call_id").alias("doc_id"), held_out.alias("held_out"), F.col("language").alias("lang_pred"), "score"
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess_quality(documents_as_calls(spark, sf_dir)).withColumnRenamed("call_id", "doc_id")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = settle(documents_as_calls(spark, sf_dir).select("call_id", "source", mixing.word_count("text").alias("size")))
    mixed = mixing.mix_sources(sized, mixing.mixing_rules(sized))
    return mixed.select(
        F.col("call_id").alias("doc_id"), "size", "_mix.source_size", "_mix.target", (F.col("copies") * F.col("size")).alias("taken")
    )


def bpe_digests(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """Encodes the texts, decodes the ids again and reduces both to digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(calls, ranks, public_tokenizers.PATTERN).withColumnRenamed("call_id", "doc_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark, documents_as_calls(spark, sf_dir))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html.extract_main_text(pages).withColumn("n_chars", F.length("text").cast("bigint"))


def toxicity_model(calls: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learns from labels outside the held-out part only."""
    named = labels.select(F.col("doc_id").alias("call_id"), "toxic")
    return toxicity.fit_toxicity(calls, named.where(_remainder(4) != 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = documents_as_calls(spark, sf_dir)
    model = toxicity_model(calls, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(calls, model).select(
        F.col("call_id").alias("doc_id"), F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
        "score", "predicted", "n_hits", "n_quoted",
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_near_copies(documents_as_calls(spark, sf_dir)).withColumnRenamed("call_id", "doc_id")


def op9_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(documents_as_calls(spark, sf_dir)).withColumnRenamed("call_id", "doc_id")


def op10_interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.interleave_shards(documents_as_calls(spark, sf_dir))
    return shards.select(
        F.col("call_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents_as_calls(spark, sf_dir)).withColumnRenamed("language", "lang")


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """The rows of `conversations` as turns of calls, one in four of them damaged; nulls are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").alias("call_id"), F.col("turn").alias("turn_idx"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("speaker"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.expr("CAST(array() AS ARRAY<INT>)")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = repair.repair_calls(damaged_turns(conversations), repair.Speakers("user", "assistant", "system"))
    of_call = {"c": repaired.calls, "d": repair.digest_calls(repaired.turns)}
    out = conversations.select("conv_id").distinct()
    for name, part in of_call.items():
        out = out.join(part.withColumnRenamed("call_id", f"_{name}"), F.col("conv_id").eqNullSafe(F.col(f"_{name}")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = documents_as_calls(spark, sf_dir)
    learn = F.coalesce(_remainder(7) != 2, F.lit(True))
    return recurrent.score_transcripts(calls, learn).select(
        F.col("call_id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_mix_sources": op4_mix_sources,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_html_main_text": op6_html_main_text,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_weighted_samples": op9_weighted_samples,
    "op10_interleave_shards": op10_interleave_shards,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_recurrent_scores": op13_recurrent_scores,
}

DRAWN = "('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 13))::BIGINT"

def _coverage(n: int) -> str:
    """Whether each word lies in an n-gram that its text holds twice or more."""
    return f"""
d{n} AS (
  SELECT doc_id, i, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}
  FROM (SELECT doc_id, i, CASE WHEN i + {n} <= n AND count(*) OVER (PARTITION BY doc_id, i + {n} <= n,
    array_to_string(list_slice(ws, i + 1, i + {n}), ' ')) > 1 THEN 1 ELSE 0 END AS twice FROM w))"""


# CRC-32 of bytes in SQL: `step` per byte value, then one fold over the bytes in hexadecimal.
CRC_STEPS = """
powers AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS step)"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(c // 256, step[1 + xor(c % 256, b)])))"""


def _edit(state: str, cost: str, initial: str, line: str) -> str:
    """A way to a state with one more edit: cost, audit, repaired turns."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'r': {state}.r || {line}}}"


def _repair_step() -> str:
    """Ways to the four states (s, o, u, a) after one more turn, before inserts."""
    kept, asked, answered = ("chr(10) || {} || ':' || text".format(x) for x in ("role", "'user'", "'assistant'"))
    delete = {q: _edit(q, "4", "D", "''") for q in "soua"}
    far = "{'c': 1000000, 'a': '', 'r': ''}"
    may = lambda condition, way: f"CASE WHEN {condition} THEN {way} ELSE {far} END"
    rerole = {q: may("NOT forced", _edit(q, "3 + late", "R", answered if q == "u" else asked)) for q in "soua"}
    keep = lambda q, letter: may(f"NOT forced AND letter = '{letter}'", _edit(q, "late", "K", kept))
    return f"""{delete["s"]} AS s, least({delete["o"]}, {keep("s", "s")}) AS o,
    least({delete["u"]}, {rerole["s"]}, {rerole["o"]}, {rerole["a"]}, {keep("s", "u")}, {keep("o", "u")}, {keep("a", "u")}) AS u,
    least({delete["a"]}, {rerole["u"]}, {keep("u", "a")}) AS a"""


def _insert_steps(source: str) -> str:
    asked, answered = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    ways = ", ".join(_edit(q, "3", "I", asked) for q in "soa")
    return f"""SELECT * EXCLUDE (a), least(a, {_edit("u", "3", "I", answered)}) AS a
    FROM (SELECT * EXCLUDE (u), least(u, {ways}) AS u FROM ({source}))"""


ORACLES = {
    "op2_quality_rules": rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM t),
{",".join(_coverage(n) for n in (3, 5, 7, 10))},
covered AS (
  SELECT doc_id, sum(length(word))::BIGINT AS word_chars, sum(c3)::BIGINT AS n_repeat_words,
    {", ".join(f"sum(CASE WHEN c{n} = 1 THEN length(word) ELSE 0 END)::BIGINT AS dup_chars_{n}" for n in (5, 7, 10))}
  FROM w JOIN d3 USING (doc_id, i) JOIN d5 USING (doc_id, i) JOIN d7 USING (doc_id, i) JOIN d10 USING (doc_id, i) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)),
dup AS (
  SELECT doc_id, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * chars)::BIGINT AS dup_line_chars
  FROM (SELECT doc_id, chars, count(*) AS k FROM lines WHERE chars > 0 GROUP BY doc_id, line, chars) GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
    {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in (5, 7, 10))}
  FROM t LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT *, base_failed IS FALSE AND 100 * dup_line_chars <= 30 * word_chars AND 100 * n_symbols <= 10 * n_words
  AND 100 * dup_chars_5 <= 30 * word_chars AND 100 * dup_chars_7 <= 28 * word_chars AND 100 * dup_chars_10 <= 25 * word_chars AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)""",
    "op4_mix_sources": rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS no_s,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ({DRAWN} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sizes AS (
  SELECT s, no_s, sum(size)::BIGINT AS source_size,
    [1, 2, 3][1 + (row_number() OVER (ORDER BY no_s, s) - 1) % 3]::DOUBLE AS w
  FROM base GROUP BY s, no_s),
levels AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, no_s, s) AS place,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
        ORDER BY 3 * source_size / w, no_s, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY 3 * source_size / w, no_s, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes),
opened AS (SELECT *, 3 * source_size <= level * w AS is_full, min(CASE WHEN NOT 3 * source_size <= level * w THEN place END) OVER () AS first_open FROM levels),
targets AS (
  SELECT s, no_s, source_size,
    CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE w * max(CASE WHEN place = first_open THEN level END) OVER () END AS target
  FROM opened),
rules AS (
  SELECT *, target - whole * source_size AS words_open, (ratio - whole) / (1 - (ratio - whole)) AS odds
  FROM (SELECT *, floor(ratio)::BIGINT AS whole FROM (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS ratio FROM targets))),
ranked AS (
  SELECT * REPLACE (CASE WHEN size > (whole + 1) * source_size - target THEN -1 / q ELSE q END AS q)
  FROM (SELECT *, CASE WHEN odds > 0 THEN (u / (1 - u)) / odds END AS q FROM base JOIN rules USING (s, no_s))),
-- one step per round: each row sees what the rows before it would fill
walk AS (
  SELECT s, no_s, doc_id, size, q, words_open AS room, words_open AS most, false AS got, 0 AS step FROM ranked WHERE odds > 0 AND size > 0
  UNION ALL
  SELECT s, no_s, doc_id, size, q, room - gain, CASE WHEN gain > 0 THEN room - gain ELSE most END / 2, got OR now, step + 1
  FROM (SELECT *, coalesce(sum(size) FILTER (now) OVER (PARTITION BY s, no_s), 0)::BIGINT AS gain FROM (
    SELECT *, may AND sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY s, no_s ORDER BY q, doc_id) <= room AS now
    FROM (SELECT *, NOT got AND size <= most AS may FROM walk WHERE most >= 1)))),
walked AS (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY s, no_s)),
nearest AS (
  SELECT *, min(CASE WHEN NOT got AND abs(room - size) < room THEN {{'off': abs(room - size), 'q': q, 'id': doc_id}} END) OVER (PARTITION BY s, no_s) AS e
  FROM walked)
SELECT doc_id, r.size, source_size, target, (whole + CASE WHEN n.got OR doc_id = n.e.id THEN 1 ELSE 0 END) * r.size AS taken
FROM ranked r LEFT JOIN nearest n USING (doc_id)""",
    "op3_warc_revisits": """
WITH records AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
sized AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload_digest FROM records),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
FROM largest""",
    "op8_jaccard_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
placed AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM t UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op10_interleave_shards": rf"""
WITH powers AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS step),
base AS (
  SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {DRAWN} AS u,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c // 256, step[1 + xor(c % 256, b)]))) AS text_crc32
  FROM documents, powers),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY u, doc_id, text_crc32, size) - 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY source) AS fraction FROM base),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, u, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * 16 // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, place - (shard * total + 15) // 16 AS slot, NULL::INT AS grown_shard
FROM cut""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, v, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM groups JOIN kept USING (lang) JOIN vocab USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM cells),
whole AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, v, sum(n) AS n FROM cells GROUP BY ALL)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE shares.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE {CRC_STEPS},
raw AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {_crc("key")} % 20 AS kind FROM raw, powers),
damaged AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
turns AS (
  SELECT g, turn, role, text, left(role, 1) AS letter, i,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal,
    row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut_off
  FROM placed),
coded AS (
  SELECT *, blank OR seen AS forced, NOT blank AND seen AS duplicate, NOT (blank OR seen) AND cut_off AS truncated,
    CASE WHEN cut_off THEN 3 ELSE 0 END AS late FROM turns),
sums AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (illegal) AS illegal, count(*) AS n FROM coded GROUP BY g),
ways AS (
  {_insert_steps("""SELECT g, 0::BIGINT AS i, {'c': 0, 'a': '', 'r': ''} AS s, {'c': 1000000, 'a': '', 'r': ''} AS o,
    {'c': 1000000, 'a': '', 'r': ''} AS u, {'c': 1000000, 'a': '', 'r': ''} AS a FROM sums""")}
  UNION ALL
  {_insert_steps(f"SELECT ways.g, coded.i, {_repair_step()} FROM ways JOIN coded ON coded.g = ways.g AND coded.i = ways.i + 1")}),
best AS (SELECT ways.g, least(s, a) AS w FROM ways JOIN sums ON sums.g = ways.g AND sums.n = ways.i),
ids AS (SELECT DISTINCT conv_id, g FROM raw)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
  coalesce(w.a, '') AS audit, sha256(substr(coalesce(w.r, ''), 2)) AS repaired_sha256
FROM ids LEFT JOIN sums USING (g) LEFT JOIN best USING (g)""",
}
