"""Registry of queries with their DuckDB counterparts, and shared SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def literal_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


WORDS = r"'[^\s\p{Z}\x{85}\x{1c}-\x{1f}\x0b]+'"

BARE = """bare AS (
  SELECT conv_id AS call_id, turn AS turn_idx,
    CASE role WHEN 'user' THEN 'CUSTOMER' WHEN 'assistant' THEN 'AGENT' ELSE upper(role) END AS speaker,
    text, conv_id % 7 AS agent_id
  FROM conversations)"""


def clock(source: str, out: str) -> str:
    return f"""{out}_w AS (
  SELECT *, 400 * CAST(len(regexp_extract_all(text, {WORDS})) AS BIGINT) AS dur FROM {source}),
{out} AS (
  SELECT * EXCLUDE (dur, start_ms), start_ms, start_ms + dur AS end_ms FROM (
    SELECT *, CAST(coalesce(sum(dur + 400) OVER (PARTITION BY call_id ORDER BY turn_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM {out}_w))"""


TURNS = BARE + ",\n" + clock("bare", "turns")


def scored(source: str, out: str = "scored") -> str:
    return f"""{out} AS (
  SELECT *, ['negative', 'neutral', 'positive'][1 + length(text) % 3] AS sentiment,
    (50 + length(text) % 50) / 100.0::DOUBLE AS conf,
    ['anger', 'fear', 'joy', 'love', 'sadness', 'surprise'][1 + (length(text) + turn_idx) % 6] AS emotion,
    ['ACCOUNT', 'CANCEL', 'CONTACT', 'DELIVERY', 'FEEDBACK', 'INVOICE', 'ORDER', 'PAYMENT', 'REFUND',
     'SHIPPING', 'SUBSCRIPTION'][1 + length(text) % 11] AS intent
  FROM {source}),
{out}_s AS (SELECT *, CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS s FROM {out})"""


SUPPORT = """support_bare AS (
  SELECT o_custkey AS call_id, o_orderkey AS order_key,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS turn_idx,
    CASE o_orderkey % 8
      WHEN 0 THEN 'my order number is uh ' || lpad(o_orderkey::VARCHAR, 6, '0')
      WHEN 1 THEN 'it is ORD-' || lpad(o_orderkey::VARCHAR, 6, '0') || ' on INV-2024-' || lpad((o_orderkey % 1000)::VARCHAR, 4, '0')
      WHEN 2 THEN 'account ACC' || lpad(o_orderkey::VARCHAR, 6, '0') || ' was charged $' || (1 + o_orderkey % 9)::VARCHAR
        || ',' || lpad((o_orderkey * 7 % 1000)::VARCHAR, 3, '0') || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0')
      WHEN 3 THEN 'write to user' || o_orderkey::VARCHAR || '@example.com or call (415) 555-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')
      WHEN 4 THEN 'please let me speak to someone'
      WHEN 5 THEN 'else about order'
      WHEN 6 THEN lpad(o_orderkey::VARCHAR, 6, '0') || ' is the number, let me transfer you now'
      ELSE 'thank you, A-' || lpad(o_orderkey::VARCHAR, 6, '0') || ' is closed' END AS text
  FROM orders JOIN customer ON o_custkey = c_custkey),
support_who AS (SELECT *, CASE WHEN turn_idx % 2 = 0 THEN 'CUSTOMER' ELSE 'AGENT' END AS speaker FROM support_bare),
""" + clock("support_who", "support")

FRAMES = """frames AS (
  SELECT user_id AS call_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS frame,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM events GROUP BY ALL)"""

REGIONS = FRAMES + """,
speech AS (SELECT call_id, frame FROM frames WHERE cents > 300),
totals AS (SELECT call_id, max(frame) + 1 AS n_frames FROM frames GROUP BY 1),
marks AS (
  SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY call_id ORDER BY frame) - 1 >= 10 THEN 1 ELSE 0 END AS brk
  FROM speech),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY call_id ORDER BY frame) AS run FROM marks),
spans AS (SELECT call_id, run, min(frame) AS first, max(frame) + 1 AS last FROM runs GROUP BY 1, 2),
ends AS (
  SELECT call_id, n_frames, first, CASE WHEN n_frames - last < 10 THEN n_frames ELSE last END AS last
  FROM spans JOIN totals USING (call_id)),
regions AS (
  SELECT call_id, greatest(0, first * 30 - 100) AS start_ms, least(n_frames * 30, last * 30 + 100) AS end_ms
  FROM ends WHERE last - first >= 6)"""

ASR = TURNS + """,
asr AS (SELECT call_id, turn_idx AS seg_idx, start_ms, end_ms, text FROM turns),
durations AS (SELECT call_id, max(end_ms) AS duration_ms FROM turns GROUP BY 1),
speakers AS (
  SELECT call_id, i AS spk_idx, CASE WHEN i % 2 = 0 THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker,
    i * 7000 AS start_ms, i * 7000 + 7000 AS end_ms
  FROM (SELECT call_id, unnest(generate_series(0, CAST(ceil(duration_ms / 7000.0) AS BIGINT) - 1)) AS i FROM durations)
  WHERE i % 5 <> 4)"""

TOKENS = """tokens AS (
  SELECT sent_id, pos, token FROM (
    SELECT sent_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM (
      SELECT conv_id * 100000 + turn AS sent_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws
      FROM conversations)))"""

TAGGED = TOKENS + """,
true_tags AS (
  SELECT sent_id, pos, token, ['O', 'B-PERSON', 'I-PERSON', 'B-PRODUCT', 'I-PRODUCT'][1 + length(token) % 5] AS tag,
    CASE WHEN sent_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS source
  FROM tokens),
pred_tags AS (SELECT * REPLACE (CASE WHEN pos % 7 = 0 THEN 'O' ELSE tag END AS tag) FROM true_tags)"""


def tag_runs(source: str, out: str) -> str:
    """Runs of tags as an ordered scan would see them, over all tokens."""
    return f"""{out}_p AS (
  SELECT *, lag(tag) OVER (PARTITION BY sent_id ORDER BY pos) AS before FROM {source}),
{out}_r AS (
  SELECT *, sum(CASE WHEN tag = 'O' OR tag LIKE 'B-%' OR before IS NULL OR before = 'O' OR substr(before, 3) <> substr(tag, 3)
    THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY pos) AS run FROM {out}_p),
{out} AS (
  SELECT sent_id, source, substr(min(tag), 3) AS label, min(pos) AS first_pos, max(pos) + 1 AS end_pos,
    arg_min(tag, pos) AS first_tag
  FROM {out}_r WHERE tag <> 'O' GROUP BY sent_id, source, run)"""


PREDS = """preds AS (
  SELECT doc_id, lang AS y_true,
    CASE WHEN n_chars % 4 = 0 THEN 'en' WHEN n_chars % 7 = 0 THEN 'fr' ELSE lang END AS y_pred
  FROM documents)"""

MANIFEST = """manifest AS (
  SELECT doc_id, 'audio/' || doc_id::VARCHAR || '.' || ext AS path, ext AS extension, ext AS format,
    doc_id % 97 <> 0 AS present, CASE WHEN doc_id % 89 = 0 THEN 0 ELSE n_chars END AS size_bytes,
    doc_id % 83 <> 0 AS readable, n_chars AS frames, n_chars / 10.0::DOUBLE AS duration_seconds,
    CASE WHEN source = 'src1' THEN 8000 ELSE 16000 END AS sample_rate,
    CASE WHEN source = 'src2' THEN 2 ELSE 1 END AS channels
  FROM (SELECT *, CASE lang WHEN 'en' THEN 'wav' WHEN 'fr' THEN 'flac' WHEN 'de' THEN 'mp3' ELSE 'ogg' END AS ext FROM documents)),
checked AS (
  SELECT *, CASE WHEN NOT present THEN 'File does not exist'
      WHEN size_bytes = 0 THEN 'File is empty (0 bytes)'
      WHEN extension NOT IN ('wav', 'flac', 'mp3') THEN 'Unsupported format ''.' || extension || ''''
      WHEN NOT readable THEN 'Corrupted or unreadable audio'
      WHEN frames = 0 OR duration_seconds <= 0 THEN 'Audio contains zero frames' END AS stop
  FROM manifest),
validated AS (
  SELECT *, coalesce(stop, concat_ws('; ',
      CASE WHEN duration_seconds < 20.0 THEN 'Duration ' || printf('%.3f', duration_seconds) || 's is below minimum 20.0s' END,
      CASE WHEN duration_seconds > 600.0 THEN 'Duration ' || printf('%.1f', duration_seconds) || 's exceeds maximum 600.0s' END)) AS errors,
    CASE WHEN stop IS NOT NULL THEN '' ELSE concat_ws('; ',
      CASE WHEN sample_rate <> 16000 THEN 'Sample rate ' || sample_rate || 'Hz differs from target 16000Hz' END,
      CASE WHEN channels <> 1 THEN channels || ' channel(s) found, target is 1' END) END AS warnings
  FROM checked)"""
