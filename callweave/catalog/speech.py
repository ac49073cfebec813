"""Queries on samples, frames, regions, speakers and transcripts."""

from pyspark.sql import functions as F

from callweave.catalog.base import ASR, REGIONS, register, with_ctes
from callweave.catalog.calls import _n, _r
from callweave.config import ChunkConfig, SegmentConfig, VadConfig
from callweave.functions import text as tx
from callweave.operators import align, cluster, der, rules, signal, wer
from callweave.plans import jobs
from callweave.session import settle
from callweave.sources import tables as T

SAMPLES = """samples AS (
  SELECT call_id, n % 2 AS channel, n // 2 AS idx, v FROM (
    SELECT user_id AS call_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)),
mono AS (SELECT call_id, idx, avg(v) AS v FROM samples GROUP BY 1, 2)"""
LEVEL = """peaks AS (SELECT call_id, max(abs(v)) AS peak FROM mono GROUP BY 1),
level AS (SELECT call_id, idx, CASE WHEN peak < 1e-6 THEN v ELSE v * (power(10, -3.0 / 20) / peak) END AS v FROM mono JOIN peaks USING (call_id))"""
RMS = """rms AS (
  SELECT call_id, idx // 4 AS frame, 20 * log10(greatest(sqrt(avg(v * v) + 1e-12), 1e-9)) AS db
  FROM level GROUP BY 1, 2 HAVING count(*) = 4)"""


@register("a1_to_mono", with_ctes(SAMPLES) + "SELECT call_id, idx, round(v, 6) AS v FROM mono")
def a1(spark, sf):
    return signal.to_mono(T.samples(spark, sf)).select("call_id", "idx", *_r("v"))


@register("a2_normalize_peak", with_ctes(SAMPLES, LEVEL) + "SELECT call_id, idx, round(v, 6) AS v FROM level")
def a2(spark, sf):
    return signal.normalize_peak(signal.to_mono(T.samples(spark, sf))).select("call_id", "idx", *_r("v"))


@register("a3_frame_rms_db", with_ctes(SAMPLES, LEVEL, RMS) + "SELECT call_id, frame, round(db, 6) AS db FROM rms")
def a3(spark, sf):
    level = signal.normalize_peak(signal.to_mono(T.samples(spark, sf)))
    return signal.frame_rms_db(level, 4).select("call_id", "frame", *_r("db"))


def _regions(spark, sf):
    frames = T.frames(spark, sf)
    return signal.speech_regions(frames.filter(F.col("cents") > T.SPEECH_CENTS), signal.frame_totals(frames))


NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY start_ms) - 1 AS region_idx FROM regions)"


@register("a4_speech_regions", with_ctes(REGIONS, NUMBERED) + "SELECT call_id, region_idx, start_ms, end_ms FROM numbered")
def a4(spark, sf):
    return signal.number_regions(_regions(spark, sf)).select("call_id", *_n("region_idx", "start_ms", "end_ms"))


@register(
    "a5_silent_calls",
    with_ctes(REGIONS.replace("cents > 300", "cents > 10000")) + "SELECT call_id FROM totals WHERE call_id NOT IN (SELECT call_id FROM regions)",
)
def a5(spark, sf):
    """Only loud frames count as speech, so about half of the calls have none."""
    frames = T.frames(spark, sf)
    regions = signal.speech_regions(frames.filter("cents > 10000"), signal.frame_totals(frames))
    return signal.silent_calls(frames.select("call_id").distinct(), regions)


MERGED = """gapped AS (
  SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY call_id ORDER BY start_ms) > 300 THEN 1 ELSE 0 END AS g FROM regions),
grouped AS (SELECT *, sum(g) OVER (PARTITION BY call_id ORDER BY start_ms) AS grp FROM gapped),
merged AS (SELECT call_id, min(start_ms) AS start_ms, arg_max(end_ms, start_ms) AS end_ms FROM grouped GROUP BY call_id, grp)"""


@register("a6_merge_regions", with_ctes(REGIONS, MERGED) + "SELECT call_id, start_ms, end_ms FROM merged")
def a6(spark, sf):
    return signal.merge_regions(_regions(spark, sf), 300).select("call_id", *_n("start_ms", "end_ms"))


def split_sql(source: str) -> str:
    return f"""parts AS (
  SELECT *, CASE WHEN end_ms - start_ms <= 1500 THEN 1 ELSE CAST(ceil((end_ms - start_ms) / 1500.0) AS BIGINT) END AS n FROM {source}),
cut AS (
  SELECT call_id, round(start_ms + i * ((end_ms - start_ms) / n::DOUBLE), 6) AS start_ms,
    round(start_ms + (i + 1) * ((end_ms - start_ms) / n::DOUBLE), 6) AS end_ms
  FROM (SELECT *, unnest(range(n)) AS i FROM parts))"""


@register("a7_split_regions", with_ctes(REGIONS, split_sql("regions")) + "SELECT call_id, start_ms, end_ms FROM cut")
def a7(spark, sf):
    return signal.split_regions(_regions(spark, sf), 1500).select("call_id", *_r("start_ms", "end_ms"))


SEGMENTS = SegmentConfig(merge_gap_ms=300, min_segment_ms=500, max_segment_ms=1500)


@register(
    "a8_diarization_segments",
    with_ctes(REGIONS, MERGED, "kept AS (SELECT * FROM merged WHERE end_ms - start_ms >= 500)", split_sql("kept"))
    + "SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY start_ms) - 1 AS seg_idx, start_ms, end_ms FROM cut",
)
def a8(spark, sf):
    return signal.diarization_segments(_regions(spark, sf), SEGMENTS).select(
        "call_id", *_n("seg_idx"), *_r("start_ms", "end_ms")
    )


CHUNKS = ChunkConfig(chunk_ms=6000, overlap_ms=400)

# The cut recurrence as a recursive query: one step per chunk.
CHUNK_SQL = """gaps AS (
  SELECT * FROM (SELECT call_id, lag(end_ms) OVER (PARTITION BY call_id ORDER BY start_ms) AS gs, start_ms AS ge FROM regions)
  WHERE ge >= gs),
gap_lists AS (SELECT call_id, list({'gs': gs::DOUBLE, 'ge': ge::DOUBLE} ORDER BY gs) AS gl FROM gaps GROUP BY 1),
calls AS (SELECT call_id, n_frames * 30.0::DOUBLE AS d, coalesce(gl, []) AS gl FROM totals LEFT JOIN gap_lists USING (call_id)),
step AS (
  SELECT call_id, d, gl, 0::BIGINT AS chunk_idx, 0.0::DOUBLE AS s, NULL::DOUBLE AS e, false AS done FROM calls
  UNION ALL
  SELECT call_id, d, gl, CASE WHEN e IS NULL THEN chunk_idx ELSE chunk_idx + 1 END, cur, nxt, nxt >= d FROM (
    SELECT *, CASE WHEN raw < d AND best IS NOT NULL AND abs(best - raw) <= 1500 AND best > cur THEN best ELSE raw END AS nxt FROM (
      SELECT *, list_sort(list_transform(gl, lambda g: {'dist': abs(least(greatest(raw, g.gs), g.ge) - raw), 'gs': g.gs,
          'c': least(greatest(raw, g.gs), g.ge)}))[1].c AS best
      FROM (SELECT *, CASE WHEN e IS NULL THEN 0.0 ELSE greatest(e - 400, s + 1) END AS cur,
          least(CASE WHEN e IS NULL THEN 0.0 ELSE greatest(e - 400, s + 1) END + 6000, d) AS raw FROM step WHERE NOT done))))"""


@register(
    "a9_plan_chunks",
    "WITH RECURSIVE " + REGIONS + ",\n" + CHUNK_SQL
    + " SELECT call_id, chunk_idx, round(s, 6) AS start_ms, round(e, 6) AS end_ms FROM step WHERE e IS NOT NULL",
)
def a9(spark, sf):
    totals = signal.frame_totals(T.frames(spark, sf))
    calls = totals.select("call_id", (F.col("n_frames") * 30).alias("duration_ms"))
    return signal.plan_chunks(calls, _regions(spark, sf), CHUNKS).select(
        "call_id", "chunk_idx", *_r("start_ms", "end_ms")
    )


def _embedded(spark, sf):
    return T.read(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 25).alias("call_id"), F.col("vec_id").alias("seg_idx"), "embedding", "label"
    )


@register("a10_cluster_speakers")
def a10(spark, sf):
    return cluster.cluster_speakers(_embedded(spark, sf))


@register(
    "a11_relabel_first_seen",
    """WITH firsts AS (SELECT vec_id // 25 AS call_id, label, min(vec_id) AS f FROM embeddings GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY f) - 1 AS r FROM firsts)
SELECT e.vec_id AS seg_idx, e.vec_id // 25 AS call_id, 'SPEAKER_' || lpad(r::VARCHAR, greatest(2, length(r::VARCHAR))::INT, '0') AS speaker
FROM embeddings e JOIN ranked ON e.vec_id // 25 = ranked.call_id AND e.label = ranked.label""",
)
def a11(spark, sf):
    rows = _embedded(spark, sf).select("call_id", "seg_idx", F.col("label").alias("cluster"))
    return cluster.relabel_first_seen(rows).select("seg_idx", "call_id", "speaker")


ALIGNED = """ov AS (
  SELECT a.call_id, seg_idx, speaker, sum(least(a.end_ms, s.end_ms) - greatest(a.start_ms, s.start_ms)) AS o, min(spk_idx) AS f
  FROM asr a JOIN speakers s ON a.call_id = s.call_id AND a.start_ms < s.end_ms AND s.start_ms < a.end_ms GROUP BY 1, 2, 3),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, seg_idx ORDER BY o DESC, f) AS r FROM ov) WHERE r = 1),
aligned AS (
  SELECT a.call_id, a.seg_idx, coalesce(speaker, 'UNKNOWN') AS speaker, start_ms, end_ms, text
  FROM asr a LEFT JOIN win USING (call_id, seg_idx))"""
ROLES = """openers AS (SELECT call_id, speaker, min(start_ms) AS m FROM speakers GROUP BY 1, 2),
roles AS (
  SELECT call_id, speaker, CASE WHEN r = 1 THEN 'AGENT' ELSE 'CUSTOMER' END AS role FROM (
    SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY m) AS r, count(*) OVER (PARTITION BY call_id) AS n FROM openers)
  WHERE n >= 2)"""


@register("j1_align_transcript", with_ctes(ASR, ALIGNED) + "SELECT call_id, seg_idx, speaker, start_ms, end_ms FROM aligned")
def j1(spark, sf):
    out = align.align(T.asr_segments(spark, sf), T.speaker_segments(spark, sf))
    return out.select("call_id", "seg_idx", "speaker", "start_ms", "end_ms")


@register("j2_infer_roles", with_ctes(ASR, ROLES) + "SELECT call_id, speaker, role FROM roles")
def j2(spark, sf):
    return align.infer_roles(T.speaker_segments(spark, sf))


@register(
    "j3_apply_roles",
    with_ctes(ASR, ROLES)
    + "SELECT call_id, spk_idx, coalesce(role, speaker) AS speaker FROM speakers LEFT JOIN roles USING (call_id, speaker)",
)
def j3(spark, sf):
    speakers = T.speaker_segments(spark, sf)
    return align.apply_roles(speakers, align.infer_roles(speakers)).select("call_id", "spk_idx", "speaker")


@register(
    "w6_ordered_speakers",
    with_ctes(ASR)
    + """SELECT call_id, speaker, m AS first_ms, row_number() OVER (PARTITION BY call_id ORDER BY m) - 1 AS speaker_order
FROM (SELECT call_id, speaker, min(start_ms) AS m FROM speakers GROUP BY 1, 2)""",
)
def w6(spark, sf):
    return align.ordered_speakers(T.speaker_segments(spark, sf)).select("call_id", "speaker", *_n("first_ms", "speaker_order"))


@register(
    "f4_clip_to_duration",
    with_ctes(ASR)
    + """SELECT call_id, seg_idx, least(start_ms, duration_ms - 2500) AS start_ms, least(end_ms, duration_ms - 2500) AS end_ms
FROM asr JOIN durations USING (call_id)""",
)
def f4(spark, sf):
    out = rules.clip_to_duration(T.asr_segments(spark, sf), T.call_durations(spark, sf, 2500))
    return out.select("call_id", "seg_idx", "start_ms", "end_ms")


@register(
    "c1_attribute_speakers",
    with_ctes(
        ASR,
        ROLES,
        "named AS (SELECT call_id, spk_idx, coalesce(role, speaker) AS speaker, start_ms, end_ms FROM speakers LEFT JOIN roles USING (call_id, speaker))",
        ALIGNED.replace("JOIN speakers s", "JOIN named s"),
    )
    + """SELECT call_id, seg_idx AS turn_idx, speaker, least(start_ms, duration_ms - 2500) AS start_ms,
  least(end_ms, duration_ms - 2500) AS end_ms, text FROM aligned JOIN durations USING (call_id)""",
)
def c1(spark, sf):
    return jobs.attribute_speakers(
        T.asr_segments(spark, sf), T.speaker_segments(spark, sf), T.call_durations(spark, sf, 2500), apply_roles=True
    )


def _manifest(spark, sf):
    """A manifest row per conversation but every ninth; the reference is its text."""
    whole = wer.join_segments(T.asr_segments(spark, sf))
    return whole.select("call_id", F.col("hypothesis").alias("reference_transcript"))


def _heard(spark, sf):
    """Segments as a recogniser might hear them."""
    heard = F.transform(
        F.split("text", " "),
        lambda w, i: F.when(i % 7 == 6, F.lit(None)).when(i % 5 == 2, F.lit("um")).otherwise(w),
    )
    return (
        T.asr_segments(spark, sf)
        .withColumn("text", F.array_join(F.array_compact(heard), " "))
    )


HEARD = """heard AS (
  SELECT call_id, seg_idx, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w, i:
    CASE WHEN (i - 1) % 7 = 6 THEN NULL WHEN (i - 1) % 5 = 2 THEN 'um' ELSE w END), lambda x: x IS NOT NULL), ' ') AS text
  FROM asr)"""


def _partly_heard(spark, sf):
    """Every ninth call has no transcript: the case that pairing is about."""
    return _heard(spark, sf).filter(F.col("call_id") % 9 != 0)


@register(
    "j4_pair_for_eval",
    with_ctes(ASR)
    + """SELECT call_id, CASE WHEN call_id % 9 = 0 THEN 'missing' ELSE 'paired' END AS state FROM durations""",
)
def j4(spark, sf):
    pairs, missing = align.pair_for_eval(_manifest(spark, sf), wer.join_segments(_partly_heard(spark, sf)))
    return pairs.select("call_id", F.lit("paired").alias("state")).unionByName(
        missing.select("call_id", F.lit("missing").alias("state"))
    )


@register(
    "g23_join_segments",
    with_ctes(ASR, HEARD)
    + "SELECT call_id, string_agg(text, ' ' ORDER BY seg_idx) AS hypothesis FROM heard GROUP BY 1",
)
def g23(spark, sf):
    return wer.join_segments(_heard(spark, sf))


def _normal_words(text: str) -> str:
    return rf"""list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower({text}),
  '[\s\p{{Z}}\x{{85}}\x0b][\s\p{{Z}}\x{{85}}\x0b]+', ' ', 'g'), '^[\s\p{{Z}}\x{{85}}\x0b]+|[\s\p{{Z}}\x{{85}}\x0b]+$', '', 'g'), '\p{{P}}', '', 'g'), ' '), lambda w: w <> '')"""


def _common(a: str, b: str) -> str:
    """Number of equal words at the start of two lists."""
    return f"coalesce(nullif(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[k] = {b}[k]), false), 0) - 1, least(len({a}), len({b})))"


# One row of all distance tables at a time. From the end a deletion is taken where one is minimal, then an insertion
# where the left cell is below the diagonal one, else the diagonal; `ins` counts the insertions on the way.
EDITS = f"""pair_words AS (
  SELECT row_number() OVER () AS p, *, {_normal_words("reference")} AS r, {_normal_words("hypothesis")} AS h FROM pairs),
headless AS (SELECT *, r[n + 1:] AS r1, h[n + 1:] AS h1 FROM (SELECT *, {_common("r", "h")} AS n FROM pair_words)),
cut AS (
  SELECT * EXCLUDE (r1, h1), r1[1:len(r1) - m] AS rt, h1[1:len(h1) - m] AS ht
  FROM (SELECT *, {_common("r1_back", "h1_back")} AS m FROM (SELECT *, list_reverse(r1) AS r1_back, list_reverse(h1) AS h1_back FROM headless))),
ref_words AS (SELECT p, unnest(rt) AS word, unnest(range(1, len(rt) + 1)) AS i FROM cut),
hyp_words AS (SELECT p, unnest(ht) AS word, unnest(range(1, len(ht) + 1)) AS j FROM cut),
rows AS (
  SELECT p, 0 AS i, unnest(range(0, len(ht) + 1)) AS j, unnest(range(0, len(ht) + 1)) AS dist, unnest(range(0, len(ht) + 1)) AS ins FROM cut
  UNION ALL
  SELECT p, i, j, dist, j + last_value(CASE WHEN NOT inserted THEN carried - j END IGNORE NULLS) OVER (PARTITION BY p ORDER BY j) AS ins
  FROM (
    SELECT *, dist <> old + 1 AND coalesce(lag(dist) OVER w < lag(old) OVER w, false) AS inserted,
      CASE WHEN dist = old + 1 THEN had ELSE lag(had) OVER w END AS carried
    FROM (
      SELECT *, j + min(best - j) OVER (PARTITION BY p ORDER BY j) AS dist
      FROM (
        SELECT rows.p, r.i, rows.j, dist AS old, ins AS had,
          least(dist + 1, coalesce(lag(dist) OVER (PARTITION BY rows.p ORDER BY rows.j) + CASE WHEN r.word = h.word THEN 0 ELSE 1 END, dist + 1)) AS best
        FROM rows JOIN ref_words r ON r.p = rows.p AND r.i = rows.i + 1 LEFT JOIN hyp_words h ON h.p = rows.p AND h.j = rows.j))
    WINDOW w AS (PARTITION BY p ORDER BY j))),
counted AS (
  SELECT cut.*, dist - ins - (ins + len(r) - len(h)) AS substitutions, ins + len(r) - len(h) AS deletions, ins AS insertions,
    len(r) - (dist - ins) AS hits, len(r) AS reference_words
  FROM rows JOIN cut USING (p) WHERE rows.i = len(rt) AND j = len(ht)),
rated AS (
  SELECT *, CASE WHEN reference_words > 0 THEN (substitutions + deletions + insertions) / reference_words::DOUBLE END AS wer FROM counted)"""

TURN_PAIRS = "pairs AS (SELECT call_id, seg_idx, asr.text AS reference, heard.text AS hypothesis FROM asr JOIN heard USING (call_id, seg_idx))"
CALL_PAIRS = """pairs AS (
  SELECT call_id, string_agg(asr.text, ' ' ORDER BY seg_idx) AS reference, string_agg(heard.text, ' ' ORDER BY seg_idx) AS hypothesis
  FROM asr JOIN heard USING (call_id, seg_idx) GROUP BY call_id)"""
_EDIT_COUNTS = ("substitutions", "deletions", "insertions", "hits")
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in (*_EDIT_COUNTS, "reference_words"))
CORPUS = f"""SELECT *, (substitutions + deletions + insertions) / reference_words::DOUBLE AS wer FROM (
  SELECT count(*) AS num_calls, {_SUMS} FROM rated WHERE reference_words > 0)"""


def _recursive(*ctes: str) -> str:
    return with_ctes(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def _turn_pairs(spark, sf):
    asr = T.asr_segments(spark, sf).withColumnRenamed("text", "reference")
    return asr.join(_heard(spark, sf).select("call_id", "seg_idx", F.col("text").alias("hypothesis")), ["call_id", "seg_idx"])


@register(
    "g20_word_error_rate",
    _recursive(ASR, HEARD, TURN_PAIRS, EDITS)
    + f"SELECT call_id, seg_idx, {', '.join(f'{c}::BIGINT AS {c}' for c in (*_EDIT_COUNTS, 'reference_words'))}, wer FROM rated",
)
def g20(spark, sf):
    return wer.call_wer(_turn_pairs(spark, sf)).drop("start_ms", "end_ms", "reference", "hypothesis")


@register("g20_corpus_wer", _recursive(ASR, HEARD, TURN_PAIRS, EDITS) + CORPUS)
def g20c(spark, sf):
    return wer.corpus_wer(wer.call_wer(_turn_pairs(spark, sf)))


@register(
    "t1_worst_calls",
    _recursive(ASR, HEARD, CALL_PAIRS, EDITS)
    + f"SELECT call_id, {', '.join(f'{c}::BIGINT AS {c}' for c in (*_EDIT_COUNTS, 'reference_words'))}, wer FROM rated ORDER BY wer DESC NULLS LAST, call_id LIMIT 10",
)
def t1(spark, sf):
    return jobs.evaluate_asr(_manifest(spark, sf), _heard(spark, sf))["worst"].drop("reference", "hypothesis")


@register("c7_evaluate_asr", _recursive(ASR, HEARD, CALL_PAIRS, EDITS) + CORPUS)
def c7(spark, sf):
    return jobs.evaluate_asr(_manifest(spark, sf), _heard(spark, sf))["corpus"]


@register(
    "n1_normal_words",
    r"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(text),
  '[\s\p{Z}\x{85}\x0b][\s\p{Z}\x{85}\x0b]+', ' ', 'g'), '^[\s\p{Z}\x{85}\x0b]+|[\s\p{Z}\x{85}\x0b]+$', '', 'g'), '\p{P}', '', 'g'), ' '), lambda w: w <> ''), '|') AS words
FROM documents""",
)
def n1(spark, sf):
    return T.read(spark, sf, "documents").select(
        "doc_id", F.array_join(tx.normal_words(F.col("text")), "|").alias("words")
    )


DER = """ref AS (SELECT call_id, speaker AS r, start_ms AS s, end_ms AS e FROM turns WHERE end_ms > start_ms),
hyp AS (SELECT call_id, speaker AS h, start_ms AS s, end_ms AS e FROM speakers),
cuts AS (SELECT DISTINCT call_id, t FROM (
  SELECT call_id, s AS t FROM ref UNION ALL SELECT call_id, e FROM ref UNION ALL SELECT call_id, s FROM hyp UNION ALL SELECT call_id, e FROM hyp)),
pieces AS (SELECT * FROM (SELECT call_id, t AS a, lead(t) OVER (PARTITION BY call_id ORDER BY t) AS b FROM cuts) WHERE b IS NOT NULL),
counted AS (
  SELECT p.call_id, a, b, count(DISTINCT r) AS nr, (SELECT count(DISTINCT h) FROM hyp WHERE hyp.call_id = p.call_id AND hyp.s < b AND hyp.e > a) AS nh
  FROM pieces p LEFT JOIN ref ON ref.call_id = p.call_id AND ref.s < b AND ref.e > a GROUP BY 1, 2, 3),
sums AS (
  SELECT call_id, sum((b - a) * nr)::BIGINT AS total_ms, sum((b - a) * greatest(nr - nh, 0))::BIGINT AS missed_ms,
    sum((b - a) * greatest(nh - nr, 0))::BIGINT AS false_alarm_ms, sum((b - a) * least(nr, nh))::BIGINT AS both_ms FROM counted GROUP BY 1),
cells AS (
  SELECT ref.call_id, r, h, sum(least(ref.e, hyp.e) - greatest(ref.s, hyp.s)) AS ms
  FROM ref JOIN hyp ON ref.call_id = hyp.call_id AND ref.s < hyp.e AND hyp.s < ref.e GROUP BY 1, 2, 3),
choices AS (
  SELECT call_id, ms FROM cells
  UNION ALL SELECT x.call_id, x.ms + y.ms FROM cells x JOIN cells y ON x.call_id = y.call_id AND x.h < y.h AND x.r <> y.r),
mapped AS (SELECT call_id, max(ms)::BIGINT AS correct_ms FROM choices GROUP BY 1)"""


@register(
    "g21_diarization_error_rate",
    with_ctes(ASR, DER)
    + """SELECT call_id, round((missed_ms + false_alarm_ms + both_ms - coalesce(correct_ms, 0)) / total_ms, 6) AS der,
  coalesce(correct_ms, 0) AS correct_ms, both_ms - coalesce(correct_ms, 0) AS confusion_ms, missed_ms, false_alarm_ms, total_ms
FROM sums LEFT JOIN mapped USING (call_id)""",
)
def g21(spark, sf):
    reference = settle(T.turns(spark, sf).select("call_id", "speaker", "start_ms", "end_ms"))
    out = der.der(reference, T.speaker_segments(spark, sf, reference))
    return out.select(
        "call_id", *_r("der"), *_n("correct_ms", "confusion_ms", "missed_ms", "false_alarm_ms", "total_ms")
    )


@register("c9_diarize")
def c9(spark, sf):
    """Users as calls; the embeddings are dealt out to the segments by number."""
    frames = settle(T.frames(spark, sf))
    speech, totals = frames.filter(F.col("cents") > T.SPEECH_CENTS), signal.frame_totals(frames)
    vectors = T.read(spark, sf, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count(F.lit(1))).scalar()

    def dealt(segments):
        number = F.pmod(F.col("call_id") * 31 + F.col("seg_idx") * 7, n)
        return segments.withColumn("vec_id", number).join(vectors, "vec_id").drop("vec_id")

    return jobs.diarize(speech, totals, dealt, VadConfig(), SEGMENTS)


# Samples at 100 a second; the files of every seventh call are empty, so these calls go no further.
SIGNAL = ",\n".join(
    [
        SAMPLES.replace("FROM events))", "FROM events WHERE user_id % 7 <> 3))"),
        LEVEL, RMS,
        """lengths AS (SELECT call_id, (max(idx) + 1) * 10.0::DOUBLE AS duration_ms FROM mono GROUP BY 1)""",
        REGIONS[REGIONS.index("marks AS (") :]
        .replace("marks AS (", "speech AS (SELECT call_id, frame FROM rms WHERE db > -15.0),\ntotals AS (SELECT call_id, max(frame) + 1 AS n_frames FROM rms GROUP BY 1),\nmarks AS (")
        .replace(">= 10", ">= 2").replace("< 10", "< 2").replace("first * 30 - 100", "first * 40.0 - 20")
        .replace("least(n_frames * 30, last * 30 + 100)", "least(duration_ms, last * 40.0 + 20)").replace("WHERE last - first >= 6", "JOIN lengths USING (call_id) WHERE last - first >= 2"),
    ]
)
SIGNAL_CHUNKS = (
    CHUNK_SQL.replace("n_frames * 30.0::DOUBLE AS d", "duration_ms AS d").replace("FROM totals LEFT JOIN", "FROM lengths LEFT JOIN")
    .replace("1500", "75").replace("6000", "300").replace("400", "40")
)


def _prepared(spark, sf):
    """Event values as samples; all calls have a manifest row."""
    vad = VadConfig(frame_ms=40, silence_threshold_db=-15.0, min_silence_ms=80, min_speech_ms=80, pad_ms=20)
    calls = T.read(spark, sf, "events").select(F.col("user_id").alias("call_id")).distinct()
    empty = F.col("call_id") % 7 == 3
    manifest = calls.select(
        "call_id", F.lit(True).alias("exists"), F.when(empty, 0).otherwise(1).alias("size_bytes"), F.lit("wav").alias("extension"),
        F.lit(True).alias("readable"), F.lit(1).alias("frames"), F.lit(10.0).alias("duration_seconds"),
        F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"),
    )
    return jobs.prepare_signal(T.samples(spark, sf), 100, vad, ChunkConfig(chunk_ms=300, overlap_ms=40), manifest=manifest)


@register("c11_prepare_signal", "WITH RECURSIVE " + SIGNAL + ",\n" + SIGNAL_CHUNKS + " SELECT call_id, chunk_idx, round(s, 6) AS start_ms, round(e, 6) AS end_ms FROM step WHERE e IS NOT NULL")
def c11(spark, sf):
    return _prepared(spark, sf)["chunks"].select("call_id", "chunk_idx", *_r("start_ms", "end_ms"))


@register("c11_regions", with_ctes(SIGNAL) + "SELECT call_id, start_ms::DOUBLE AS start_ms, end_ms::DOUBLE AS end_ms FROM regions")
def c11_regions(spark, sf):
    return _prepared(spark, sf)["regions"].select("call_id", *_r("start_ms", "end_ms"))


@register("c11_samples", with_ctes(SIGNAL) + "SELECT call_id, idx, round(v, 6) AS v FROM level")
def c11_samples(spark, sf):
    return _prepared(spark, sf)["samples"].select("call_id", "idx", *_r("v"))


@register(
    "c11_left_out",
    with_ctes(SIGNAL)
    + """SELECT call_id, 'silent' AS reason FROM lengths WHERE call_id NOT IN (SELECT call_id FROM regions)
UNION ALL SELECT DISTINCT user_id, 'File is empty (0 bytes)' FROM events WHERE user_id % 7 = 3""",
)
def c11_left_out(spark, sf):
    """Calls without speech, and those whose file is not valid."""
    out = _prepared(spark, sf)
    invalid = out["invalid"].select("call_id", F.array_join("errors", "; ").alias("reason"))
    return out["silent"].select("call_id", F.lit("silent").alias("reason")).unionByName(invalid)
