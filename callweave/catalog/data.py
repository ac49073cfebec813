"""Queries on datasets: files, quality reports, samples, metrics, models."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from callweave import config as C
from callweave.catalog import text  # noqa: F401  its SQL is used here as well
from callweave.catalog.base import ASR, MANIFEST, ORACLES, PREDS, TOKENS, TURNS, literal_list, register, with_ctes
from callweave.catalog.calls import FEATURES, SCORED, SUP_SCORED, VOTES, _n, _r
from callweave.config import AudioConfig
from callweave.operators import evaluate, features, learn, quality, rules, sampling, sentiment
from callweave.plans import jobs
from callweave.session import scratch_path, settle
from callweave.sources import files
from callweave.sources import tables as T

CFG = AudioConfig(min_duration_seconds=20.0, max_duration_seconds=600.0)


def _validated(spark, sf):
    return rules.validate(T.manifest(spark, sf), CFG)


def _text_lists(df):
    return df.withColumns({c: F.array_join(c, "; ") for c in ("errors", "warnings")})


@register("f1_validate", with_ctes(MANIFEST) + "SELECT path, errors, warnings, errors = '' AS is_valid FROM validated")
def f1(spark, sf):
    return _text_lists(_validated(spark, sf)).select("path", "errors", "warnings", "is_valid")


@register(
    "f2_split_valid",
    with_ctes(MANIFEST) + "SELECT path, CASE WHEN errors = '' THEN 'valid' ELSE 'invalid' END AS part FROM validated",
)
def f2(spark, sf):
    valid, invalid = rules.split_valid(_validated(spark, sf))
    return valid.select("path", F.lit("valid").alias("part")).unionByName(
        invalid.select("path", F.lit("invalid").alias("part"))
    )


REPORT = """known AS (
  SELECT errors, CASE WHEN info THEN sample_rate END AS sr, CASE WHEN info THEN channels END AS ch, CASE WHEN info THEN format END AS fmt,
    CASE WHEN info THEN duration_seconds END AS d
  FROM (SELECT *, stop IS NULL OR stop = 'Audio contains zero frames' AS info FROM validated)),
rows_ AS (
  SELECT 'all' AS kind, NULL AS value, * FROM known UNION ALL SELECT 'sample_rate', sr::VARCHAR, * FROM known
  UNION ALL SELECT 'channels', ch::VARCHAR, * FROM known UNION ALL SELECT 'format', fmt, * FROM known)"""


@register(
    "g10_dataset_report",
    with_ctes(MANIFEST, REPORT)
    + """SELECT kind, value, count(*) AS n_files, count(*) FILTER (WHERE errors = '') AS n_valid, count(*) FILTER (WHERE errors <> '') AS n_invalid,
  min(d) AS min_duration, max(d) AS max_duration, round(sum(d), 6) AS total_seconds FROM rows_ WHERE kind = 'all' OR value IS NOT NULL GROUP BY 1, 2""",
)
def g10(spark, sf):
    return quality.dataset_report(_validated(spark, sf)).select(
        "kind", "value", *_n("n_files", "n_valid", "n_invalid"), "min_duration", "max_duration", *_r("total_seconds")
    )


@register(
    "g10_dataset_issues",
    with_ctes(MANIFEST) + "SELECT path, errors, warnings FROM validated WHERE errors <> '' OR warnings <> ''",
)
def g10_issues(spark, sf):
    return _text_lists(quality.dataset_issues(_validated(spark, sf)))


DUPES = """dupes AS (
  SELECT sha256(text) AS content_sha256, count(*) AS n_copies, min(doc_id) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1)"""


@register(
    "g11_duplicate_groups",
    with_ctes(DUPES)
    + "SELECT content_sha256, doc_id AS path, n_copies, first_path FROM documents JOIN dupes ON sha256(text) = content_sha256",
)
def g11(spark, sf):
    return quality.duplicate_groups(T.read(spark, sf, "documents"), "doc_id", "text")


@register(
    "g12_duration_histogram",
    """WITH s AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, least(20, count(*)) AS bins FROM documents),
grid AS (SELECT unnest(range(bins)) AS bin, lo, (hi - lo) / bins AS w FROM s),
counts AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / bins)), bins - 1)::BIGINT AS bin, count(*) AS n FROM documents, s GROUP BY 1)
SELECT bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n FROM grid LEFT JOIN counts USING (bin)""",
)
def g12(spark, sf):
    out = quality.duration_histogram(T.read(spark, sf, "documents"), "n_chars")
    return out.select(*_n("bin"), *_r("lower", "upper"), *_n("n"))


@register(
    "g12_duration_stats",
    """SELECT count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS mean, sum(n_chars)::BIGINT AS total FROM documents""",
)
def g12_stats(spark, sf):
    return quality.duration_stats(T.read(spark, sf, "documents"), "n_chars").select("n", "min", "max", *_r("mean"), "total")


@register(
    "g24_batch_summary",
    with_ctes(MANIFEST)
    + "SELECT count(*) AS total, count(*) FILTER (WHERE stop IS NULL) AS succeeded, count(*) FILTER (WHERE stop IS NOT NULL) AS failed FROM checked",
)
def g24(spark, sf):
    rows = _validated(spark, sf).withColumn("error", F.when(~F.col("has_info"), F.element_at("errors", 1)))
    return quality.batch_summary(rows)


@register("g24_written_summary", ORACLES["g24_batch_summary"])
def g24_written(spark, sf):
    """Counts that the write of the items gathered."""
    rows = _validated(spark, sf).withColumn("error", F.when(~F.col("has_info"), F.element_at("errors", 1)))
    return quality.write_with_summary(rows, scratch_path(spark, "outcomes"))


@register(
    "g24_batch_failures",
    with_ctes(MANIFEST) + "SELECT path, stop AS error FROM checked WHERE stop IS NOT NULL",
)
def g24_failures(spark, sf):
    rows = _validated(spark, sf).withColumn("error", F.when(~F.col("has_info"), F.element_at("errors", 1)))
    return quality.batch_failures(rows)


@register(
    "c8_validate_dataset",
    with_ctes(MANIFEST, DUPES)
    + """SELECT 'report' AS part, count(*) FILTER (WHERE errors = '') AS n FROM validated UNION ALL
SELECT 'issues', count(*) FROM validated WHERE errors <> '' OR warnings <> '' UNION ALL SELECT 'duplicates', sum(n_copies)::BIGINT FROM dupes""",
)
def c8(spark, sf):
    content = T.read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    out = jobs.validate_dataset(T.manifest(spark, sf), content, CFG)
    valid = out["report"].filter("kind = 'all'").select(F.lit("report").alias("part"), F.col("n_valid").alias("n"))
    sizes = [out[p].select(F.lit(p).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")) for p in ("issues", "duplicates")]
    return valid.unionByName(sizes[0]).unionByName(sizes[1])


# --- sources and sinks: tables written and read back -----------------------------------


@register("s1_conversation_json", with_ctes(TURNS) + "SELECT call_id, turn_idx, speaker, start_ms, end_ms, text FROM turns")
def s1(spark, sf):
    """One JSON file per call, every other one as a bare array."""
    path = scratch_path(spark, "conversations")
    turn = F.struct(
        "speaker", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text"
    )
    calls = (
        T.turns(spark, sf).groupBy("call_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", turn.alias("t")))), lambda x: x["t"]).alias("conversation"))
    )
    body = F.when(F.col("call_id") % 2 == 0, F.to_json("conversation")).otherwise(F.to_json(F.struct("conversation")))
    files.write_conversations(calls.select("call_id", body.alias("value")), path)
    return files.load_turns(spark, path).withColumn("call_id", F.col("call_id").cast("bigint"))


def _conversation_files(spark, sf):
    """Files of both shapes; some cut off, some without turns, some with keys that nobody asked for."""
    path = scratch_path(spark, "conversations")
    turn = F.struct("speaker", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", F.lit(1).alias("more"))
    calls = T.turns(spark, sf).groupBy("call_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", turn.alias("t")))), lambda x: x["t"]).alias("conversation")
    )
    whole = F.when(F.col("call_id") % 2 == 0, F.to_json("conversation")).otherwise(F.to_json(F.struct("conversation", F.lit("x").alias("extra"))))
    body = F.when(F.col("call_id") % 5 == 3, F.left(whole, F.length(whole) - 1)).when(F.col("call_id") % 7 == 4, F.lit('{"turns": []}')).otherwise(whole)
    files.write_conversations(calls.select("call_id", body.alias("value")), path)
    return files.read_conversations(spark, path)


@register(
    "s1_conversations_of_both_shapes",
    with_ctes(TURNS) + "SELECT call_id, turn_idx, speaker, start_ms, end_ms, text FROM turns WHERE call_id % 5 <> 3 AND call_id % 7 <> 4",
)
def s1_shapes(spark, sf):
    return _conversation_files(spark, sf).turns.withColumn("call_id", F.col("call_id").cast("bigint"))


@register(
    "s1_broken_files",
    """SELECT call_id, CASE WHEN call_id % 5 = 3 THEN 'Not valid JSON' ELSE 'No list of turns' END AS error
FROM (SELECT DISTINCT conv_id AS call_id FROM conversations) WHERE call_id % 5 = 3 OR call_id % 7 = 4""",
)
def s1_broken(spark, sf):
    return _conversation_files(spark, sf).outcomes.where("error IS NOT NULL").select(F.col("call_id").cast("bigint").alias("call_id"), "error")


@register("w7_turn_order", "SELECT conv_id AS call_id, turn AS turn_idx, role AS speaker, text FROM conversations")
def w7(spark, sf):
    """Turns kept as an array per call and numbered again by their place in it."""
    rows = T.read(spark, sf, "conversations")
    nested = rows.groupBy(F.col("conv_id").alias("call_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("conversation")
    )
    return files.explode_turns(nested).select("call_id", "turn_idx", "t.speaker", "t.text")


MANIFEST_JSON = """SELECT doc_id::VARCHAR AS call_id, 'audio/' || doc_id::VARCHAR || '.flac' AS audio_path, text AS reference_transcript,
  round(n_chars / 16.0, 3) AS duration_seconds, 16000 AS sample_rate FROM documents"""


def _manifest_rows(spark, sf):
    return T.read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("call_id"),
        F.concat(F.lit("audio/"), F.col("doc_id").cast("string"), F.lit(".flac")).alias("audio_path"),
        F.col("text").alias("reference_transcript"),
        F.round(F.col("n_chars") / 16.0, 3).alias("duration_seconds"),
        F.lit(16000).alias("sample_rate"),
    )


@register("s2_s3_manifest_json", MANIFEST_JSON)
def s2(spark, sf):
    path = scratch_path(spark, "manifest")
    files.write_manifest(_manifest_rows(spark, sf), path)
    return files.load_manifest(spark, path)


@register("s4_manifest_from_parquet", MANIFEST_JSON)
def s4(spark, sf):
    path = scratch_path(spark, "audio-table")
    T.read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.struct(
            F.encode("text", "UTF-8").alias("bytes"),
            F.round(F.col("n_chars") / 16.0, 3).alias("duration_seconds"),
            F.lit(16000).alias("sample_rate"),
        ).alias("audio"),
        "text",
    ).write.parquet(path)
    return files.manifest_from_parquet(spark, path)


@register(
    "s5_scan_files",
    """SELECT 'lang=' || lang AS folder, 'txt' AS extension, sum(length(base64(encode(text))) + 1)::BIGINT AS size_bytes, count(*) AS n_lines
FROM documents GROUP BY lang""",
)
def s5(spark, sf):
    """Files written below one folder per language, found by extension and read."""
    path = scratch_path(spark, "scan")
    T.read(spark, sf, "documents").select("lang", F.base64(F.encode("text", "UTF-8")).alias("v")).select(
        "lang", F.regexp_replace("v", "\\s", "").alias("value")
    ).write.partitionBy("lang").text(path)
    found = files.scan_audio(spark, path, ["txt"])
    lines = F.length(F.decode("content", "UTF-8")) - F.length(F.replace(F.decode("content", "UTF-8"), F.lit("\n"), F.lit("")))
    return found.groupBy(F.regexp_extract("path", "/([^/]+)/[^/]*$", 1).alias("folder"), "extension").agg(
        F.sum("size_bytes").alias("size_bytes"), F.sum(lines).cast("bigint").alias("n_lines")
    )


@register("s6_s7_transcripts_json", with_ctes(ASR) + "SELECT call_id::VARCHAR AS call_id, seg_idx, start_ms, end_ms, text FROM asr")
def s6(spark, sf):
    path = scratch_path(spark, "transcripts")
    segment = F.struct(
        (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text"
    )
    calls = T.asr_segments(spark, sf).groupBy(F.col("call_id").cast("string").alias("call_id")).agg(
        F.lit("en").alias("language"),
        (F.max("end_ms") / 1000.0).alias("duration"),
        F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", segment.alias("s")))), lambda x: x["s"]).alias("segments"),
    )
    files.write_transcripts(calls, path)
    return files.transcript_segments(files.load_transcript_lines(spark, path))


@register(
    "s8_report_json",
    with_ctes(MANIFEST) + "SELECT count(*) AS total_files, count(*) FILTER (WHERE errors = '') AS valid_files FROM validated",
)
def s8(spark, sf):
    path = scratch_path(spark, "report")
    report = _validated(spark, sf).agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("is_valid").alias("valid_files")
    )
    files.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@register(
    "s9_load_labelled",
    "SELECT doc_id, ['poor', 'good'][1 + quality] AS label, sha256(text) AS text_sha FROM documents JOIN labels USING (doc_id)",
)
def s9(spark, sf):
    rows = files.load_labelled(T.doc_labels(spark, sf), "text", "quality", ["poor", "good"])
    return rows.select("doc_id", "label", F.sha2("text", 256).alias("text_sha"))


# --- distributions, samples and splits ---------------------------------------------------


@register("g13_class_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def g13(spark, sf):
    return evaluate.class_distribution(T.read(spark, sf, "documents"), "lang")


@register(
    "g22_class_weights",
    "SELECT lang, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM documents GROUP BY 1",
)
def g22(spark, sf):
    return evaluate.class_weights(T.read(spark, sf, "documents"), "lang").select("lang", "n", *_r("weight"))


HASHED = """hashed AS (SELECT doc_id, lang, md5(doc_id::VARCHAR || '-42') AS h FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS r, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total,
    row_number() OVER (ORDER BY h) AS rall FROM hashed)"""


@register(
    "p1_stratified_subsample",
    with_ctes(HASHED) + "SELECT doc_id, lang FROM placed WHERE r <= greatest(1, round_even(n / total * 137, 0))",
)
def p1(spark, sf):
    docs = T.read(spark, sf, "documents").select("doc_id", "lang")
    return sampling.stratified_subsample(docs, "lang", ["doc_id"], 137)


@register(
    "p2_stratified_split",
    with_ctes(HASHED)
    + """SELECT doc_id, lang, CASE WHEN n < 3 THEN 'train' WHEN r <= greatest(1, floor(n * 0.15)) THEN 'test'
  WHEN r <= 2 * greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split FROM placed""",
)
def p2(spark, sf):
    docs = T.read(spark, sf, "documents").select("doc_id", "lang")
    return sampling.stratified_split(docs, "lang", ["doc_id"])


@register(
    "p3_holdout_split",
    with_ctes(HASHED)
    + """SELECT doc_id, CASE WHEN rall <= floor(total * 0.15) THEN 'test' WHEN rall <= 2 * floor(total * 0.15) THEN 'val' ELSE 'train' END AS split FROM placed""",
)
def p3(spark, sf):
    docs = T.read(spark, sf, "documents").select("doc_id")
    return sampling.holdout_split(docs, ["doc_id"], {"test": 0.15, "val": 0.15})


@register(
    "m11_prepare_dataset",
    with_ctes(
        HASHED,
        "sub AS (SELECT doc_id, lang, h FROM placed WHERE r <= greatest(1, round_even(n / total * 200, 0)))",
        "again AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS r, count(*) OVER (PARTITION BY lang) AS n FROM sub)",
    )
    + """SELECT lang, CASE WHEN n < 3 THEN 'train' WHEN r <= greatest(1, floor(n * 0.15)) THEN 'test'
  WHEN r <= 2 * greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM again GROUP BY ALL""",
)
def m11(spark, sf):
    docs = T.read(spark, sf, "documents").select("doc_id", "lang")
    prepared = learn.prepare_dataset(docs, ["doc_id"], "lang", 200)
    return prepared.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


# --- metrics -----------------------------------------------------------------------------

LANGS = ["de", "en", "es", "fr", "it"]


@register(
    "g14_confusion_matrix",
    with_ctes(PREDS, f"l AS (SELECT unnest({literal_list(LANGS)}) AS x)")
    + """SELECT a.x AS y_true, b.x AS y_pred, count(doc_id) AS n FROM l a CROSS JOIN l b
LEFT JOIN preds ON y_true = a.x AND y_pred = b.x GROUP BY 1, 2""",
)
def g14(spark, sf):
    return evaluate.confusion(T.class_predictions(spark, sf), LANGS)


CLASSES = f"""l AS (SELECT unnest(['{"', '".join(LANGS)}']) AS label),
cls AS (
  SELECT label, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(nt, 0), 0) AS recall,
    coalesce(2 * tp / nullif(nt + np, 0), 0) AS f1, nt AS support FROM (
    SELECT label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE y_true = label) AS nt,
      count(*) FILTER (WHERE y_pred = label) AS np FROM l CROSS JOIN preds GROUP BY 1))"""


@register(
    "g15_class_metrics",
    with_ctes(PREDS, CLASSES)
    + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cls",
)
def g15(spark, sf):
    out = evaluate.class_metrics(T.class_predictions(spark, sf), LANGS)
    return out.select("label", *_r("precision", "recall", "f1"), *_n("support"))


@register(
    "g15_macro_metrics",
    with_ctes(PREDS, CLASSES)
    + """SELECT round((SELECT avg((y_true = y_pred)::INT) FROM preds), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
  round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM cls""",
)
def g15_macro(spark, sf):
    out = evaluate.macro_metrics(T.class_predictions(spark, sf), LANGS)
    return out.select(*_r("accuracy", "precision_macro", "recall_macro", "f1_macro"))


TASKS = """long AS (
  SELECT 'lang' AS task, 'a' AS model, y_true, y_pred FROM preds UNION ALL SELECT 'lang', 'b', y_true, y_true FROM preds
  UNION ALL SELECT 'size', 'a', CASE WHEN doc_id % 3 = 0 THEN 's' ELSE 'l' END, CASE WHEN doc_id % 4 = 0 THEN 's' ELSE 'l' END FROM preds),
labs AS (SELECT task, model, y_true AS label FROM long UNION SELECT task, model, y_pred FROM long),
cls AS (
  SELECT labs.task, labs.model, label, coalesce(count(*) FILTER (WHERE y_true = label AND y_pred = label) / nullif(count(*) FILTER (WHERE y_pred = label), 0), 0) AS p,
    coalesce(count(*) FILTER (WHERE y_true = label AND y_pred = label) / nullif(count(*) FILTER (WHERE y_true = label), 0), 0) AS r,
    coalesce(2 * count(*) FILTER (WHERE y_true = label AND y_pred = label) / nullif(count(*) FILTER (WHERE y_true = label) + count(*) FILTER (WHERE y_pred = label), 0), 0) AS f
  FROM labs JOIN long ON labs.task = long.task AND labs.model = long.model GROUP BY 1, 2, 3)"""


@register(
    "g16_multi_task_metrics",
    with_ctes(PREDS, TASKS)
    + """SELECT task, model, round(accuracy, 6) AS accuracy, round(p, 6) AS precision_macro, round(r, 6) AS recall_macro, round(f, 6) AS f1_macro
FROM (SELECT task, model, avg(p) AS p, avg(r) AS r, avg(f) AS f FROM cls GROUP BY 1, 2)
JOIN (SELECT task, model, avg((y_true = y_pred)::INT) AS accuracy FROM long GROUP BY 1, 2) USING (task, model)""",
)
def g16(spark, sf):
    preds = T.class_predictions(spark, sf)
    size = [F.when(F.col("doc_id") % k == 0, "s").otherwise("l") for k in (3, 4)]

    def rows(task, model, true, pred):
        return preds.select(F.lit(task).alias("task"), F.lit(model).alias("model"), true.alias("y_true"), pred.alias("y_pred"))

    long = (
        rows("lang", "a", F.col("y_true"), F.col("y_pred"))
        .unionByName(rows("lang", "b", F.col("y_true"), F.col("y_true")))
        .unionByName(rows("size", "a", *size))
    )
    return evaluate.multi_task_metrics(long).select(
        "task", "model", *_r("accuracy", "precision_macro", "recall_macro", "f1_macro")
    )


@register(
    "g17_binary_metrics",
    """WITH s AS (SELECT quality AS y, (doc_id % 101) / 100.0::DOUBLE AS p FROM labels),
t AS (SELECT sum(y) AS pos, sum(1 - y) AS neg FROM s),
ranked AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s),
per_p AS (SELECT p, sum(y) AS dp, count(*) AS dn FROM s GROUP BY 1),
cum AS (SELECT p, dp, sum(dp) OVER w AS tp, sum(dn) OVER w AS n FROM per_p WINDOW w AS (ORDER BY p DESC)),
ap AS (SELECT sum(dp * tp / n) / (SELECT pos FROM t) AS ap FROM cum),
auc AS (SELECT (sum(r) FILTER (WHERE y = 1) - (SELECT pos * (pos + 1) / 2 FROM t)) / (SELECT pos * neg FROM t) AS auc FROM ranked),
c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5) AS np, sum(y) AS nt, avg((p - y) * (p - y)) AS brier FROM s)
SELECT round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (np + nt), 6) AS f1, round(auc, 6) AS roc_auc,
  round(ap, 6) AS average_precision, round(brier, 6) AS brier_score FROM c, ap, auc""",
)
def g17(spark, sf):
    scored = T.read(spark, sf, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") % 101) / 100.0).alias("p"))
    return evaluate.binary_metrics(scored).select(
        *_r("precision", "recall", "f1", "roc_auc", "average_precision", "brier_score")
    )


@register(
    "t4_argmax_label",
    """SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'No' WHEN b >= c THEN 'Partly' ELSE 'Yes' END AS label FROM (
  SELECT doc_id, n_chars % 5 AS a, n_chars % 7 AS b, n_chars % 4 AS c FROM documents)""",
)
def t4(spark, sf):
    docs = T.read(spark, sf, "documents")
    weights = F.array(*[(F.col("n_chars") % k).cast("double") for k in (5, 7, 4)])
    return docs.select("doc_id", learn.argmax_label(weights, ["No", "Partly", "Yes"]).alias("label"))


# --- models --------------------------------------------------------------------------------


def _labelled_docs(spark, sf):
    rows = files.load_labelled(T.doc_labels(spark, sf), "text", "quality", ["poor", "good"])
    return settle(learn.prepare_dataset(rows.select("doc_id", "text", "label"), ["doc_id"]))


@register("m1_m3_text_baseline_scores")
def m1(spark, sf):
    """Trains on the train part and scores the test part."""
    prepared = _labelled_docs(spark, sf)
    model = learn.train_text_baseline(prepared.filter("split = 'train'"))
    scored = learn.score(model, prepared.filter("split = 'test'"))
    return scored.select("doc_id", "label", "predicted", "confidence")


@register("m2_evaluate_text_baseline")
def m2(spark, sf):
    prepared = _labelled_docs(spark, sf)
    model = learn.train_text_baseline(prepared.filter("split = 'train'"))
    return learn.evaluate_model(model, prepared.filter("split = 'test'"))


@register("m10_training_report")
def m10(spark, sf):
    prepared = _labelled_docs(spark, sf)
    model = learn.train_text_baseline(prepared.filter("split = 'train'"))
    return learn.training_report(model, prepared)


def _call_features(spark, sf):
    scored = settle(T.with_predictions(T.support_turns(spark, sf)))  # three branches read it
    labels = scored.select("call_id").distinct().withColumn("outcome", T.pick(list(C.OUTCOMES), F.col("call_id") % 5))
    return (
        features.business_features(scored)
        .join(features.first_customer_intent(scored), "call_id")
        .join(rules.outcome_labels(labels), "call_id")
    )


@register("m5_resolution_scores")
def m5(spark, sf):
    rows = settle(sampling.holdout_split(settle(_call_features(spark, sf)), ["call_id"], {"test": 0.2}))
    model = learn.train_resolution(rows.filter("split = 'train'"))
    return learn.score(model, rows.filter("split = 'test'")).select("call_id", "resolution", "predicted", "confidence")


HELD_OUT = "SELECT floor(count(DISTINCT o_custkey) * 0.2)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey"


@register(
    "m5_sound_scores",
    f"SELECT n AS n_calls, 0::BIGINT AS n_repeated, 0::BIGINT AS n_bad_sums, 0::BIGINT AS n_other_labels, 0::BIGINT AS n_other_confidences FROM ({HELD_OUT})",
)
def m5_sound(spark, sf):
    """What holds for any model: a call is scored once, probabilities sum to 1, the label is the most probable one."""
    rows = settle(sampling.holdout_split(settle(_call_features(spark, sf)), ["call_id"], {"test": 0.2}))
    model = learn.train_resolution(rows.filter("split = 'train'"))
    scored = learn.score(model, rows.filter("split = 'test'"))
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    own = F.element_at("probabilities", F.col("predicted"))
    return scored.agg(
        F.count(F.lit(1)).alias("n_calls"), (F.count(F.lit(1)) - F.count_distinct("call_id")).alias("n_repeated"),
        F.count_if(F.abs(total - 1) > 1e-9).alias("n_bad_sums"), F.count_if(F.col("predicted") != learn.argmax_of_map(F.col("probabilities"))).alias("n_other_labels"),
        F.count_if(own != F.col("confidence")).alias("n_other_confidences"),
    )


@register("m6_escalation_scores")
def m6(spark, sf):
    rows = settle(sampling.holdout_split(settle(_call_features(spark, sf)), ["call_id"], {"test": 0.2}))
    model = learn.train_escalation(rows.filter("split = 'train'"))
    scored = learn.escalation_probability(model, rows.filter("split = 'test'"))
    return scored.select("call_id", "escalation", "probability", rules.risk_tier(F.col("probability")).alias("risk_tier"))


@register("m7_importances")
def m7(spark, sf):
    model = learn.train_escalation(settle(_call_features(spark, sf)))
    return learn.importances(model, spark)


@register("m7_importance_sums", "SELECT 1.0::DOUBLE AS total, 0::BIGINT AS n_negative, 0::BIGINT AS n_repeated")
def m7_sums(spark, sf):
    table = settle(learn.importances(learn.train_escalation(settle(_call_features(spark, sf))), spark))
    return table.agg(
        F.round(F.sum("importance"), 6).alias("total"), F.count_if(F.col("importance") < 0).alias("n_negative"),
        (F.count(F.lit(1)) - F.count_distinct("feature")).alias("n_repeated"),
    )


@register("m8_saved_model_scores", "SELECT count(DISTINCT o_custkey) AS n_calls, 0::BIGINT AS n_different FROM orders JOIN customer ON o_custkey = c_custkey")
def m8(spark, sf):
    """Scores before a model is saved against those after it is loaded again."""
    rows = settle(_call_features(spark, sf))
    path = scratch_path(spark, "model")
    model = learn.train_escalation(rows)
    learn.save(model, path)
    before = learn.escalation_probability(model, rows).select("call_id", F.col("probability").alias("before"))
    after = learn.escalation_probability(learn.load(path), rows).select("call_id", "probability")
    return before.join(after, "call_id", "full").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(~F.col("before").eqNullSafe(F.col("probability"))).alias("n_different")
    )


@register(
    "m12_feature_vectors",
    with_ctes(SUP_SCORED, FEATURES)
    + f"""SELECT call_id, unnest(range({len(C.BUSINESS_FEATURES)}))::INT AS position,
  unnest([{", ".join(f"round({n}::DOUBLE, 6)" for n in C.BUSINESS_FEATURES)}]) AS value FROM feats""",
)
def m12(spark, sf):
    """The vectors of the calls, one row per place."""
    rows = features.business_features(T.with_predictions(T.support_turns(spark, sf)))
    vectors = learn.assemble(C.BUSINESS_FEATURES).transform(rows)
    return vectors.select("call_id", F.posexplode(vector_to_array("features")).alias("position", "value")).withColumn("value", F.round("value", 6))


CONVERSATION_TASKS = ["category", "resolution", "satisfaction", "escalation"]


def _conversation_rows(spark, sf):
    scored = T.scored_turns(spark, sf)
    conv = features.conversation_features(scored, jobs.entity_counts(scored))
    return (
        conv.join(features.first_customer_intent(scored), "call_id")
        .join(rules.outcome_labels(T.outcomes(spark, sf)), "call_id")
        .withColumn("category", T.pick(C.INTENTS, F.col("call_id") % 11))
    )


@register("m4_conversation_baseline_metrics")
def m4(spark, sf):
    rows = settle(sampling.holdout_split(settle(_conversation_rows(spark, sf)), ["call_id"], {"test": 0.2}))
    models = learn.train_conversation_baseline(rows.filter("split = 'train'"), CONVERSATION_TASKS)
    predicted = learn.predict_tasks(models, rows.filter("split = 'test'"))
    long = None
    for task in CONVERSATION_TASKS:
        part = predicted.select(
            F.lit(task).alias("task"), F.lit("baseline").alias("model"), F.col(task).alias("y_true"),
            F.col(f"{task}_label").alias("y_pred"),
        )
        long = part if long is None else long.unionByName(part)
    return evaluate.multi_task_metrics(long)


@register("c12_predict_conversations")
def c12(spark, sf):
    """Models of the train part on all calls; `split` tells which calls they had seen."""
    rows = settle(sampling.holdout_split(settle(_conversation_rows(spark, sf)), ["call_id"], {"test": 0.2}))
    models = learn.train_conversation_baseline(rows.filter("split = 'train'"), CONVERSATION_TASKS)
    predicted = jobs.predict_conversations(T.scored_turns(spark, sf), T.outcomes(spark, sf), models)
    return predicted.join(rows.select("call_id", "split"), "call_id", "left")


def _halves(spark, sf):
    """Both halves of the calls, each beside the other half, from which its models are learned."""
    scored = settle(T.scored_turns(spark, sf))
    half = F.pmod(F.xxhash64("call_id"), F.lit(2))
    return [(scored.where(half == i), scored.where(half != i)) for i in (0, 1)]


def _models(scored, outcomes):
    intents = features.first_customer_intent(scored)
    rows = settle(features.business_features(scored).join(intents, "call_id").join(rules.outcome_labels(outcomes), "call_id"))
    return learn.train_resolution(rows), learn.train_escalation(rows)


def _intent_model(scored):
    """Intents of calls learned from their texts."""
    texts = sentiment.intent_text(scored).join(features.first_customer_intent(scored), "call_id")
    model = learn.train_text_baseline(texts, "intent_text", "intent")
    return lambda wanted: learn.score(model, wanted).select("call_id", F.col("predicted").alias("label"), "confidence")


def _intent_of(texts):
    """Intents as a table that SQL can follow: label and confidence from the length of the text."""
    size = F.length("intent_text")
    return texts.select("call_id", T.pick(C.INTENTS, size % 11).alias("label"), ((50 + size % 50) / F.lit(100.0)).alias("confidence"))


@register("c5_analyze_calls")
def c5(spark, sf):
    """The nested rows as JSON; each half of the calls is analysed by models of the other."""
    out = None
    for learned, rest in _halves(spark, sf):
        done = jobs.analyze_calls(rest, _intent_model(learned), *_models(learned, T.outcomes(spark, sf)))["calls"]
        rows = done.select("call_id", F.to_json(F.struct("*")).alias("analysis"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _assembled(spark, sf, scored):
    """The analysis from predictions that are tables, which SQL can follow."""
    calls = scored.select("call_id").distinct()
    p = (F.col("call_id") % 101) / 100.0
    labels = ["Resolved", "Partially Resolved", "Unresolved"]
    resolutions = calls.select("call_id", T.pick(labels, F.col("call_id") % 3).alias("label"), p.alias("confidence"))
    escalations = calls.select("call_id", rules.risk_tier(p).alias("risk_tier"), p.alias("probability"))
    return jobs.assemble_calls(scored, _intent_of(sentiment.intent_text(scored)), resolutions, escalations)


@register(
    "c5_call_results",
    with_ctes(
        SCORED,
        VOTES,
        """texts AS (SELECT call_id, coalesce(string_agg(text, ' ' ORDER BY turn_idx) FILTER (WHERE speaker = 'CUSTOMER'),
  string_agg(text, ' ' ORDER BY turn_idx)) AS t FROM bare GROUP BY 1)""",
    )
    + f"""SELECT call_id, {literal_list(C.INTENTS)}[1 + length(t) % 11] AS intent, c.label AS customer_label, b.label AS conversation_label,
  ['Resolved', 'Partially Resolved', 'Unresolved'][1 + call_id % 3] AS resolution,
  CASE WHEN (call_id % 101) / 100.0 <= 0.35 THEN 'Low' WHEN (call_id % 101) / 100.0 <= 0.65 THEN 'Medium' ELSE 'High' END AS risk_tier
FROM texts JOIN best b USING (call_id) LEFT JOIN cbest c USING (call_id)""",
)
def c5_results(spark, sf):
    return _assembled(spark, sf, T.scored_turns(spark, sf))["calls"].select(
        "call_id", F.col("intent.label").alias("intent"), F.col("sentiment.customer_level.label").alias("customer_label"),
        F.col("sentiment.conversation_level.label").alias("conversation_label"), F.col("resolution.label").alias("resolution"),
        "escalation.risk_tier",
    )


@register("c5_call_emotions", ORACLES["w2_emotion_timeline"])
def c5_emotions(spark, sf):
    out = _assembled(spark, sf, T.scored_turns(spark, sf))["emotions"]
    return out.select("call_id", *(F.col(c).cast("bigint").alias(c) for c in ("entry_idx", "time_ms")), "speaker", "label", *_r("confidence"))


@register("c5_call_turns", ORACLES["c4_turn_masks"])
def c5_turns(spark, sf):
    scored = T.with_predictions(T.support_turns(spark, sf))
    return _assembled(spark, sf, scored)["turns"].select("call_id", "turn_idx", "masked_text")


@register(
    "m10_business_report_sizes",
    """WITH n AS (SELECT count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n - floor(n * 0.2)::BIGINT AS n_train, floor(n * 0.2)::BIGINT AS n_test, 2 AS models_with_importances, true AS in_range FROM n""",
)
def m10_sizes(spark, sf):
    """Sizes of the parts; metrics and importances in one check, as they are learned."""
    out = jobs.business_report(settle(_call_features(spark, sf)))
    sums = out["importances"].groupBy("model").agg(F.abs(F.sum("importance") - 1) < 1e-6)
    fair = out["escalation"].select(
        (F.col("roc_auc").between(0, 1) | F.col("roc_auc").isNull()) & F.col("brier_score").between(0, 1)
    )
    return out["sizes"].select(
        "n_train", "n_test", F.lit(sums.toDF("model", "ok").where("ok").count()).alias("models_with_importances"),
        F.lit(bool(fair.first()[0])).alias("in_range"),
    )


@register("m10_business_report_metrics")
def m10_metrics(spark, sf):
    """Held-out metrics of both forests and the importances, one row per number."""
    out = jobs.business_report(settle(_call_features(spark, sf)))
    resolution = out["resolution"].select(F.lit("resolution").alias("model"), F.concat(F.lit("f1 "), "label").alias("name"), F.col("f1").alias("value"))
    names = ("precision", "recall", "f1", "roc_auc", "average_precision", "brier_score")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("m")
    escalation = out["escalation"].select(F.lit("escalation").alias("model"), pairs).select("model", "m.name", "m.value")
    importances = out["importances"].select("model", F.concat(F.lit("importance "), "feature").alias("name"), F.col("importance").alias("value"))
    return resolution.unionByName(escalation).unionByName(importances)


@register(
    "m11_tagged_corpus",
    with_ctes(
        TOKENS,
        """flat AS (SELECT *, ['PERSON', 'ORGANIZATION', 'O', 'O', 'O', 'O', 'O', 'O', 'O', 'O', 'O', 'O', 'O'][1 + length(token) % 13] AS label
  FROM tokens WHERE sent_id % 2 = 0)""",
        "prev AS (SELECT *, lag(label) OVER (PARTITION BY sent_id ORDER BY pos) AS before FROM flat)",
        "bio AS (SELECT sent_id, pos, CASE WHEN label = 'O' THEN 'O' WHEN label = before THEN 'I-' || label ELSE 'B-' || label END AS tag FROM prev)",
        """every AS (SELECT *, 'real' AS source FROM bio WHERE sent_id IN (SELECT sent_id FROM bio WHERE tag <> 'O')
  UNION ALL SELECT sent_id, pos, 'O', 'synthetic' FROM tokens WHERE sent_id % 2 = 1)""",
        """sents AS (SELECT *, row_number() OVER (ORDER BY md5(source || '-' || sent_id::VARCHAR || '-42')) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT source, sent_id FROM every))""",
    )
    + """SELECT sent_id, pos, tag, source, CASE WHEN r <= greatest(1, floor(n * 0.15)) THEN 'test'
  WHEN r <= 2 * greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split FROM every JOIN sents USING (source, sent_id)""",
)
def m11_tagged(spark, sf):
    words = T.words(spark, sf)
    coarse = ["person", "organization", *["other"] * 11]
    even = F.col("sent_id") % 2 == 0
    real = words.filter(even).withColumn("label", T.pick(coarse, F.length("token") % 13))
    synthetic = words.filter(~even).withColumn("tag", F.lit("O"))
    out = jobs.prepare_tagged_corpus(real, synthetic, C.CORPUS_TYPE_MAP, {"test": 0.15, "val": 0.15})
    return out.select("sent_id", "pos", "tag", "source", "split")


@register("c6_agent_report")
def c6(spark, sf):
    """All calls, each half scored by models of the other."""
    rows, metrics = settle(_conversation_rows(spark, sf)), None
    for learned, rest in _halves(spark, sf):
        known = rows.join(learned.select("call_id").distinct(), "call_id", "left_semi")
        satisfaction = learn.train_conversation_baseline(known, ["satisfaction"])["satisfaction"]
        part = jobs.predicted_metrics(rest, T.agents_of_calls(spark, sf), *_models(learned, T.outcomes(spark, sf)), satisfaction)
        metrics = part if metrics is None else metrics.unionByName(part)
    return jobs.report_on(metrics).select("agent_id", "num_calls", "resolution_rate", "escalation_rate", "score")
