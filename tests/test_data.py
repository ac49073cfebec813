"""Files, validation, metrics, samples and models on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from callweave.operators import evaluate, learn, quality, rules, sampling
from callweave.sources import files


def test_conversation_files(spark, tmp_path):
    turn = {"speaker": "AGENT", "start": 0.0, "end": 1.5, "text": "hi"}
    (tmp_path / "one.json").write_text(json.dumps({"conversation": [turn, dict(turn, text="there", start=1.5)], "call_id": "zzz"}))
    (tmp_path / "two.json").write_text(" " + json.dumps([turn]))
    got = files.load_turns(spark, str(tmp_path)).orderBy("call_id", "turn_idx").collect()
    assert [(r.call_id, r.turn_idx, r.start_ms, r.end_ms, r.text) for r in got] == [
        ("one", 0, 0, 1500, "hi"), ("one", 1, 1500, 1500, "there"), ("two", 0, 0, 1500, "hi")
    ]


def test_transcript_files(spark, tmp_path):
    row = {"call_id": "a", "language": None, "duration": 2.5, "segments": [{"start": 0.0, "end": 2.5, "text": "hi"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(row, indent=2))
    df = files.load_transcripts(spark, str(tmp_path / "in"))
    assert df.columns == ["call_id", "language", "duration", "segments"]
    files.write_transcripts(df, str(tmp_path / "per"), per_call=True)
    assert list((tmp_path / "per" / "call=a").glob("*.json"))
    files.write_transcripts(df, str(tmp_path / "lines"))
    assert files.load_transcript_lines(spark, str(tmp_path / "lines")).first().segments[0].text == "hi"


def test_scan_by_extension(spark, tmp_path):
    for name in ("a.wav", "b.FLAC", "c.txt", "sub/d.mp3", "e.ogg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    got = files.scan_audio(spark, str(tmp_path)).select("call_id", "extension", "size_bytes").collect()
    assert sorted(r.call_id for r in got) == ["a", "b", "d", "e"] and {r.size_bytes for r in got} == {3}
    plan = files.scan_audio(spark, str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


MANIFEST = "path string, extension string, exists boolean, size_bytes bigint, readable boolean, frames bigint, duration_seconds double, sample_rate int, channels int, format string"


def test_validation_rules(spark):
    ok = ("ok", "wav", True, 10, True, 5, 1.0, 16000, 1, "WAV")
    rows = [
        ok, ("gone", "wav", False, None, None, None, None, None, None, None), ("empty", "wav", True, 0, None, None, None, None, None, None),
        ("type", "ogg", True, 10, True, 5, 1.0, 16000, 1, "OGG"), ("bad", "wav", True, 10, False, None, None, None, None, None),
        ("zero", "wav", True, 10, True, 0, 0.0, 8000, 2, "WAV"), ("short", "wav", True, 10, True, 5, 0.1, 8000, 2, "WAV"),
        ("long", "wav", True, 10, True, 5, 601.0, 16000, 1, "WAV"),
    ]
    checked = rules.validate(spark.createDataFrame(rows, MANIFEST))
    got = {r.path: r for r in checked.collect()}
    assert {p for p, r in got.items() if r.is_valid} == {"ok"}
    assert all(len(r.errors) == 1 for p, r in got.items() if p != "ok")
    assert len(got["short"].warnings) == 2 and got["zero"].warnings == [] and not got["type"].has_info and got["zero"].has_info
    valid, invalid = rules.split_valid(checked)
    assert (valid.count(), invalid.count()) == (1, 7)
    report = {(r.kind, r.value): r for r in quality.dataset_report(checked).collect()}
    assert report["all", None].n_files == 8 and report["sample_rate", "8000"].n_files == 2 and ("format", "OGG") not in report


def test_duplicates(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "x")], "path string, content string")
    got = {r.path: (r.n_copies, r.first_path) for r in quality.duplicate_groups(df).collect()}
    assert got == {"a": (3, "a"), "b": (3, "a"), "d": (3, "a")}


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "d double")
    got = [(r.bin, r.n) for r in quality.duration_histogram(df, "d").orderBy("bin").collect()]
    assert got == [(0, 0), (1, 3), (2, 0)]


def test_class_metrics(spark):
    df = spark.createDataFrame(list(zip("AABB", "ABBB")), "y_true string, y_pred string")
    per = {r.label: r for r in evaluate.class_metrics(df).collect()}
    assert per["A"].recall == 0.5 and per["B"].recall == 1.0 and per["A"].support == 2
    macro = evaluate.macro_metrics(df, ["A", "B", "C"]).first()
    assert macro.accuracy == 0.75 and macro.recall_macro == pytest.approx(0.5)
    cells = {(r.y_true, r.y_pred): r.n for r in evaluate.confusion(df, ["A", "B"]).collect()}
    assert cells == {("A", "A"): 1, ("A", "B"): 1, ("B", "A"): 0, ("B", "B"): 2}


def test_binary_metrics_against_pairs(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.2), (1, 0.2), (0, 0.1), (1, 1.0), (0, 0.0)]
    m = evaluate.binary_metrics(spark.createDataFrame(rows, "y int, p double")).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert m.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / 16)
    ap, seen = 0.0, 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(p >= t for _, p in rows)
        ap, seen = ap + (tp / 4 - seen) * tp / n, tp / 4
    assert m.average_precision == pytest.approx(ap)
    assert m.brier_score == pytest.approx(sum((y - p) ** 2 for y, p in rows) / 8) and m.recall == 0.5


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    assert {r.label: r.weight for r in evaluate.class_weights(df).collect()} == {"a": pytest.approx(2 / 3), "b": 2.0}


def test_samples_are_exact_and_stable(spark):
    df = spark.createDataFrame([(i, "a" if i < 990 else "b") for i in range(1000)], "id int, label string")
    keep = sampling.stratified_subsample(df, "label", ["id"], 100)
    assert {r.label: r["count"] for r in keep.groupBy("label").count().collect()} == {"a": 99, "b": 1}
    again = sampling.stratified_subsample(df.repartition(7), "label", ["id"], 100)
    assert {r.id for r in keep.collect()} == {r.id for r in again.collect()}
    tiny = spark.createDataFrame([(i, "x" if i < 100 else "y") for i in range(102)], "id int, label string")
    split = {(r.label, r.split): r["count"] for r in sampling.stratified_split(tiny, "label", ["id"]).groupBy("label", "split").count().collect()}
    assert split == {("x", "test"): 15, ("x", "val"): 15, ("x", "train"): 70, ("y", "train"): 2}
    few = df.filter("id < 3")
    held = sampling.holdout_split(few, ["id"], {"test": 0.15, "val": 0.15}, at_least=1)
    assert {r.split: r["count"] for r in held.groupBy("split").count().collect()} == {"test": 1, "val": 1, "train": 1}


def test_text_model_scores_saves_and_loads(spark, tmp_path):
    words = {"REFUND": "money back refund please now", "ORDER": "where is my order package"}
    rows = [(i, " ".join(words[k].split()[: 3 + i % 3]), k) for i, k in enumerate(["REFUND", "ORDER"] * 20)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    model = learn.train_text_baseline(df)
    learn.save(model, str(tmp_path / "m"))
    scored = learn.score(learn.load(str(tmp_path / "m")), df.drop("label")).collect()
    assert len(scored) == 40 and [r.predicted for r in scored[:2]] == ["REFUND", "ORDER"]
    for r in scored:
        assert sum(r.probabilities.values()) == pytest.approx(1.0) and r.confidence == pytest.approx(max(r.probabilities.values()))
    assert {r.label: r.f1 for r in learn.evaluate_model(model, df).collect()} == {"REFUND": 1.0, "ORDER": 1.0}


def test_external_scorer(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id int, text string")

    def load():
        return lambda texts: [("long" if len(t) > 2 else "short", 0.5) for t in texts]

    assert [r.predicted for r in learn.score_external(df, "text", load, 2).orderBy("id").collect()] == ["short"] * 3 + ["long"] * 2


def test_labels_are_decoded(spark):
    df = spark.createDataFrame([("t", 1), ("u", 9)], "body string, y int")
    assert [tuple(r) for r in files.load_labelled(df, "body", "y", ["no", "yes"]).collect()] == [("t", "yes"), ("u", None)]


def test_argmax_tie_takes_the_first_class(spark):
    r = spark.range(1).select(
        learn.argmax_label(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)), ["a", "b", "c"]),
        learn.argmax_of_map(F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5))),
    ).first()
    assert list(r) == ["a", "a"]


def test_conversation_files_of_any_kind(spark, tmp_path):
    good = '{"speaker": "AGENT", "start": 1.25, "end": 2, "text": "Hi", "mood": {"x": [1]}}'
    bodies = {
        "array": f"[{good}]", "object": f'{{"id": 7, "conversation": [{good}, {{"text": "so", "start": "late", "speaker": null}}]}}', "none": "[]",
        "cut": f"[{good}", "empty": "\n", "other": '{"conversation": 3}', "null": "null", "bad": f'[{good}, {{"speaker": "AGENT"}}]', "plain": '["Hi"]',
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    out = files.read_conversations(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in out.turns.collect())
    assert rows == [("array", 0, "AGENT", 1250, 2000, "Hi"), ("object", 0, "AGENT", 1250, 2000, "Hi"), ("object", 1, None, None, None, "so")]
    errors = {r.call_id: r.error for r in out.outcomes.collect()}
    assert errors == {
        "array": None, "object": None, "none": None, "cut": "Not valid JSON", "empty": "Not valid JSON", "other": "No list of turns",
        "null": "No list of turns", "bad": "A turn is not an object with text", "plain": "A turn is not an object with text",
    }
    assert quality.batch_summary(out.outcomes).first() == (9, 3, 6)


def test_files_of_calls_share_a_fixed_number_of_folders(spark, tmp_path):
    calls = spark.range(40).selectExpr("id AS call_id", """'[{"speaker": "AGENT", "start": 0.5, "end": 1, "text": "né ' || id || '"}]' AS value""")
    for _ in range(2):  # a task that is tried again leaves the same files
        files.write_conversations(calls, f"file://{tmp_path}/calls", folders=4)
    assert len(list((tmp_path / "calls").iterdir())) <= 4
    got = files.load_turns(spark, str(tmp_path / "calls")).collect()
    assert {(r.call_id, r.start_ms, r.text) for r in got} == {(str(i), 500, f"né {i}") for i in range(40)} and len(got) == 40
