"""Composed jobs: from turns, transcripts or frames to finished tables.

Jobs with results at several grains return a dict of DataFrames, one per grain:
a call may have any number of turns, so its turns stay rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import config as C
from callweave.config import AudioConfig, ChunkConfig, SegmentConfig, VadConfig
from callweave.functions import spans
from callweave.operators import (
    agents,
    align,
    cluster,
    entities,
    evaluate,
    features,
    learn,
    quality,
    rules,
    sampling,
    sentiment,
    signal,
    wer,
)
from callweave.session import settle


def attribute_speakers(
    asr: DataFrame, speakers: DataFrame, durations: DataFrame, apply_roles: bool = False
) -> DataFrame:
    """Speaker-attributed transcript turns, clipped to the length of the call."""
    if apply_roles:
        speakers = align.apply_roles(speakers, align.infer_roles(speakers))
    aligned = align.align(asr, speakers)
    return rules.clip_to_duration(aligned, durations).select(
        "call_id", F.col("seg_idx").alias("turn_idx"), "speaker", "start_ms", "end_ms", "text"
    )


def analyze_nlp(scored: DataFrame) -> dict[str, DataFrame]:
    """Intent text, both sentiment levels and the emotion timeline of every call."""
    return {
        "intent_text": sentiment.intent_text(scored),
        "sentiment": sentiment.conversation_sentiment(scored),
        "emotion_timeline": sentiment.emotion_timeline(scored),
    }


def analyze_text(docs: DataFrame, text: str = "text", model_spans: str | None = None) -> DataFrame:
    """Adds entities (with normalised values), masked text and structured fields.

    `model_spans` names a column with the spans of a statistical model, if any;
    on overlap the longer span wins. Everything happens in the row of the text.
    """
    found = spans.rule_spans(F.col(text))
    if model_spans is not None:
        found = spans.longest_spans(
            spans.with_source(F.col(model_spans), "model"), spans.with_source(found, "rule")
        )
    return (
        docs.withColumn("_spans", found)
        .withColumn("entities", spans.with_normalized(F.col("_spans")))
        .withColumn("masked_text", spans.mask(F.col(text), F.col("_spans")))
        .withColumn("structured_fields", spans.structured_fields(F.col("_spans")))
        .drop("_spans")
    )


def analyze_entities(turns: DataFrame) -> dict[str, DataFrame]:
    """Entities and masks per turn, and the fields of the joined text per call."""
    texts = entities.call_text(turns).withColumn("spans", spans.rule_spans(F.col("text")))
    return {
        "turns": analyze_text(turns).drop("structured_fields"),
        "calls": entities.call_fields(texts),
    }


def business_report(rows: DataFrame, test_frac: float = 0.2, seed: int = 42, trees: int = 200) -> dict[str, DataFrame]:
    """Trains both forests on one part of the calls and reports on the other.

    rows: the business features, intent, resolution and escalation of calls.
    Returns sizes (n_train, n_test), resolution (metrics per class and macro),
    escalation (precision, recall, F1, ROC-AUC, average precision, Brier score of
    P(Yes)) and importances (model, feature, importance).
    """
    spark = rows.sparkSession
    split = settle(sampling.holdout_split(rows, ["call_id"], {"test": test_frac}, seed))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    resolution = learn.train_resolution(train, trees=trees)
    escalation = learn.train_escalation(train, trees=trees)
    risk = learn.escalation_probability(escalation, test).select(
        (F.col("escalation") == "Yes").cast("int").alias("y"), F.col("probability").alias("p")
    )
    scores = [
        learn.importances(m, spark).select(F.lit(n).alias("model"), "feature", "importance")
        for n, m in (("resolution", resolution), ("escalation", escalation))
    ]
    return {
        "sizes": split.agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "test")]),
        "resolution": learn.evaluate_model(resolution, test, "resolution"),
        "escalation": evaluate.binary_metrics(risk),
        "importances": scores[0].unionByName(scores[1]),
    }


def prepare_tagged_corpus(
    real: DataFrame, synthetic: DataFrame, mapping: dict[str, str], fracs: dict[str, float], seed: int = 42
) -> DataFrame:
    """Tagged tokens of two corpora in one tag set, and a split per sentence.

    real: sent_id, pos, token and a flat label of its own set, of which only
    sentences with an entity of ours are kept; synthetic: sent_id, pos, token, tag.
    Every part named in `fracs` gets at least one sentence.
    """
    mapped = entities.flat_to_bio(rules.map_labels(real, "label", mapping, "O"))
    kept = rules.has_target(mapped).select("sent_id", "pos", "token", "tag")
    rows = settle(sampling.union_tagged(kept, synthetic.select("sent_id", "pos", "token", "tag")))
    sentences = rows.select("source", "sent_id").distinct()
    placed = sampling.holdout_split(sentences, ["source", "sent_id"], fracs, seed, at_least=1)
    return rows.join(placed, ["source", "sent_id"])


def entity_counts(turns: DataFrame) -> DataFrame:
    """Rule entities per call, summed over its turns; calls without one count 0."""
    per_turn = turns.select("call_id", F.size(spans.rule_spans(F.col("text"))).alias("n"))
    return per_turn.groupBy("call_id").agg(F.sum("n").alias("num_entities"))


def analyze_calls(
    scored: DataFrame,
    intent_of: Callable[[DataFrame], DataFrame],
    resolution_model: PipelineModel,
    escalation_model: PipelineModel,
) -> dict[str, DataFrame]:
    """Everything about a call: one nested row per call, one row per turn, one row per emotion.

    The turns are scored once, before this job; all branches read that table.
    `intent_of` gives label and confidence for (call_id, intent_text).
    """
    feats = settle(features.business_features(scored).join(features.first_customer_intent(scored), "call_id"))
    resolved = learn.score(resolution_model, feats).select(
        "call_id", F.col("predicted").alias("label"), "confidence", "probabilities"
    )
    risk = learn.escalation_probability(escalation_model, feats)
    table = learn.importances(escalation_model, scored.sparkSession)
    verdict = features.explain_escalation(risk, features.importance_map(table)).select(
        "call_id", "risk_tier", "probability", "top_factors", "factor_importances", "explanation"
    )
    return assemble_calls(scored, intent_of(sentiment.intent_text(scored)), resolved, verdict)


def assemble_calls(
    scored: DataFrame, intents: DataFrame, resolutions: DataFrame, escalations: DataFrame
) -> dict[str, DataFrame]:
    """The analysis of calls from predictions that are tables.

    intents: call_id, label, confidence; resolutions and escalations: call_id and
    the fields of the nested value.
    """

    def nested(table: DataFrame, name: str) -> DataFrame:
        return table.select("call_id", F.struct(*[c for c in table.columns if c != "call_id"]).alias(name))

    def level(name: str) -> Column:
        fields = ("label", "confidence", "score")
        return F.struct(*[F.col(f"{name}_{f}").alias(f) for f in fields]).alias(f"{name}_level")

    nlp = analyze_nlp(scored)
    mood = nlp["sentiment"].select("call_id", F.struct(level("customer"), level("conversation")).alias("sentiment"))
    found = analyze_entities(scored)
    calls = mood
    for table, name in (
        (intents.select("call_id", "label", "confidence"), "intent"),
        (found["calls"], "structured_fields"),
        (resolutions, "resolution"),
        (escalations, "escalation"),
    ):
        calls = calls.join(nested(table, name), "call_id", "left")
    turns = found["turns"].select(
        "call_id", "turn_idx", "speaker", "start_ms", "end_ms", "sentiment", "sentiment_confidence", "emotion",
        "emotion_confidence", "masked_text", "entities",
    )
    return {"calls": calls, "turns": turns, "emotions": nlp["emotion_timeline"]}


def predicted_metrics(
    scored: DataFrame,
    agents_of_calls: DataFrame,
    resolution_model: PipelineModel,
    escalation_model: PipelineModel,
    satisfaction_model: PipelineModel,
) -> DataFrame:
    """Metrics of each call, with the three labels predicted by models."""
    intents = features.first_customer_intent(scored)
    feats = settle(features.business_features(scored).join(intents, "call_id"))
    resolution = learn.score(resolution_model, feats).select(
        "call_id", F.col("predicted").alias("resolution")
    )
    risk = learn.escalation_probability(escalation_model, feats).select(
        "call_id", rules.risk_tier(F.col("probability")).alias("risk_tier")
    )
    conv = features.conversation_features(scored, entity_counts(scored)).join(intents, "call_id")
    satisfied = learn.score(satisfaction_model, conv).select("call_id", F.col("predicted").alias("satisfaction"))
    return agents.call_metrics(feats, features.talk_listen(scored), resolution, risk, satisfied, agents_of_calls)


def report_on(metrics: DataFrame) -> DataFrame:
    """Metrics and score per agent, from the metrics of calls."""
    rolled = agents.agent_metrics(metrics)
    return rolled.join(agents.agent_score(rolled), "agent_id")


def agent_report(
    scored: DataFrame,
    agents_of_calls: DataFrame,
    resolution_model: PipelineModel,
    escalation_model: PipelineModel,
    satisfaction_model: PipelineModel,
) -> DataFrame:
    """Metrics and score per agent, with the three labels predicted by models."""
    return report_on(predicted_metrics(scored, agents_of_calls, resolution_model, escalation_model, satisfaction_model))


def evaluate_asr(manifest: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """Word error rates of transcripts against a manifest."""
    pairs, missing = align.pair_for_eval(
        manifest.select("call_id", F.col("reference_transcript").alias("reference")), wer.join_segments(segments)
    )
    scored = wer.call_wer(pairs)
    return {
        "corpus": wer.corpus_wer(scored),
        "calls": scored,
        "worst": wer.worst_calls(scored),
        "missing": missing,
        "rejected": wer.rejected_pairs(scored),
    }


def validate_dataset(manifest: DataFrame, content: DataFrame, cfg: AudioConfig = C.DEFAULTS.audio) -> dict[str, DataFrame]:
    """Validation report of a file collection. `content`: path, content."""
    checked = rules.validate(manifest, cfg)
    return {
        "report": quality.dataset_report(checked),
        "issues": quality.dataset_issues(checked),
        "duplicates": quality.duplicate_groups(content),
    }


def diarize(
    speech_frames: DataFrame,
    totals: DataFrame,
    embeddings: DataFrame | Callable[[DataFrame], DataFrame],
    vad: VadConfig = C.DEFAULTS.vad,
    cfg: SegmentConfig = C.DEFAULTS.segment,
    speakers: int = 2,
) -> DataFrame:
    """Speaker segments from speech frames and one embedding per segment.

    `embeddings`: call_id, seg_idx, embedding, or a function that gives them for (call_id, seg_idx).
    """
    # Regions, segments and labels are few beside frames and several passes read them: computed once.
    regions = settle(signal.speech_regions(speech_frames, totals, vad))
    segments = settle(signal.diarization_segments(regions, cfg))
    if callable(embeddings):
        embeddings = embeddings(segments.select("call_id", "seg_idx"))
    keyed = segments.select("call_id", "seg_idx").join(embeddings, ["call_id", "seg_idx"])
    labels = settle(cluster.cluster_speakers(keyed, speakers))
    return segments.join(cluster.relabel_first_seen(labels), ["call_id", "seg_idx"]).select(
        "call_id", F.col("seg_idx").alias("spk_idx"), "speaker", "start_ms", "end_ms"
    )


def evaluate_ner(tokens: DataFrame, true_bio: DataFrame, entity_sets: dict[str, DataFrame]) -> DataFrame:
    """Entity-level metrics of several extractors on one tagged corpus, by source.

    tokens: sent_id, pos, token; true_bio: sent_id, pos, tag, source; entity sets:
    sent_id, ent_idx, label, start, end.
    """
    placed = settle(entities.token_offsets(tokens))
    tagged = None
    # spans have no O tokens, so only tagged ones are handed on
    for name, found in entity_sets.items():
        rows = entities.covered_tags(placed, found).select("sent_id", "pos", "tag", F.lit(name).alias("model"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    pred = tagged.join(true_bio.select("sent_id", "pos", "source"), ["sent_id", "pos"])
    return evaluate.span_metrics_by(true_bio, pred, models=list(entity_sets))


def prepare_signal(
    samples: DataFrame,
    sample_rate: int,
    vad: VadConfig = C.DEFAULTS.vad,
    chunk: ChunkConfig = C.DEFAULTS.chunk,
    audio: AudioConfig = C.DEFAULTS.audio,
    manifest: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Mono, normalised samples, speech regions and the chunk plan of every call.

    samples: call_id, channel, idx, v at one sample rate. With `manifest` (call_id and what `rules.validate`
    reads), only calls whose file is valid go on; the others are returned as `invalid` with their errors.
    """
    checked = None
    if manifest is not None:
        checked = settle(rules.validate(manifest, audio))
        samples = samples.join(checked.filter("is_valid").select("call_id"), "call_id", "left_semi")
    frame_len = max(1, int(sample_rate * vad.frame_ms / 1000))
    # a frame is a whole number of samples, so it may be shorter than asked
    vad = replace(vad, frame_ms=frame_len * 1000 / sample_rate)
    mono = signal.to_mono(samples)
    level = signal.normalize_peak(mono, audio.target_peak_dbfs)
    frames = signal.frame_rms_db(level, frame_len)
    durations = mono.groupBy("call_id").agg(((F.max("idx") + 1) * 1000.0 / sample_rate).alias("duration_ms"))
    totals = signal.frame_totals(frames).join(durations, "call_id")
    speech = frames.filter(F.col("db") > vad.silence_threshold_db)
    regions = settle(signal.speech_regions(speech, totals, vad))
    return {
        "samples": level,
        "regions": regions,
        "chunks": signal.plan_chunks(durations, regions, chunk),
        "silent": signal.silent_calls(durations.select("call_id"), regions),
    } | ({} if checked is None else {"invalid": checked.filter("NOT is_valid")})


def predict_conversations(
    scored: DataFrame, calls: DataFrame, models: dict[str, PipelineModel]
) -> DataFrame:
    """Label and confidence of every task per call; calls without turns get NULLs."""
    feats = features.conversation_features(scored, entity_counts(scored)).join(
        features.first_customer_intent(scored), "call_id"
    )
    predicted = learn.predict_tasks(models, feats)
    names = [c for t in models for c in (f"{t}_label", f"{t}_confidence")]
    return calls.select("call_id").join(predicted.select("call_id", *names), "call_id", "left")
