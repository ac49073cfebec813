"""Signals, regions, chunks, speakers and error rates against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.catalog import speech
from callweave.config import ChunkConfig, SegmentConfig, VadConfig
from callweave.operators import align, cluster, der, rules, signal, wavefront, wer
from callweave.plans import jobs
from callweave.sources import tables as T

RATE = 1000


def tone(ms):
    return [0.5 * math.sin(i * 0.7) for i in range(ms)]


def silence(ms):
    return [0.0] * ms


def samples(spark, calls):
    rows = [(c, 0, i, float(v)) for c, xs in calls.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "call_id string, channel int, idx bigint, v double")


def regions_by_pattern(speech, n, cfg):
    """Speech regions in frames, found in the call written as a text of 1 (speech) and 0."""
    text = "".join("1" if i in speech else "0" for i in range(n))
    gap = cfg.min_silence_frames - 1
    # silence that is too short to end a region, at the end of the call as well
    found = re.finditer(rf"1(?:0{{0,{gap}}}1)*(?:0{{0,{gap}}}$)?", text)
    return [m.span() for m in found if m.end() - m.start() >= cfg.min_speech_frames]


@pytest.mark.parametrize("size", [5, 100_000])
def test_speech_regions_equal_a_pattern(spark, size):
    rnd, cfg = random.Random(1), VadConfig()
    speech, totals = {}, {}
    for call in range(40):
        n, on, at = rnd.randint(5, 150), rnd.random() < 0.5, 0
        speech[call], totals[call] = set(), n
        while at < n:
            length = rnd.choice([1, 3, 6, 9, 10, 11, 20])
            if on:
                speech[call] |= set(range(at, min(n, at + length)))
            at, on = at + length, not on
    frames = spark.createDataFrame([(c, f) for c in speech for f in speech[c]], "call_id int, frame bigint")
    calls = spark.createDataFrame(list(totals.items()), "call_id int, n_frames bigint")
    got = {(r.call_id, r.start_ms, r.end_ms) for r in signal.speech_regions(frames, calls, cfg, size).collect()}
    want = {
        (c, max(0, a * 30 - 100), min(totals[c] * 30, b * 30 + 100)) for c in speech for a, b in regions_by_pattern(speech[c], totals[c], cfg)
    }
    assert got == want


def test_prepare_signal(spark):
    calls = {"two": tone(2000) + silence(1000) + tone(2000), "none": silence(3000), "long": tone(40_000)}
    out = jobs.prepare_signal(samples(spark, calls), RATE)
    regions = {}
    for r in out["regions"].collect():
        regions.setdefault(r.call_id, []).append((r.start_ms, r.end_ms))
    assert len(regions["two"]) == 2 and "none" not in regions and len(regions["long"]) == 1
    assert [r.call_id for r in out["silent"].collect()] == ["none"]
    assert max(abs(r.v) for r in out["samples"].filter("call_id = 'two'").collect()) == pytest.approx(10 ** (-3 / 20))
    chunks = sorted((r.call_id, r.chunk_idx, r.start_ms, r.end_ms) for r in out["chunks"].collect())
    assert chunks == [("long", 0, 0, 30_000), ("long", 1, 28_000, 40_000), ("none", 0, 0, 3000), ("two", 0, 0, 5000)]
    segments = signal.diarization_segments(out["regions"].filter("call_id = 'long'")).orderBy("seg_idx").collect()
    assert len(segments) == 4 and all(a.end_ms == pytest.approx(b.start_ms) for a, b in zip(segments, segments[1:]))


def test_mono_is_the_mean_of_channels(spark):
    df = spark.createDataFrame([("c", 0, 0, 0.2), ("c", 1, 0, 0.4)], "call_id string, channel int, idx bigint, v double")
    assert signal.to_mono(df).first().v == pytest.approx(0.3)


def test_partial_last_frame_is_dropped(spark):
    df = samples(spark, {"c": tone(250)}).drop("channel")
    assert sorted(r.frame for r in signal.frame_rms_db(df, 100).collect()) == [0, 1]


def follows_the_definition(chunks, duration, regions, cfg):
    """Whether each chunk follows from the one before and from the silences."""
    between = np.array([(a[1], b[0]) for a, b in zip(regions, regions[1:]) if a[1] <= b[0]]).reshape(-1, 2)
    starts = [0.0, *(max(e - cfg.overlap_ms, s + 1) for s, e in chunks[:-1])]
    if [s for s, _ in chunks] != pytest.approx(starts) or chunks[-1][1] != duration:
        return False
    for start, end in chunks:
        aim = start + cfg.chunk_ms
        moments = np.clip(aim, between[:, 0], between[:, 1])
        near = moments[np.abs(moments - aim) <= cfg.chunk_ms / 4]
        ends = [duration] if aim >= duration else [aim]
        if aim < duration and len(near):
            off = np.abs(near - aim).min()
            # two silences may be equally near
            ends = [m if m > start else aim for m in near if abs(abs(m - aim) - off) < 1e-9]
        if min(abs(end - e) for e in ends) > 1e-6 or (end == duration) != (end == chunks[-1][1]):
            return False
    return True


def test_plan_chunks_follows_its_definition(spark):
    rnd, cfg = random.Random(2), ChunkConfig(chunk_ms=1000, overlap_ms=100)
    calls, regions = {}, {}
    for c in range(60):
        at, mine = 0.0, []
        for _ in range(rnd.randint(0, 30)):
            at += rnd.choice([0, 5, 60, 400, 2500])
            length = rnd.choice([20, 150, 900, 4000])
            mine.append((at, at + length))
            at += length - rnd.choice([0, 0, 10])
        calls[c], regions[c] = at + rnd.choice([1.0, 500.0]), mine
    rows = signal.plan_chunks(
        spark.createDataFrame(list(calls.items()), "call_id int, duration_ms double"),
        spark.createDataFrame([(c, a, b) for c, rs in regions.items() for a, b in rs], "call_id int, start_ms double, end_ms double"),
        cfg,
    ).orderBy("call_id", "chunk_idx").collect()
    for c, duration in calls.items():
        mine = [r for r in rows if r.call_id == c]
        assert [r.chunk_idx for r in mine] == list(range(len(mine)))
        assert follows_the_definition([(r.start_ms, r.end_ms) for r in mine], duration, regions[c], cfg)


def test_frames_of_a_whole_number_of_samples(spark):
    """At 22 050 Hz a frame of 30 ms has 661 samples; ten minutes later its time must not be half a second off."""
    rate, n = 22_050, 661
    frame = 20_000
    one = spark.createDataFrame([("c", frame + i) for i in range(40)], "call_id string, frame bigint")
    totals = spark.createDataFrame([("c", frame + 100)], "call_id string, n_frames bigint")
    cfg = VadConfig(frame_ms=n * 1000 / rate, pad_ms=0)
    start = signal.speech_regions(one, totals, cfg).first().start_ms
    assert start == pytest.approx(frame * n * 1000 / rate) and abs(start - frame * 30) > 400


def test_merge_drop_split_order(spark):
    rows = [("c", 0, 300), ("c", 500, 900), ("c", 5000, 5200), ("c", 9000, 22_000)]
    df = spark.createDataFrame(rows, "call_id string, start_ms bigint, end_ms bigint")
    got = [(r.start_ms, r.end_ms) for r in signal.diarization_segments(df, SegmentConfig()).orderBy("seg_idx").collect()]
    assert got == [(0, 900), (9000, 15_500), (15_500, 22_000)]


ASR = "call_id string, seg_idx bigint, start_ms bigint, end_ms bigint, text string"
SPK = "call_id string, spk_idx bigint, speaker string, start_ms bigint, end_ms bigint"


def test_align_cases(spark):
    asr = spark.createDataFrame([("a", 0, 0, 5000, "x"), ("a", 1, 10_000, 12_000, "y"), ("a", 2, 500, 1500, "tie")], ASR)
    spk = spark.createDataFrame([("a", 0, "S0", 0, 1000), ("a", 1, "S1", 1000, 5000)], SPK)
    got = {r.seg_idx: r.speaker for r in align.align(asr, spk).collect()}
    assert got == {0: "S1", 1: "UNKNOWN", 2: "S0"}


@pytest.mark.parametrize("width", [7, 100, 60_000])
def test_align_equals_a_loop(spark, width):
    rnd = random.Random(4)
    asr, spk = [], []
    for c in "ab":
        for i in range(60):
            s = rnd.randint(0, 900)
            asr.append((c, i, s, s + rnd.randint(1, 90), "t"))
        for i in range(40):
            s = rnd.randint(0, 900)
            spk.append((c, i, f"S{rnd.randint(0, 3)}", s, s + rnd.randint(0, 70)))
    want = {}
    for c, i, s, e, _ in asr:
        total = {}
        for c2, _, who, a, b in spk:
            if c2 == c and min(e, b) > max(s, a):
                total[who] = total.get(who, 0) + min(e, b) - max(s, a)
        want[c, i] = max(total.items(), key=lambda kv: kv[1])[0] if total else "UNKNOWN"
    got = align.align(spark.createDataFrame(asr, ASR), spark.createDataFrame(spk, SPK), width).collect()
    assert {(r.call_id, r.seg_idx): r.speaker for r in got} == want


def test_roles(spark):
    spk = spark.createDataFrame([("a", 0, "S1", 50, 60), ("a", 1, "S0", 0, 40), ("b", 0, "S0", 0, 9)], SPK)
    roles = align.infer_roles(spk)
    assert {(r.call_id, r.speaker, r.role) for r in roles.collect()} == {("a", "S0", "AGENT"), ("a", "S1", "CUSTOMER")}
    named = {(r.call_id, r.spk_idx): r.speaker for r in align.apply_roles(spk, roles).collect()}
    assert named == {("a", 0): "CUSTOMER", ("a", 1): "AGENT", ("b", 0): "S0"}


def test_clip(spark):
    turns = spark.createDataFrame([("a", 0, 900, 1200)], "call_id string, turn_idx bigint, start_ms bigint, end_ms bigint")
    r = rules.clip_to_duration(turns, spark.createDataFrame([("a", 1000)], "call_id string, duration_ms bigint")).first()
    assert (r.start_ms, r.end_ms) == (900, 1000)


def vectors(rnd, n, centers):
    who = [rnd.randrange(len(centers)) for _ in range(n)]
    return who, [(centers[w] + np.array([rnd.gauss(0, 0.25) for _ in range(16)])).tolist() for w in who]


def linkage_by_definition(vecs, k):
    """Average linkage by recomputing all mean distances before each merge."""
    u = np.array([np.array(v) / np.linalg.norm(v) for v in vecs])
    groups = [[i] for i in range(len(vecs))]
    while len(groups) > k:
        pairs = itertools.combinations(range(len(groups)), 2)
        a, b = min(pairs, key=lambda p: 1 - (u[groups[p[0]]] @ u[groups[p[1]]].T).mean())
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("k, limit", [(2, 4000), (2, 7), (3, 9)])
def test_cluster_speakers(spark, k, limit):
    rnd = random.Random(8)
    centers = [np.array([rnd.gauss(0, 1) for _ in range(16)]) for _ in range(3)]
    calls = {c: vectors(rnd, n, centers)[1] for c, n in (("one", 1), ("two", 2), ("many", 16), ("few", 6))}
    rows = [(c, i, v) for c, vs in calls.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "call_id string, seg_idx bigint, embedding array<double>")
    got = {}
    for r in cluster.cluster_speakers(df, k, limit).collect():
        got.setdefault((r.call_id, r.cluster), set()).add(r.seg_idx)
    for c, vs in calls.items():
        assert {frozenset(v) for (call, _), v in got.items() if call == c} == linkage_by_definition(vs, k)


def test_a_batch_of_any_size_holds_whole_calls(spark):
    """Calls that end with a batch, go on in the next one, or fill several; calls with no key."""
    rnd = random.Random(9)
    rows = [(c, i, [rnd.gauss(0, 1) for _ in range(3)]) for c in (1, 2, None, 5, 6, 7) for i in range(rnd.choice([1, 2, 5, 9]))]
    df = spark.createDataFrame(rows, "call_id int, seg_idx int, embedding array<double>")

    def groups(size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            return sorted(map(str, cluster.cluster_speakers(df).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    assert len(groups(10000)) == len(rows)
    assert groups(10000) == groups(1) == groups(4)


def test_short_calls_have_no_task_step_each(spark):
    plan = cluster.cluster_speakers(
        spark.range(50).select(
            F.floor(F.col("id") / 2).alias("call_id"), F.col("id").alias("seg_idx"), F.array(F.lit(1.0)).alias("embedding")
        )
    )._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_diarize_takes_embeddings_from_its_segments(spark):
    """The function is asked once, and the table that it gives is the one that the job uses."""
    frames = spark.createDataFrame([(1, f) for f in range(200) if f % 50 < 40], "call_id bigint, frame bigint")
    totals = spark.createDataFrame([(1, 200)], "call_id bigint, n_frames bigint")
    asked = []

    def embed(segments):
        asked.append(sorted(r.seg_idx for r in segments.collect()))
        return segments.withColumn("embedding", F.array((F.col("seg_idx") % 2).cast("double"), F.lit(0.5)))

    cfg = SegmentConfig(max_segment_ms=1500)
    got = {r.spk_idx: r.speaker for r in jobs.diarize(frames, totals, embed, cfg=cfg).collect()}
    assert asked == [sorted(got)] and len(got) > 2
    assert got == {i: f"SPEAKER_0{i % 2}" for i in got}


def test_relabel_first_seen(spark):
    df = spark.createDataFrame([("c", 0, 7), ("c", 1, 3), ("c", 2, 7)], "call_id string, seg_idx bigint, cluster bigint")
    got = {r.seg_idx: r.speaker for r in cluster.relabel_first_seen(df).collect()}
    assert got == {0: "SPEAKER_00", 1: "SPEAKER_01", 2: "SPEAKER_00"}


def edits_by_table(ref, hyp):
    """Alignment counts from a full distance table, read from its end."""
    while ref and hyp and ref[0] == hyp[0]:
        ref, hyp = ref[1:], hyp[1:]
    while ref and hyp and ref[-1] == hyp[-1]:
        ref, hyp = ref[:-1], hyp[:-1]
    n, m = len(ref), len(hyp)
    d = [[max(i, j) if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    i, j, s, dl, ins = n, m, 0, 0, 0
    while i or j:
        if i and d[i][j] == d[i - 1][j] + 1:
            i, dl = i - 1, dl + 1
        elif j and (not i or d[i][j - 1] < d[i - 1][j - 1]):
            j, ins = j - 1, ins + 1
        else:
            s += d[i][j] != d[i - 1][j - 1]
            i, j = i - 1, j - 1
    return s, dl, ins


def test_word_errors(spark):
    rnd = random.Random(9)
    pairs = [("the cat sat", "the dog sat"), ("Hello, World!", "hello world"), ("", "x"), ("a b", "")]
    for _ in range(150):
        ref = [rnd.choice("abcd") for _ in range(rnd.randint(1, 14))]
        hyp = [w for w in ref if rnd.random() > 0.2] + [rnd.choice("abcd") for _ in range(rnd.randint(0, 4))]
        rnd.random() < 0.3 and rnd.shuffle(hyp)
        pairs.append((" ".join(ref), " ".join(hyp)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "call_id int, reference string, hypothesis string")
    scored = wer.call_wer(df)
    got = {r.call_id: r for r in scored.collect()}
    assert got[0].wer == pytest.approx(1 / 3) and got[0].substitutions == 1 and got[1].wer == 0.0
    assert got[2].wer is None and got[3].deletions == 2
    for i, (ref, hyp) in enumerate(pairs[4:], 4):
        r = got[i]
        assert (r.substitutions, r.deletions, r.insertions) == edits_by_table(ref.split(), hyp.split()), (ref, hyp)
        assert r.hits == len(ref.split()) - r.substitutions - r.deletions
    assert [r.call_id for r in wer.rejected_pairs(scored).collect()] == [2]
    two = scored.filter("call_id < 2")
    assert wer.corpus_wer(two).first().wer == pytest.approx(1 / 5)
    assert wer.worst_calls(scored, 1).first().wer == max(r.wer for r in got.values() if r.wer is not None)


def test_evaluate_asr(spark):
    manifest = spark.createDataFrame([("a", "one two three four"), ("b", "x"), ("c", "")], "call_id string, reference_transcript string")
    segments = spark.createDataFrame([("a", 1, 0, 0, "three for"), ("a", 0, 0, 0, "one two"), ("c", 0, 0, 0, "y")], ASR)
    out = jobs.evaluate_asr(manifest, segments)
    corpus = out["corpus"].first()
    assert (corpus.substitutions, corpus.reference_words, corpus.wer) == (1, 4, 0.25)
    assert [r.call_id for r in out["missing"].collect()] == ["b"] and [r.call_id for r in out["rejected"].collect()] == ["c"]


SEG = "call_id string, speaker string, start_ms bigint, end_ms bigint"


def der_by_ms(ref, hyp):
    span = range(0, max(e for _, _, e in ref + hyp))
    at = [({w for w, s, e in ref if s <= t < e}, {w for w, s, e in hyp if s <= t < e}) for t in span]
    total = sum(len(r) for r, _ in at)
    missed = sum(max(0, len(r) - len(h)) for r, h in at)
    false = sum(max(0, len(h) - len(r)) for r, h in at)
    both = sum(min(len(r), len(h)) for r, h in at)
    rs, hs = sorted({w for w, *_ in ref}), sorted({w for w, *_ in hyp})
    best = 0
    for perm in itertools.permutations(hs + [None] * len(rs), len(rs)):
        m = dict(zip(rs, perm))
        best = max(best, sum(sum(m[w] in h for w in r) for r, h in at))
    return total, missed, false, both - best, best


def test_der_equals_counting_milliseconds(spark):
    rnd, rows_r, rows_h, want = random.Random(6), [], [], {}
    for c in map(str, range(12)):
        def segs(n, names):
            out = []
            for _ in range(n):
                s = rnd.randint(0, 90)
                out.append((rnd.choice(names), s, s + rnd.randint(0, 30)))
            return out
        ref, hyp = segs(6, "ABC") + [("A", 0, 10)], segs(rnd.randint(0, 6), "XYZ")
        rows_r += [(c, *r) for r in ref]
        rows_h += [(c, *h) for h in hyp]
        want[c] = der_by_ms(ref, hyp)
    got = der.der(spark.createDataFrame(rows_r, SEG), spark.createDataFrame(rows_h, SEG)).collect()
    for r in got:
        assert (r.total_ms, r.missed_ms, r.false_alarm_ms, r.confusion_ms, r.correct_ms) == want[r.call_id]
        assert r.der == pytest.approx((r.missed_ms + r.false_alarm_ms + r.confusion_ms) / r.total_ms)
    assert len(got) == 12


def test_der_in_many_tasks_and_bins(spark, monkeypatch):
    """Segments that cross, end at and start at the borders of bins; tasks follow the number of pieces."""
    rnd = random.Random(10)
    edge = align.ALIGN_BIN_MS

    def some(names):
        starts = [edge * rnd.randint(0, 1) + rnd.choice([-30, -7, 0, 5, 20]) for _ in range(6)]
        return [(rnd.choice(names), max(0, s), max(0, s) + rnd.choice([0, 7, 30, 60])) for s in starts]

    calls = {f"c{i}": (some("AB"), some("xyz")) for i in range(8)}
    sides = [
        spark.createDataFrame([(c, *seg) for c, pair in calls.items() for seg in pair[k]], SEG).coalesce(1) for k in (0, 1)
    ]
    monkeypatch.setattr(der, "EDGES_A_TASK", 20)
    pieces = der._speaker_time(*sides)
    tasks = der._by_bin(pieces).rdd.getNumPartitions()
    assert tasks == max(spark.sparkContext.defaultParallelism, -(-2 * pieces.count() // 20)) > 4
    got = {r.call_id: r for r in der.der(*sides).collect()}
    assert set(got) == set(calls)
    for c, pair in calls.items():
        r = got[c]
        assert (r.total_ms, r.missed_ms, r.false_alarm_ms, r.confusion_ms, r.correct_ms) == der_by_ms(*pair), c


def test_tiles_of_one_call_are_in_several_tasks(spark):
    timed = spark.createDataFrame([(1, 0, 7000 * 100000)], "call_id bigint, start_ms bigint, end_ms bigint")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tiles = T.speaker_segments(spark, None, timed).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(r["count"] for r in tiles) == 80000 and len(tiles) > 1


def test_assignment_methods_agree():
    rnd = np.random.default_rng(0)
    for shape in [(3, 3), (2, 5), (5, 2), (6, 9)]:
        m = rnd.integers(0, 50, shape).astype(float)
        wide = m if shape[0] <= shape[1] else m.T
        assert der._best_total(m) == pytest.approx(der._assignment_by_potentials(wide))


def test_clustering_does_not_depend_on_the_limit(spark):
    """Ties included: few distinct vectors, so that many distances are equal."""
    rnd = random.Random(8)
    few = [[rnd.choice([0.0, 1.0]) for _ in range(4)] for _ in range(9)]
    rows = [(c, i, rnd.choice(few)) for c in range(4) for i in range(rnd.randint(30, 60))]
    df = spark.createDataFrame(rows, "call_id int, seg_idx bigint, embedding array<double>")

    def groups(limit):
        found = {}
        for r in cluster.cluster_speakers(df, 2, limit).collect():
            found.setdefault((r.call_id, r.cluster), set()).add(r.seg_idx)
        return sorted((c, sorted(v)) for (c, _), v in found.items())

    assert groups(20) == groups(4000)


def test_corpus_error_rate_takes_in_every_call(spark):
    sf = "/root/testdata/sf0.001"
    row = speech.c7(spark, sf).first()
    heard = wer.join_segments(speech.T.asr_segments(spark, sf)).where("trim(hypothesis) != ''")
    assert row.num_calls == heard.count()


def _texts(draw, n, words=6):
    ref = [f"w{x}" for x in draw.integers(0, words, n)]
    heard = ["um" if draw.random() < 0.1 else w for w in ref if draw.random() > 0.2]
    return " ".join(ref), " ".join(heard)


def test_blocks_align_as_whole_texts_do(spark):
    """Counts of pairs aligned in blocks, in rounds and with growing bands, equal those of one table."""
    draw = np.random.default_rng(7)
    rows = [(i, *_texts(draw, int(draw.integers(1, 60)))) for i in range(8)]
    rows += [(20, " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(9)))]  # nothing in common
    rows += [(21, "x y " * 12 + "z", "y x " * 12), (22, "a b c", "a b c"), (23, None, "a b"), (24, "a b", "")]
    df = spark.createDataFrame(rows, "call_id bigint, reference string, hypothesis string")
    whole = {r.call_id: r for r in wer.call_wer(df).collect()}
    blocks = {r.call_id: r for r in wer.call_wer(df, whole_cells=0, block_words=13).collect()}
    assert whole == blocks


def test_band_leaves_blocks_out_and_grows(spark, monkeypatch):
    draw = np.random.default_rng(8)
    ref, heard = _texts(draw, 160, words=40)
    filled, plain = [], wavefront._diagonal
    monkeypatch.setattr(wavefront, "_diagonal", lambda *a: filled.append(plain(*a).count()) or plain(*a))
    df = spark.createDataFrame([(1, ref.split(), heard.split())], "pair bigint, ref array<string>, hyp array<string>")
    row = wavefront.align_long(df, 10).first()
    want = wer._batch_edits(*[[np.array([hash(w) for w in words])] for words in (ref.split(), heard.split())])[0]
    assert (row.distance, row.insertions) == (sum(want), want[2])
    assert sum(filled) < 16 * -(-len(heard.split()) // 10)


def test_trimmed_arrays(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c"]), (["a"], ["a"]), ([], ["a"]), (["a", "a"], ["a"])]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    got = df.select(*[c.alias(n) for c, n in zip(wavefront.trimmed(F.col("r"), F.col("h")), "rh")]).collect()
    assert [(r.r, r.h) for r in got] == [(["b"], ["x"]), ([], []), ([], ["a"]), (["a"], [])]


def test_words_of_a_few_pairs_exist_at_a_time(monkeypatch):
    """Batches of any size give the same edits; the words come as one cell each."""
    import pandas as pd

    draw = random.Random(5)
    texts = [[" ".join(draw.choices("abcd", k=draw.randint(0, 9))) for _ in range(2)] for _ in range(40)]
    ref, hyp = (pd.Series([t[i] for t in texts]) for i in (0, 1))
    whole = wer._word_edits(ref, hyp)
    monkeypatch.setattr(wer, "PAIRS", 7)
    pd.testing.assert_frame_equal(wer._word_edits(ref, hyp), whole)
    assert (whole["hits"] + whole["substitutions"] + whole["deletions"]).tolist() == [len(r.split()) for r in ref]
