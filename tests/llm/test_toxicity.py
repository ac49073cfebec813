import random

import pytest
from pyspark.sql import functions as F

from callweave.llm import queries, toxicity
from callweave.llm.toxicity import Entry, LexiconAutomaton, ToxicityModel

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(40)})
    entries = [Entry(t, False, 1.0) for t in terms]
    automaton = LexiconAutomaton(entries)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        near = [d for e in entries if (d := distance(word, e.term)) <= e.edits]
        found = automaton.find(word)
        assert (found is None) == (not near)
        if found:
            assert found[1] == min(near) == distance(word, entries[found[0]].term)


def test_stems_and_exact_words_come_first():
    automaton = LexiconAutomaton([Entry("idiot", False, 3.0), Entry("idio", True, 2.0), Entry("stupid", False, 1.0)])
    assert automaton.find("idiot") == (0, 0)
    assert automaton.find("idiocy") == (1, 0)
    assert automaton.find("stupd") == (2, 1) and automaton.find("stu9id") == (2, 1) and automaton.find("sstupid") == (2, 1)
    assert automaton.find("stupidity") is None and automaton.find("") is None


def test_stems_are_found_misspelt():
    automaton = LexiconAutomaton([Entry("idio", True, 3.0), Entry("scum", False, 2.0), Entry("disgustin", True, 1.0)])
    for word in ("iddiot", "idoit", "idjots", "udiotic", "iddio"):
        assert automaton.find(word) == (0, 1)
    assert automaton.find("scuum") == (1, 1) and automaton.find("skum") == (1, 1) and automaton.find("scum") == (1, 0)
    assert automaton.find("disgustin") == (2, 0) and automaton.find("dizgustng") == (2, 2)
    # too short for a longer word with an edit
    assert automaton.find("ido") is None and automaton.find("idio") == (0, 0)


def test_stems_equal_the_distance_of_the_nearest_beginning():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(6)})
    for term in terms:
        automaton = LexiconAutomaton([entry := Entry(term, True, 1.0)])
        for _ in range(500):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
            near = min(distance(word[:k], term) for k in range(len(word) + 1))
            found = automaton.find(word)
            if near == 0 or (near <= entry.edits and len(word) > len(term) - near):
                assert found == (0, near)
            else:
                assert found is None


def test_quotation_counts_less():
    model = ToxicityModel([Entry("moron", False, 4.0, 2.0)])
    reader = toxicity.ContextReader(model)
    plain, _, hits, quoted = reader.read("you are a Moron, sir")
    assert (hits, quoted) == (1, 0) and plain[3] == 4.0
    held, _, hits, quoted = reader.read('he said "you are a moron" to them')
    assert (hits, quoted) == (1, 1) and held[3] == 1.0
    assert reader.read("a m0ron")[0][3] == 2.0
    # marks that close in another line or not at all quote nothing, a long quotation is one
    assert reader.read('he said "moron\n" then')[3] == 0 and reader.read('he said "moron')[3] == 0
    assert reader.read('"' + "x " * 400 + 'moron"')[3] == 1
    # inches are no marks
    assert reader.read('a 5" screen, you moron, and a 7" one')[3] == 0 and reader.read("«moron» 3»")[3] == 1


def test_quotations_equal_a_walk_over_all_marks():
    def walk(text):
        out, i = [], 0
        while i < len(text):
            close = toxicity.QUOTES.get(text[i])
            if close and not (i and text[i - 1].isalnum()):
                stop = (text + "\n").index("\n", i)
                ends = [j for j in range(i + 1, stop) if text[j] == close and not text[j + 1 : j + 2].isalnum()]
                if ends:
                    out.append((i, ends[0] + 1))
                    i = ends[0]
            i += 1
        return out

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice('ab "“”„«»\n‘’') for _ in range(rng.randint(0, 40)))
        assert toxicity.quoted_chars(text) == walk(text)


def test_all_terms_with_evidence_are_entries(spark, calls):
    """A lexicon of 600 unlike words, each in many toxic texts and in no clean one."""
    rng = random.Random(8)
    terms = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(600)})
    rows = [(i, " ".join(terms[k % len(terms)] for k in range(i * 37, i * 37 + 60)) + " and so on") for i in range(600)]
    rows += [(i, " ".join(f"fine{rng.randrange(50)}" for _ in range(60)) + " and so on") for i in range(600, 1200)]
    model = toxicity.fit_toxicity(calls(rows), spark.createDataFrame([(i, int(i < 600)) for i in range(1200)], "call_id bigint, toxic int"))
    found = [e.term for e in model.entries]
    assert len(found) == len(set(found)) and all(sum(t.startswith(f) for f in found) == 1 for t in terms)


def test_kept_rows_keep_columns_with_inner_names(spark, calls):
    df = calls([(1, "good day")]).withColumn("_found", F.lit("mine"))
    assert [r._found for r in toxicity.keep_civil(df, ToxicityModel(coefficients=[-10.0] + [0.0] * 5)).collect()] == ["mine"]


def test_window_finds_the_densest_stretch():
    reader = toxicity.ContextReader(ToxicityModel([Entry("moron", False, 1.0, 1.0)]))
    near = reader.read("moron " * 3 + "word " * 300)[0]
    far = reader.read(("moron " + "word " * 100) * 3)[0]
    assert near[0] == pytest.approx(far[0]) and near[2] > far[2]


def labelled(spark, calls, n=400):
    rng = random.Random(2)
    words = ["".join(rng.choice("abdefghiklmnprstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["wretch", "villain", "scoundrel"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return calls(rows), spark.createDataFrame(labels, "call_id bigint, toxic int")


def test_learned_lexicon_and_scores(spark, calls):
    df, labels = labelled(spark, calls)
    model = toxicity.fit_toxicity(df, labels)
    assert {"wretch", "villain", "scoundrel"} <= {e.term for e in model.entries}
    probes = [(1, "good day"), (2, "you wretch and villain"), (3, "you wretsh and vilain"), (4, None), (5, ""), (5, ""), (None, "scoundrel " * 9000)]
    out = toxicity.score_toxicity(calls(probes).withColumn("score", F.lit("clash")), model).collect()
    got = {r.call_id: r for r in out}
    assert len(out) == len(probes) and all(0 <= r.score <= 1 for r in out)
    assert [got[k].predicted for k in (1, 2, 3, 4, 5, None)] == [0, 1, 1, 0, 0, 1]
    assert got[3].n_hits == 2
    kept = toxicity.keep_civil(calls(probes), model)
    assert sorted(r.call_id for r in kept.collect()) == [1, 4, 5, 5]
    assert toxicity.score_toxicity(calls([]), model).collect() == []


def test_misspelt_forms_of_a_learned_stem(spark, calls):
    rng = random.Random(4)
    words = ["".join(rng.choice("abefghklmnprtu") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(400)]
    rows = [(i, t + (f" you {rng.choice(['idiot', 'idiots'])} and scum" if i % 5 == 0 else " slum")) for i, t in rows]
    model = toxicity.fit_toxicity(calls(rows), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "call_id bigint, toxic int"))
    assert ("scum", False) in {(e.term, e.stem) for e in model.entries} and any(e.stem and "idiots".startswith(e.term) for e in model.entries)
    reader = toxicity.ContextReader(model)
    for text in ("idoit", "an iddiot", "idjots", "scumm", "skum"):
        assert reader.read(text)[2] == 1
    # a word of clean texts is no misspelling of its neighbour
    assert reader.read("slum")[2] == 0


def test_one_label_or_none(spark, calls):
    df = calls([(1, "a"), (2, "b")])
    for labels, low in (([], True), ([(1, 0)], True), ([(1, 1), (2, 1)], False), ([(1, None)], True), ([(9, 1), (8, 0)], None)):
        model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, "call_id bigint, toxic int"))
        scores = [r.score for r in toxicity.score_toxicity(df, model).collect()]
        assert len(set(scores)) == 1 and (low is None or (scores[0] < 0.3) == low)


def test_held_out_recall_and_precision(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op7_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.toxic == 1 and r.predicted == 1 for r in rows)
    assert hits / sum(r.toxic == 1 for r in rows) > 0.85 and hits / sum(r.predicted for r in rows) > 0.8
