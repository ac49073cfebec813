"""Toxic transcripts: a learned lexicon, found with its misspellings, weighed by context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import DRAW_BITS, WORD, draw, free_name, short_batches
from callweave.session import settle

# Shortest and longest word beginnings that may be entries, in letters.
STEM_LENGTHS = (4, 9)
# Entries are in this many toxic texts and this much more frequent there.
LEAST_TEXTS, LEAST_RATIO = 3, 5.0
# Letters from which an entry is also found with 1 and 2 edits.
EDIT_LENGTHS = (5, 9)
# Entries of so many letters are found with one edit as well, as are stems of any length.
SHORT_LENGTH = 4
# What a misspelt and a quoted mention count, as parts of a plain one.
MISSPELT, QUOTED = 0.7, 0.25
WINDOW_WORDS = 64
# Opening marks and what closes them.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
MEMO_WORDS = 200_000
THRESHOLD = 0.3


@dataclass
class Entry:
    """A term of the lexicon; a stem stands for all words that begin with it."""

    term: str
    stem: bool
    weight: float
    misspelt: float = 0.0
    # near words that clean texts show to be words of their own
    others: frozenset[str] = frozenset()

    @property
    def edits(self) -> int:
        edits = sum(len(self.term) >= n for n in EDIT_LENGTHS)
        return max(edits, 1) if len(self.term) >= SHORT_LENGTH else edits


@dataclass
class ToxicityModel:
    entries: list[Entry] = field(default_factory=list)
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))


FEATURES = ["sum", "density", "window", "largest", "length"]


def fit_toxicity(
    calls: DataFrame,
    labels: DataFrame,
    key: str = "call_id",
    text: str = "text",
    label: str = "toxic",
    texts_per_label: int = 4000,
    seed: int = 0,
) -> ToxicityModel:
    """Learns the lexicon and the weights of the features.

    Fitted on a bounded sample: about `texts_per_label` labelled transcripts of
    each label, drawn by key and then weighted as the whole. Words and word
    beginnings that toxic texts hold far more often become entries, so the driver
    sees at most the entries, the sample's own words that are spelt almost like one,
    and one row of features per sampled transcript. Rows
    without text, key or label teach nothing; with one label only, the model scores
    every text alike.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"), draw(key, seed).alias("_draw"))
    # labels of other tables' transcripts say nothing about these
    known = settle(known.join(calls.where(F.col(text).isNotNull()).select(F.col(key).alias("_key")), "_key", "left_semi"))
    sizes = {r[0]: r[1] for r in known.groupBy("_label").agg(F.count("*")).collect()}
    if not all(sizes.get(v) for v in (0, 1)):
        rate = 0.0 if not sizes else float(1 in sizes)
        return ToxicityModel(coefficients=np.array([20.0 * rate - 10.0 if sizes else -10.0] + [0.0] * len(FEATURES)))
    part = F.col("_draw") / F.lit(float(2**DRAW_BITS))
    chosen = [(F.col("_label") == v) & (part * F.lit(sizes[v]) < texts_per_label) for v in (0, 1)]
    # bounded by the parameter, so it may be sent to every executor
    drawn = F.broadcast(settle(known.where(chosen[0] | chosen[1]).select("_key", "_label")))
    texts = calls.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    sample = settle(texts.join(drawn, "_key"))

    # a word counts once per text, so that one long text can't make an entry
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)), _bare))
    counts = settle(
        sample.select("_label", F.explode(words).alias("_word"))
        .where("_word != ''")
        .groupBy("_word")
        .agg(F.sum("_label").alias("_toxic"), F.sum(1 - F.col("_label")).alias("_clean"))
    )
    entries = _lexicon(counts)
    _weigh_misspelt(counts, entries)

    model = ToxicityModel(entries)
    rows = _features(sample, model).collect()
    if not rows:
        return model
    x = np.array([r[2] for r in rows])
    y = np.array([r[1] for r in rows], float)
    found = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.where(y == 1, sizes[1] / found[1], sizes[0] / found[0])
    model.coefficients = logistic(x, y, weight * len(y) / weight.sum())
    return model


def _bare(word: Column) -> Column:
    """A word without the marks around it."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _lexicon(counts: DataFrame) -> list[Entry]:
    """Whole words and stems by evidence; one that overlaps with a better one is left out.

    All with enough evidence are entries. They are terms of the fitted sample, so its parameter bounds them.
    """
    totals = counts.agg(F.sum("_toxic"), F.sum("_clean")).first()
    if not totals[0]:
        return []
    longest = F.least(F.lit(STEM_LENGTHS[1]), F.length("_word") - 1)
    width = F.explode(F.sequence(F.lit(STEM_LENGTHS[0]), longest))
    stems = (
        counts.where(F.length("_word") > STEM_LENGTHS[0])
        .select("_toxic", "_clean", "_word", width.alias("_width"))
        .groupBy(F.substring("_word", F.lit(1), F.col("_width")).alias("_term"))
        .agg(F.sum("_toxic").alias("_toxic"), F.sum("_clean").alias("_clean"))
        .withColumn("_stem", F.lit(True))
    )
    whole = counts.where(F.length("_word") >= 3).select(F.col("_word").alias("_term"), "_toxic", "_clean", F.lit(False).alias("_stem"))
    a, b = F.col("_toxic"), F.col("_clean")
    share = F.lit(float(totals[0]) / float(totals[0] + (totals[1] or 0)))
    both = a + b
    evidence = 2 * (a * F.log(a / (both * share)) + F.when(b > 0, b * F.log(b / (both * (1 - share)))).otherwise(0.0))
    weight = F.log((a + 0.5) / (b + 0.5) * (1 - share) / share)
    candidates = settle(
        stems.unionByName(whole)
        .where(a >= LEAST_TEXTS)
        .select("_term", "_stem", evidence.alias("_evidence"), weight.alias("_weight"))
    )
    # of n terms without any meaning, about one has a log-likelihood ratio above 2 log n
    least = 2 * float(np.log(max(2, candidates.count())))
    ranked = (
        candidates.where((F.col("_weight") >= float(np.log(LEAST_RATIO))) & (F.col("_evidence") >= least))
        # of equal evidence, a whole word says more than its beginnings, a long beginning more than a short one
        .orderBy(F.desc(F.round("_evidence", 6)), "_stem", F.desc(F.length("_term")), "_term")
    )
    chosen: list[Entry] = []
    stems_chosen, beginnings = set(), set()
    for term, stem, _, weight_ in ranked.collect():
        begun = {term[:n] for n in range(1, len(term) + 1)}
        if not begun & stems_chosen and not (stem and term in beginnings):
            chosen.append(Entry(term, stem, float(weight_)))
            beginnings |= begun
            if stem:
                stems_chosen.add(term)
    return chosen


def _weigh_misspelt(counts: DataFrame, entries: list[Entry]) -> None:
    """Near misses count less than the term, and little where clean texts hold them as well.

    A near word that clean texts hold so often that it would count nothing by itself is
    another word and no mention; it does not speak against the misspelt ones.
    """
    shared = counts.sparkSession.sparkContext.broadcast(entries)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(shared.value)
        for batch in batches:
            hits = [automaton.find(w) for w in batch.column(0).to_pylist()]
            keep = [i for i, h in enumerate(hits) if h is not None and h[1] > 0]
            part = batch.take(pa.array(keep, pa.int64()))
            found = [hits[i][0] for i in keep]
            own = [
                _misspelt_weight(shared.value[e].weight, a, c) == 0.0
                for e, a, c in zip(found, part.column(1).to_pylist(), part.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(own, pa.bool_()), *part.columns], names=["_entry", "_own", "_word", "_toxic", "_clean"]
            )

    seen = counts.select("_word", "_toxic", "_clean").mapInArrow(near, "_entry int, _own boolean, _word string, _toxic bigint, _clean bigint")
    seen = settle(seen)
    others: dict[int, set[str]] = {}
    for i, word in seen.where("_own").select("_entry", "_word").collect():
        others.setdefault(i, set()).add(word)
    sums = {r[0]: r[1:] for r in seen.where("NOT _own").groupBy("_entry").agg(F.sum("_toxic"), F.sum("_clean")).collect()}
    for i, entry in enumerate(entries):
        entry.misspelt = MISSPELT * _misspelt_weight(entry.weight, *sums.get(i, (0, 0)))
        entry.others = frozenset(others.get(i, ()))


def _misspelt_weight(weight: float, toxic: int, clean: int) -> float:
    """What is left of an entry's weight for words that so many toxic and clean texts hold."""
    doubt = float(np.log((clean + 1.0) / (toxic + 1.0)))
    return max(0.0, weight - max(0.0, 2 * doubt))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps, the constant first."""
    z = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-9] + [ridge] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (y - p)) - penalty @ beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _features(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    return sample.select("_key", "_label", mentions(sample, F.col("_text"), model)["features"])


def mentions(calls: DataFrame, text: Column, model: ToxicityModel) -> Column:
    """Struct of features, score, n_hits and n_quoted of a text."""
    shared = short_batches(calls).sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = ContextReader(shared.value)
        for texts in batches:
            found = [reader.read(t.as_py() or "") for t in texts]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.list_(pa.float64())),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([f[3] for f in found], pa.int64()),
                ],
                names=["features", "score", "n_hits", "n_quoted"],
            )

    scan.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, "struct<features: array<double>, score: double, n_hits: bigint, n_quoted: bigint>")(text)


def score_toxicity(calls: DataFrame, model: ToxicityModel, key: str = "call_id", text: str = "text") -> DataFrame:
    """The probability that a whole transcript is labelled toxic.

    Each word runs through a Levenshtein automaton intersected with the trie of
    the lexicon, whole words and stems alike. A mention counts its entry's weight, less if it is misspelt, less
    if it stands in quotation marks that close in the same line. The
    features are the sum of all mentions, their density, the largest sum in a
    window of 64 words, the largest single mention and the length.

    Returns `key`, score (0 to 1), predicted (1 if score >= 0.3), n_hits and
    n_quoted. Other columns are not read. A null text counts as an empty one and
    gets the score of a text without mentions; an empty table gives an empty result.
    """
    scanned = calls.select(F.col(key), mentions(calls, F.col(text), model).alias("_found"))
    predicted = (F.col("_found.score") >= THRESHOLD).cast("int").alias("predicted")
    return scanned.select(key, "_found.score", predicted, "_found.n_hits", "_found.n_quoted")


def keep_civil(calls: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    found = free_name(calls, "_found")
    scanned = calls.withColumn(found, mentions(calls, F.col(text), model))
    return scanned.where(F.col(f"{found}.score") < THRESHOLD).drop(found)


class LexiconAutomaton:
    """The Levenshtein automaton of a word run along the trie of all entries.

    A state is the set of (trie node, edits so far) that the letters read can have
    reached; states and steps are made when a word first needs them. Most words
    leave the trie after a few letters.
    """

    DEAD = 0

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0]  # most edits that an entry at or below the node may have
        for i, entry in enumerate(entries):
            node = 0
            self.allowed[0] = max(self.allowed[0], entry.edits)
            for letter in entry.term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], entry.edits)
            self.ends[node].append(i)
        self.numbers: dict[frozenset, int] = {frozenset(): self.DEAD}
        self.states: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.finals: list[tuple[int, int] | None] = [None]
        self.stems: list[tuple[int, int] | None] = [None]
        self.start = self._number({(0, 0)})

    def _number(self, reached: set[tuple[int, int]]) -> int:
        # a letter of the entry may be missing in the word
        todo = list(reached)
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                nxt = (child, edits + 1)
                if edits < self.allowed[child] and nxt not in reached:
                    reached.add(nxt)
                    todo.append(nxt)
        state = frozenset(reached)
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            for stem, best in ((False, self.finals), (True, self.stems)):
                ends = [
                    (e, -self.entries[i].misspelt, -self.entries[i].weight, i)
                    for n, e in state for i in self.ends[n] if e <= self.entries[i].edits and self.entries[i].stem == stem
                ]
                best.append((min(ends)[3], min(ends)[0]) if ends else None)
        return self.numbers[state]

    def _step(self, state: int, letter: str) -> int:
        reached = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(letter)
            if child is not None and edits <= self.allowed[child]:
                reached.add((child, edits))
            if edits < self.allowed[node]:
                reached.add((node, edits + 1))  # a letter too many
            for child in self.children[node].values():
                if edits < self.allowed[child]:
                    reached.add((child, edits + 1))  # another letter
        self.steps[state][letter] = number = self._number(reached) if reached else self.DEAD
        return number

    def find(self, word: str) -> tuple[int, int] | None:
        """Entry and edits of the best match of a whole word: by the fewest edits, of equal ones by the whole word, then by its beginning.

        A stem is met by any beginning of the word within its edits. A word of fewer letters than
        a longer word can have after that many edits is none of the stem's.
        """
        state, stem = self.start, None
        for letter in word:
            state = self.steps[state][letter] if letter in self.steps[state] else self._step(state, letter)
            if state == self.DEAD:
                break
            met = self.stems[state]
            if met is not None and met[1] and len(word) <= len(self.entries[met[0]].term) - met[1]:
                met = None
            if met is not None and (stem is None or met[1] < stem[1] or met[1] == stem[1] == 0):
                stem = met
        final = self.finals[state]
        if stem is not None and (final is None or final[1] > stem[1]):
            return stem
        return final


class ContextReader(dict):
    """Remembers for words of a worker what they mention; the value is an index into `weights`, 0 for nothing."""

    find_words = re.compile(WORD)
    edge = re.compile(r"^[\W_]+|[\W_]+$")

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model
        self.automaton = LexiconAutomaton(model.entries)
        plain, near = [e.weight for e in model.entries], [e.misspelt for e in model.entries]
        self.weights = np.array([0.0, *plain, *near])

    def __missing__(self, word: str) -> int:
        bare = self.edge.sub("", word)
        hit, kind = self.automaton.find(bare), 0
        if hit is not None and not hit[1]:
            kind = 1 + hit[0]
        elif hit is not None and bare not in self.model.entries[hit[0]].others and self.model.entries[hit[0]].misspelt > 0:
            kind = 1 + hit[0] + len(self.model.entries)
        self[word] = kind
        return kind

    def read(self, text: str) -> tuple[list[float], float, int, int]:
        if len(self) > MEMO_WORDS:
            self.clear()
        lowered = text.lower()
        words = self.find_words.findall(lowered)
        kinds = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(kinds)
        weight, quoted = self.weights[kinds[at]], 0
        if len(at):
            inside = quoted_chars(lowered)
            if inside:
                starts = [m.start() for m in self.find_words.finditer(lowered)]
                marked = np.array([any(a <= starts[i] < b or a <= starts[i] + len(words[i]) // 2 < b for a, b in inside) for i in at])
                weight, quoted = np.where(marked, QUOTED * weight, weight), int(marked.sum())
        total = float(weight.sum())
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        window = sums[1:] - sums[np.searchsorted(at, at - WINDOW_WORDS + 1)] if len(at) else np.zeros(1)
        features = [
            float(np.log1p(total)),
            float(np.log1p(100 * total / max(1, len(words)))),
            float(np.log1p(window.max())),
            float(weight.max(initial=0.0)),
            float(np.log1p(len(words))),
        ]
        beta = self.model.coefficients
        logit = float(beta[0] + np.dot(beta[1:], features))
        return features, float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))), len(at), quoted


def quoted_chars(text: str) -> list[tuple[int, int]]:
    """Stretches between quotation marks of one line, of any length.

    A mark after a letter or digit opens nothing, one before a letter or digit closes nothing, and a mark that is not
    closed in its line quotes nothing. The plain `'` is no quotation mark.
    """
    found, i, line_end = [], 0, -1
    unclosed: set[str] = set()
    for at in (m.start() for m in re.finditer("[" + "".join(QUOTES) + "]", text)):
        if at < i or text[at - 1 : at].isalnum():
            continue
        if at > line_end:
            line_end = text.find("\n", at)
            line_end = len(text) if line_end < 0 else line_end
            unclosed.clear()
        closing = QUOTES[text[at]]
        if closing in unclosed:
            continue
        end = text.find(closing, at + 1, line_end)
        while end >= 0 and text[end + 1 : end + 2].isalnum():
            end = text.find(closing, end + 1, line_end)
        if end < 0:
            unclosed.add(closing)
        else:
            found.append((at, end + 1))
            i = end + 1
    return found
