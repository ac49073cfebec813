"""Language of transcripts: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import DRAW_BITS, draw, short_batches
from callweave.session import settle

UNDETERMINED = "und"
LONGEST_GRAM = 5
# what a missing count stands for
SMOOTHING = 0.5
# the words of a worker that are kept with their scores before it starts anew
MEMO_WORDS = 200_000


@dataclass
class LanguageModel:
    """Log frequencies: a row of `scores` for each word or n-gram, a column for each language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray


def fit_language_model(
    calls: DataFrame,
    key: str = "call_id",
    text: str = "text",
    language: str = "language",
    texts_per_language: int = 3000,
    words_per_language: int = 50_000,
    grams_per_length: int = 20_000,
    seed: int = 0,
) -> LanguageModel:
    """Counts words and character n-grams of 1 to 5 letters per language.

    The model is fitted on a bounded sample: about `texts_per_language` whole
    transcripts of each language, drawn by their key, of which the most frequent
    words and n-grams are kept. So what comes to the driver is bounded by the
    parameters times the number of languages. Rows without text or language teach
    nothing; without any row the model knows no language.

    An n-gram counts as often as the words that hold it; word edges are part of it.
    """
    labelled = calls.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(
        F.col(text).alias("_text"), F.col(language).alias("_language"), draw(key, seed).alias("_draw")
    )
    sizes = settle(labelled.groupBy("_language").agg(F.count("*").alias("_n")))
    sample = labelled.join(sizes, "_language").where(
        F.col("_draw") / F.lit(float(2**DRAW_BITS)) * F.col("_n") < texts_per_language
    )
    words = F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), F.lit(0)))
    counts = settle(sample.select("_language", words.alias("_part")).groupBy("_language", "_part").agg(F.count("*").alias("_n")))

    edged = F.concat(F.lit(" "), F.col("_part"), F.lit(" "))
    width = F.explode(F.sequence(F.lit(1), F.lit(LONGEST_GRAM))).alias("_width")
    wide = counts.select("_language", "_n", edged.alias("_word"), width).where(F.length("_word") >= F.col("_width"))
    start = F.explode(F.sequence(F.lit(1), F.length("_word") - F.col("_width") + 1))
    grams = (
        wide.select("_language", "_n", "_word", "_width", start.alias("_start"))
        .select("_language", "_width", "_n", F.col("_word").substr(F.col("_start"), F.col("_width")).alias("_part"))
        .where("_part != ' '")
        .groupBy("_language", "_width", "_part")
        .agg(F.sum("_n").alias("_n"))
    )
    languages = [r[0] for r in sizes.orderBy("_language").select("_language").collect()]
    return _model(languages, _most(counts, ["_language"], words_per_language), _most(grams, ["_language", "_width"], grams_per_length))


def _most(counts: DataFrame, group: list[str], n: int) -> list[tuple[str, str, int]]:
    """The n most frequent parts of each group."""
    order = Window.partitionBy(*group).orderBy(F.desc("_n"), "_part")
    top = counts.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
    return [tuple(r) for r in top.select("_language", "_part", "_n").collect()]


def _model(languages: list[str], words: list, grams: list) -> LanguageModel:
    column = {name: j for j, name in enumerate(languages)}
    tables, blocks, first = [], [], 0
    for parts in (words, grams):
        index: dict[str, int] = {}
        for _, part, _ in parts:
            index.setdefault(part, first + len(index))
        counts = np.full((len(index), len(languages)), SMOOTHING)
        for name, part, n in parts:
            counts[index[part] - first, column[name]] += n
        blocks.append(counts)
        tables.append(index)
        first += len(index)
    word_counts, gram_counts = blocks
    if len(word_counts):
        word_counts = np.log(word_counts / word_counts.sum(axis=0))
    # each length of n-gram has a total of its own
    widths = np.array([len(g) for g in tables[1]])
    for w in np.unique(widths):
        rows = widths == w
        gram_counts[rows] = np.log(gram_counts[rows] / gram_counts[rows].sum(axis=0))
    return LanguageModel(languages, tables[0], tables[1], np.concatenate([word_counts, gram_counts]))


def identify_language(calls: DataFrame, model: LanguageModel, key: str = "call_id", text: str = "text") -> DataFrame:
    """The most likely language of each whole transcript.

    A known word scores its log frequency in each language. An unknown one is cut
    into its n-grams of 5 letters; if the model knows none of them, of 4, and so on
    down to single letters, and the mean of the known ones is its score. The sum
    over all words decides, the first language in code point order on a tie.

    Returns `key`, language and score, the probability of that language. Other
    columns are not read. `und` with score 0 stands for a null text, a text
    without letters and a model without languages. A text of letters that the
    model has never seen gets the first language, with one part in all languages
    as score. An empty table gives an empty result.
    """
    shared = calls.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = WordScores(shared.value)
        for texts in batches:
            found = [scorer.judge(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["language", "score"]
            )

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judged = F.arrow_udf(predict, "struct<language: string, score: double>")
    return short_batches(calls).select(F.col(key), judged(F.col(text)).alias("_judged")).select(key, "_judged.*")


class WordScores(dict):
    """Row of scores for each word; rows of unknown words are made when met and kept for a while."""

    letters = re.compile(r"[^\W\d_]+")

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        """Back to the known words."""
        self.clear()
        self.update(self.model.words)
        self.used = len(self.model.scores)
        self.rows = np.concatenate([self.model.scores, np.zeros((1024, len(self.model.languages)))])

    def __missing__(self, word: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        row = self.used
        self.rows[row] = self.backed_off(word)
        self.used += 1
        self[word] = row
        return row

    def backed_off(self, word: str) -> np.ndarray | float:
        edged, known = f" {word} ", self.model.grams
        for width in range(min(LONGEST_GRAM, len(edged)), 0, -1):
            rows = [known[g] for i in range(len(edged) - width + 1) if (g := edged[i : i + width]) in known]
            if rows:
                return self.model.scores[rows].mean(axis=0)
        return 0.0

    def judge(self, text: str | None) -> tuple[str, float]:
        languages = self.model.languages
        words = self.letters.findall(text.lower()) if text and languages else []
        if not words or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        if self.used - len(self.model.scores) > MEMO_WORDS:
            self.forget()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = self.rows[rows].sum(axis=0)
        best = int(total.argmax())
        return languages[best], float(1 / np.exp(total - total[best]).sum())
