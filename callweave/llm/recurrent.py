"""Log-likelihood of transcripts under a gated recurrent language model with a class-factored softmax."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.session import settle

# Tokens outside the vocabulary; the end of a text is a class of its own, and what stands before its first word.
_END, _RARE = 0, 1
_FIRST_WORD = 2

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SLICE_BYTES = 1 << 20
_HELD_WORDS = 250_000
_OUT_ROWS = 50_000
# Tokens a task holds as numbers before it runs them.
_HELD_TOKENS = 1 << 21
# Parameters travel in pieces of so many numbers.
_PIECE = 1024


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; none of them grows with the corpus."""

    vocabulary: int = 65_536  # most frequent words with an own number
    own_vectors: int = 512  # of these, words that the network sees and tells apart itself
    own_classes: int = 24
    other_classes: int = 38
    anchors: int = 16  # most frequent words, by which texts and then words are told apart
    hidden: int = 16
    lanes: int = 512  # texts read side by side, at most
    window: int = 32  # steps of truncated backpropagation
    rounds: int = 3  # times the copies of the model are averaged
    rate: float = 0.08


@dataclass(frozen=True)
class Vocabulary:
    """Words by falling count, the sums of the whole corpus, and the class of each word."""

    words: list[bytes]
    counts: np.ndarray
    n_own: int
    n_tokens: int
    n_words: int
    n_ends: int
    class_of: np.ndarray | None = None
    n_classes: int = 0

    @property
    def rare_total(self) -> int:
        """Tokens and words outside the vocabulary, and one for words never seen."""
        tokens = self.n_tokens - int(self.counts.sum()) - self.n_ends
        return tokens + self.n_words - len(self.words) - (self.n_ends > 0) + 1


def score_transcripts(calls: DataFrame, learn: Column, key: str = "call_id", shape: Shape = Shape()) -> DataFrame:
    """Scores every whole transcript; learns from those where `learn` is true (null: not).

    `calls` has `key` and `text` (null: empty). A-Z are lower-cased; tokens are what ASCII white space separates, then one end. Returns
    per transcript: key, learned, n_tokens, n_known (tokens that the learned texts hold), train_tokens, base_score (log10 of
    unigram probabilities with one added) and score (log10 probability by the model). Repeated rows are scored each; an empty
    table gives no rows; without learned texts both scores rest on the words never seen. Other columns are not kept.

    The counts of all words of all learned texts are a table; the `vocabulary` most frequent words go to every task.
    A gated recurrent unit reads the words and gives the odds of the next token's class; within a class the first `own_vectors`
    words have a softmax over the hidden state, the others their share of the class's count. Words outside the vocabulary are
    one class; their share is joined from the table of counts, and their part of the score does not depend on the place.

    Learning passes over every learned text once, by truncated backpropagation in windows: each task trains a copy of the
    model on its texts of a round, and the copies are averaged by tokens. A text is scored from its first to its last token with the
    state carried from window to window. The result depends on how the rows are dealt to tasks, not on the order of tasks.
    """
    marked = calls.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    counts = settle(_word_counts(marked.where("learned")))
    vocabulary = _vocabulary(counts, shape)
    encoded = settle(_encode(marked, vocabulary))
    company = _company(encoded.where("learned"), len(vocabulary.words), shape)
    vocabulary = with_classes(vocabulary, company, shape)
    model = _train(encoded.where("learned"), vocabulary, shape)
    scored = _score(encoded, vocabulary, shape, model)
    rare = _rare_words(encoded, counts, vocabulary)
    unseen = math.log10(vocabulary.n_tokens + vocabulary.n_words + 1)
    zero = F.lit(0.0)
    return scored.join(rare, "row", "left").select(
        F.col("key").alias(key), "learned", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(vocabulary.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") + F.coalesce("rare_log", zero) - F.col("n_tokens") * F.lit(unseen)).alias("base_score"),
        (F.col("model_log") + F.coalesce("rare_log", zero) - F.coalesce("rare_n", F.lit(0)) * F.lit(math.log10(vocabulary.rare_total))).alias("score"),
    )


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time."""
    lowered = text.lower()
    start = 0
    while start < len(lowered):
        cut = _SPACE.search(lowered, start + _SLICE_BYTES)
        end = cut.start() if cut else len(lowered)
        yield lowered[start:end].split()
        start = end


def _word_counts(learned: DataFrame) -> DataFrame:
    """Occurrences of each word; the end of a text is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                for words in _words(text.as_py()):
                    held.update(words)
                    if len(held) >= _HELD_WORDS:
                        yield from hand_over(held)
                        held.clear()
            held[b""] += batch.num_rows
        yield from hand_over(held)

    def hand_over(held: Counter) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for start in range(0, len(words), _OUT_ROWS):
            part = words[start : start + _OUT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"]
            )

    return learned.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    sums = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    # only words of the count classes that can be among the first leave their tasks
    named = counts.where(F.length("word") > 0)
    height = F.floor(F.log2("n") * 8)
    least, room = 0, shape.vocabulary
    for row in sorted(named.groupBy(height.alias("height")).count().collect(), key=lambda r: -r["height"]):
        least, room = row["height"], room - row["count"]
        if room <= 0:
            break
    top = named.where(height >= least).orderBy(F.desc("n"), "word").limit(shape.vocabulary).collect()
    numbers = np.array([r["n"] for r in top], np.int64)
    return Vocabulary([bytes(r["word"]) for r in top], numbers, min(shape.own_vectors, len(top)), sums[0] or 0, sums[1], sums[2] or 0)


def with_classes(vocabulary: Vocabulary, company: np.ndarray, shape: Shape) -> Vocabulary:
    """Sorts words in classes of equal sums of square roots of counts, each of words that keep the same company."""
    class_of = np.zeros(len(vocabulary.words), np.int64)
    first = _FIRST_WORD
    for low, high, n in ((0, vocabulary.n_own, shape.own_classes), (vocabulary.n_own, len(class_of), shape.other_classes)):
        order = low + np.argsort(company[low:high], kind="stable")
        class_of[order] = first + _classes(vocabulary.counts[order], n)
        first += n
    return replace(vocabulary, class_of=class_of, n_classes=first)


def _company(learned: DataFrame, n_words: int, shape: Shape) -> np.ndarray:
    """For each word, the anchor of most texts around it: the most frequent words are anchors, and a text is of that which it holds most."""
    anchors = min(shape.anchors, n_words)
    if not anchors:
        return np.zeros(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_words * anchors)
        for batch in batches:
            flat, at = _flat(batch)
            text = np.repeat(np.arange(batch.num_rows), np.diff(at))
            is_anchor = (flat >= _FIRST_WORD) & (flat < _FIRST_WORD + anchors)
            held = np.bincount(text[is_anchor] * anchors + flat[is_anchor] - _FIRST_WORD, minlength=batch.num_rows * anchors)
            anchor = held.reshape(-1, anchors).argmax(axis=1)
            known = flat >= _FIRST_WORD
            sums += np.bincount((flat[known] - _FIRST_WORD) * anchors + anchor[text[known]], minlength=len(sums))
        yield from _pieces(sums.astype(np.float32), 1.0)

    total = _sum_pieces(learned.select("ids").mapInArrow(count, _PIECES))
    return np.zeros(n_words, np.int64) if total is None else total[0].reshape(n_words, anchors).argmax(axis=1)


def _classes(counts: np.ndarray, n: int) -> np.ndarray:
    """Words by falling count in classes of equal sums of square roots of counts."""
    mass = np.cumsum(np.sqrt(counts))
    return np.minimum((mass - np.sqrt(counts)) * n / mass[-1], n - 1).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def _encode(marked: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as numbers, with the words outside the vocabulary beside them, and a number per row."""
    key = marked.schema["key"]
    words, counts = vocabulary.words, vocabulary.counts
    n_ends = vocabulary.n_ends

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: i + _FIRST_WORD for i, w in enumerate(words)}.get
        log_count = np.concatenate([[math.log10(n_ends + 1), 0.0], np.log10(counts + 1.0)])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, n_tokens, n_known, logs, rare_words, rare_n, rare_at = [], [], [], [], [], [], [0]
            for text in batch.column("text"):
                mine, rare = [np.zeros(0, np.int32)], Counter()
                for part in _words(text.as_py()):
                    numbers = np.fromiter(map(get, part, repeat(_RARE)), np.int32, len(part))
                    mine.append(numbers)
                    rare.update([part[i] for i in np.flatnonzero(numbers == _RARE).tolist()])
                ids.append(np.concatenate(mine))
                n_tokens.append(len(ids[-1]) + 1)
                n_known.append(int((ids[-1] != _RARE).sum()) + (n_ends > 0))
                logs.append(float(log_count[ids[-1]].sum() + log_count[_END]))
                rare_words.extend(rare)
                rare_n.extend(rare.values())
                rare_at.append(len(rare_words))
            at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + batch.num_rows), pa.int64()), batch.column("key"), batch.column("learned"),
                    pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()),
                    pa.ListArray.from_arrays(at, flat),
                    pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(rare_words, pa.binary())),
                    pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(rare_n, pa.int64())),
                ],
                names=["row", "key", "learned", "n_tokens", "n_known", "log_counts", "ids", "rare_words", "rare_counts"],
            )
            row += batch.num_rows

    long, double = T.LongType(), T.DoubleType()
    fields = [
        ("row", long), ("key", key.dataType), ("learned", T.BooleanType()), ("n_tokens", long), ("n_known", long), ("log_counts", double),
        ("ids", T.ArrayType(T.IntegerType())), ("rare_words", T.ArrayType(T.BinaryType())), ("rare_counts", T.ArrayType(long)),
    ]
    return marked.mapInArrow(encode, T.StructType([T.StructField(n, t) for n, t in fields]))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the texts of a batch behind each other, and where each text begins and ends."""
    ids = batch.column("ids")
    return ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()


def _rare_words(encoded: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row: log10(count + 1) of its words outside the vocabulary, how many there are, and how many of them are known."""
    words = encoded.select("row", F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("_w"))
    least = int(vocabulary.counts[-1]) if len(vocabulary.counts) else 0
    # a word outside the vocabulary is no more frequent than the last one in it
    outside = counts.where((F.length("word") > 0) & (F.col("n") <= least)).select("word", F.col("n").alias("c"))
    joined = words.select("row", F.col("_w.rare_words").alias("word"), F.col("_w.rare_counts").alias("n")).join(outside, "word", "left")
    return joined.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"), F.sum("n").alias("rare_n"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("rare_known"),
    )


class Network:
    """The gated recurrent unit, its tables and its softmaxes, over one flat vector of numbers."""

    def __init__(self, vocabulary: Vocabulary, shape: Shape, values: np.ndarray | None = None):
        self.vocabulary, self.shape = vocabulary, shape
        hidden, own, classes = shape.hidden, vocabulary.n_own, vocabulary.n_classes
        # what the network sees of a token: an own word, or its class
        sizes = {
            "seen": (classes + own, 3 * hidden), "state": (hidden, 3 * hidden), "bias": (3 * hidden,),
            "to_class": (hidden, classes), "class_bias": (classes,), "to_word": (hidden, own), "word_bias": (own,),
        }
        total = sum(math.prod(s) for s in sizes.values())
        self.values = np.zeros(total, np.float32) if values is None else values.astype(np.float32)
        self.parts, start = {}, 0
        for name, size in sizes.items():
            end = start + math.prod(size)
            self.parts[name] = self.values[start:end].reshape(size)
            start = end
        number = np.arange(len(vocabulary.words))
        of_words = np.where(number < own, classes + number, vocabulary.class_of)
        self.seen_of = np.concatenate([[_END, _RARE], of_words]).astype(np.int64)
        self.class_of = np.concatenate([[_END, _RARE], vocabulary.class_of]).astype(np.int64)
        # own words of a class lie side by side
        order = np.argsort(vocabulary.class_of[:own], kind="stable")
        self.slot_of = np.argsort(order)
        bounds = np.searchsorted(vocabulary.class_of[order], np.arange(classes + 1))
        self.own_ranges = [(c, lo, hi) for c, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo]
        # words without own vector: their share of the class
        in_class = np.bincount(vocabulary.class_of, vocabulary.counts, classes)
        share = np.log(np.maximum(vocabulary.counts, 1) / np.maximum(in_class[vocabulary.class_of], 1))
        share[:own] = 0
        self.share_of = np.concatenate([[0.0, 0.0], share])
        if values is None:
            self._begin(in_class)

    def _begin(self, in_class: np.ndarray) -> None:
        """Starts from the plain counts, with small random weights in between."""
        draw = np.random.default_rng(0)
        v = self.vocabulary
        for name in ("seen", "state"):
            self.parts[name][:] = draw.normal(0, 0.1, self.parts[name].shape)
        for name in ("to_class", "to_word"):
            self.parts[name][:] = draw.normal(0, 0.02, self.parts[name].shape)
        mass = in_class.copy()
        mass[_END], mass[_RARE] = v.n_ends, v.n_tokens - v.n_ends - in_class.sum()
        self.parts["class_bias"][:] = np.log((mass + 1) / (mass + 1).sum())
        self.parts["word_bias"][self.slot_of] = np.log(np.maximum(v.counts[: v.n_own], 1))

    def run(self, tokens: np.ndarray, state: np.ndarray, fresh: np.ndarray, keep: bool = False):
        """Hidden states before each of `tokens` (step, lane) is known; `fresh` marks where a text begins.

        `tokens` are those seen before; the last state is returned too.
        """
        p, hidden = self.parts, self.shape.hidden
        steps, lanes = tokens.shape
        seen = p["seen"][self.seen_of[tokens]] + p["bias"]
        out = np.empty((steps, lanes, hidden), np.float32)
        saved = []
        for t in range(steps):
            if fresh[t].any():
                state = np.where(fresh[t][:, None], np.float32(0), state)
            inner = state @ p["state"]
            gates = seen[t, :, : 2 * hidden] + inner[:, : 2 * hidden]
            np.negative(gates, gates)
            np.exp(gates, gates)
            gates += 1
            np.reciprocal(gates, gates)
            reset, update = gates[:, :hidden], gates[:, hidden:]
            new = np.tanh(seen[t, :, 2 * hidden :] + reset * inner[:, 2 * hidden :])
            if keep:
                saved.append((state, reset, update, new, inner[:, 2 * hidden :]))
            state = new + update * (state - new)
            out[t] = state
        return out, state, saved

    def log_odds(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target; words outside the vocabulary count as their class."""
        p = self.parts
        logits = states @ p["to_class"] + p["class_bias"]
        wanted = self.class_of[targets]
        out = logits[np.arange(len(wanted)), wanted].astype(np.float64)
        np.exp(logits, logits)
        out -= np.log(logits.sum(axis=1))
        out += self.share_of[targets]
        for rows, lo, hi, word in self._own(targets, wanted):
            inside = states[rows] @ p["to_word"][:, lo:hi] + p["word_bias"][lo:hi]
            out[rows] += inside[np.arange(len(rows)), word] - _log_sum(inside)
        return out

    def _own(self, targets: np.ndarray, wanted: np.ndarray):
        order = np.argsort(wanted.astype(np.int16), kind="stable")
        bounds = np.searchsorted(wanted[order], np.arange(self.vocabulary.n_classes + 1))
        for c, lo, hi in self.own_ranges:
            rows = order[bounds[c] : bounds[c + 1]]
            if len(rows):
                yield rows, lo, hi, self.slot_of[targets[rows] - _FIRST_WORD] - lo

    def gradient(self, seen: np.ndarray, targets: np.ndarray, state: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean loss of one window, and the state behind it."""
        p, hidden = self.parts, self.shape.hidden
        steps, lanes = seen.shape
        out, last, saved = self.run(seen, state, fresh, keep=True)
        flat, goal = out.reshape(-1, hidden), targets.reshape(-1)
        slope = np.zeros_like(self.values)
        g, start = {}, 0
        for name, part in p.items():
            g[name] = slope[start : start + part.size].reshape(part.shape)
            start += part.size

        logits = flat @ p["to_class"] + p["class_bias"]
        np.exp(logits - logits.max(axis=1, keepdims=True), logits)
        logits /= logits.sum(axis=1, keepdims=True)
        wanted = self.class_of[goal]
        logits[np.arange(len(goal)), wanted] -= 1
        g["to_class"][:], g["class_bias"][:] = flat.T @ logits, logits.sum(axis=0)
        d_out = logits @ p["to_class"].T
        for rows, lo, hi, word in self._own(goal, wanted):
            near = flat[rows]
            inside = near @ p["to_word"][:, lo:hi] + p["word_bias"][lo:hi]
            np.exp(inside - inside.max(axis=1, keepdims=True), inside)
            inside /= inside.sum(axis=1, keepdims=True)
            inside[np.arange(len(rows)), word] -= 1
            g["to_word"][:, lo:hi], g["word_bias"][lo:hi] = near.T @ inside, inside.sum(axis=0)
            d_out[rows] += inside @ p["to_word"][:, lo:hi].T
        d_out = d_out.reshape(steps, lanes, hidden)

        d_state = np.zeros((lanes, hidden), np.float32)
        d_seen = np.empty((steps, lanes, 3 * hidden), np.float32)
        turned = np.ascontiguousarray(p["state"].T)
        for t in range(steps - 1, -1, -1):
            before, reset, update, new, inner = saved[t]
            d_state += d_out[t]
            d_new = d_state * (1 - update) * (1 - new * new)
            d = d_seen[t]
            d[:, :hidden] = d_new * inner * reset * (1 - reset)
            d[:, hidden : 2 * hidden] = d_state * (before - new) * update * (1 - update)
            d[:, 2 * hidden :] = d_new
            through = d.copy()
            through[:, 2 * hidden :] *= reset
            g["state"] += before.T @ through
            d_state = d_state * update + through @ turned
            if fresh[t].any():
                d_state[fresh[t]] = 0
        d_flat = d_seen.reshape(-1, 3 * hidden)
        g["bias"][:] = d_flat.sum(axis=0)
        number = self.seen_of[seen.reshape(-1)].astype(np.int32)
        order = np.argsort(number, kind="stable")
        begins = np.flatnonzero(np.diff(number[order], prepend=-1))
        g["seen"][number[order][begins]] = np.add.reduceat(d_flat[order], begins, axis=0)
        slope /= len(goal)
        return slope, last


def _log_sum(logits: np.ndarray) -> np.ndarray:
    most = logits.max(axis=1)
    return most + np.log(np.exp(logits - most[:, None]).sum(axis=1))


def _train(learned: DataFrame, vocabulary: Vocabulary, shape: Shape) -> np.ndarray:
    """Parameters after every learned text was passed once; copies of the model are averaged after each round."""
    size = Network(vocabulary, shape).values.size
    values, squares = Network(vocabulary, shape).values, np.full(size, 1e-4, np.float32)
    for number in range(shape.rounds):
        begin = (values, squares)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _learn(batches, vocabulary, shape, *begin)

        part = learned.where(F.pmod(F.xxhash64("row"), F.lit(shape.rounds)) == number).select("ids")
        total = _sum_pieces(part.mapInArrow(learn, _PIECES))
        if total is not None:
            both = (total[0] / total[1]).astype(np.float32)
            values, squares = both[:size], both[size:]
    return values


_PIECES = "piece int, weight double, numbers binary"


def _pieces(numbers: np.ndarray, weight: float) -> Iterator[pa.RecordBatch]:
    parts = [numbers[i : i + _PIECE].tobytes() for i in range(0, len(numbers), _PIECE)]
    columns = [pa.array(range(len(parts)), pa.int32()), pa.array([weight] * len(parts), pa.float64()), pa.array(parts, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["piece", "weight", "numbers"])


def _sum_pieces(pieces: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weighted sum of vectors that came in pieces, and the sum of weights; null if there are none."""
    sums = pieces.repartition("piece").mapInArrow(_add_pieces, _PIECES).collect()
    sums.sort(key=lambda r: r["piece"])
    return (np.concatenate([np.frombuffer(r["numbers"]) for r in sums]), sums[0]["weight"]) if sums else None


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the copies of each piece, weighted; a piece is in one task only."""
    sums: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for piece, weight, numbers in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = np.frombuffer(numbers, np.float32).astype(np.float64) * weight
            total, held = sums.get(piece, (0.0, 0.0))
            sums[piece] = (total + weight, held + own)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()),
            pa.array([n.tobytes() for _, n in sums.values()], pa.binary()),
        ],
        names=["piece", "weight", "numbers"],
    )


def _learn(
    batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, shape: Shape, values: np.ndarray, squares: np.ndarray
) -> Iterator[pa.RecordBatch]:
    network, squares, passed = Network(vocabulary, shape, values), squares.copy(), 0
    held, size = [], 0

    def train(stream: np.ndarray, lanes: int) -> None:
        """One pass over a stream of texts with their ends, cut in lanes of equal length."""
        nonlocal squares
        table = stream.reshape(lanes, -1).T
        before = np.vstack([np.full((1, lanes), _END, np.int32), table[:-1]])
        state = np.zeros((lanes, shape.hidden), np.float32)
        for start in range(0, len(table), shape.window):
            seen = before[start : start + shape.window]
            slope, state = network.gradient(seen, table[start : start + shape.window], state, seen == _END)
            squares += slope * slope
            network.values -= shape.rate * slope / np.sqrt(squares)

    def drain(stream: np.ndarray) -> np.ndarray:
        """Trains on whole windows of as many lanes as there are; returns the rest."""
        lanes = min(shape.lanes, len(stream) // shape.window)
        if not lanes:
            return stream
        whole = lanes * (len(stream) // lanes // shape.window) * shape.window
        train(stream[:whole], lanes)
        return stream[whole:]

    for batch in batches:
        flat, at = _flat(batch)
        held.append(np.insert(flat, at[1:], _END))
        size += len(held[-1])
        if size >= _HELD_TOKENS:
            rest = drain(np.concatenate(held))
            held, passed, size = [rest], passed + size - len(rest), len(rest)
    stream = np.concatenate(held) if held else np.zeros(0, np.int32)
    passed += len(stream)
    while len(stream) >= shape.window:
        stream = drain(stream)
    if len(stream):
        train(stream, 1)
    if not passed:
        return
    yield from _pieces(np.concatenate([network.values, squares]), float(passed))


def _score(encoded: DataFrame, vocabulary: Vocabulary, shape: Shape, values: np.ndarray) -> DataFrame:
    kept = ["row", "key", "learned", "n_tokens", "n_known", "log_counts"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(vocabulary, shape, values)
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("ids").flatten()) + batch.num_rows
            if size >= _HELD_TOKENS:
                yield from scored(network, held)
                held, size = [], 0
        yield from scored(network, held)

    def scored(network: Network, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for batch in held:
            flat, at = _flat(batch)
            texts += [flat[a:b] for a, b in zip(at, at[1:])]
        logs, start = text_log_odds(network, texts) / math.log(10), 0
        for batch in held:
            own = logs[start : start + batch.num_rows]
            start += batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own, pa.float64())], names=[*kept, "model_log"])

    fields = [encoded.schema[c] for c in kept]
    return encoded.select(*kept, "ids").mapInArrow(score, T.StructType([*fields, T.StructField("model_log", T.DoubleType())]))


def text_log_odds(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each whole text, its end included; the state goes on from window to window.

    Texts are read one behind the other in lanes of about equal length; the state starts anew with each.
    """
    shape = network.shape
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    if not texts:
        return np.zeros(0)
    # no more lanes than the longest text lets fill
    lanes: list[list[int]] = [[] for _ in range(min(shape.lanes, int(lengths.sum() // lengths.max())))]
    filled = [(0, i) for i in range(len(lanes))]
    for i in np.argsort(-lengths, kind="stable").tolist():
        used, lane = filled[0]
        lanes[lane].append(i)
        heapq.heapreplace(filled, (used + int(lengths[i]), lane))
    lanes.sort(key=lambda lane: -int(lengths[lane].sum()))
    used = np.array([int(lengths[lane].sum()) for lane in lanes])
    table = np.full((int(used[0]), len(lanes)), _END, np.int32)
    text_of = np.zeros(table.shape, np.int32)
    for j, lane in enumerate(lanes):
        table[: used[j], j] = np.concatenate([np.append(texts[i], _END) for i in lane])
        text_of[: used[j], j] = np.repeat(lane, lengths[lane])
    out = np.zeros(len(texts))
    state = np.zeros((len(lanes), shape.hidden), np.float32)
    before = np.full((1, len(lanes)), _END, np.int32)
    for start in range(0, len(table), shape.window):
        # lanes that have ended are the last ones
        active = int((used > start).sum())
        targets = table[start : start + shape.window, :active]
        seen = np.concatenate([before[:, :active], targets[:-1]])
        states, state, _ = network.run(seen, state[:active], seen == _END)
        inside = np.arange(start, start + len(targets))[:, None] < used[:active]
        logs = network.log_odds(states.reshape(-1, shape.hidden), targets.reshape(-1)).reshape(targets.shape)
        mine = text_of[start : start + shape.window, :active]
        out += np.bincount(mine[inside], logs[inside], len(texts))
        before = targets[-1:]
    return out
