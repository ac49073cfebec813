"""Byte-level BPE of transcripts: token ids with character offsets, and back to bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# texts handed to the tokenizer at once hold about this many characters, or are one text
SLICE_CHARS = 500_000
# a worker remembers the ids of so many short pieces, some 30 MB
MEMO_PIECES = 1 << 17
MEMO_CHARS = 24


def encode_transcripts(
    calls: DataFrame, ranks_path: str, pattern: str, key: str = "call_id", text: str = "text", slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """Token ids of whole texts, and the characters that each token covers.

    `ranks_path` is a file of base64 tokens with their ranks that every executor
    has; `pattern` cuts a text into pieces that are merged separately. No special
    tokens are added or recognised.

    Returns `key`, token_ids, token_starts and token_ends (arrays of INT; starts
    and ends count characters). A token that holds part of a character covers the
    whole character. A null text counts as an empty one and gives empty arrays.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = _key_and_text(calls, key, text)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [rows.schema[0], *[T.StructField(c, ints) for c in ("token_ids", "token_starts", "token_ends")]]
    )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = Encoder(ranks_path, pattern), token_lengths(ranks_path)
        for batch in batches:
            for part in slices(batch, slice_chars):
                texts = part.column(1).to_pylist()
                ids, ends = encoder.flat_ids(texts)
                starts_, ends_ = character_offsets(texts, ids, ends, lengths)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, starts_, ends_)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=schema.names)

    return rows.mapInArrow(work, schema)


def round_trip_digests(
    calls: DataFrame, ranks_path: str, pattern: str, key: str = "call_id", text: str = "text", slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """Encodes whole texts, decodes the ids again, and returns digests of both in one pass over the texts.

    Returns `key`, n_tokens, ids_sha256 (of the ids in decimal, joined by single spaces), decoded_sha256 (of the decoded bytes)
    and n_chars_covered (characters up to the end of the last token). Nulls, other columns and empty tables as in
    `encode_transcripts`; ids and bytes as from `encode_transcripts` and `decode_tokens`.
    """
    rows = _key_and_text(calls, key, text)
    names = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("n_chars_covered", T.LongType())]
    schema = T.StructType([rows.schema[0], *[T.StructField(n, t) for n, t in names]])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths, table, decimals = Encoder(ranks_path, pattern), token_lengths(ranks_path), byte_pieces(ranks_path), decimal_pieces(ranks_path)
        for batch in batches:
            for part in slices(batch, slice_chars):
                texts = part.column(1).to_pylist()
                ids, ends = encoder.flat_ids(texts)
                to = character_offsets(texts, ids, ends, lengths)[1]
                cuts = np.concatenate([[0], ends])
                digests: list[list] = [[], [], []]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    written = b"".join(decimals[ids[a:b]].tolist())[:-1]
                    decoded = b"".join(table[ids[a:b]].tolist())
                    for column, value in zip(digests, (hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest(), int(to[b - 1]) if b > a else 0)):
                        column.append(value)
                columns = [pa.array(np.diff(cuts), pa.int64()), *[pa.array(d, t) for d, t in zip(digests, (pa.string(), pa.string(), pa.int64()))]]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return rows.mapInArrow(work, schema)


def _key_and_text(calls: DataFrame, key: str, text: str) -> DataFrame:
    return calls.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def decode_tokens(tokens: DataFrame, ranks_path: str, ids: str = "token_ids", keep: tuple = ("call_id",)) -> DataFrame:
    """Bytes of token ids, with the columns of `keep` carried along.

    Returns the kept columns and decoded (BINARY). Tokens of a whole text give its
    UTF-8 bytes; a run of tokens may begin or end inside a character, so the bytes
    are not cast to text here (`decoded_text` does that). Null ids give null, an id
    outside the vocabulary is an error, an empty table gives an empty result.
    """
    rows = tokens.select(*keep, F.col(ids).alias("_ids"))
    schema = T.StructType([*rows.schema[:-1], T.StructField("decoded", T.BinaryType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_pieces(ranks_path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            # offsets and values as they lie in the batch, so nothing is made a Python number
            cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            out = [b"".join(table[flat[a:b]].tolist()) if ok else None for a, b, ok in zip(cuts[:-1], cuts[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(work, schema)


def decoded_text(decoded: Column) -> Column:
    """Bytes as text; what is left of characters cut by the first or last token becomes U+FFFD."""
    return F.make_valid_utf8(decoded.cast("string"))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the ids written in decimal and joined by single spaces; null for null."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def slices(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts (column 1) have about `chars` bytes, or that are one row."""
    first, room = 0, chars
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if n > room and i > first:
            yield batch.slice(first, i - first)
            first, room = i, chars
        room -= n
    if first < batch.num_rows:
        yield batch.slice(first)


class Encoder:
    """Texts to ids: the pattern cuts a text, the tokenizers library merges each piece, pieces seen before are remembered."""

    def __init__(self, ranks_path: str, pattern: str, memo_pieces: int = MEMO_PIECES):
        self.pieces_of = regex.compile(pattern).findall
        self.tokenizer = load_tokenizer(ranks_path)
        self.memo: dict[str, bytes] = {}
        self.memo_pieces = memo_pieces

    def flat_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text ends among them."""
        cut = [self.pieces_of(t) for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.memo})
        ids = [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        fresh = dict(zip(new, ids))
        if len(self.memo) + len(fresh) > self.memo_pieces:
            # this slice still needs the pieces that it shares with earlier ones
            fresh |= {p: self.memo[p] for pieces in cut for p in pieces if p in self.memo}
            self.memo = {}
        # long pieces are no good to remember
        long = {p: x for p, x in fresh.items() if len(p) > MEMO_CHARS}
        self.memo |= {p: x for p, x in fresh.items() if len(p) <= MEMO_CHARS}
        get = (lambda p: long[p] if p in long else self.memo[p]) if long else self.memo.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        ends = np.cumsum([len(x) // 4 for x in out], dtype=np.int64)
        return np.frombuffer(b"".join(out), np.int32), ends


def character_offsets(texts: list[str], ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and character behind the last one of each token, counted in its own text."""
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    if not len(ids):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    # characters begin at the bytes that are no continuation
    character = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)
    size = lengths[ids]
    to = np.cumsum(size, dtype=np.int32)
    start, end = character[to - size] - 1, character[to - 1]
    firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int32)
    base = np.repeat(firsts, np.diff(np.concatenate([[0], ends])))
    return start - base, end - base


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: itself if visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def byte_pieces(path: str) -> np.ndarray:
    """The bytes of each id: the byte alphabet read backwards."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    vocabulary = visible_vocabulary(path)
    table = np.empty(1 + max(vocabulary.values()), dtype=object)
    for token, i in vocabulary.items():
        table[i] = bytes(back[c] for c in token)
    return table


@cache
def decimal_pieces(path: str) -> np.ndarray:
    """Each id in decimal with a space behind it."""
    return np.array([b"%d " % i for i in range(len(byte_pieces(path)))], dtype=object)


@cache
def token_lengths(path: str) -> np.ndarray:
    return np.array([len(t or b"") for t in byte_pieces(path)], np.int32)


def visible_vocabulary(path: str) -> dict[str, int]:
    alphabet = byte_alphabet()
    return {"".join(alphabet[b] for b in token): rank for token, rank in read_ranks(path).items()}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that the merges of lower rank leave of a token."""
    parts, rank = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while True:
        joined = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best, i = min(joined, default=(rank, 0))
        if best >= rank:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@cache
def load_tokenizer(path: str):
    """A tokenizer of single pieces whose merges are those that the ranks imply, once per Python worker."""
    import os

    # Spark has a task on every core already
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, alphabet = read_ranks(path), byte_alphabet()
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1:
            parts = last_merge(token, ranks)
            if len(parts) != 2:
                raise ValueError(f"token {ranks[token]} does not come from one merge")
            merges.append(tuple("".join(alphabet[b] for b in part) for part in parts))
    tokenizer = Tokenizer(models.BPE(vocab=visible_vocabulary(path), merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer
