import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.llm import bpe, queries

RANKS = P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "I'll call you back at 5pm.\n\n\tThanks  ", "naïve café ☎️ 日本語 العربية 👩‍👩‍👧", "<|endoftext|>", "a" * 5000,
    "-" * 3000, "x\r\n" * 500, "it's  IT'S it’s", "\x00\x85\u2028", "word " * 20000,
]


def test_ids_offsets_and_round_trip(spark, calls, reference):
    df = calls([(i, t) for i, t in enumerate(TEXTS)]).withColumn("token_ids", F.lit("clash"))
    encoded = bpe.encode_transcripts(df, RANKS, P.PATTERN, slice_chars=2000)
    back = bpe.decode_tokens(encoded, RANKS, keep=("call_id", "token_ids", "token_starts", "token_ends")).collect()
    assert len(back) == len(TEXTS)
    for r in back:
        text = TEXTS[r.call_id] or ""
        assert r.token_ids == reference.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        pieces = [reference.decode_single_token_bytes(i) for i in r.token_ids]
        for piece, a, b in zip(pieces, r.token_starts, r.token_ends):
            assert piece in text[a:b].encode() and len(text[a:b].encode()) <= len(piece) + 6
        assert (r.token_ends[-1] if r.token_ends else 0) == len(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_tokenizer_equals_rank_merges(text):
    ids, ends = bpe.Encoder(RANKS, P.PATTERN).flat_ids([text])
    assert ids.tolist() == REF.encode_ordinary(text) and ends.tolist() == [len(ids)]


def test_memo_stays_short_and_right():
    encoder = bpe.Encoder(RANKS, P.PATTERN, memo_pieces=5)
    for _ in range(2):
        for texts in (["a bb ccc", "", "a b " + "x" * 90], ["dd ee a bb"], ["q w e r t y u i o p a bb " + "y" * 90]):
            ids, ends = encoder.flat_ids(texts)
            parts = [REF.encode_ordinary(t) for t in texts]
            assert ids.tolist() == sum(parts, []) and ends.tolist() == [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    assert len(encoder.memo) <= 20


def test_one_pass_equals_two(spark, calls):
    df = calls([(i, t) for i, t in enumerate(TEXTS)])
    one = {r.call_id: r for r in bpe.round_trip_digests(df, RANKS, P.PATTERN, slice_chars=3000).collect()}
    encoded = bpe.encode_transcripts(df, RANKS, P.PATTERN)
    two = bpe.decode_tokens(encoded, RANKS, keep=("call_id", "token_ids", "token_ends")).withColumn("digest", bpe.ids_digest(F.col("token_ids")))
    for r in two.collect():
        got = one[r.call_id]
        assert (got.n_tokens, got.ids_sha256) == (len(r.token_ids), r.digest)
        assert got.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()
        assert got.n_chars_covered == (r.token_ends[-1] if r.token_ends else 0)
    assert len(one) == len(TEXTS) and bpe.round_trip_digests(df.limit(0), RANKS, P.PATTERN).count() == 0


REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_split_characters(spark):
    ids = REF.encode_ordinary("日本")
    cut = spark.createDataFrame([(1, ids[1:]), (2, []), (3, None)], "call_id bigint, token_ids array<int>")
    out = {r.call_id: r for r in bpe.decode_tokens(cut, RANKS).withColumn("text", bpe.decoded_text(F.col("decoded"))).collect()}
    want = b"".join(REF.decode_single_token_bytes(i) for i in ids[1:])
    assert bytes(out[1].decoded) == want and out[1].text == want.decode(errors="replace")
    assert bytes(out[2].decoded) == b"" and out[3].decoded is None


def test_empty_table(spark, calls):
    assert bpe.encode_transcripts(calls([]), RANKS, P.PATTERN).collect() == []


def test_query_equals_library_on_all_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = REF.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        assert r.n_chars_covered == len(docs[r.doc_id])
