import base64
import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from callweave.llm import queries, toxicity
from callweave.llm.common import as_calls
from callweave.session import settle
from tests.llm.test_jaccard import brute as components
from tests.llm.test_quality import brute as counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = settle(stage(spark, docs, SF))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_in_order_keep_the_columns(stages):
    names = list(stages)
    assert names[1:] == ["quality rules", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE"]
    for name in names[:-1]:
        assert stages[name].columns == stages["input"].columns
        assert stages[name].count() > 0


def test_quality_stage_equals_brute_force(stages):
    def kept(text):
        n, chars, symbols, _, repeats, dup, *grams = counts(text or "")
        base = n < 50 or 100 * repeats > 50 * n
        return not (base or 100 * dup > 30 * chars or 100 * symbols > 10 * n or any(100 * g > x * chars for g, x in zip(grams, (30, 28, 25))))

    want = Counter(tuple(r) for r in stages["input"].collect() if kept(r.text))
    assert rows(stages["quality rules"]) == want


def test_toxicity_stage_drops_what_the_model_predicts(spark, stages):
    docs = stages["quality rules"]
    model = queries.toxicity_model(as_calls(docs), spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.call_id for r in toxicity.score_toxicity(as_calls(docs), model).where("predicted = 1").collect()}
    assert rows(stages["toxicity"]) == Counter(tuple(r) for r in docs.collect() if r.doc_id not in toxic)


def test_join_stage_equals_all_pairs(stages):
    docs = stages["toxicity"].collect()
    first = components({r.doc_id: r.text for r in docs})
    assert rows(stages["n-gram Jaccard join"]) == Counter(tuple(r) for r in docs if first[r.doc_id][1] == r.doc_id)


def test_mixing_stage_copies_whole_documents(stages):
    before, after = rows(stages["n-gram Jaccard join"]), rows(stages["mixing sources to target weights"])
    assert set(after) <= set(before) and all(n <= 3 * before[r] for r, n in after.items())
    words = lambda c: sum(n * len((r[1] or "").split()) for r, n in c.items())
    assert abs(words(after) - words(before)) < 0.25 * words(before)


def test_encoding_stage_equals_the_library(stages):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digests(text):
        ids = encoding.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    want = Counter((r.doc_id, *digests(r.text)) for r in stages["mixing sources to target weights"].collect())
    assert Counter(tuple(r)[:4] for r in stages["byte-level BPE"].collect()) == want


def test_run_equals_the_stages(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages["byte-level BPE"])


def test_stages_on_odd_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    good = " ".join(f"w{i}" for i in range(80))
    # ids without labels
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (None, good, None, None, 1)]
    odd += [(10**6 + 2, good, "en", "s", 1)] * 2 + [(10**6 + 3, good + " end", "en", "s", 1)]
    for table in (odd, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, SF))
        assert (docs.count() > 0) == bool(table)
