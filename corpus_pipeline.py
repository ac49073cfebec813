"""From raw documents to encoded training text, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import jaccard, mixing, quality, queries, toxicity
from callweave.llm.common import as_calls, free_name
from callweave.session import scratch_path, settle


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that repeat themselves, are too short or full of symbols go."""
    return quality.keep_good(docs)


def keep_civil_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents predicted toxic go; learned from the labels of documents still there."""
    model = queries.toxicity_model(as_calls(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_civil(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies, the document with the smallest id stays."""
    linked = jaccard.link_near_copies(docs, key="doc_id")
    others = settle(linked.where("component_id != doc_id").select("doc_id"))
    return docs.join(others, "doc_id", "left_anti")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document is there as often as the mix takes it."""
    size, copies, goal, copy = (free_name(docs, n) for n in ("_size", "_copies", "_goal", "_copy"))
    sized = docs.withColumn(size, mixing.word_count("text"))
    rules = mixing.mixing_rules(settle(sized.select("doc_id", "source", size)), key="doc_id", size=size)
    mixed = mixing.mix_sources(sized, rules, key="doc_id", size=size, copies=copies, goal=goal)
    numbers = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return mixed.where(F.col(copies) > 0).select(*docs.columns, numbers.alias(copy)).drop(copy)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids of every document, with their digest and that of the bytes decoded from them."""
    return queries.bpe_digests(spark, as_calls(docs))


STAGES = [
    ("quality rules", keep_good_texts),
    ("toxicity", keep_civil_texts),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_to_weights),
    ("byte-level BPE", encode_texts),
]

# The toxicity stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
