"""Training and scoring with pyspark.ml.

Forests and regressions are Spark's own; they match the described models in
kind and parameters, not bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    ElementwiseProduct,
    NGram,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave import config as C
from callweave.operators import evaluate, sampling

SEED = 42


TASKS_PER_CORE = 2


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a table of numbers is a few small files, but a forest takes long for each of its rows."""
    return df.repartition(TASKS_PER_CORE * _cores(df))


def _fit(stages: list, df: DataFrame, label: str, deal: Callable[[DataFrame], DataFrame]) -> PipelineModel:
    """Fits stages on weighted rows, dealt to tasks by `deal`; every stage reads the rows again, so they are kept."""
    rows = deal(evaluate.with_class_weights(df, label)).persist()
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def _indexed_label(label: str) -> StringIndexer:
    # alphabetical, so that the class order is the sorted one
    return StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")


def train_text_baseline(df: DataFrame, text: str = "text", label: str = "label", vocab: int = 10000) -> PipelineModel:
    """TF-IDF over words and word pairs, then a balanced logistic regression.

    Words have two or more letters or digits; words and pairs share one
    vocabulary of the `vocab` most frequent terms found in two or more texts.
    """
    words = [
        RegexTokenizer(inputCol=text, outputCol="_w", gaps=False, pattern=r"(?U)\b\w\w+\b", toLowercase=True),
        NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="SELECT *, concat(_w, _b) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocab, minDF=2),
        IDF(inputCol="_tf", outputCol="_idf"),
    ]
    rows = df.persist()
    try:
        counted = Pipeline(stages=words).fit(rows)
        # a term of every text keeps the weight 1
        weights = Vectors.dense(counted.stages[-1].idf.toArray() + 1.0)
        head = PipelineModel(
            [
                *counted.stages[:-1],
                ElementwiseProduct(inputCol="_tf", outputCol="_idf", scalingVec=weights),
                Normalizer(inputCol="_idf", outputCol="features"),
            ]
        )
        n_rows, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
        tasks = _regression_tasks(rows, chars)
        texts = rows.select(label, text)
        if texts.rdd.getNumPartitions() < tasks:
            texts = texts.repartition(tasks)
        # the words and pairs of a text take many times its bytes and are not needed any more
        vectors = head.transform(texts).select(label, "features")
        fitted = _fit([_indexed_label(label), _logistic(n_rows)], vectors, label, lambda df: df.coalesce(tasks))
        return PipelineModel([*head.stages, *fitted.stages])
    finally:
        rows.unpersist()


# Characters of text whose vectors one task of a regression holds: a term of a text, with its number and weight, takes
# at most four bytes for each character.
TASK_CHARS = 1 << 26


def _regression_tasks(df: DataFrame, chars: int) -> int:
    """A task per core, or as many as keep the vectors of `chars` characters of text short.

    No more than that: in each of some hundred steps a task of the regression sends a gradient as long as the vocabulary for each class.
    """
    return max(_cores(df), -(-chars // TASK_CHARS))


def _gathered(df: DataFrame) -> DataFrame:
    """No more tasks than cores, for vectors of a few numbers."""
    return df.coalesce(_cores(df))


def _logistic(n_rows: int, c: float = 1.0) -> LogisticRegression:
    """Logistic regression with the penalty 1 / (2 C) on the squared coefficients of the summed loss.

    Spark divides the loss by the sum of the weights; balanced weights sum up to
    the number of rows.
    """
    return LogisticRegression(
        featuresCol="features", labelCol="_y", weightCol="weight", maxIter=1000, tol=1e-4, regParam=1.0 / (c * max(1, n_rows)), standardization=False
    )


def _labels_of(model: PipelineModel) -> list[str]:
    indexer = next(s for s in model.stages if s.__class__.__name__ == "StringIndexerModel" and s.getOutputCol() == "_y")
    return list(indexer.labels)


def argmax_label(probabilities: F.Column, labels: Sequence[str]) -> F.Column:
    """The most probable class; on a tie the first in class order."""
    ranked = F.array(
        *[
            F.struct(F.get(probabilities, F.lit(i)).alias("p"), F.lit(-i).alias("o"), F.lit(name).alias("label"))
            for i, name in enumerate(labels)
        ]
    )
    return F.array_max(ranked)["label"]


def argmax_of_map(probabilities: F.Column) -> F.Column:
    """The most probable key of a label -> probability map; ties to the smaller label."""
    return F.element_at(
        F.array_sort(
            F.map_entries(probabilities),
            lambda a, b: F.when(a["value"] > b["value"], -1)
            .when(a["value"] < b["value"], 1)
            .when(a["key"] < b["key"], -1)
            .otherwise(1),
        ),
        1,
    )["key"]


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Label, confidence (its own probability) and the probability map per row."""
    labels = _labels_of(model)
    forest = isinstance(model.stages[-1], RandomForestClassificationModel)
    out = _transform_unlabelled(model, _spread(df) if forest else df)
    p = F.col("_p")
    pairs = [x for i, name in enumerate(labels) for x in (F.lit(name), F.get(p, F.lit(i)))]
    return (
        out.withColumn("_p", vector_to_array("probability"))
        .select(
            *[F.col(c) for c in df.columns],
            argmax_label(p, labels).alias("predicted"),
            F.array_max(F.slice(p, 1, len(labels))).alias("confidence"),
            F.create_map(*pairs).alias("probabilities"),
        )
    )


def _transform_unlabelled(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Runs the fitted stages without the label indexer, which scoring does not need."""
    out = df
    for stage in model.stages:
        if stage.__class__.__name__ == "StringIndexerModel" and stage.getOutputCol() == "_y":
            continue
        out = stage.transform(out)
    return out


def score_external(
    df: DataFrame,
    text: str,
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
    batch: int = 32,
) -> DataFrame:
    """Scores texts with a model from outside Spark, loaded once per task.

    `load` returns a function from a list of texts to (label, confidence) pairs.
    """
    schema = df.select("*", F.lit("").alias("predicted"), F.lit(0.0).alias("confidence")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for rows in batches:
            texts = rows[text].tolist()
            results = [r for i in range(0, len(texts), batch) for r in predict(texts[i : i + batch])]
            yield rows.assign(predicted=[r[0] for r in results], confidence=[float(r[1]) for r in results])

    return df.mapInPandas(run, schema)


def evaluate_model(model: PipelineModel, df: DataFrame, label: str = "label") -> DataFrame:
    """Per-class metrics of a fitted model over its own label list."""
    scored = score(model, df).select(F.col(label).alias("y_true"), F.col("predicted").alias("y_pred"))
    return evaluate.class_metrics(scored, _labels_of(model))


def assemble(names: Sequence[str], out: str = "features") -> VectorAssembler:
    """Named features into a vector, in the order of the names."""
    return VectorAssembler(inputCols=list(names), outputCol=out)


def _numeric_and_intent(names: Sequence[str], with_intent: bool) -> list:
    stages = [
        VectorAssembler(inputCols=list(names), outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True),
    ]
    if not with_intent:
        return [*stages, VectorAssembler(inputCols=["_scaled"], outputCol="features")]
    return [
        *stages,
        StringIndexer(inputCol="intent", outputCol="_int", stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCol="_int", outputCol="_hot", dropLast=True),
        VectorAssembler(inputCols=["_scaled", "_hot"], outputCol="features"),
    ]


def _fit_forest(df: DataFrame, label: str, with_intent: bool, depth: int, trees: int) -> PipelineModel:
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="_y",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        seed=SEED,
        maxMemoryInMB=1024,  # nodes split in one pass over the rows
    )
    stages = [*_numeric_and_intent(C.BUSINESS_FEATURES, with_intent), _indexed_label(label), forest]
    return _fit(stages, df, label, _spread)


def train_resolution(df: DataFrame, label: str = "resolution", trees: int = 200, depth: int = 8) -> PipelineModel:
    """Resolution forest over the business features and the intent."""
    return _fit_forest(df, label, True, depth, trees)


def train_escalation(df: DataFrame, label: str = "escalation", trees: int = 200, depth: int = 6) -> PipelineModel:
    """Escalation forest over the business features; scores give P(Yes)."""
    return _fit_forest(df, label, False, depth, trees)


def escalation_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = score(model, df)
    return scored.withColumn("probability", F.element_at("probabilities", "Yes")).drop(
        "predicted", "confidence", "probabilities"
    )


def train_conversation_baseline(df: DataFrame, tasks: Sequence[str]) -> dict[str, PipelineModel]:
    """One balanced logistic regression per task over the conversation features and the intent."""
    features = Pipeline(stages=_numeric_and_intent(C.CONVERSATION_FEATURES, True)).fit(df)
    prepared, n_rows = features.transform(df), df.count()
    models = {}
    for task in tasks:
        fitted = _fit(
            [_indexed_label(task), _logistic(n_rows)],
            prepared,
            task,
            _gathered,
        )
        models[task] = PipelineModel([*features.stages, *fitted.stages])
    return models


def predict_tasks(models: dict[str, PipelineModel], features: DataFrame) -> DataFrame:
    """Label and confidence of every task per call, one column pair per task."""
    out = features
    for task, model in models.items():
        out = (
            score(model, out)
            .withColumnRenamed("predicted", f"{task}_label")
            .withColumnRenamed("confidence", f"{task}_confidence")
            .drop("probabilities")
        )
    return out


def importances(model: PipelineModel, spark) -> DataFrame:
    """Importance of every model input by name."""
    forest = model.stages[-1]
    names = _input_names(model)
    values = forest.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def _input_names(model: PipelineModel) -> list[str]:
    names = list(model.stages[0].getInputCols())
    for stage in model.stages:
        if stage.__class__.__name__ == "StringIndexerModel" and stage.getOutputCol() == "_int":
            names += [f"intent={v}" for v in stage.labels]
    return names


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def prepare_dataset(
    df: DataFrame,
    ids: Sequence[str],
    label: str = "label",
    max_total: int | None = None,
    val_frac: float = 0.15,
    test_frac: float = 0.15,
    seed: int = SEED,
) -> DataFrame:
    """Optional subsample, then the stratified split column."""
    rows = df if max_total is None else sampling.stratified_subsample(df, label, ids, max_total, seed)
    return sampling.stratified_split(rows, label, ids, val_frac, test_frac, seed)


def training_report(model: PipelineModel, prepared: DataFrame, label: str = "label") -> DataFrame:
    """One row: sizes of the splits and the test metrics of a model."""
    sizes = prepared.agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")]
    )
    test = score(model, prepared.filter(F.col("split") == "test")).select(
        F.col(label).alias("y_true"), F.col("predicted").alias("y_pred")
    )
    metrics = evaluate.macro_metrics(test, _labels_of(model))
    per_class = evaluate.class_metrics(test, _labels_of(model)).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("label", "precision", "recall", "f1", "support"))))
    )
    return metrics.select(
        *[c for c in metrics.columns],
        *[sizes.select(c).scalar().alias(c) for c in sizes.columns],
        per_class.scalar().alias("per_class"),
    )
