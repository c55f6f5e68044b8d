"""A trained toxicity score: terms, document frequencies, logistic regression."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padron.functions.scores import over_threshold
from padron.functions.text import fold_long, words
from padron.operators.metrics import binary_metrics, confusion_matrix
from padron.operators.moderation import lexical_flag
from padron.session import saved, scratch_dir

# Most terms with a weight of their own; beyond it, the most frequent ones have one.
FEATURES = 1 << 18

# Terms of fewer documents have no weight: chance would give them one.
MIN_DOCS = 3
# Penalty on the sum of absolute weights.
REG = 0.002


def tokens_of(df: DataFrame, text: str, terms: Iterable[str] = ()) -> DataFrame:
    """Words of the text, and one more token where a blocked term is among them."""
    folded = df.withColumn("_folded", fold_long(F.col(text)))
    bare = F.regexp_replace("_folded", r"[^\p{L}\p{N}\s]+", " ")
    found = words(bare)
    if terms:
        blocked = lexical_flag(F.col("_folded"), terms, "word")
        mark = F.when(blocked, F.array(F.lit("# blocked"))).otherwise(F.array().cast("array<string>"))
        found = F.concat(found, mark)
    none = F.array().cast("array<string>")
    return folded.withColumn("tokens", F.coalesce(found, none)).drop("_folded")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Give both classes the same total weight."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")
    ).select(F.struct("n", "pos").alias("s")).scalar()
    n, pos = stats.getField("n"), stats.getField("pos")
    side = F.when(F.col(label) == 1, pos).otherwise(n - pos)
    weight = F.try_divide(n.cast("double"), F.lit(2.0) * side.cast("double"))
    return df.withColumn("weight", F.coalesce(weight, F.lit(1.0)))


def _even(df: DataFrame, name: str) -> DataFrame:
    """Rows as a table of even files, whose number follows their measured size.

    Training passes over its input many times; a table is made once and stays
    when executors go.
    """
    return saved(df.hint("rebalance"), name)


def fit_features(tokens: DataFrame, features: int = FEATURES) -> PipelineModel:
    """Terms present, weighted by document frequency: a long text is no more toxic for it.

    Terms are counted and numbered, so the solver is as wide as the kept terms.
    """
    kept = CountVectorizer(
        inputCol="tokens", outputCol="tf", minDF=float(MIN_DOCS), vocabSize=features, binary=True
    )
    return Pipeline(stages=[kept, IDF(inputCol="tf", outputCol="features")]).fit(tokens)


def regression(label: str, max_iter: int, reg: float) -> LogisticRegression:
    """Sparse weights: few of the many terms tell the classes apart."""
    return LogisticRegression(
        featuresCol="features",
        labelCol=label,
        weightCol="weight",
        maxIter=max_iter,
        regParam=reg,
        elasticNetParam=1.0,
    )


def _features(
    df: DataFrame, text: str, label: str, terms: Iterable[str]
) -> tuple[PipelineModel, DataFrame]:
    """Fitted feature stages and the weighted training rows."""
    tokens = _even(tokens_of(df, text, terms).select("tokens", label), "tokens")
    fitted = fit_features(tokens)
    return fitted, balanced(fitted.transform(tokens), label).select("features", label, "weight")


def train(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    max_iter: int = 40,
    reg: float = REG,
    terms: Iterable[str] = (),
) -> PipelineModel:
    """Fit on (text, label). Fitting reduces over the data; no rows reach the driver.

    ``terms``: a blocklist whose hits are one more feature; give the same to ``score``.
    """
    fitted, rows = _features(df, text, label, terms)
    return PipelineModel([*fitted.stages, _stored(regression(label, max_iter, reg).fit(rows), df)])


def _stored(model: LogisticRegressionModel, df: DataFrame) -> LogisticRegressionModel:
    """The model as written and read again: weights without the summary of their training.

    A summary holds the session, which tasks that score would have to carry.
    """
    path = scratch_dir(df.sparkSession, "model")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def score(
    model: PipelineModel, df: DataFrame, text: str = "text", terms: Iterable[str] = ()
) -> DataFrame:
    """Add ``score``, the probability of the toxic class."""
    scored = model.transform(tokens_of(df, text, terms))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("score"))


def evaluate(scored: DataFrame, label: str = "label", threshold: float = 0.5) -> DataFrame:
    predicted = scored.withColumn("pred", over_threshold(F.col("score"), threshold).cast("int"))
    return binary_metrics(confusion_matrix(predicted, "pred", label))
