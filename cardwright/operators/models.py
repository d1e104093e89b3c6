"""Classifiers of cards, on Spark's own learners. Where labels are rare, classes are balanced by weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model, Pipeline, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, HashingTF, IDF, MinMaxScaler, NGram, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwright.session import staged

BUCKETS = 1 << 12


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with weight: each class counts for one half."""
    sizes = df.agg(F.sum(F.col(label)).alias("p"), F.count(label).alias("n")).first()
    p, n = sizes.p or 0, sizes.n or 0
    weight = F.when(F.col(label) == 1, n / (2 * p) if p else 1.0).otherwise(n / (2 * (n - p)) if n > p else 1.0)
    return df.withColumns({"weight": weight, label: F.col(label).cast("double")})


def text_stages(column: str = "text", out: str = "features", buckets: int = BUCKETS) -> list:
    """Words and pairs of words, hashed and weighted."""
    words = RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    one, two = (HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=buckets) for c in ("_words", "_pairs"))
    return [words, pairs, one, two, IDF(inputCol="_words_tf", outputCol="_words_w", minDocFreq=2), IDF(inputCol="_pairs_tf", outputCol="_pairs_w", minDocFreq=2), VectorAssembler(inputCols=["_words_w", "_pairs_w"], outputCol=out)]


def logistic(n: int, c: float = 4.0, features: str = "features", label: str = "label") -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (c * max(1, n)), maxIter=15)


def positive(model_out: DataFrame, out: str = "score") -> DataFrame:
    """The probability of class 1, or the sigmoid of the margin where a model has no probability."""
    if "probability" in model_out.columns:
        return model_out.withColumn(out, vector_to_array("probability")[1])
    return model_out.withColumn(out, 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def per_category(df: DataFrame, category: str, label: str, stages: Callable[[int], list], categories: list[str], settings: dict[str, dict] | None = None) -> tuple[dict[str, Model], dict[str, float]]:
    """A pipeline fitted on each category's labelled rows, and the share of positives. stages(n, **settings of the category)."""
    models, priors = {}, {}
    for c in categories:
        rows = staged(balanced(df.where((F.col(category) == c) & F.col(label).isNotNull()), label), "training")
        found = rows.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
        if found.n and 0 < found.p < found.n:
            models[c] = Pipeline(stages=stages(found.n, **(settings or {}).get(c, {}))).fit(rows)
        if found.n:
            priors[c] = found.p / found.n
    return models, priors


def scored(df: DataFrame, category: str, models: dict[str, Model], priors: dict[str, float], keep: list[str]) -> DataFrame:
    """keep and score. A category without a model gets its share of positives, an unknown one the mean of the shares."""
    mean = sum(priors.values()) / len(priors) if priors else 0.5
    shares = F.create_map(*[F.lit(x) for kv in {**priors, "": mean}.items() for x in kv])
    known = F.coalesce(F.col(category), F.lit(""))
    out = df.where(~known.isin(*models)).select(*keep, F.coalesce(F.try_element_at(shares, known), F.lit(mean)).alias("score"))
    for c, model in models.items():
        out = out.unionByName(positive(model.transform(df.where(known == c))).select(*keep, "score"))
    return out


def dense_stages(vector: str, numbers: list[str], width: int, k: int = 16) -> list:
    """Vectors, scaled and reduced to k numbers, beside others. Fitted on training rows only, as all stages are."""
    return [StandardScaler(inputCol=vector, outputCol="_scaled", withMean=True), PCA(k=min(k, width), inputCol="_scaled", outputCol="_reduced"), VectorAssembler(inputCols=["_reduced", *numbers], outputCol="features", handleInvalid="keep")]


def vectors(df: DataFrame, column: str, width: int, out: str = "vector") -> DataFrame:
    """df with the array as a vector; another length than width is an error."""
    right = F.when(F.size(column) == width, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"a vector that has not {width} numbers but "), F.size(column).cast("string"))).cast("array<double>"))
    return df.withColumn(out, array_to_vector(right.cast("array<double>")))


class NotBelow(Transformer):
    """The vectors of a column, smaller numbers than least made least."""

    def __init__(self, column: str, least: float = 0.0):
        super().__init__()
        self.column, self.least = column, least

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, array_to_vector(F.transform(vector_to_array(self.column), lambda x: F.greatest(x, F.lit(self.least)))))


def zoo(width: int) -> dict[str, Callable[[], list]]:
    """Learners by name; the features are scaled to [0, 1] by the training rows, as some take no negative ones. Other rows can
    lie outside; complement_bayes refuses negative ones there too, so it reads them as 0. Boosting stands for the boosted
    libraries, factorisation machines for the kernel-like ones; extremely random trees have no like here."""
    scaled = MinMaxScaler(inputCol="features", outputCol="scaled")
    given = {"featuresCol": "scaled", "labelCol": "label"}
    made = {
        "logistic": lambda: LogisticRegression(**given, weightCol="weight", maxIter=30),
        "ridge": lambda: LogisticRegression(**given, weightCol="weight", regParam=0.1, maxIter=30),
        "lasso": lambda: LogisticRegression(**given, weightCol="weight", regParam=0.01, elasticNetParam=1.0, maxIter=30),
        "svm": lambda: LinearSVC(**given, weightCol="weight", maxIter=30),
        "complement_bayes": lambda: NaiveBayes(**given, weightCol="weight", modelType="complement"),
        "tree": lambda: DecisionTreeClassifier(**given, weightCol="weight", seed=7),
        "forest": lambda: RandomForestClassifier(**given, weightCol="weight", numTrees=30, seed=7),
        "boosted": lambda: GBTClassifier(**given, weightCol="weight", maxIter=10, seed=7),
        "factors": lambda: FMClassifier(**given, factorSize=4, maxIter=30, seed=7),
        "perceptron": lambda: MultilayerPerceptronClassifier(**given, layers=[width, 16, 2], maxIter=40, seed=7),
    }
    within = {"complement_bayes": [NotBelow("scaled")]}
    return {name: (lambda f=f, more=within.get(name, []): [scaled, *more, f()]) for name, f in made.items()}


def out_of_fold(df: DataFrame, fold: str, folds: int, stages: Callable[[int], list], label: str, out: str, id_: str = "id") -> DataFrame:
    """id, out: each fold's rows are scored by a model of the others."""
    parts = []
    for f in range(folds):
        rows = staged(balanced(df.where((F.col(fold) != f) & F.col(label).isNotNull()), label), "training")
        n = rows.count()
        parts.append(positive(Pipeline(stages=stages(n)).fit(rows).transform(df.where(F.col(fold) == f))).select(id_, F.col("score").alias(out)))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got


def routed(score: Column, kind: Column, handlers: dict[str, Column]) -> Column:
    """The score, but for rows of a kind that has a handler of its own and for which it has an opinion."""
    out = score
    for name, own in handlers.items():
        out = F.when((kind == name) & own.isNotNull(), own).otherwise(out)
    return out
