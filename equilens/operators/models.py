"""Classifiers as Spark ML pipelines: encode -> assemble -> fit -> score.

The scored table has the method's layout: label_Y, pred_Y, score_S (P(y=1)
or, for a model without probabilities, its hard label) plus the protected
columns, so every metric operator applies unchanged.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import (OneHotEncoder, OneHotEncoderModel, StringIndexer, StringIndexerModel, VectorAssembler, VectorSizeHint,
                                VectorSlicer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.operators import perceptron, trees
from equilens.spec import AuditSpec

SEED = 0


def vector_width(df: DataFrame, col: str) -> int:
    """Length of a vector column, from the metadata that the feature stages attach."""
    return int(df.schema[col].metadata["ml_attr"]["num_attrs"])


class DropLastSlot(Transformer):
    """Cuts the last slot off a vector column."""

    def __init__(self, input_col: str, output_col: str):
        super().__init__()
        self.input_col, self.output_col = input_col, output_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n = vector_width(dataset, self.input_col) - 1
        if n > 0:
            return VectorSlicer(inputCol=self.input_col, outputCol=self.output_col, indices=list(range(n))).transform(dataset)
        empty = dataset.withColumn(self.output_col, array_to_vector(F.array().cast("array<double>")))
        return VectorSizeHint(inputCol=self.output_col, size=0, handleInvalid="optimistic").transform(empty)


def feature_stages(spec: AuditSpec, features_col: str = "features"):
    """One-hot without the first level (levels in descending order, the last one left out); numerics as they are.

    A level not seen in training gets all zeros, like the first level: the indexer puts it into an
    extra index, and the vector keeps only the slots of the seen levels but the first.
    """
    cat = list(spec.categorical)
    stages, oh = [], []
    if cat:
        idx, full, oh = ([f"{c}__{k}" for c in cat] for k in ("idx", "all", "oh"))
        stages.append(StringIndexer(inputCols=cat, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetDesc"))
        # with the extra index, dropping the last slot leaves one slot for each seen level
        stages.append(OneHotEncoder(inputCols=idx, outputCols=full, dropLast=True))
        stages += [DropLastSlot(f, o) for f, o in zip(full, oh)]
    stages.append(VectorAssembler(inputCols=list(spec.numerical) + oh, outputCol=features_col, handleInvalid="keep"))
    return stages


# the method grows trees without a bound; Spark allows a depth of 30 at most.  A forest of 100
# trees that deep holds up to one node for each row and tree, so its default is lower: raise
# ``max_depth`` where the executors' memory allows it
MAX_TREE_DEPTH = 30
RF_DEPTH = 12
BOOSTED = ("GBDT", "XGBoost", "LGBM", "CatBoost")


def classifier(name: str, n_train: int | None = None, n_features: int | None = None, label: str = "label_Y",
               max_depth: int | None = None):
    """Factory of the supported classifiers (names as in the method's configuration)."""
    kw = dict(featuresCol="features", labelCol=label)
    if name == "LR":
        return LogisticRegression(regParam=1.0 / max(n_train or 1, 1), elasticNetParam=0.0,
                                  standardization=False, maxIter=100, **kw)
    if name == "LR1000":
        return LogisticRegression(regParam=1.0 / max(n_train or 1, 1), elasticNetParam=0.0,
                                  standardization=False, maxIter=1000, **kw)
    if name == "DT":
        return DecisionTreeClassifier(maxDepth=MAX_TREE_DEPTH, seed=SEED, **kw)
    if name == "RF":
        return RandomForestClassifier(numTrees=100, maxDepth=max_depth or RF_DEPTH, seed=SEED, **kw)
    if name in BOOSTED:
        return GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED, **kw)
    if name == "NB":
        return NaiveBayes(modelType="gaussian", **kw)
    if name == "SVM":
        return LinearSVC(maxIter=100, **kw)
    if name == "MLP":
        return MultilayerPerceptronClassifier(layers=[n_features or 1, 100, 2], seed=SEED, maxIter=100, **kw)
    raise ValueError(f"unsupported classifier type: {name}")


def fit(train: DataFrame, spec: AuditSpec, name: str = "LR", label: str = "label_Y"):
    fe = Pipeline(stages=feature_stages(spec)).fit(train)
    n_features = vector_width(fe.transform(train), "features")
    n_train = train.count() if name.startswith("LR") else None
    clf = classifier(name, n_train, n_features, label)
    return Pipeline(stages=[fe, clf]).fit(train)


def linear_terms(model):
    """``(intercept, {feature: what it adds})`` of a logistic regression by :func:`fit`; None for any other model.

    A number adds the number times a factor, a category ``{level: term}`` (0 for levels not named there).
    The prediction is 1 where the sum is over 0.
    """
    def flat(m):
        return [x for s in m.stages for x in flat(s)] if isinstance(m, PipelineModel) else [m]
    *stages, lr = flat(model)
    if len(stages) < 1 or not isinstance(lr, LogisticRegressionModel) or lr.numClasses > 2 or not isinstance(stages[-1], VectorAssembler):
        return None
    levels, *drops = {}, *stages[:-1]
    if drops:
        index, *drops = drops
        if not isinstance(index, StringIndexerModel) or not drops or not isinstance(drops[0], OneHotEncoderModel) \
                or not all(isinstance(d, DropLastSlot) for d in drops[1:]):
            return None
        levels = dict(zip(index.getInputCols(), index.labelsArray))
    inputs, w, at, added = stages[-1].getInputCols(), lr.coefficients.toArray(), 0, {}
    named = {f"{c}__oh": c for c in levels}
    for x in inputs:
        if x in named:
            values = list(levels[named[x]])[:-1]              # the last level has no slot
            added[named[x]] = {v: float(w[at + i]) for i, v in enumerate(values) if at + i < len(w)}
            at += len(values)
        else:
            added[x] = float(w[at]) if at < len(w) else 0.0
            at += 1
    if at != len(w) or len(added) != len(inputs) or {*named.values()} - {*added}:
        return None
    t = lr.getThreshold()
    return lr.intercept - (math.log(t / (1 - t)) if 0 < t < 1 else math.inf if t >= 1 else -math.inf), added


def score(model, df: DataFrame, spec: AuditSpec, label: str = "label_Y", keep=()) -> DataFrame:
    out = model.transform(df)
    pred = F.col("prediction").cast("int")
    if "probability" in out.columns:
        s = vector_to_array(F.col("probability"))[1]
    else:
        s = F.col("prediction").cast("double")
    return out.select(*keep, F.col(label).cast("int").alias("label_Y"), pred.alias("pred_Y"),
                      s.alias("score_S"), *spec.protected)


def fit_score(train: DataFrame, test: DataFrame, spec: AuditSpec, name: str = "LR", label: str = "label_Y",
              keep=()) -> DataFrame:
    """Trees and perceptron are fitted by passes over packed rows (:mod:`trees`, :mod:`perceptron`); the other models are the library's."""
    if name == "DT":
        return trees.tree_fit_score(train, test, spec, MAX_TREE_DEPTH, label, keep)
    if name == "RF":
        return trees.score_forest(trees.fit_forest(train, spec, 100, RF_DEPTH, label), test, spec, label, keep)
    if name in BOOSTED:
        return trees.score_boosted(trees.fit_boosted(train, spec, 100, 3, 0.1, label), test, spec, label, keep)
    if name == "MLP":
        return perceptron.score_mlp(perceptron.fit_mlp(train, spec, classifier, label), test, spec, label, keep)
    return score(fit(train, spec, name, label), test, spec, label, keep)
