"""Models on feature tables with spark.ml, and the selections and grids around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators import metrics as m
from sieveline.plans.guards import both_classes, guarded
from sieveline.plans.ordered import running_sums
from sieveline.session import cut_lineage

FLAT = 1e-6


def standardise(train: DataFrame, target: DataFrame, features: Sequence[str], flat: float = FLAT) -> DataFrame:
    """Target features minus the training mean over the training population deviation; flat features use 1."""
    missing = [f for f in features if f not in target.columns]
    if missing:
        raise ValueError(f"target lacks features: {missing}")
    stats = train.agg(
        F.struct(
            *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
            *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)],
        ).alias("t")
    ).scalar()
    out = target.withColumn("_t", stats)
    scale = lambda i: F.when(F.col(f"_t.s_{i}") < flat, 1.0).otherwise(F.col(f"_t.s_{i}"))
    return out.withColumns({f: (F.col(f) - F.col(f"_t.m_{i}")) / scale(i) for i, f in enumerate(features)}).drop("_t")


@dataclass(frozen=True)
class ScaledLogistic:
    """A fitted scaler and logistic model, applied as one expression."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def logit(self) -> Column:
        total = F.lit(self.intercept)
        for name, mean, scale, weight in zip(self.features, self.means, self.scales, self.weights):
            total = total + (F.col(name) - mean) / scale * weight
        return total

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return df.withColumn(out, 1.0 / (1.0 + F.exp(-self.logit())))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add `weight` = n / (2 n_label)."""
    totals = df.agg(
        F.struct(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).alias("t")
    ).scalar()
    n = F.col("_t.p") + F.col("_t.n")
    own = F.when(F.col(label) == 1, F.col("_t.p")).otherwise(F.col("_t.n"))
    return df.withColumn("_t", totals).withColumn("weight", n / (2.0 * own)).drop("_t")


def fit_scaled_logistic(
    train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, balanced: bool = True, max_iter: int = 200
) -> ScaledLogistic:
    """L2 logistic regression of strength C on standardised features; rows with equal features are counted once."""
    if c <= 0:
        raise ValueError("C must be positive")
    features = list(features)
    checked = guarded(train, [both_classes(train, label)])
    rows = checked.groupBy(*features, label).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        stats = train.agg(
            *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
            *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)],
            F.count_if(F.col(label) == 1).alias("p"),
            F.count(F.lit(1)).alias("n"),
        ).first()
        k = len(features)
        means = [float(stats[i]) for i in range(k)]
        scales = [float(stats[k + i]) or 1.0 for i in range(k)]
        p, n = stats["p"], stats["n"]
        per_label = F.when(F.col(label) == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p))) if balanced else F.lit(1.0)
        vector = array_to_vector(F.array(*[(F.col(f) - mu) / sd for f, mu, sd in zip(features, means, scales)]))
        data = rows.select(vector.alias("features"), F.col(label).cast("double").alias("label"), (F.col("_n") * per_label).alias("w"))
        model = LogisticRegression(
            weightCol="w", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter, tol=1e-8
        ).fit(data)
    finally:
        rows.unpersist()
    return ScaledLogistic(
        tuple(features), tuple(means), tuple(scales), tuple(float(x) for x in model.coefficients), float(model.intercept)
    )


def _assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def random_forest(label: str, trees: int = 300, min_leaf: int = 2, seed: int = 7) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, numTrees=trees, minInstancesPerNode=min_leaf, weightCol="weight", seed=seed
    )


def boosting(label: str, rounds: int = 300, rate: float = 0.05, seed: int = 7) -> GBTClassifier:
    return GBTClassifier(labelCol=label, maxIter=rounds, stepSize=rate, seed=seed)


def perceptron(label: str, width: int, hidden: int = 128, rounds: int = 100, seed: int = 7) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol=label, layers=[width, hidden, 2], maxIter=rounds, seed=seed)


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, estimator) -> PipelineModel:
    """Assemble, weigh the classes evenly, fit."""
    return Pipeline(stages=[_assembled(features), estimator]).fit(balanced_weights(train, label))


def classifier_score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the fake class."""
    staged = df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))
    scored = model.transform(staged).withColumn(out, F.get(vector_to_array("probability"), 1))
    return scored.drop("features", "rawPrediction", "probability", "prediction", "weight")


def cross_dataset_score(path: str, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Apply a saved model to another dataset with the same feature set."""
    model = PipelineModel.load(path)
    wanted = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    if list(wanted) != list(features):
        raise ValueError("the saved model was fitted on another feature set")
    return classifier_score(model, df)


def long_features(df: DataFrame, ident: str, label: str, vector: str) -> DataFrame:
    return df.select(ident, F.col(label).alias("label"), F.posexplode(vector).alias("feature", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def anova_f(long: DataFrame) -> DataFrame:
    """F statistic per feature from class-wise sums: one pass, combined on the map side."""
    cells = long.groupBy("feature", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")
    )
    sums = cells.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
    )
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return sums.select("feature", (between / within).alias("f_value"))


def binned_mutual_information(long: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information of the label and the equal-frequency bin of each feature."""
    counts = long.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    per_value = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    placed = running_sums(per_value, ["feature"], "value", ["n"]).select(
        "feature",
        "value",
        F.col("n_all").alias("total"),
        F.floor(F.col("n_below") * F.lit(bins) / F.col("n_all")).cast("int").alias("bin"),
    )
    cells = counts.join(placed, ["feature", "value"]).groupBy("feature", "bin", "label", "total").agg(F.sum("n").alias("n"))
    rows = cells.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    cols = cells.groupBy("feature", "label").agg(F.sum("n").alias("n_label"))
    joined = cells.join(rows, ["feature", "bin"]).join(cols, ["feature", "label"])
    part = F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("n_bin") * F.col("n_label")))
    return joined.groupBy("feature").agg(F.sum(part).alias("mutual_information"))


def select_k(values: DataFrame, value: str, k: int) -> DataFrame:
    """The k best features by a value; the feature number breaks ties."""
    return values.orderBy(F.desc(value), "feature").limit(k)


def anova_selector(df: DataFrame, features: Sequence[str], label: str, k: int) -> list[str]:
    """Names kept by spark.ml's own F-test selector."""
    selector = UnivariateFeatureSelector(featuresCol="features", outputCol="kept", labelCol=label, selectionMode="numTopFeatures")
    selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    model = selector.fit(_assembled(features).transform(df))
    return [features[i] for i in sorted(model.selectedFeatures)]


def knn_head_blend(
    votes: DataFrame, heads: DataFrame, weights: Sequence[float], apcer_weight: float = 0.2
) -> DataFrame:
    """Metrics of w * head + (1 - w) * neighbours over k x temperature x w.

    `votes` has (query_id, k, temperature, score), `heads` has (query_id, y_true, head_score).
    """
    grid = F.array(*[F.lit(float(w)) for w in weights])
    rows = votes.join(heads, "query_id").withColumn("head_weight", F.explode(grid))
    blend = F.col("head_weight") * F.col("head_score") + (1.0 - F.col("head_weight")) * F.col("score")
    keys = ["k", "temperature", "head_weight"]
    running = m.running(rows.select(*keys, "y_true", blend.alias("score")), keys)
    both = m.join_groups(m.summarise_running(running, keys), m.operating_metrics_of(running, keys), keys)
    return m.selection_objective(both, apcer_weight).select(
        *keys, "accuracy", "roc_auc", "apcer", "audet_proxy", "selection_objective"
    )


def out_of_fold_scores(
    df: DataFrame, ident: str, features: Sequence[str], label: str, folds: DataFrame, n_folds: int, fit: Callable
) -> DataFrame:
    """Every row scored by the model of the other folds. `fit(train)` returns an object with `score(rows)`."""
    # read once per fold: written out once instead of being derived again each time
    rows = cut_lineage(df.join(folds.select(ident, "fold"), ident))
    out = None
    for fold in range(n_folds):
        model = fit(rows.where(F.col("fold") != fold))
        one = model.score(rows.where(F.col("fold") == fold))
        out = one if out is None else out.unionByName(one)
    return out


def ablation_grid(
    tables: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]],
    label: str,
    cs: Sequence[float],
    seeds: Sequence[int],
) -> DataFrame:
    """Metrics of every feature set x strength x seed. A cell is one Spark job on a cached feature table.

    `tables` maps a set name to (train, test, features); both carry a `seed` column.
    """
    out = None
    for name, (train, test, features) in tables.items():
        for c in cs:
            for seed in seeds:
                model = fit_scaled_logistic(train.where(F.col("seed") == seed), features, label, c)
                scored = model.score(test.where(F.col("seed") == seed)).select(
                    F.lit(name).alias("feature_set"),
                    F.lit(float(c)).alias("c"),
                    F.lit(int(seed)).alias("seed"),
                    F.col(label).alias("y_true"),
                    "score",
                )
                out = scored if out is None else out.unionByName(scored)
    return m.binary_metrics(cut_lineage(out), ["feature_set", "c", "seed"])
