"""Models on pyspark.ml; features come from windows over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W

FEATURES = ("z20", "roc5", "stoch", "range_ratio", "volume_ratio")


def features(bars: DataFrame, horizon: int, band: float) -> DataFrame:
    """Adds FEATURES and label: 2 up, 0 down, 1 flat, by the mean of the next closes; rows without all of them are left out."""
    ahead = W.by_symbol().rowsBetween(1, horizon)
    move = F.avg("close").over(ahead) - F.col("close")
    b = bars.withColumns({
        "z20": W.zscore("close", 20), "roc5": W.roc("close", 5), "stoch": W.stochastic_k(14),
        "range_ratio": (F.col("high") - F.col("low")) / F.nullif(F.avg(F.col("high") - F.col("low")).over(W.last_n(20)), F.lit(0.0)),
        "volume_ratio": F.col("volume") / F.nullif(W.sma("volume", 20), F.lit(0.0)),
        "label": F.when(move > band, 2.0).when(move < -band, 0.0).otherwise(1.0),
    }).withColumn("_full", F.count("close").over(ahead))
    return b.where(F.col("_full") == horizon).drop("_full").dropna(subset=list(FEATURES))


def forest(train: DataFrame, test: DataFrame, trees: int = 20, depth: int = 5, seed: int = 7) -> tuple[DataFrame, object]:
    """(test with prediction, the model) of a three-class random forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="x"),
        RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)
    return model.transform(test), model


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def regimes(rows: DataFrame, cols: list[str], k: int = 3, seed: int = 7) -> DataFrame:
    """Adds regime: the Gaussian-mixture state of each row, states numbered by the size of their covariance."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="skip").transform(rows)
    model = GaussianMixture(featuresCol="_x", predictionCol="_p", probabilityCol="_prob", k=k, seed=seed).fit(v)
    size = {k: float(sum(r.cov.toArray().diagonal())) for k, r in enumerate(model.gaussiansDF.collect())}
    place = {state: n for n, state in enumerate(sorted(size, key=size.get))}
    return model.transform(v).withColumn("regime", F.element_at(F.create_map(*(F.lit(x) for kv in place.items() for x in kv)),
        F.col("_p"))).drop("_x", "_p", "_prob")
