"""One-class anomaly scores, their learned threshold, and learned fusion of module scores.

These follow the written design of the original; its code does not contain them.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FEATURES = 200
#: Partitions' moments are joined in so many groups before they meet.
MOMENT_GROUPS = 32


@dataclass(frozen=True)
class GenuineModel:
    """Means and inverse covariance of the features of genuine documents."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    precision: tuple[tuple[float, ...], ...]


def _moments(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and sums of products of deviations of complete rows."""
    rows = rows[~np.isnan(rows).any(1)]
    mean = rows.mean(0) if len(rows) else np.zeros(rows.shape[1])
    return len(rows), mean, (rows - mean).T @ (rows - mean)


def _joined_moments(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / max(n, 1)), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / max(n, 1))


def fit_genuine(genuine: DataFrame, features: tuple[str, ...]) -> GenuineModel:
    """Means and covariances in one pass: one matrix of moments a partition, joined in ``MOMENT_GROUPS`` groups, then here.

    A row with a missing feature is not used. Only the matrix of at most ``MAX_FEATURES`` squared numbers is inverted here.
    """
    width = len(features)
    if width > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features")
    nothing = 0, np.zeros(width), np.zeros((width, width))

    def packed(part: int, moments: tuple[int, np.ndarray, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [moments[0]], "mean": [moments[1].tobytes()], "products": [moments[2].tobytes()]})

    def unpacked(rows) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return [(int(n), np.frombuffer(mean), np.frombuffer(products).reshape(width, width)) for n, mean, products in rows]

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = nothing
        for batch in batches:
            total = _joined_moments(total, _moments(batch.to_numpy(float)))
        yield packed(TaskContext.get().partitionId() % MOMENT_GROUPS, total)

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        return packed(0, reduce(_joined_moments, unpacked(rows[["n", "mean", "products"]].itertuples(index=False))))

    layout = "part int, n long, mean binary, products binary"
    values = genuine.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)])
    groups = values.mapInPandas(of_partition, layout).groupBy("part").applyInPandas(of_group, layout).collect()
    n, mean, products = reduce(_joined_moments, unpacked((r.n, r.mean, r.products) for r in groups), nothing)
    precision = np.linalg.pinv(products / max(n - 1, 1), hermitian=True)
    return GenuineModel(tuple(features), tuple(mean.tolist()), tuple(map(tuple, precision.tolist())))


def with_anomaly(df: DataFrame, model: GenuineModel) -> DataFrame:
    """Rows with ``distance`` and ``contributions`` (shares of each feature in its square), for any number of features.

    Matrix products over whole batches; the plan does not grow with the features, as that of ``anomaly_distance`` does. A
    missing feature gives nulls.
    """
    means, precision = np.array(model.means), np.array(model.precision)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gaps = np.stack([np.array([np.nan if v is None else v for v in row], float) for row in batch]) - means
            shares = gaps * (gaps @ precision)
            squared = shares.sum(1)
            whole = ~np.isnan(squared)
            yield pd.DataFrame({
                "distance": np.where(whole, np.sqrt(np.maximum(squared, 0)), None), "contributions": [s if w else None for s, w in zip(shares, whole, strict=True)]
            })

    judged = F.pandas_udf(run, "distance double, contributions array<double>")
    values = F.array(*[F.col(c).cast("double") for c in model.features])
    return df.withColumn("_a", judged(values)).select(*df.columns, F.col("_a.distance").alias("distance"), F.col("_a.contributions").alias("contributions"))


def contributions(model: GenuineModel) -> list[Column]:
    """Share of each feature in the squared distance; they add up to it."""
    gaps = [F.col(c).cast("double") - m for c, m in zip(model.features, model.means, strict=True)]
    return [
        gap * reduce(lambda a, b: a + b, [other * w for other, w in zip(gaps, weights, strict=True)])
        for gap, weights in zip(gaps, model.precision, strict=True)
    ]


def anomaly_distance(model: GenuineModel) -> Column:
    """Mahalanobis distance of a document from the genuine ones, as one expression; for a few features (else ``with_anomaly``).

    A missing feature gives NULL.
    """
    squared = reduce(lambda a, b: a + b, contributions(model))
    return F.when(squared >= 0, F.sqrt(squared)).when(squared < 0, 0.0)


def learned_threshold(genuine: DataFrame, distance: str, share: float = 0.95) -> DataFrame:
    """Distance that the given share of a genuine validation split stays within, exactly, from counts per distance."""
    return genuine.agg(F.percentile(F.col(distance), share).alias("threshold"))


def learned_fusion(cases: DataFrame, labelled: DataFrame, scores: tuple[str, ...], label: str) -> DataFrame:
    """Cases with the fraud probability of a logistic regression over the module scores, fitted on the labelled cases.

    A missing score counts as 0. Fitting is Spark's own distributed one.
    """
    filled = lambda df: df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in scores})
    assemble = VectorAssembler(inputCols=[f"_{c}" for c in scores], outputCol="_scores")
    rows = assemble.transform(filled(labelled)).select("_scores", F.col(label).cast("double").alias("_label"))
    model = LogisticRegression(featuresCol="_scores", labelCol="_label", regParam=0.01, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_d").fit(rows)
    scored = model.transform(assemble.transform(filled(cases)))
    return scored.withColumn("fraud_probability", vector_to_array("_p")[1]).select(*cases.columns, "fraud_probability")
