"""Fraud probability of a random forest over module scores, with what each score contributes to it.

The forest is Spark's own. Its trees, bounded by ``trees`` and ``depth``, are then applied as arrays: the probability of a case is
the mean of the forest plus, along each tree's path, the change of the node's probability at every split, credited to its score.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, DEPTH, SEED = 40, 6, 11


@dataclass(frozen=True)
class Forest:
    """Trees as arrays over their nodes: split feature (-1 at leaves), threshold, children, and probability of fraud."""

    scores: tuple[str, ...]
    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]


def _filled(df: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"_{n}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for n, c in enumerate(scores)})


def _nodes(root) -> tuple[np.ndarray, ...]:
    """Nodes of one tree of Spark's model, parents before children."""
    feature, bound, left, right, value, queue = [], [], [], [], [], [root]
    while queue:
        node = queue.pop(0)
        stats = list(node.impurityStats().stats())
        value.append(stats[1] / sum(stats))
        inner = node.subtreeDepth() > 0
        feature.append(node.split().featureIndex() if inner else -1)
        bound.append(node.split().threshold() if inner else 0.0)
        at = len(value) + len(queue)
        left.append(at if inner else -1)
        right.append(at + 1 if inner else -1)
        if inner:
            queue += [node.leftChild(), node.rightChild()]
    return np.array(feature), np.array(bound), np.array(left), np.array(right), np.array(value)


def fit_forest(labelled: DataFrame, scores: tuple[str, ...], label: str, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Fit on labelled cases; a missing score counts as 0, a case without a label is not learnt from."""
    rows = _filled(labelled.filter(F.col(label).isNotNull()), scores).select(*[f"_{n}" for n in range(len(scores))], F.col(label).cast("double").alias("_label"))
    assembled = VectorAssembler(inputCols=[f"_{n}" for n in range(len(scores))], outputCol="_scores").transform(rows)
    model = RandomForestClassifier(featuresCol="_scores", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled)
    return Forest(tuple(scores), tuple(_nodes(tree.rootNode()) for tree in model._java_obj.trees()))


def _applied(forest: Forest, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability, and contributions by score, of rows of scores."""
    rows, given = np.arange(len(values)), np.zeros_like(values)
    probability = np.zeros(len(values))
    for feature, bound, left, right, value in forest.trees:
        at = np.zeros(len(values), np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            split = np.where(inner, feature[at], 0)
            to = np.where(inner, np.where(values[rows, split] <= bound[at], left[at], right[at]), at)
            given[rows, split] += np.where(inner, value[to] - value[at], 0.0)
            at = to
        probability += value[at]
    return probability / len(forest.trees), given / len(forest.trees)


def score_forest(cases: DataFrame, forest: Forest) -> DataFrame:
    """Cases with ``fraud_probability`` and ``contributions`` (by score, in the order of ``forest.scores``).

    The contributions and the forest's mean at its roots add up to the probability.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            probability, given = _applied(forest, np.stack([c.to_numpy(float) for c in columns], 1))
            yield pd.DataFrame({"probability": probability, "contributions": list(given)})

    scored = F.pandas_udf(run, "probability double, contributions array<double>")
    filled = _filled(cases, forest.scores)
    found = filled.withColumn("_f", scored(*[F.col(f"_{n}") for n in range(len(forest.scores))]))
    return found.select(*cases.columns, F.col("_f.probability").alias("fraud_probability"), F.col("_f.contributions").alias("contributions"))


def mean_probability(forest: Forest) -> float:
    """The forest's probability before any split."""
    return float(np.mean([value[0] for *_, value in forest.trees]))
