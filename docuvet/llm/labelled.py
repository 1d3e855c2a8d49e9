"""A bounded, repeatable sample of labelled document texts to learn from."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer texts are scored like all others, but not learnt from: the sample must fit the driver.
LONGEST = 100_000


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int, columns: tuple[str, ...] = (), longest: int = LONGEST) -> pa.Table:
    """``raw_text``, 0/1 ``label`` and numeric ``columns`` (as _0, _1, ...) of at most ``most`` labelled documents, chosen and ordered by a hash of doc_id.

    A label that is null or neither 0 nor 1 counts as none; of several labels of one document the largest holds. The chosen ids,
    ``most`` at most, are broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.orderBy(*order).limit(most)
    texts = documents.select("doc_id", "raw_text", *[F.col(c).cast("double").alias(f"_{n}") for n, c in enumerate(columns)]).join(F.broadcast(chosen), "doc_id").filter(
        F.coalesce(F.length("raw_text"), F.lit(0)) <= longest
    )
    return texts.dropDuplicates(["doc_id"]).orderBy(*order).select(
        F.coalesce("raw_text", F.lit("")).alias("raw_text"), "label", *[f"_{n}" for n in range(len(columns))]
    ).toArrow()
