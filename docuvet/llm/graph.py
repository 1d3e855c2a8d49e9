"""Connected groups from links, as joins and aggregates over the links."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docuvet.llm.storage import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``id`` and ``component_id`` (smallest id reachable) of every id that has a link to another.

    Large-star and small-star steps in turn: each id hangs its larger neighbours, then its smaller ones, below its
    smallest neighbour, until only stars are left. The minimum per id combines before the shuffle and comes back by an equi-join,
    which Spark splits for an id with very many links. Null ids, self links and repeated links change nothing; no links, no rows.
    """
    edges = stored(
        links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).filter("a <> b").distinct(), "links"
    )
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        ).select("e.a", "e.b").filter("a <> b").distinct()
        edges = stored(small, "links")
        # Stars: every id hangs below one other, and nothing hangs below it.
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        if not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").limit(1).count():
            break
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component_id")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )


def numbered(df: DataFrame, group: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """Gapless position from 0 of each row within its ``group``, counted by ``part`` first and then inside each part.

    ``part`` must order before ``order``; only the counts per (group, part) meet in one place.
    """
    counts = df.groupBy(*group, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1
    ranked = df.withColumn("_inside", inside)
    return ranked.join(offsets, [*group, part]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_inside", "_before")
