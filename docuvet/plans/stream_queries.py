"""Queries that run a stream over stored results to its end."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuvet.plans.registry import query
from docuvet.plans.risk_queries import RISK
from docuvet.sources.shared import new_path
from docuvet.streaming.cases import decide_case_stream

#: A row of its own at this time in each source ends the waiting of all others.
CLOSING = "2100-01-01 00:00:00"
EVENT_TIMES = {"case_documents": "screened_at", "case_face_results": "compared_at", "case_liveness_results": "checked_at"}


#: Document results of a slice of time. One slice is one batch, so state holds what two of them leave, not the whole table.
SLICE_ROWS = 1_000_000


def slice_bounds(rows: DataFrame, at: str) -> list[float]:
    """Seconds at which the slices after the first begin; a time is never cut."""
    slices = -(-rows.count() // SLICE_ROWS)
    places = rows.select(F.col(at).cast("double").alias("at")).approxQuantile("at", [n / slices for n in range(1, slices)], 0.2 / slices) if slices > 1 else []
    return sorted(set(places))


def as_stream(rows: DataFrame, path: str, at: str, closing_case: int, bounds: list[float]) -> DataFrame:
    """Rows stored in a folder and read as a stream in the order of time, a file a slice, with a closing row behind them.

    A slice is written when the one before it is, because the source takes files by their time of writing. All times of a slice lie
    behind those of the slices before it in the same stream, and the watermark follows the slowest stream, so no row comes late.
    """
    spark = rows.sparkSession
    starts = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    place = F.coalesce(F.size(F.filter(starts, lambda b: b <= F.col(at).cast("double"))), F.lit(0))
    rows.withColumn("_slice", place).repartition(len(bounds) + 1, "_slice").write.partitionBy("_slice").parquet(f"{path}-slices")
    layout = rows.withColumn("_slice", F.lit(0)).schema
    stored = spark.read.schema(layout).parquet(f"{path}-slices")
    for n in range(len(bounds) + 1):
        # Also a slice without rows is one file: the streams stay side by side.
        stored.filter(F.col("_slice") == n).select(*rows.columns).coalesce(1).write.mode("append").parquet(path)
    end = spark.range(1).select(*[
        F.lit(closing_case if f.name == "case_id" else CLOSING if f.name == at else None).cast(f.dataType).alias(f.name) for f in rows.schema
    ])
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def to_the_end(stream: DataFrame, path: str) -> DataFrame:
    """All rows of a stream over what its sources hold now. State has a partition a core: each costs eleven commits a batch."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


_IN_TIME = "BETWEEN d.screened_at - INTERVAL 10 MINUTE AND d.screened_at + INTERVAL 10 MINUTE"
_STREAM_RISK = RISK.replace("<signals>", "sig").replace("  similarity < 70 AS face_failed", "  has_face AND similarity < 70 AS face_failed").replace(
    "CAST(CASE WHEN similarity < 70", "CAST(CASE WHEN NOT has_face THEN 5 WHEN similarity < 70")


@query("case_stream", f"""
WITH sig AS (SELECT d.*, f.case_id IS NOT NULL AS has_face, coalesce(f.similarity, 95) AS similarity, l.liveness_passed FROM <case_documents> d
LEFT JOIN <case_face_results> f ON d.case_id = f.case_id AND f.compared_at {_IN_TIME} LEFT JOIN <case_liveness_results> l ON d.case_id = l.case_id AND l.checked_at {_IN_TIME})
SELECT case_id, owner_id, has_face, liveness_passed, CAST(risk_score AS DOUBLE) AS risk_score, risk_level, final_decision, recommended_action FROM {_STREAM_RISK}""")
def case_stream(t):
    path = new_path(t.spark, "case-stream")
    bounds = slice_bounds(t.case_documents, EVENT_TIMES["case_documents"])
    store = lambda n, name, at: as_stream(getattr(t, name), f"{path}/{name}", at, -1 - n, bounds)
    with ThreadPoolExecutor(len(EVENT_TIMES)) as pool:
        streams = list(pool.map(store, range(len(EVENT_TIMES)), *zip(*EVENT_TIMES.items(), strict=True)))
    decided = decide_case_stream(*streams).select(
        "case_id", "owner_id", "has_face", "liveness_passed", F.col("risk_score").cast("double").alias("risk_score"), "risk_level", "final_decision", "recommended_action"
    )
    return to_the_end(decided, path).filter("case_id >= 0")
