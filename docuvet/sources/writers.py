"""Writers for verification history and dossiers."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuvet.operators.history import BUCKET, owner_bucket, upsert


def write_verifications(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A whole history, in folders by a hash of the owner, so that reading one tenant reads one folder."""
    records.withColumn(BUCKET, owner_bucket(F.col("owner_id"))).write.mode(mode).partitionBy(BUCKET).parquet(path)


def merge_verifications(spark: SparkSession, batch: DataFrame, path: str, order=("timestamp", "version")) -> None:
    """Merge a batch into a stored history; only the folders of the batch's owners are written anew.

    A case lies in its owner's folder and nowhere else, whatever its decision, so it stays single. The merged folders are written
    beside the history first and replace the old ones after that; if the job is lost meanwhile, running it again repairs it.
    """
    batch = batch.withColumn(BUCKET, owner_bucket(F.col("owner_id")))
    # At most one number per folder.
    touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())
    if not touched:
        return
    stored = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched))
    merged = upsert(stored, batch.select(*stored.columns), order)
    beside = f"{path.rstrip('/')}/_merging-{uuid.uuid4().hex}"
    merged.write.parquet(beside)
    spark.read.schema(merged.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dossier_json(dossiers: DataFrame) -> DataFrame:
    """One JSON text per case."""
    return dossiers.select("case_id", F.to_json(F.struct("*")).alias("value"))


def write_dossiers_whole(dossiers: DataFrame, path: str) -> None:
    """JSON lines of the whole documents (``dossier``, a VARIANT) as they were read, unknown keys included."""
    dossiers.select(F.to_json("dossier").alias("value")).write.mode("overwrite").text(path)


def write_dossiers(dossiers: DataFrame, path: str) -> None:
    """JSON lines, one case document per line."""
    dossier_json(dossiers).select("value").write.mode("overwrite").text(path)
