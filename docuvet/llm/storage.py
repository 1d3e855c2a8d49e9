"""Results that several later steps read, kept where every executor can read them again."""

from pyspark.sql import DataFrame

from docuvet.sources.shared import new_path, shared_folder

__all__ = ["new_path", "shared_folder", "stored"]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: lost executors lose nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
