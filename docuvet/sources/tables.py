"""Reading tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set to ``true`` by the local session alone: scans of fewer splits than cores are dealt anew. A table of one small file otherwise
#: keeps one core busy and leaves the rest idle. On a cluster a scan has more splits than cores, and this stays unset.
REDEAL = "spark.docuvet.redealSmallScans"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    if spark.conf.get(REDEAL, "false") != "true":
        return df
    cores = spark.sparkContext.defaultParallelism
    # Columns that are not read further down are pruned below the exchange too.
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_dealt(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table whose rows are costly further down, dealt by its key to as many tasks as a shuffle has, three a core at least.

    The number of splits says little: one row group goes to one task, however many splits its file has. Only the columns that are
    read further down are dealt, and joins by the same key need no shuffle of the wide rows that grow from them.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return spark.read.parquet(path).repartition(tasks, F.col(key))
