"""Session settings."""

from pyspark.sql import SparkSession

from docuvet.sources.tables import REDEAL

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Methods beyond 8000 bytes of bytecode are never compiled by the JVM; let such stages fall
    # back to one generated class per operator, whose methods are split.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording the call site of every column expression makes long chains slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).config(REDEAL, "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
