"""Small files beside tables, through the file system that Spark itself uses."""

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    """The file system of a path and the path in its own form."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and modification times (milliseconds) in a folder; nothing where there is none."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(target)]


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, or not at all: False where one of that name is there already.

    The text goes to a name of its own first; a rename that refuses an existing target then decides between several writers.
    """
    fs, target = _fs(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(beside, target, no_overwrite)
    except Exception as e:
        fs.delete(beside, False)
        if fs.exists(target):
            return False
        raise e
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)
