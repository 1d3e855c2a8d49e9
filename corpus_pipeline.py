"""From raw documents to packed training sequences: abusive and poor texts go, one of each group of near copies stays."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuvet.llm import near_text, packing, quality, toxicity
from docuvet.llm.storage import stored

MAX_TOKENS = 4096
#: The shingles of near-duplicate stages are of five words here; see ``near_text``.
SHINGLE_WORDS, PER_CENT = 5, 80
ORACLE_SQL = None


def _records(docs: DataFrame) -> DataFrame:
    return docs.withColumnRenamed("text", "raw_text")


def drop_abusive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; a text without words is kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("abusive"))
    model = toxicity.fit_documents(_records(docs), labels)
    score = toxicity.judged(F.col("text").cast("string"), model)["score"]
    return docs.withColumn("_score", score).filter(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("accepted"))
    model = quality.fit_documents(_records(docs), labels, ("n_chars",))
    score = quality.quality_score(model, F.col("text").cast("string"), F.col("n_chars").cast("double"))
    return docs.withColumn("_score", score).filter(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies. A row without doc_id is kept."""
    groups = near_text.link_documents(_records(docs), SHINGLE_WORDS, PER_CENT)
    dropped = groups.filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack_documents(_records(docs), public_tokenizers.path("word_bpe_49k.json"), max_tokens=MAX_TOKENS)


STAGES = [
    ("toxicity", drop_abusive),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
