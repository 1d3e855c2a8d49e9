"""Token counts of documents in flat token files, found by their end-of-document ids alone."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docuvet.llm.bpe import coder
from docuvet.llm.textops import portions

#: Ids are little-endian unsigned 16-bit numbers. 0 ends a document; the vocabulary's id n is written as n + 1.
WIDTH, END = 2, 0
#: A record begins with its document's number in so many digits to the base 2**15, each plus one; a missing number is all ones.
KEY_IDS, KEY_BASE, NO_KEY = 5, 1 << 15, (1 << 16) - 1
#: Ids of a block.
BLOCK = 1 << 19


def key_ids(doc_ids: np.ndarray) -> np.ndarray:
    """Digits of 64-bit document numbers, last digit first."""
    rest, out = doc_ids.astype(np.int64).view(np.uint64), np.empty((len(doc_ids), KEY_IDS), "<u2")
    for n in range(KEY_IDS):
        out[:, n] = rest % np.uint64(KEY_BASE) + np.uint64(1)
        rest = rest // np.uint64(KEY_BASE)
    return out


def document_numbers(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers of rows of digits, and which rows have one."""
    out = np.zeros(len(digits), np.uint64)
    for n in range(KEY_IDS - 1, -1, -1):
        out = out * np.uint64(KEY_BASE) + (digits[:, n].astype(np.uint64) - np.uint64(1))
    return out.view(np.int64), (digits != NO_KEY).all(1)


def write_token_files(documents: DataFrame, path: str, ranks_path: str, pattern: str) -> None:
    """Write document records (``doc_id``, ``raw_text``) as flat token files without an index, one file a task.

    Spark's text writer puts the bytes of a record and then the end id as its line separator. Null and empty texts are records
    without ids. Repeated rows are written as often as they come. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(ranks_path, pattern)
        for batch in (part for whole in batches for part in portions(whole, 1)):
            numbers = batch.column(0)
            keys = key_ids(numbers.fill_null(0).to_numpy(zero_copy_only=False))
            keys[np.asarray(numbers.is_null())] = NO_KEY
            records = [
                key.tobytes() + (np.array(encoding.encode_ordinary(text or ""), np.int64) + 1).astype("<u2").tobytes()
                for key, text in zip(keys, batch.column(1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    records = documents.select(F.col("doc_id").cast("long"), F.col("raw_text").cast("string")).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0" * WIDTH).text(path)


def _scan(payload: bytes, begins: bool, block: int, keyed: int) -> list[tuple[np.ndarray, ...]]:
    """Complete documents, the open start and the first end of one block.

    ``payload``: the block and, after it, as many ids as a key has. ``begins``: whether a document begins with the block.
    Returns (start, end, key position) of complete documents, then the same of the open one, and the end of one begun earlier.
    """
    ids = np.frombuffer(payload, "<u2")
    own = min(block, len(ids))
    ends = np.flatnonzero(ids[:own] == END)
    starts = ends + 1
    starts = starts[starts < own]
    if begins and own:
        starts = np.concatenate([[0], starts])
    earlier = ends[:1] if len(ends) and not begins else ends[:0]
    closed = ends[len(earlier) :]
    return [starts[: len(closed)], closed, starts[len(closed) :], earlier]


def token_counts(spark: SparkSession, path: str, block: int = BLOCK, keyed: bool = True) -> DataFrame:
    """Documents in flat token files: file, start (position of the first id), n_tokens, closed and, if ``keyed``, doc_id.

    Files are cut into blocks of ``block`` ids, each searched for end ids at once, with one id before and a few behind it. What a
    block cannot tell is where a document ends that it leaves open; a scan over the open starts and first ends of each file's
    blocks, two at most a block, joins them. Screening keeps no token files of its own, so this works on any file of 16-bit ids
    that 0 separates; Spark reads a file of up to 2 GB. A file's last document without an end id is not ``closed``. Empty files have
    no documents; two end ids in a row hold one without ids. With ``keyed``, the ids of the key are not counted, and doc_id is
    null where it was or where the record is too short for a key.
    """
    extra = KEY_IDS if keyed else 0
    size = F.col("length")
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length", "content")
    at = F.col("block") * (block * WIDTH)
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / (block * WIDTH))))).select(
        F.col("path").alias("file"), "length", "block",
        F.substring("content", (F.greatest(at - WIDTH, F.lit(0)) + 1).cast("int"), (F.lit((block + extra + 1) * WIDTH) - F.when(F.col("block") == 0, WIDTH).otherwise(0)).cast("int")).alias("part"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                file, length, number, part = (batch.column(c)[n].as_py() for c in range(4))
                begins = number == 0
                if number:
                    begins, part = int.from_bytes(part[:WIDTH], "little") == END, part[WIDTH:]
                begun, closed, left, earlier = _scan(part, begins, block, extra)
                first = np.concatenate([begun, left, earlier])
                kind = np.repeat([0, 1, 2], [len(begun), len(left), len(earlier)])
                base = number * block
                numbers, known = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
                if keyed:
                    ids = np.append(np.frombuffer(part, "<u2"), np.zeros(extra, "<u2"))
                    digits = ids[np.minimum(first[:, None] + np.arange(extra), len(ids) - 1)]
                    numbers, known = document_numbers(np.where(digits == END, NO_KEY, digits))
                end = np.concatenate([closed, np.full(len(left) + len(earlier), length // WIDTH - base)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([file] * len(first), pa.string()), pa.array(np.full(len(first), number), pa.int64()), pa.array(kind, pa.int32()),
                    pa.array(first + base, pa.int64()), pa.array(end + base, pa.int64()), pa.array(numbers, pa.int64(), mask=~known),
                ], names=["file", "block", "kind", "start", "end", "doc_id"])

    found = blocks.mapInArrow(run, "file string, block long, kind int, start long, end long, doc_id long")
    complete = found.filter("kind = 0").select("file", "start", "end", "doc_id", F.lit(True).alias("closed"))
    # Order inside a block: the end of an earlier document, then an open start.
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    boundary = found.filter("kind > 0").withColumns({"next_kind": F.lead("kind").over(order), "next_at": F.lead("start").over(order)})
    ended = F.coalesce(F.col("next_kind") == 2, F.lit(False))
    opened = boundary.filter("kind = 1").select(
        "file", "start", F.when(ended, F.col("next_at")).otherwise(F.col("end")).alias("end"), "doc_id", ended.alias("closed")
    )
    counted = complete.unionByName(opened).withColumn("n_tokens", F.greatest(F.col("end") - F.col("start") - extra, F.lit(0)))
    return counted.select("file", "start", "n_tokens", "closed", *["doc_id"] * keyed)
