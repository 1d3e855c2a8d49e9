"""Vector bin packing of tokenised records into training sequences."""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuvet.llm.bpe import WordIds
from docuvet.llm.storage import stored
from docuvet.llm.textops import portions

PIECES_PER_GROUP = 2_000


def cut_documents(
    documents: DataFrame, vocabulary_path: str, end_id: int, max_tokens: int, answer_column: str | None = None
) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of each document's ``raw_text`` followed by ``end_id``.

    Returns doc_id, row_key (of the input row, so that repeated doc_ids stay apart), start, length, loss_length (ids that bear
    loss: all, or those of pieces at or after the character position in ``answer_column``), ids_crc32 (little-endian unsigned
    32-bit ids) and doc_tokens. Every id lies in one piece. Null text: only ``end_id``. Null answer position: all ids bear loss.
    """
    answers = F.lit(0) if answer_column is None else F.coalesce(F.col(answer_column), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(vocabulary_path)
        end = np.array([end_id], "<u4")
        for batch in (part for whole in batches for part in portions(whole, 2)):
            texts = batch.column(2).to_pylist()
            out = {"doc_id": [], "row_key": [], "start": [], "length": [], "loss_length": [], "ids_crc32": [], "doc_tokens": []}
            prompts = batch.column(3).to_pylist()
            asked = [p if t and p and p > 0 else 0 for t, p in zip(texts, prompts, strict=True)]
            before = words.encode([(t or "")[:p] if p else "" for t, p in zip(texts, asked, strict=True)])
            for doc, row, ids, prompt in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), words.encode(texts), before, strict=True
            ):
                ids = np.concatenate([ids, end])
                for at in range(0, len(ids), max_tokens):
                    piece = ids[at : at + max_tokens]
                    out["doc_id"].append(doc)
                    out["row_key"].append(row)
                    out["start"].append(at)
                    out["length"].append(len(piece))
                    out["loss_length"].append(min(len(piece), max(0, at + len(piece) - len(prompt))))
                    out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    out["doc_tokens"].append(len(ids))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), *[(c, pa.int64()) for c in (
        "start", "length", "loss_length", "ids_crc32", "doc_tokens")]])
    return documents.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_key"), F.col("raw_text").cast("string"),
        answers.cast("long").alias("answer"),
    ).mapInArrow(run, "doc_id long, row_key long, start long, length long, loss_length long, ids_crc32 long, doc_tokens long")


def fill(sizes: np.ndarray, limits: np.ndarray, choices: int = 64) -> np.ndarray:
    """Sequence number of each item, by the dot-product heuristic with one open sequence at a time.

    The open sequence takes the fitting item whose demand, as shares of the limits, has the largest weighted dot product with
    the room that is left; weights are the mean demands. Items are kept by their first dimension, largest first; among the
    ``choices`` largest kinds of items that fit, the best wins, which decides as the whole list would while tokens are scarce.
    """
    order = np.lexsort(tuple(sizes[:, d] for d in range(sizes.shape[1] - 1, -1, -1)))
    kinds, first, counts = np.unique(sizes[order], axis=0, return_index=True, return_counts=True)
    taken = np.zeros(len(kinds), np.int64)
    share = kinds / limits
    weights = (share * counts[:, None]).sum(0) / counts.sum()
    alive = np.arange(len(kinds))
    out = np.empty(len(sizes), np.int64)
    sequence, room, remaining = 0, limits.astype(np.int64).copy(), len(sizes)
    while remaining:
        high = int(np.searchsorted(kinds[alive, 0], room[0], "right"))
        best, low = -1, high
        while best < 0 and low > 0:
            high, low = low, max(0, low - choices)
            near = alive[low:high]
            fits = near[(kinds[near] <= room).all(1)]
            if len(fits):
                best = int(fits[np.argmax((share[fits] * (weights * room / limits)).sum(1))])
        if best < 0:
            sequence, room = sequence + 1, limits.astype(np.int64).copy()
            continue
        out[order[first[best] + taken[best]]] = sequence
        taken[best] += 1
        remaining -= 1
        room = room - kinds[best]
        if taken[best] == counts[best]:
            alive = alive[alive != best]
    return out


def pack_pieces(pieces: DataFrame, max_tokens: int, max_segments: int, max_loss: int, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Place pieces (``length``, ``loss_length``) under three limits at once; adds sequence_id and offset.

    A sequence holds at most ``max_tokens`` ids, ``max_segments`` pieces and ``max_loss`` loss-bearing ids. Pieces are dealt by a
    hash of their row and start into groups of about ``per_group``, so that no document, length or source gathers in one task,
    and each group is packed on its own; one part-filled sequence a group is the price. A piece that is over a limit by itself
    is an error of the caller and stops the job.
    """
    pieces = stored(pieces, "pieces")
    groups = max(1, pieces.count() // per_group)
    limits = np.array([max_tokens, max_segments, max_loss])

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["row_key", "start"], ignore_index=True)
        sizes = np.column_stack([batch["length"], np.ones(len(batch), np.int64), batch["loss_length"]]).astype(np.int64)
        if (sizes > limits).any():
            raise ValueError("a piece is larger than a sequence may be")
        batch["sequence_id"] = fill(sizes, limits) * groups + batch["packing_group"]
        batch = batch.sort_values(["sequence_id", "row_key", "start"], ignore_index=True)
        batch["offset"] = batch.groupby("sequence_id")["length"].cumsum() - batch["length"]
        return batch[names]

    names = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in pieces.dtypes], "sequence_id long", "offset long"])
    grouped = pieces.withColumn("packing_group", F.pmod(F.xxhash64("row_key", "start"), F.lit(groups)))
    return grouped.groupBy("packing_group").applyInPandas(run, schema)


def pack_documents(
    documents: DataFrame, vocabulary_path: str, end_id: int = 2, max_tokens: int = 4096, max_segments: int = 512,
    max_loss: int | None = None, answer_column: str | None = None,
) -> DataFrame:
    """Pack document records (``doc_id``, ``raw_text``) into sequences of at most ``max_tokens`` ids.

    Documents longer than a sequence give full sequences and a rest; rests and short documents are placed by vector bin packing
    on tokens, segments and loss-bearing tokens. Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (gapless from 0 in a sequence), loss_length. ``answer_column`` names the character position from which
    a record's text bears loss (instruction data); without it all ids do.
    Null or empty text: one piece, the end id. Repeated rows are packed as often as they come. Other columns are not used. No
    rows in, none out.
    """
    pieces = cut_documents(documents, vocabulary_path, end_id, max_tokens, answer_column)
    packed = pack_pieces(pieces, max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_length")
