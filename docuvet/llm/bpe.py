"""Byte-level BPE of document texts by overlapping chunks, and back."""

import base64
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docuvet.llm.storage import stored
from docuvet.llm.textops import portions

#: Characters of a chunk, and how many more it shares with the next one.
CHUNK = 50_000
OVERLAP = 2_000


@functools.lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def matcher(pattern: str):
    return regex.compile(pattern)


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Ends of pre-tokens of one chunk at which the text may be cut, from the chunk's first character.

    A cut after white space could change how the pattern, which looks ahead there, reads the end of the first part; such ends
    are left out, as is an end at the chunk's own end, where a pre-token may have been cut short.
    """
    ends = [m.end() for m in matcher(pattern).finditer(text) if not m.group()[-1].isspace()]
    return ends if last else [e for e in ends if e < len(text)]


def _encoded(encoding, text: str) -> tuple[int, bytes, bytes, list[int]]:
    ids = encoding.encode_ordinary(text)
    return len(ids), str(ids)[1:-1].replace(" ", "").encode(), encoding.decode_bytes(ids), ids


def _long_documents(long: DataFrame, ranks_path: str, pattern: str, size: int, overlap: int, with_ids: bool, schema: str) -> DataFrame:
    """Long texts: chunk rows, boundaries per chunk, cuts where neighbours agree, segments, digests in the order of segments.

    A boundary of a chunk is one of the text if the chunk is in step with it. Chunk 0 is, and so is every chunk that agrees with a
    neighbour before it that is. A text with neighbours that nowhere agree is cut anew, chunk after chunk, from its beginning.
    """
    # A cut must lie before all boundaries that the same chunk has in common with the next one.
    overlap = min(overlap, size)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, at in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_pydict({"doc_id": [doc], "row_key": [row], "chunk": [n], "part": [text[at : at + size + overlap]]}, schema=chunk_schema)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text in batch.column(3).to_pylist():
                ends = boundaries(text, pattern, len(text) <= size)
                heads.append([e for e in ends if e <= overlap])
                tails.append([e - size for e in ends if e > size])
            names = ["row_key", "chunk", "head", "tail"]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(x, pa.list_(pa.int32())) for x in (heads, tails))], names=names)

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, segment, carried, tried = None, None, 0, "", 0

        def rows(parts: list[str]) -> pa.RecordBatch:
            numbers = [segment + n for n in range(len(parts))]
            return pa.RecordBatch.from_pydict({"doc_id": [doc] * len(parts), "row_key": [now] * len(parts), "segment": numbers, "part": parts}, schema=segment_schema)

        for batch in batches:
            for x in batch.to_pylist():
                if x["row_key"] != now:
                    now, doc, segment, carried, tried = x["row_key"], x["doc_id"], 0, "", 0
                carried += x["part"] if x["last"] else x["part"][:size]
                if x["last"]:
                    yield rows([carried])
                    carried = ""
                elif len(carried) >= 2 * tried:
                    # What lies within an overlap of the end may read otherwise once more text is there.
                    ends = [e for e in boundaries(carried, pattern, False) if e <= len(carried) - overlap]
                    tried = 0 if ends else len(carried)
                    if ends:
                        yield rows([carried[: ends[-1]]])
                        segment, carried = segment + 1, carried[ends[-1] :]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(ranks_path, pattern)
        for batch in batches:
            found = [_encoded(encoding, text) for text in batch.column(3).to_pylist()]
            columns = [*(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32())), strict=True))] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["doc_id", "row_key", "segment", "n", "written", "decoded", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, n, digest, back, every = None, None, 0, None, None, []
        for batch in batches:
            for x in batch.to_pylist():
                if x["row_key"] != now:
                    if now is not None:
                        yield _result([doc], [n], [digest.hexdigest()], [back.hexdigest()], [every] if with_ids else None)
                    now, doc, n, digest, back, every = x["row_key"], x["doc_id"], 0, hashlib.sha256(), hashlib.sha256(), []
                digest.update((b"," if n and x["n"] else b"") + x["written"])
                back.update(x["decoded"])
                n += x["n"]
                if with_ids:
                    every += x["ids"]
        if now is not None:
            yield _result([doc], [n], [digest.hexdigest()], [back.hexdigest()], [every] if with_ids else None)

    chunk_schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("chunk", pa.int32()), ("part", pa.string())])
    segment_schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("segment", pa.int64()), ("part", pa.string())])
    chunks = stored(long.mapInArrow(chunked, "doc_id long, row_key long, chunk int, part string"), "chunks").repartition("row_key", "chunk")
    ends = chunks.mapInArrow(searched, "row_key long, chunk int, head array<int>, tail array<int>")
    order = Window.partitionBy("row_key").orderBy("chunk")
    agreed = F.array_max(F.array_intersect(F.lag("tail").over(order), "head"))
    cuts = ends.withColumn("cut", agreed).withColumns({
        "next_cut": F.lead("cut").over(order), "last": F.lead("chunk").over(order).isNull(),
        "broken": F.max(F.col("cut").isNull() & (F.col("chunk") > 0)).over(Window.partitionBy("row_key")),
    }).drop("head", "tail")
    placed = chunks.join(cuts, ["row_key", "chunk"])
    first = F.coalesce("cut", F.lit(0))
    after = F.when(F.col("last"), F.length("part")).otherwise(F.col("next_cut") + size)
    in_step = placed.filter(~F.col("broken")).select(
        "doc_id", "row_key", F.col("chunk").cast("long").alias("segment"), F.substring("part", first + 1, after - first).alias("part")
    )
    one_by_one = placed.filter("broken").select("doc_id", "row_key", "chunk", "last", "part").repartition("row_key").sortWithinPartitions("row_key", "chunk")
    segments = in_step.unionByName(one_by_one.mapInArrow(recut, "doc_id long, row_key long, segment long, part string"))
    pieces = segments.mapInArrow(encoded, "doc_id long, row_key long, segment long, n long, written binary, decoded binary, ids array<int>")
    if not with_ids:
        pieces = pieces.drop("ids")
    return pieces.repartition("row_key").sortWithinPartitions("row_key", "segment").mapInArrow(digested, schema)


def _result(docs: list, counts: list, hashed: list, decoded: list, ids: list | None) -> pa.RecordBatch:
    columns = [pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if ids is not None:
        columns.append(pa.array(ids, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def encode_documents(
    documents: DataFrame, ranks_path: str, pattern: str, size: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False
) -> DataFrame:
    """Encode every whole ``raw_text`` of document records by byte-level BPE and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes) and, if
    asked for, ids (array of int). A text of at most ``size`` characters is one chunk. Longer ones become chunk rows that share
    ``overlap`` characters with the next; every chunk is pre-tokenised wherever it lies, cuts fall where the boundaries of
    neighbours agree, and the segments between cuts are encoded apart. Chunk 0 begins where the text does, so by turns every chunk
    that agrees with its neighbour is in step with the text. A text with neighbours that nowhere agree (a very long word or run
    of spaces; runs of digits where the pattern takes so many at a time) is cut one chunk after the other instead, which holds for any
    pattern that looks no further than ``overlap`` characters ahead and for any ``size``. Digests grow segment by segment.
    ``ranks_path`` must be readable on every executor. Null and empty texts have no tokens and the digests of nothing. Repeated
    rows give repeated results; other columns are not used; no rows in, none out. Only long texts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(ranks_path, pattern)
        for whole in batches:
            for batch in portions(whole, 1):
                found = [_encoded(encoding, text or "") for text in batch.column(1).to_pylist()]
                yield _result(
                    batch.column(0).to_pylist(), [f[0] for f in found], [hashlib.sha256(f[1]).hexdigest() for f in found],
                    [hashlib.sha256(f[2]).hexdigest() for f in found], [f[3] for f in found] if with_ids else None,
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    texts = documents.select(F.col("doc_id").cast("long"), F.col("raw_text").cast("string"))
    is_long = F.coalesce(F.length("raw_text") > size, F.lit(False))
    long = texts.filter(is_long).select("doc_id", F.monotonically_increasing_id().alias("row_key"), "raw_text")
    return texts.filter(~is_long).mapInArrow(run, schema).unionByName(
        _long_documents(long, ranks_path, pattern, size, overlap, with_ids, schema)
    )


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Bytes of every row's ``ids``: doc_id, decoded binary. The bytes of the ids follow each other; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(ranks_path, pattern)
        for batch in batches:
            decoded = [encoding.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


#: Ends a word while it is encoded. An upper-case letter never occurs in a lower-case vocabulary.
WORD_END = "Z"
#: Pre-tokens of the word vocabulary in lower-case text without combining marks.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+|_")


@functools.lru_cache(maxsize=2)
def _word_coder(vocabulary_path: str):
    """The tokenizer itself; a byte-rank coder of the same vocabulary; characters found to be safe and unsafe so far.

    In ranks, the symbol that ends a word is the byte before it joined to ``WORD_END``, the first join of all; the other joins
    keep their order. White space and word ends are then the caller's work.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path)
    tokenizer.encode_special_tokens = True
    visible = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {c: b for b, c in visible.items()} | {chr(256 + n): b for n, b in enumerate(hidden)}
    ranks = {}
    for token, n in tokenizer.get_vocab(with_added_tokens=False).items():
        stem = token.removesuffix("</w>")
        if all(c in byte_of for c in stem):
            key = bytes(byte_of[c] for c in stem) + WORD_END.encode() * (stem != token)
            if key not in ranks:
                ranks[key] = n
    ranks = {k: n for k, n in ranks.items() if n < len(ranks)}
    coder = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
    return tokenizer, coder, set(), set()


class WordIds:
    """Ids of texts as the tokenizer of a word vocabulary gives them, by a faster way for texts of ordinary characters.

    A character is ordinary if it does not combine with its neighbours, has one lower-case form, and the tokenizer cuts around
    it as ``PRE_TOKENS`` does; that is asked of the tokenizer once per character. A text with any other character is left to the
    tokenizer.
    """

    def __init__(self, vocabulary_path: str):
        self.tokenizer, self.coder, self.safe, self.unsafe = _word_coder(vocabulary_path)

    def _ordinary(self, c: str) -> bool:
        if c == "Σ" or unicodedata.combining(c) or unicodedata.category(c)[0] == "M":
            return False
        if 0x1100 <= ord(c) <= 0x11FF or 0xA960 <= ord(c) <= 0xA97F or 0xD7B0 <= ord(c) <= 0xD7FF:
            return False
        whole = self.tokenizer.normalizer.normalize_str(c)
        if len(c.lower()) != 1 or whole != c.lower() and not (c.isspace() and whole == " "):
            return False
        for sample in (f"a{c}{c}b", f"1{c}.{c}2", f"'{c}'s{c}"):
            text = self.tokenizer.normalizer.normalize_str(sample)
            theirs = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            ours = [self.tokenizer.pre_tokenizer.pre_tokenize_str(w) for w in PRE_TOKENS.findall(sample.lower())]
            if theirs != [piece for one in ours for piece, _ in one] or any(len(one) != 1 for one in ours):
                return False
        return True

    def _plain(self, text: str) -> bool:
        new = set(text) - self.safe
        if not new:
            return True
        for c in new - self.unsafe:
            (self.safe if self._ordinary(c) else self.unsafe).add(c)
        return new <= self.safe

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for text in texts:
            if not text:
                out.append(np.zeros(0, "<u4"))
            elif self._plain(text):
                marked = WORD_END.join(PRE_TOKENS.findall(text.lower()))
                out.append(np.array(self.coder.encode_ordinary(marked + WORD_END) if marked else [], "<u4"))
            else:
                out.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
        return out
