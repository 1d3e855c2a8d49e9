"""Token ids of document records in grammar-compressed shards (Re-Pair) that can be decoded at any place.

A shard is one row of a Parquet table and holds whole documents: ``symbols`` (little-endian unsigned 32-bit), the ``rules`` (two
symbols each) that the symbols from ``first_rule`` on stand for, the number of ids that each rule expands to (``lengths``), and
number, ids and symbols of its documents. No symbol reaches over the end of a document. A second table has the ids before each
part (the rows of one writing task); ``before`` counts those before a shard inside its part.
"""

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docuvet.llm.textops import portions

#: Ids of a shard: it is closed with the document that reaches them.
SHARD_IDS = 1 << 19
#: A pair becomes a rule if it occurs so often; rounds of rarer pairs end when one in so many symbols is saved.
LEAST_COUNT, LEAST_SAVING = 4, 200
#: Pairs are counted in so many cells first.
CELLS = 1 << 19
#: How the byte-level tokenizer cuts texts. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in Unicode. Fixed value.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The look-ahead keeps the last blank of a run for what follows. Where the text is cut there first, the pattern needs none.
BEFORE_LAST_BLANK = re.compile(f"[{WHITE}](?=[{WHITE}][^{WHITE}])")
WITHOUT_LOOK_AHEAD = BYTE_LEVEL.replace(r"\s+(?!\S)|", "")
SHARDS, PARTS = "shards", "parts"
SCHEMA = (
    "part int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>, first_rule long, "
    "rules binary, lengths binary, symbols binary"
)


@functools.lru_cache(maxsize=2)
def _coders(vocabulary_path: str):
    """The tokenizer, a coder of the same vocabulary as byte ranks, and the characters found safe and unsafe so far."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path)
    tokenizer.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): n for token, n in tokenizer.get_vocab(with_added_tokens=False).items() if set(token) <= byte_of.keys()}
    ranks = {token: n for token, n in ranks.items() if n < len(ranks)}
    return tokenizer, tiktoken.Encoding("bytes", pat_str=WITHOUT_LOOK_AHEAD, mergeable_ranks=ranks, special_tokens={}), set(), set()


class ByteIds:
    """Ids of texts as the tokenizer gives them, by the byte ranks of its vocabulary.

    Both cut texts by classes of characters, and their tables of classes differ in age. Each character beyond ASCII is asked of
    both once; a text with one on which they disagree is left to the tokenizer.
    """

    def __init__(self, vocabulary_path: str):
        self.tokenizer, self.coder, self.safe, self.unsafe = _coders(vocabulary_path)

    def _agreed(self, c: str) -> bool:
        import tiktoken

        for lead in ("a", "1", ".", "\t"):
            both = lead + c
            pieces = {bytes([b]): b for b in range(256)} | {both.encode(): 256}
            one = tiktoken.Encoding("cut", pat_str=BYTE_LEVEL, mergeable_ranks=pieces, special_tokens={}).encode_ordinary(both) == [256]
            if one != (len(self.tokenizer.pre_tokenizer.pre_tokenize_str(both)) == 1):
                return False
        return True

    def _plain(self, text: str) -> bool:
        if text.isascii():
            return True
        new = set(text) - self.safe
        for c in new - self.unsafe:
            (self.safe if c.isascii() or self._agreed(c) else self.unsafe).add(c)
        return new <= self.safe

    def encode(self, text: str) -> np.ndarray:
        if self._plain(text):
            cuts = [m.end() for m in BEFORE_LAST_BLANK.finditer(text)]
            ids = array("I")
            for start, stop in zip([0, *cuts], [*cuts, len(text)], strict=True):
                ids.extend(self.coder.encode_ordinary(text[start:stop]))
            return np.frombuffer(ids, np.uint32)
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)


def _frequent(symbols: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that occur ``least`` times, their counts, the positions at which they stand, and which pair that is."""
    left, right = symbols[:-1], symbols[1:]
    cell = (left * np.uint32(2654435761) + right * np.uint32(40503)) >> np.uint32(13)
    cell[last[:-1]] = CELLS
    filled = np.bincount(cell, minlength=CELLS + 1)
    filled[CELLS] = 0
    at = np.flatnonzero(filled[cell] >= least)
    keys = left[at].astype(np.uint64) << np.uint64(32) | right[at]
    ordered = np.sort(keys)
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(ordered)))
    pairs, counts = ordered[begins][counts >= least], counts[counts >= least]
    if not len(pairs):
        return pairs, counts, at[:0], at[:0]
    which = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
    hit = pairs[which] == keys
    return pairs, counts, at[hit], which[hit]


def _apart(at: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Which of the pairs at positions ``at`` to replace: none that shares a symbol with a more frequent one; of equal neighbours every other."""
    beside = np.zeros(size + 2, np.int64)
    beside[at + 1] = weight
    best = np.flatnonzero((weight >= beside[at]) & (weight >= beside[at + 2]))
    place = at[best]
    index = np.arange(len(place))
    begins = np.maximum.accumulate(np.where(np.append(True, np.diff(place) != 1), index, 0)) if len(place) else index
    return best[(index - begins) % 2 == 0]


def re_pair(symbols: np.ndarray, last: np.ndarray, first: int, least: int = LEAST_COUNT, saving: int = LEAST_SAVING) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (pairs, each of earlier symbols) of a grammar for ``symbols``; ``last`` marks those that end a document.

    Round by round the most frequent pairs of neighbours become new symbols from ``first`` on; the count that makes a pair
    frequent falls from a thousandth of the symbols to ``least`` and stays there until a round saves too little.
    """
    symbols, last, rules, bound = symbols.copy(), last.copy(), [], max(least, len(symbols) // 1000)
    known = 0
    while len(symbols) > 1:
        pairs, counts, at, which = _frequent(symbols, last, bound)
        chosen = _apart(at, counts[which], len(symbols))
        at, which = at[chosen], which[chosen]
        kept = np.bincount(which, minlength=len(pairs)) >= min(3, least)
        at, which = at[kept[which]], which[kept[which]]
        symbols[at] = (np.cumsum(kept) - 1 + first + known).astype(np.uint32)[which]
        last[at] = last[at + 1]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, last = symbols[stays], last[stays]
        rules.append(pairs[kept])
        known += int(kept.sum())
        if bound == least and len(at) * saving <= len(symbols):
            break
        bound = max(least, bound // 4)
    joined = np.concatenate([*rules, np.zeros(0, np.uint64)])
    return symbols, np.stack([joined >> np.uint64(32), joined & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to. A rule's parts are older than the rule: lengths spread until none is missing."""
    lengths = np.zeros(len(rules), np.int64)
    of = lambda s: np.where(s < first, 1, lengths[np.maximum(s.astype(np.int64) - first, 0)])
    while len(rules) and not lengths.all():
        a, b = of(rules[:, 0]), of(rules[:, 1])
        lengths = np.where((a > 0) & (b > 0), a + b, 0)
    return lengths


def expanded(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a shard. The lengths tell where every symbol's ids lie, so nothing outside is expanded."""
    size = lambda s: np.where(s < first, 1, lengths[np.maximum(s - first, 0)]) if len(lengths) else np.ones(len(s), np.int64)
    pending = symbols.astype(np.int64)
    width = size(pending)
    place = np.cumsum(width) - width
    total = int(width.sum())
    stop = total if stop is None else min(stop, total)
    out = np.empty(max(0, stop - start), "<u4")
    while len(pending):
        near = (place < stop) & (place + width > start)
        pending, place = pending[near], place[near]
        plain = pending < first
        out[place[plain] - start] = pending[plain]
        pair, at = rules[pending[~plain] - first].astype(np.int64), place[~plain]
        left = size(pair[:, 0])
        pending, place = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([at, at + left])
        width = np.concatenate([left, size(pair[:, 1])])
    return out


def write_token_shards(
    documents: DataFrame, path: str, vocabulary_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS
) -> None:
    """Encode every whole ``raw_text`` of document records, append ``end_id`` to each, and write the ids as compressed shards.

    Documents lie in ascending order of ``doc_id`` (null first; rows of one number by a hash of their text). They are dealt by
    ranges of that order, so parts follow each other, and equal numbers are spread too. A task keeps one shard at a time.
    Null and empty texts are the end id alone. Repeated rows are written as often as they come; other columns are not used; no
    rows in, no shards. ``vocabulary_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = ByteIds(vocabulary_path), TaskContext.get().partitionId(), 0
        numbers, ids, held = [], [], 0

        def shard() -> pa.RecordBatch:
            symbols, sizes = np.concatenate(ids), np.array([len(i) for i in ids])
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(sizes) - 1] = True
            first = max(coder.size, end_id + 1)
            short, rules = re_pair(symbols, last, first)
            lengths = expansion_lengths(rules, first)
            ends = np.cumsum(np.where(short < first, 1, lengths[np.maximum(short.astype(np.int64) - first, 0)]) if len(rules) else np.ones(len(short), np.int64))
            upto = np.searchsorted(ends, np.cumsum(sizes)) + 1
            written = [x.astype("<u4").tobytes() for x in (rules, lengths, short)]
            return pa.RecordBatch.from_pydict({
                "part": [part], "before": [before], "n_tokens": [len(symbols)], "doc_ids": [numbers], "doc_tokens": [sizes],
                "doc_symbols": [np.diff(upto, prepend=0)], "first_rule": [first], "rules": written[:1], "lengths": written[1:2], "symbols": written[2:],
            }, schema=arrow_schema)

        for whole in batches:
            for batch in portions(whole, 1):
                for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    numbers.append(number)
                    ids.append(np.append(coder.encode(text or ""), np.uint32(end_id)))
                    held += len(ids[-1])
                    if held >= shard_ids:
                        yield shard()
                        before, numbers, ids, held = before + held, [], [], 0
        if ids:
            yield shard()

    long_list = pa.list_(pa.int64())
    arrow_schema = pa.schema([
        ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", long_list), ("doc_tokens", long_list),
        ("doc_symbols", long_list), ("first_rule", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()),
    ])
    order = ["doc_id", "_hash", "_tie"]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("raw_text").cast("string").alias("raw_text")).withColumns(
        {"_hash": F.xxhash64("raw_text"), "_tie": F.monotonically_increasing_id()}
    )
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "raw_text")
    ordered.mapInArrow(run, SCHEMA).write.parquet(f"{path}/{SHARDS}", compression="zstd")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per writing task.
    totals = documents.sparkSession.read.schema(SCHEMA).parquet(f"{path}/{SHARDS}").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/{PARTS}")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``start``, the ids of all documents before them."""
    parts = spark.read.schema("part int, start long").parquet(f"{path}/{PARTS}")
    shards = spark.read.schema(SCHEMA).parquet(f"{path}/{SHARDS}")
    return shards.join(parts, "part").withColumn("start", F.col("start") + F.col("before"))


def _arrays(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, rules, lengths and first rule of a shard."""
    of = lambda name: np.frombuffer(batch.column(name)[row].as_py(), "<u4")
    return of("symbols"), of("rules").reshape(-1, 2), of("lengths").astype(np.int64), batch.column("first_rule")[row].as_py()


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a folder of shards: doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids
    (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids = expanded(*_arrays(batch, row))
                sizes = np.array(batch.column("doc_tokens")[row].as_py(), np.int64)
                starts = np.cumsum(sizes) - sizes
                offsets = np.append(starts, sizes.sum()) * ids.itemsize
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    pa.array(batch.column("doc_ids")[row].as_py(), pa.int64()), pa.array(starts + batch.column("start")[row].as_py()), pa.array(sizes), held.cast(pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    return _shards(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def decode_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Ids [start, stop) of the whole folder, in one row per shard that holds some: start, ids.

    Other shards are left out by their places; inside one, only symbols whose ids lie in the span are expanded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                base, n = batch.column("start")[row].as_py(), batch.column("n_tokens")[row].as_py()
                low, high = max(0, start - base), min(n, stop - base)
                ids = expanded(*_arrays(batch, row), low, high)
                yield pa.RecordBatch.from_arrays([pa.array([base + low]), pa.array([ids.tobytes()], pa.binary())], names=["start", "ids"])

    held = _shards(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    return held.mapInArrow(run, "start long, ids binary")


def decode_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The named documents alone: doc_id, start, n_tokens, ids. Only their symbols are expanded."""
    wanted = {int(d) for d in doc_ids}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                symbols, rules, lengths, first = _arrays(batch, row)
                of = lambda name: np.array(batch.column(name)[row].as_py(), np.int64)
                numbers, sizes, used = batch.column("doc_ids")[row].as_py(), of("doc_tokens"), of("doc_symbols")
                hit = [n for n, number in enumerate(numbers) if number in wanted]
                begins, starts = np.cumsum(used) - used, np.cumsum(sizes) - sizes
                found = [expanded(symbols[begins[n] : begins[n] + used[n]], rules, lengths, first).tobytes() for n in hit]
                yield pa.RecordBatch.from_arrays([
                    pa.array([numbers[n] for n in hit], pa.int64()), pa.array(starts[hit] + batch.column("start")[row].as_py(), pa.int64()), pa.array(sizes[hit], pa.int64()), pa.array(found, pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    asked = F.array(*[F.lit(d) for d in sorted(wanted)]).cast("array<long>")
    held = _shards(spark, path).filter(F.arrays_overlap("doc_ids", asked))
    return held.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
