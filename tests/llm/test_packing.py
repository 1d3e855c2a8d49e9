"""Packing, sharding, byte-pair encoding and token files against tokenizers, published laws and round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docuvet.llm import bpe, packing, queries, sharding, storage, token_files
from harness import compare, connect

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SYMBOLS = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "22", "'s", "'", "!?", "中", " ", "　", "ß", "word ", " x", "İ", "Σ", "́",
           "½", "한", "ᄀ", "ᅡ", "😀", "<|endoftext|>", "don't", "\x1c", "\x00"]


def texts_of(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(SYMBOLS, k=rng.randint(0, longest))) for _ in range(n)] + [None, "", " " * 700, "x" * 900, "'" * 300 + " " * 300]


def documents(spark, texts):
    rows = [(i, t, 0, 1, "p") for i, t in enumerate(texts)] + [(None, "key of nothing", 0, 1, "q")]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, raw_text string, start long, length long, part string").repartition(3)


@pytest.mark.parametrize(("size", "overlap"), [(50, 20), (97, 30), (100_000, 10)])
def test_chunks_encode_as_whole_texts(spark, size, overlap):
    texts = texts_of(1, 60, 600)
    rows = bpe.encode_documents(documents(spark, texts), RANKS, PATTERN, size, overlap, with_ids=True).collect()
    encoding = bpe.coder(RANKS, PATTERN)
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "key of nothing" if r.doc_id is None else texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("size", "overlap", "n"), [(30, 2000, 900), (33, 10, 900), (60, 50, 2000), (51_000, 2000, 250_000)])
def test_cuts_hold_for_periodic_tokens(spark, size, overlap, n):
    """Digits in threes: neighbours agree with each other and not with the text, unless they begin in step with it."""
    pattern = PATTERN.replace(r"\p{N}+", r"\p{N}{1,3}")
    assert pattern != PATTERN
    rng = random.Random(n)
    texts = ["a" + "1" * n + " end of text", "7" * n, "12 " * (n // 3), " " * n + "x", "y" * n, "ab" + "1" * n + "cd " * (n // 4) + "2" * n + "." + "words of text " * (n // 10)]
    texts += ["".join(rng.choice(["1", "22", " ", "word", ".", "\n\n", "é9"]) for _ in range(n // 2)), "x " * n + "3" * (n + 1)]
    encoding = bpe.coder(RANKS, pattern)
    for r in bpe.encode_documents(documents(spark, texts), RANKS, pattern, size, overlap, with_ids=True).collect():
        text = "key of nothing" if r.doc_id is None else texts[r.doc_id]
        want = encoding.encode_ordinary(text)
        assert r.ids == want, (r.doc_id, len(r.ids), len(want))
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ids_decode_to_bytes(spark):
    texts = texts_of(2, 20, 50)
    encoded = bpe.encode_documents(documents(spark, texts), RANKS, PATTERN, with_ids=True)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(encoded, RANKS, PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    assert bpe.encode_documents(documents(spark, texts).filter("false"), RANKS, PATTERN).count() == 0


def test_word_ids_as_the_tokenizer():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    texts = texts_of(3, 3000, 30)
    for got, text in zip(bpe.WordIds(WORDS).encode(texts), texts, strict=True):
        assert got.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, ascii(text)


def test_packed_pieces_hold_every_id_once(spark):
    rng = random.Random(4)
    texts = [*texts_of(4, 40, 200), *[" ".join(["word"] * rng.randint(1, 300)) for _ in range(80)]]
    limit, segments = 64, 5
    rows = packing.pack_documents(documents(spark, texts), WORDS, max_tokens=limit, max_segments=segments).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_document) == {*range(len(texts)), None}
    for doc, pieces in by_document.items():
        ids = np.array(tokenizer.encode("key of nothing" if doc is None else texts[doc] or "", add_special_tokens=False).ids + [2], "<u4")
        times = 2 if doc == 0 else 1
        assert sorted(p.start for p in pieces) == sorted(list(range(0, len(ids), limit)) * times)
        for p in pieces:
            part = ids[p.start : p.start + p.length]
            assert (p.doc_tokens, p.length, p.ids_crc32) == (len(ids), len(part), zlib.crc32(part.tobytes()))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert len(pieces) <= segments and sum(p.length for p in pieces) <= limit
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:n]) for n in range(len(pieces))]
    assert packing.pack_documents(documents(spark, texts).filter("false"), WORDS).count() == 0


def test_loss_limit_binds(spark):
    rows = [(i, "ask " * 10 + "answer " * 10, 40) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, raw_text string, answer_from int")
    packed = packing.pack_documents(df, WORDS, max_tokens=200, max_loss=25, answer_column="answer_from").collect()
    sums = defaultdict(lambda: [0, 0])
    for r in packed:
        assert (r.length, r.loss_length) == (21, 11)
        sums[r.sequence_id][0] += r.length
        sums[r.sequence_id][1] += r.loss_length
    assert all(n <= 200 and loss <= 25 for n, loss in sums.values()) and len(sums) == 15


def test_vectors_fill_sequences_well():
    rng = np.random.default_rng(7)
    sizes = np.column_stack([rng.integers(1, 1000, 3000), np.ones(3000, int), rng.integers(1, 400, 3000)])
    sizes[:, 2] = np.minimum(sizes[:, 2], sizes[:, 0])
    limits = np.array([4096, 64, 4096])
    where = packing.fill(sizes, limits)
    for d in range(3):
        assert np.bincount(where, sizes[:, d]).max() <= limits[d]
    assert sizes[:, 0].sum() / 4096 / (where.max() + 1) > 0.98


def jump(key, shards):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24])
def test_jump_hash_as_published(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *random.Random(6).sample(range(10**15), 300)]
    rows = [(k, f"ü{k}", 0, "s") for k in keys] + [(None, None, 1, "t")]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, raw_text string, shard int, part string")
    got = sharding.shard_documents(df, shards).collect()
    assert len(got) == len(rows) + 1
    slots = defaultdict(list)
    for r in got:
        key = r.doc_id or 0
        assert (r.shard, r.grown_shard) == (jump(key, shards), jump(key, shards + 1))
        assert r.grown_shard in (r.shard, shards)
        data = b"" if r.doc_id is None else f"ü{r.doc_id}".encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(df.filter("false"), shards).count() == 0


def test_sharding_stays_native(spark):
    plan = sharding.shard_documents(documents(spark, ["a"]), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_token_files_count_documents(spark):
    texts = texts_of(8, 40, 80)
    df, path = documents(spark, texts), storage.new_path(spark, "tokens")
    token_files.write_token_files(df, path, RANKS, PATTERN)
    encoding = bpe.coder(RANKS, PATTERN)
    want = sorted((repr(r.doc_id), len(encoding.encode_ordinary(r.raw_text or ""))) for r in df.collect())
    for block in (1, 2, 7, 64, 1 << 19):
        rows = token_files.token_counts(spark, path, block).collect()
        assert sorted((repr(r.doc_id), r.n_tokens) for r in rows) == want and all(r.closed for r in rows)


def test_separators_in_any_file(spark, tmp_path):
    rng = np.random.default_rng(9)
    for n, size in enumerate((0, 1, 2, 9, 40, 41)):
        folder = tmp_path / str(n)
        folder.mkdir()
        ids = rng.integers(0, 3, size).astype("<u2")
        (folder / "x.bin").write_bytes(ids.tobytes())
        want, start = [], 0
        for end in np.flatnonzero(ids == 0):
            want.append((start, int(end) - start, True))
            start = int(end) + 1
        if start < size:
            want.append((start, size - start, False))
        for block in (1, 2, 5, 100):
            rows = token_files.token_counts(spark, str(folder), block, keyed=False).collect()
            assert sorted((r.start, r.n_tokens, r.closed) for r in rows) == want


def test_document_numbers_round_trip():
    numbers = np.array([0, 1, -1, 2**63 - 1, -(2**63), 32767, 32768, 10**12])
    back, known = token_files.document_numbers(token_files.key_ids(numbers))
    assert known.all() and (back == numbers).all() and (token_files.key_ids(numbers) != token_files.END).all()


def test_shards_equal_their_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = compare(spark, connect(folder), queries.QUERIES["op4_jump_shards"], queries.ORACLES["op4_jump_shards"], folder)
    assert found == ("", 200)
