"""Grammar-compressed token shards against the tokenizer, and fill-in-middle texts against a loop over lines."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docuvet.llm import fill_middle, queries, token_grammar

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = "doc_id long, raw_text string, ids string, start long, n string"


@pytest.fixture(scope="module")
def tokenizer():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return tokenizer


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def words(rng, n):
    stock = ["PASSPORT", "name", "Ravi", "न", "日本", "born", "12/03/1999", "\n", "  ", "the", "of", "don't", "ﬃ", "Ω", "՘", "\U00018d10", "​"]
    return " ".join(rng.choice(stock) for _ in range(n))


def texts_of(rng):
    copies = words(rng, 300)
    return [None, "", " ", "\n\n", "#", "<|endoftext|>", "a" * 3000, " " * 3000, *[words(rng, rng.randrange(1, 400)) for _ in range(80)], *[copies] * 40]


def test_shards_hold_the_tokenizers_ids(spark, tokenizer, tmp_path):
    texts = texts_of(random.Random(1))
    rows = [(i, t, "x", 9, "y") for i, t in enumerate(texts)] + [(None, "no number", None, None, None), (7, "another of this number", "x", 1, "z")]
    rows += [(3, "\n\n", "x", 9, "y")]  # a repeated row
    df = spark.createDataFrame(rows, AWKWARD).repartition(5)
    path = str(tmp_path / "shards")
    token_grammar.write_token_shards(df, path, VOCABULARY, shard_ids=2000)
    got = token_grammar.read_token_shards(spark, path).collect()
    want = sorted((str(r[0]), encoded(tokenizer, r[1])) for r in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    in_order = sorted(got, key=lambda r: r.start)
    numbers = [r.doc_id for r in in_order]
    assert numbers == sorted(numbers, key=lambda d: (d is not None, d or 0))
    assert [r.start for r in in_order] == np.cumsum([0, *[r.n_tokens for r in in_order]])[:-1].tolist()
    shards = spark.read.parquet(f"{path}/{token_grammar.SHARDS}")
    assert shards.count() > 5
    assert shards.agg(F.sum(F.length("symbols")) / F.sum("n_tokens")).first()[0] < 4 * 0.6

    # Any span, and single documents, without the rest.
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in in_order])
    for start, stop in ((0, 1), (0, len(every)), (1999, 2001), (len(every) - 3, len(every) + 10), (5000, 9000), (4, 4), (len(every), len(every) + 1)):
        parts = sorted(token_grammar.decode_span(spark, path, start, stop).collect())
        assert np.concatenate([np.frombuffer(b"".join(p.ids for p in parts), "<u4")]).tolist() == every[start:stop].tolist()
    some = {(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_grammar.decode_documents(spark, path, [0, 50, 100, 7, 10**9]).collect()}
    assert some == {(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got if r.doc_id in (0, 50, 100, 7)}


def test_no_documents_no_shards(spark, tmp_path):
    token_grammar.write_token_shards(spark.createDataFrame([], AWKWARD), str(tmp_path / "none"), VOCABULARY)
    assert token_grammar.read_token_shards(spark, str(tmp_path / "none")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=12), st.sampled_from([2, 3, 4]))
def test_grammar_expands_to_its_ids(documents, least):
    ids = np.array([i for d in documents for i in d], np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum([len(d) for d in documents]) - 1] = True
    symbols, rules = token_grammar.re_pair(ids, last, 4, least, saving=10**9)
    lengths = token_grammar.expansion_lengths(rules, 4)
    assert token_grammar.expanded(symbols, rules, lengths, 4).tolist() == ids.tolist()
    assert all((rules[n] < 4 + n).all() for n in range(len(rules)))
    ends = np.cumsum([1 if s < 4 else lengths[s - 4] for s in symbols])
    assert set(np.cumsum([len(d) for d in documents])) <= set(ends.tolist())  # no symbol reaches over a document's end
    for start in range(0, len(ids), 7):
        assert token_grammar.expanded(symbols, rules, lengths, 4, start, start + 5).tolist() == ids[start : start + 5].tolist()


def test_frequent_pairs_become_rules():
    ids = np.array([1, 2, 3, 4] * 5000, np.uint32)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    symbols, rules = token_grammar.re_pair(ids, last, 10)
    assert len(symbols) < 20 and len(rules) < 40
    runs, rules = token_grammar.re_pair(np.full(4097, 1, np.uint32), np.arange(4097) == 4096, 10)
    assert len(runs) < 20


def test_ids_of_characters_on_which_tables_differ(tokenizer):
    coder = token_grammar.ByteIds(VOCABULARY)
    for c in [chr(p) for p in (0x558, 0x88F, 0x1DB0, 0xA7CE, 0x10940, 0x18D10, 0x323B0, 0x3FC3F, 0x200B, 0x85, 0xA0, 0x1C, 0x3000, 0x2160, 0x301, 0xD7A4, 9, 11, 12, 13, 32, 0x1F, 0x1680, 0x2003, 0x2029, 0x202F, 0x205F, 0x180E, 0xFEFF)]:
        for text in (c, f"a{c}b {c}1{c}2  {c}.{c}", f"\t{c}\n{c} x", f"a  {c}  b", f"a {c} {c}b\n\n{c}\n\n b", c * 4 + "1"):
            assert coder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_shard_query_matches_the_tokenizer(spark, tokenizer, tmp_path):
    texts = texts_of(random.Random(5))
    spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.QUERIES["op12_repair_token_shards"](spark, str(tmp_path)).collect())
    start = 0
    for r, (i, text) in zip(got, enumerate(texts), strict=True):
        ids = encoded(tokenizer, text)
        assert tuple(r) == (3 * i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def by_loop(doc_id, text, seed, rate, spm_rate):
    lines, rest = [], text
    while rest:
        cut = rest.find("\n") + 1 or len(rest)
        lines.append(rest[:cut])
        rest = rest[cut:]
    n, digest = len(lines), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINES = [None, "", "\n", "\n\n\n", "one line", "NAME: RAVI\nDOB: 12/03/1999\n", "a\r\nb c\n d", "x<P>y\nz", "<M", "P>\n<\nS>", "😀\né\n" * 50, "long " * 200_000, "y\n" * 100_000 + "z"]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_in_middle_matches_a_loop(spark, rate, spm_rate):
    rows = [(i, t, "x", 1, "form") for i, t in enumerate(LINES * 3)] + [(None, "a\nb\nc", None, None, None), (4, "one line", "x", 1, "form")]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, AWKWARD), 7, rate, spm_rate)
    got = made.withColumn("restored", fill_middle.restored_text(F.col("form"), F.col("output"))).collect()
    want = sorted((repr((r[0], *by_loop(r[0], r[1] or "", 7, rate, spm_rate), r[1] or "")) for r in rows))
    assert sorted(repr(tuple(r)) for r in got) == want


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], AWKWARD)).collect() == []
