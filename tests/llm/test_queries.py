"""The numbered queries themselves: columns and types, held-out rows, thresholds, and labels that must not be learnt from."""

import zlib

import pytest
from pyspark.sql import functions as F

from docuvet.llm import queries

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bag_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_style_tree_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_pack_vectors": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_jump_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_projection_forest_faces": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_prefix_forest_faces": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_overlap_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_setsketch_near_text": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_factorisation_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_interval_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op12_repair_token_shards": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op13_captured_fill_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_types(spark, name):
    found = dict(queries.QUERIES[name](spark, SF_DIR).dtypes)
    assert {c: found.get(c) for c in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize(("name", "label", "modulus", "remainder", "threshold"), [
    ("op1_bag_toxicity", "toxic", 5, 0, 0.5), ("op10_factorisation_quality", "quality", 4, 2, 0.7),
])
def test_held_out_labels_are_not_learnt(spark, tmp_path, name, label, modulus, remainder, threshold):
    """Scores do not change when the labels of held-out rows, or columns that are no inputs, do."""
    rows = queries.QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % modulus == remainder
    labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label))).write.parquet(f"{tmp_path}/labels.parquet")
    others = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumns({"lang": F.lit("xx"), "source": F.lit("elsewhere")})
    others.write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: r.score for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
