"""Connected groups, positions, pipeline and the guard of the entry points."""

import random

import corpus_pipeline
import __spark_entry__
from docuvet.llm import graph, queries

SF = "/root/testdata/sf0.001"


def test_components_of_chains_and_stars(spark):
    rng = random.Random(13)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(5, 5), (None, 3), (9, None), (8, 9), (9, 8)]
    rng.shuffle(links)
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 240))} | {8: 8, 9: 8}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_random_components(spark):
    rng = random.Random(14)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    label = {i: i for pair in links for i in pair}
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in label.items() if i in got}
    assert all(label[i] == i for i in label if i not in got)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        left = stage(spark, left, SF).cache()
        assert left.columns == columns
        after = {r.doc_id for r in left.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before), name
    packed = corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()
    assert {r.doc_id for r in packed} == after
    assert sum(labels[i].quality for i in after if i in labels) >= 0.95 * sum(i in labels for i in after)


def test_pipeline_of_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text without a number " * 4, "en", "s", 80), (3, "same words again " * 9, None, None, None),
            (4, "same words again " * 9, "de", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.filter("false"), SF).count() == 0
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, None]
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() == 5


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in queries.QUERIES) == 1 for k in range(1, 11))
