"""The stream of cases against the batch join on the same rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from docuvet.operators import screening
from docuvet.streaming.cases import decide_case_stream

START = datetime.datetime(2026, 5, 1)
DOCS = "case_id string, screened_at timestamp, tampering_score double, document_score double, mrz_status string, note string, verhoeff_ok boolean, barcode_status string, is_readable boolean, recapture boolean"
REST = (None, "NOT_FOUND", True, False)
FACES = "case_id string, compared_at timestamp, similarity double, face_status string"
LIVE = "case_id string, checked_at timestamp, liveness_passed boolean"
SHOWN = ("case_id", "note", "similarity", "face_status", "liveness_passed", "risk_score", "risk_level", "final_decision")


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


class Sources:
    """Three folders that are read as streams, and one running checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.tmp, self.options, self.progress = spark, tmp_path, options, None

    def add(self, docs=(), faces=(), live=()):
        docs = [(*d, *REST) for d in docs]
        for name, layout, rows in (("docs", DOCS, docs), ("faces", FACES, faces), ("live", LIVE, live)):
            self.spark.createDataFrame(list(rows), layout).coalesce(1).write.mode("append").parquet(str(self.tmp / name))

    def run(self):
        streams = [self.spark.readStream.schema(s).parquet(str(self.tmp / n)) for n, s in (("docs", DOCS), ("faces", FACES), ("live", LIVE))]
        decided = decide_case_stream(*streams, **self.options).select(*SHOWN)
        out = str(self.tmp / "out")
        query = decided.writeStream.format("parquet").option("checkpointLocation", str(self.tmp / "cp")).option("path", out).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        self.progress = query.lastProgress
        return sorted((tuple(r) for r in self.spark.read.schema(decided.schema).parquet(out).collect()), key=repr)

    def state_rows(self):
        return sum(o["numRowsTotal"] for o in self.progress["stateOperators"])


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def closing(n, seconds):
    return [(f"end{n}d", at(seconds), 1.0, 1.0, "VERIFIED", "end")], [(f"end{n}f", at(seconds), 90.0, "PASSED")], [(f"end{n}l", at(seconds), True)]


def test_cases_are_decided_when_their_last_part_arrives(spark, tmp_path):
    s = Sources(spark, tmp_path)
    docs = [(f"C{n}", at(n), 10.0 * n, 12.0 * n, "FAILED" if n == 5 else "VERIFIED", f"n{n}") for n in range(8)]
    faces = [(f"C{n}", at(n + 60), 60.0 + 5 * n, "PASSED") for n in (0, 1, 2, 5, 6)]
    live = [(f"C{n}", at(n + 90), n != 6) for n in (0, 2, 3, 6)]
    # Documents first: nothing can be decided yet.
    s.add(docs=docs)
    assert s.run() == []
    s.add(faces=faces, live=live[:2])
    assert [r[0] for r in s.run()] == ["C0", "C2"]
    s.add(live=live[2:])
    assert [r[0] for r in s.run()] == ["C0", "C2", "C6"]
    # Time goes on in all three streams: the others are decided with defaults.
    s.add(*closing(1, 3600))
    decided = s.run()
    batch = screening.decide_cases(spark.createDataFrame([(*d, *REST) for d in docs], DOCS), spark.createDataFrame(faces, FACES), spark.createDataFrame(live, LIVE))
    assert decided == sorted((tuple(r) for r in batch.select(*SHOWN).collect()), key=repr)
    assert {r[0] for r in decided} == {f"C{n}" for n in range(8)}
    # State holds the rows of the closing time only, whatever went by before.
    for n in range(2, 5):
        more = [(f"M{n}-{i}", at(3600 * n - 1800), 5.0, 5.0, "VERIFIED", "m") for i in range(200)]
        d, f, v = closing(n, 3600 * n)
        s.add(docs=more + d, faces=[(c, t, 99.0, "PASSED") for c, t, *_ in more] + f, live=[(c, t, True) for c, t, *_ in more[::2]] + v)
        decided = s.run()
    assert len([r for r in decided if r[1] != "end"]) == 8 + 600
    assert s.state_rows() < 200


def test_results_that_come_too_late_or_twice(spark, tmp_path):
    s = Sources(spark, tmp_path, wait="10 minutes")
    docs = [("A", at(0), 10.0, 10.0, "VERIFIED", "a"), ("B", at(0), 10.0, 10.0, "VERIFIED", "b")]
    s.add(docs=docs, faces=[("A", at(30), 99.0, "PASSED"), ("B", at(30), 99.0, "PASSED")])
    s.add(docs=docs[:1], faces=[("A", at(30), 99.0, "PASSED")], live=[("A", at(50), True), ("A", at(50), True), ("B", at(601), False), (None, at(5), False)])
    s.run()
    s.add(*closing(1, 3600))
    decided = s.run()
    # B's liveness came a second after its time; A counts once.
    assert [(r[0], r[4], r[7]) for r in decided] == [("A", True, "VERIFIED"), ("B", None, "VERIFIED")]


def test_no_rows(spark, tmp_path):
    s = Sources(spark, tmp_path)
    s.add()
    assert s.run() == []


def test_repeated_results_join_again_without_once(spark, tmp_path):
    s = Sources(spark, tmp_path, once=False)
    s.add(docs=[("A", at(0), 10.0, 10.0, "VERIFIED", "a")], faces=[("A", at(30), 99.0, "PASSED")] * 2, live=[("A", at(40), True)])
    assert len(s.run()) == 2
