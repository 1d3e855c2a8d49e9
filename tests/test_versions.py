"""Versions of a stored history: what readers see, lost jobs, two writers, clean-up, and a stream that merges into it."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from docuvet.operators import history
from docuvet.sources import files, versions

SCHEMA = "owner_id string, case_id string, final_decision string, timestamp timestamp, version int"


def day(n):
    return datetime.datetime(2026, 8, n)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "history")
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    versions.create_history(spark, frame(("U1", "C1", "VERIFIED", day(1), 1), ("U1", "C2", "HIGH RISK", day(1), 1), ("U2", "C9", "VERIFIED", day(1), 1)), path)
    return path, frame


def rows(df):
    return sorted((r.owner_id, r.case_id, r.final_decision) for r in df.collect())


FIRST = [("U1", "C1", "VERIFIED"), ("U1", "C2", "HIGH RISK"), ("U2", "C9", "VERIFIED")]


def test_versions_keep_every_case_once(spark, stored):
    path, frame = stored
    versions.merge_history(spark, frame(("U1", "C3", "HIGH RISK", day(2), 1)), path)
    again = frame(("U1", "C1", "SUSPICIOUS", day(3), 2), ("U1", "C1", "VERIFIED", day(2), 2), ("U2", "C1", "VERIFIED", day(3), 1), (None, "C1", "VERIFIED", day(3), 1))
    newest = versions.merge_history(spark, again, path)
    assert newest.number == 3
    want = [("U1", "C1", "SUSPICIOUS"), ("U1", "C2", "HIGH RISK"), ("U1", "C3", "HIGH RISK"), ("U2", "C1", "VERIFIED"), ("U2", "C9", "VERIFIED")]
    assert rows(versions.read_history(spark, path).filter("owner_id is not null")) == want
    assert versions.read_history(spark, path).filter("owner_id is null").count() == 1
    assert rows(versions.read_history(spark, path, 1)) == FIRST
    assert rows(versions.read_tenant(spark, path, "U2")) == [r for r in want if r[0] == "U2"]
    assert versions.read_tenant(spark, path, "U9").count() == versions.read_tenant(spark, path, None).count() == 0
    assert versions.merge_history(spark, again.filter("false"), path).number == 3
    with pytest.raises(FileNotFoundError):
        versions.read_history(spark, path, 9)
    # A tenant's read lists one folder.
    assert len(versions.read_tenant(spark, path, "U2").inputFiles()) == 1


def test_a_reader_keeps_its_version_through_a_merge(spark, stored):
    path, frame = stored
    reader = versions.read_history(spark, path)
    versions.merge_history(spark, frame(("U1", "C1", "SUSPICIOUS", day(3), 2), ("U2", "C9", "HIGH RISK", day(3), 2)), path)
    assert rows(reader) == FIRST
    assert {r[2] for r in rows(versions.read_history(spark, path))} == {"SUSPICIOUS", "HIGH RISK"}


def test_a_lost_merge_leaves_the_old_version(spark, stored, monkeypatch):
    path, frame = stored
    batch = frame(("U1", "C1", "SUSPICIOUS", day(3), 2))

    def lost(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(versions, "_commit", lost)
    with pytest.raises(RuntimeError, match="gone"):
        versions.merge_history(spark, batch, path)
    monkeypatch.undo()
    assert rows(versions.read_history(spark, path)) == FIRST
    # A job that fails inside the write commits nothing either.
    broken = batch.withColumn("final_decision", F.when(F.lit(True), F.raise_error(F.lit("executor lost"))).cast("string"))
    with pytest.raises(Exception, match="executor lost"):
        versions.merge_history(spark, broken, path)
    assert rows(versions.read_history(spark, path)) == FIRST
    assert versions.merge_history(spark, batch, path).number == 2
    assert ("U1", "C1", "SUSPICIOUS") in rows(versions.read_history(spark, path))


def test_two_writers(spark, stored, monkeypatch):
    """Whoever commits second merges again on top of the first, or only names its files anew where no bucket is shared."""
    path, frame = stored
    commit, merges = versions._commit, []
    written = versions._written

    def after_another(spark_, path_, version):
        monkeypatch.setattr(versions, "_commit", commit)
        versions.merge_history(spark, other, path)
        return commit(spark_, path_, version)

    for other, own, writes in (
        (frame(("U1", "C7", "VERIFIED", day(4), 1)), frame(("U1", "C8", "VERIFIED", day(4), 1)), 3),
        (frame(("U2", "C7", "VERIFIED", day(4), 1)), frame(("U1", "C6", "VERIFIED", day(4), 1)), 2),
    ):
        merges.clear()
        monkeypatch.setattr(versions, "_written", lambda *a: merges.append(1) or written(*a))
        monkeypatch.setattr(versions, "_commit", after_another)
        versions.merge_history(spark, own, path)
        assert len(merges) == writes
        found = rows(versions.read_history(spark, path))
        assert set(rows(own)) | set(rows(other)) <= set(found) and len(found) == len(set(found))
    assert len(found) == 7
    with pytest.raises(versions.Conflict):
        versions.create_history(spark, own, path)


def test_clean_up_keeps_what_versions_name(spark, stored):
    path, frame = stored
    for n in range(2, 6):
        versions.merge_history(spark, frame(("U1", "C1", f"D{n}", day(n), n)), path)
    orphan = versions._written(versions._bucketed(frame(("U1", "CX", "LOST", day(9), 9))), path)
    assert versions.clean_up(spark, path, keep=2) == 0
    assert versions._versions(spark, path) == [4, 5]
    time.sleep(1.1)
    assert versions.clean_up(spark, path, keep=2, grace_seconds=1) == 4
    assert not files.exists(spark, f"{path}/data/write={orphan}")
    assert ("U1", "C1", "D4") in rows(versions.read_history(spark, path, 4)) and ("U1", "C1", "D5") in rows(versions.read_history(spark, path))
    assert ("U2", "C9", "VERIFIED") in rows(versions.read_history(spark, path))


def test_a_replayed_batch_changes_nothing(spark, stored):
    path, frame = stored
    sink = versions.history_sink(spark, path, "submissions")
    sink(frame(("U1", "C1", "SUSPICIOUS", day(3), 2)), 0)
    sink(frame(("U1", "C1", "VERIFIED", day(4), 3)), 1)
    before = versions.version_at(spark, path)
    sink(frame(("U1", "C1", "SUSPICIOUS", day(3), 2)), 0)
    sink(frame(("U1", "C1", "HIGH RISK", day(9), 9)), 1)
    assert versions.version_at(spark, path) == before and before.number == 3
    assert ("U1", "C1", "VERIFIED") in rows(versions.read_history(spark, path))
    # Another stream counts its own batches; an empty batch is noted too.
    versions.history_sink(spark, path, "other")(frame(("U3", "C1", "VERIFIED", day(1), 1)).filter("false"), 0)
    assert versions.version_at(spark, path).streams == {"submissions": 1, "other": 0}


def test_stream_into_history_after_a_failure(spark, stored, tmp_path, monkeypatch):
    """The stream fails after a commit and before its checkpoint knows; the restart hands the batch in again."""
    path, frame = stored
    source = str(tmp_path / "in")
    for n in range(3):
        frame((f"U{n}", "C1", f"S{n}", day(10 + n), 5), ("U1", "CS", f"S{n}", day(10 + n), 5)).coalesce(1).write.mode("append").parquet(source)
    merge, fails = versions.merge_history, [True]

    def once(*args):
        done = merge(*args)
        if fails and args[5] == 1:
            fails.clear()
            raise RuntimeError("lost after the commit")
        return done

    def start():
        incoming = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        sink = versions.history_sink(spark, path, "submissions")
        return incoming.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    monkeypatch.setattr(versions, "merge_history", once)
    with pytest.raises(Exception, match="lost after the commit"):
        start().awaitTermination(120)
    assert versions.version_at(spark, path).streams == {"submissions": 1}
    assert start().awaitTermination(120)
    assert versions.version_at(spark, path).streams == {"submissions": 2} and versions.version_at(spark, path).number == 4
    batches = spark.read.parquet(source)
    want = history.upsert(spark.createDataFrame([(*r, day(1), 1) for r in FIRST], SCHEMA), batches)
    assert rows(versions.read_history(spark, path)) == rows(want)
