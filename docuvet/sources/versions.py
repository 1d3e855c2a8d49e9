"""A history of verifications in versions: readers see one version as a whole, whatever is written meanwhile.

``data/write=<id>/owner_bucket=<n>`` holds the files that one write made for one hash bucket of owners and never changes after it.
``versions/<number>.json`` names, for every bucket, the write that holds its records. Creating the next number is the commit: it
succeeds for one writer and fails for any other. A job that is lost before it leaves files that no version names.
"""

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docuvet.operators.history import BUCKET, owner_bucket, tenant_history, upsert
from docuvet.sources import files

DATA, VERSIONS, WRITE = "data", "versions", "write"
ATTEMPTS = 10


@dataclass(frozen=True)
class Version:
    """One state of the history: the write of each bucket, the layout of records, and the last batch of each stream."""

    number: int
    buckets: dict[str, str]
    layout: str
    streams: dict[str, int] = field(default_factory=dict)
    written_at: float = 0.0


class Conflict(RuntimeError):
    """Other writers kept committing first."""


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = [name for name, _ in files.entries(spark, f"{path}/{VERSIONS}")]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def version_at(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version by its number, the newest without one; None where there is none."""
    known = _versions(spark, path)
    if not known or (number is not None and number not in known):
        return None
    number = known[-1] if number is None else number
    return Version(**json.loads(files.read_text(spark, f"{path}/{VERSIONS}/{number:010d}.json")))


def _commit(spark: SparkSession, path: str, version: Version) -> bool:
    return files.write_new(spark, f"{path}/{VERSIONS}/{version.number:010d}.json", json.dumps(asdict(version)))


def _bucketed(records: DataFrame) -> DataFrame:
    return records.withColumn(BUCKET, owner_bucket(F.col("owner_id")))


def _written(records: DataFrame, path: str) -> str:
    """Write bucketed records under an id of their own."""
    write = uuid.uuid4().hex
    records.write.partitionBy(BUCKET).parquet(f"{path}/{DATA}/{WRITE}={write}")
    return write


def _folders(version: Version, path: str, buckets=None) -> list[str]:
    wanted = version.buckets if buckets is None else [b for b in map(str, buckets) if b in version.buckets]
    return [f"{path}/{DATA}/{WRITE}={version.buckets[b]}/{BUCKET}={b}" for b in sorted(wanted, key=int)]


def _read(spark: SparkSession, path: str, version: Version, buckets=None) -> DataFrame:
    layout = StructType.fromJson(json.loads(version.layout))
    folders = _folders(version, path, buckets)
    if not folders:
        return spark.createDataFrame([], layout).withColumn(BUCKET, F.lit(None).cast("int"))
    with_bucket = StructType([*layout.fields, *StructType.fromDDL(f"{BUCKET} int").fields])
    return spark.read.schema(with_bucket).option("basePath", f"{path}/{DATA}").parquet(*folders).drop(WRITE)


def create_history(spark: SparkSession, records: DataFrame, path: str) -> Version:
    """Version 1 of a new history."""
    bucketed = _bucketed(records)
    write = _written(bucketed, path)
    version = Version(1, {str(b): write for b in _present(spark, path, write)}, records.schema.json(), {}, time.time())
    if not _commit(spark, path, version):
        raise Conflict(f"a history exists at {path}")
    return version


def _present(spark: SparkSession, path: str, write: str) -> list[int]:
    """Buckets for which a write has files."""
    names = [name for name, _ in files.entries(spark, f"{path}/{DATA}/{WRITE}={write}")]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))


def read_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The records of one version. The files are fixed here: later commits do not change what the result reads."""
    found = version_at(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no version {'' if version is None else version} of a history at {path}")
    return _read(spark, path, found).drop(BUCKET)


def read_tenant(spark: SparkSession, path: str, owner, version: int | None = None) -> DataFrame:
    """One owner's records: only the folder of the owner's bucket is listed and read. No owner, no rows."""
    found = version_at(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no version {'' if version is None else version} of a history at {path}")
    if owner is None:
        return _read(spark, path, found, []).drop(BUCKET)
    layout = StructType.fromJson(json.loads(found.layout))
    bucket = spark.range(1).select(owner_bucket(F.lit(owner).cast(layout["owner_id"].dataType))).first()[0]
    return tenant_history(_read(spark, path, found, [bucket]), owner).drop(BUCKET)


def merge_history(
    spark: SparkSession, batch: DataFrame, path: str, order=("timestamp", "version"), stream: str | None = None, batch_id: int | None = None
) -> Version:
    """Commit a new version with a batch merged in; only buckets of the batch's owners are written.

    Stored and new records of those buckets are merged by one aggregation into files of their own, then the next version names
    them. If another writer commits first, the merge is done again where it touched the same buckets, and only named anew where
    it did not. With ``stream`` and ``batch_id`` the version also notes the batch: a batch that is handed in again, after a
    failure between commit and acknowledgement, changes nothing. An empty batch commits nothing unless a stream hands it in.
    """
    path = path.rstrip("/")
    base = version_at(spark, path)
    if base is None:
        raise FileNotFoundError(f"no history at {path}")
    # At most one number per bucket.
    touched = sorted(r[0] for r in _bucketed(batch).select(BUCKET).distinct().collect())
    write, merged_from, kept = None, None, []
    for _ in range(ATTEMPTS):
        if stream is not None and base.streams.get(stream, -1) >= batch_id:
            return base
        if not touched and stream is None:
            return base
        held = {str(b): base.buckets.get(str(b)) for b in touched}
        if touched and held != merged_from:
            layout = StructType.fromJson(json.loads(base.layout))
            stored = _read(spark, path, base, touched).drop(BUCKET)
            write = _written(_bucketed(upsert(stored, batch.select(*layout.fieldNames()), order)), path)
            merged_from, kept = held, _present(spark, path, write)
        buckets = {b: w for b, w in base.buckets.items() if b not in held} | {str(b): write for b in kept}
        streams = base.streams if stream is None else base.streams | {stream: batch_id}
        version = Version(base.number + 1, buckets, base.layout, streams, time.time())
        if _commit(spark, path, version):
            return version
        base = version_at(spark, path)
    raise Conflict(f"{ATTEMPTS} other writers committed first at {path}")


def clean_up(spark: SparkSession, path: str, keep: int = 5, grace_seconds: float = 86_400) -> int:
    """Drop all versions but the newest ``keep`` and the files that none of those names; returns how many folders went.

    Writes younger than ``grace_seconds`` stay: they may belong to a merge that has not committed yet, or be read through a
    version that goes now.
    """
    path = path.rstrip("/")
    known = _versions(spark, path)
    kept = [version_at(spark, path, n) for n in known[-keep:]]
    for n in known[:-keep]:
        files.delete(spark, f"{path}/{VERSIONS}/{n:010d}.json")
    named = {(write, bucket) for v in kept for bucket, write in v.buckets.items()}
    gone, limit = 0, (time.time() - grace_seconds) * 1000
    for name, changed in files.entries(spark, f"{path}/{DATA}"):
        if not name.startswith(f"{WRITE}=") or changed > limit:
            continue
        write, inside = name.split("=")[1], files.entries(spark, f"{path}/{DATA}/{name}")
        buckets = [n.split("=")[1] for n, _ in inside if n.startswith(f"{BUCKET}=")]
        unused = [b for b in buckets if (write, b) not in named]
        if len(unused) == len(buckets):
            files.delete(spark, f"{path}/{DATA}/{name}")
        else:
            for b in unused:
                files.delete(spark, f"{path}/{DATA}/{name}/{BUCKET}={b}")
        gone += len(unused)
    return gone


def history_sink(spark: SparkSession, path: str, stream: str, order=("timestamp", "version")):
    """Function for ``foreachBatch`` that merges each micro-batch into a history, once, however often it is handed in.

    ``stream`` names the query in the versions; it must stay the same over restarts and differ between queries.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_history(batch.sparkSession, batch, path, order, stream, batch_id)

    return merge
