"""Module results, review decisions and audit actions as long rows, an append-only audit table, and data minimisation by policy."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docuvet.sources.files import exists

#: Layout of every long row: what happened to a case, by whom, with which outcome.
LAYOUT = "event_id string, case_id string, at timestamp, kind string, actor string, subject string, value string"
MODULE, REVIEW, ACTION = "MODULE", "REVIEW", "ACTION"
DAY = "day"


def _rows(df: DataFrame, at: Column, kind: str, actor: Column, subject: Column, value: Column) -> DataFrame:
    """Long rows; their id is a digest of all they say, so that the same row written again is known."""
    rows = df.select(
        F.col("case_id").cast("string").alias("case_id"), at.cast("timestamp").alias("at"), F.lit(kind).alias("kind"), actor.cast("string").alias("actor"),
        subject.cast("string").alias("subject"), value.cast("string").alias("value"),
    )
    said = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]
    return rows.select(F.sha2(F.concat_ws("\n", *said), 256).alias("event_id"), "*")


def module_results(cases: DataFrame, at: str) -> DataFrame:
    """Five rows a screened case: the scores of the modules and the composite one. No shuffle."""
    modules = {"DOCUMENT": "document_risk", "CONSISTENCY": "consistency_risk", "FACE": "face_risk", "LIVENESS": "liveness_risk", "COMPOSITE": "risk_score"}
    scores = F.array(*[F.struct(F.lit(m).alias("module"), F.col(c).cast("decimal(9,1)").alias("score")) for m, c in modules.items()])
    each = cases.select("case_id", F.col(at).alias("_at"), F.explode(scores).alias("m"))
    return _rows(each, F.col("_at"), MODULE, F.lit("screening"), F.col("m.module"), F.col("m.score"))


def review_decisions(overrides: DataFrame) -> DataFrame:
    """One row per analyst's decision."""
    return _rows(overrides, F.col("acted_at"), REVIEW, F.col("analyst"), F.lit("final_decision"), F.col("action"))


def audit_actions(actions: DataFrame) -> DataFrame:
    """Rows of (case_id, at, actor, action, detail): reads, exports, deletions."""
    return _rows(actions, F.col("at"), ACTION, F.col("actor"), F.col("action"), F.col("detail"))


def long_rows(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def append_audit(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Add rows to an audit table in folders by day. Nothing that is there is ever rewritten.

    Rows whose id is there already are left out, so a batch that is handed in again adds nothing; only the days of the batch are
    read for that. One job appends to a table at a time.
    """
    dated = rows.dropDuplicates(["event_id"]).withColumn(DAY, F.coalesce(F.to_date("at"), F.lit("1970-01-01").cast("date")))
    # At most one value a day.
    days = [r[0] for r in dated.select(DAY).distinct().collect()]
    try:
        known = read_audit(spark, path).filter(F.col(DAY).isin(days)).select("event_id")
    except FileNotFoundError:
        known = None
    new = dated if known is None else dated.join(known, "event_id", "left_anti")
    new.write.mode("append").partitionBy(DAY).parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(f"{LAYOUT}, {DAY} date").parquet(path)


KEEP, MASK, HASH, DROP = "KEEP", "MASK", "HASH", "DROP"


@dataclass(frozen=True)
class Policy:
    """What a role sees of a column in records older than so many days."""

    role: str
    column: str
    older_than_days: int
    action: str


def read_policies(table: DataFrame) -> list[Policy]:
    """A policy table (role, column, older_than_days, action); it has as many rows as roles, columns and ages that differ."""
    return [Policy(*r) for r in table.select("role", "column", "older_than_days", "action").collect()]


def _shown(column: str, action: str, kind: str) -> Column:
    value = F.col(column).cast("string")
    shown = {
        KEEP: F.col(column), MASK: F.concat(F.left(value, F.lit(1)), F.lit("***")), HASH: F.substring(F.sha2(value, 256), 1, 12), DROP: F.lit(None),
    }
    if action not in shown:
        raise ValueError(f"no such action: {action}")
    return shown[action].cast(kind)


def minimised(records: DataFrame, policies: list[Policy], role: str, at: str, today: Column) -> DataFrame:
    """Records as ``role`` may see them ``today``: per column the policy of the highest age that a record has passed.

    The policies become one projection, so columns that are not read further down are still pruned and filters pushed. Columns
    that a policy masks or hashes become strings; without a policy a column is shown. A record without a time counts as older than
    any age. A policy for a column that is not there is an error.
    """
    own = [p for p in policies if p.role == role]
    unknown = {p.column for p in own} - set(records.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    age = F.date_diff(today, F.to_date(at))
    kinds, shown = dict(records.dtypes), []
    for column in records.columns:
        rules = sorted((p for p in own if p.column == column), key=lambda p: -p.older_than_days)
        kind = "string" if any(p.action in (MASK, HASH) for p in rules) else kinds[column]
        value = F.col(column).cast(kind)
        for p in reversed(rules):
            value = F.when(age.isNull() | (age > p.older_than_days), _shown(column, p.action, kind)).otherwise(value)
        shown.append(value.alias(column))
    return records.select(*shown)
