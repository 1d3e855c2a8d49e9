"""Tenant-isolated verification history: records, upserts, lookups, search and KPIs."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from docuvet import fixed
from docuvet.functions.text import first_non_empty

KEY = ("owner_id", "case_id")
SECRETS = ("password_hash", "salt")

# Places of each field of a submitted result, in the order in which the first non-empty one counts. Dotted names lie inside
# the nested document result.
_DOCUMENTS = ("doc_data", "docAnalysis")
_inside = lambda *names: tuple(f"{d}.{n}" for d in _DOCUMENTS for n in names)
KEY_SPELLINGS = {
    "case_id": ("case_id", "caseId"),
    "name": (*_inside("ocr.fields.name"), "name"),
    "applicant_name": ("applicant_name", "applicantName"),
    "document_type": (*_inside("documentType", "document_type"), "documentType", "document_type"),
    "source_display": (*_inside("source_display", "source_type"), "source_display", "source_type"),
    "final_decision": ("final_decision", "finalDecision"),
    "overall_risk_score": ("overall_risk_score", "overallRiskScore"),
    "overall_status": ("overall_status", "overallStatus"),
    "evidence_sha256": (*_inside("evidenceSha256", "evidence_sha256"), "evidenceSha256", "evidence_sha256"),
    "reasons": (*_inside("suspiciousReasons", "reasons"), "suspiciousReasons", "reasons"),
    "doc_number": (*_inside("ocr.fields.docNumber", "ocr.fields.doc_number"), "doc_number", "docNumber"),
    "dob": (*_inside("ocr.fields.dob"), "dob"),
    "gender": (*_inside("ocr.fields.gender"), "gender"),
    "address": (*_inside("ocr.fields.address"), "address"),
    "tampering_score": ("tampering_score", "tamperingScore"),
    "composite_risk_score": ("composite_risk_score", "compositeRiskScore"),
    "face_similarity": ("face_similarity", "faceSimilarity", "similarity_score", "similarityScore"),
    "face_status": ("face_status", "faceStatus"),
    "liveness_passed": ("liveness_passed", "livenessPassed"),
}
# Types of the fields that a submission may lack altogether.
OPTIONAL = {
    "overall_risk_score": "double", "reasons": "array<string>", "face_similarity": "double", "liveness_passed": "boolean",
    "timestamp": "timestamp", "user_id": "string", "result_key": "string",
}
RECORD_DEFAULTS = {
    "applicant_name": fixed.DEFAULT_APPLICANT,
    "document_type": fixed.NATIONAL_ID,
    "source_display": fixed.DEFAULT_SOURCE,
    "final_decision": "VERIFIED",
    "overall_status": "LOW",
    "evidence_sha256": "",
}
SHOWN_FIELDS = ("name", "doc_number", "dob", "gender", "address")


def _type_at(df: DataFrame, path: str):
    """Type of a column or of a field inside structs; None where there is none."""
    kind = df.schema
    for part in path.split("."):
        if not isinstance(kind, StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


def normalize_keys(df: DataFrame, spellings: dict = KEY_SPELLINGS) -> DataFrame:
    """Merge the spellings and nested places of each field into one column; other columns pass through.

    Of strings the first non-empty one counts, of other types the first that is there. Nested results are left out once
    they have been read.
    """
    present = {name: [(s, _type_at(df, s)) for s in options] for name, options in spellings.items()}
    found = {name: [(s, t) for s, t in options if t is not None] for name, options in present.items()}
    used = {s.split(".")[0] for options in found.values() for s, _ in options} | ({*_DOCUMENTS} if spellings is KEY_SPELLINGS else set())
    columns = [F.col(c) for c in df.columns if c not in used]
    for name, options in found.items():
        if options:
            pick = first_non_empty if all(isinstance(t, StringType) for _, t in options) else F.coalesce
            columns.append(pick(*[F.col(s) for s, _ in options]).alias(name))
    return df.select(*columns)


def with_optional(df: DataFrame, names) -> DataFrame:
    """Add the columns that a submission lacks, as NULLs of their type."""
    return df.withColumns({c: F.lit(None).cast(OPTIONAL.get(c, "string")) for c in names if c not in df.columns})


def project_verification_record(submitted: DataFrame, users: DataFrame) -> DataFrame:
    """Flatten submitted results, normalised by ``normalize_keys``, and their submitting users into the record layout.

    Results without a known user are kept under the anonymous owner. The recognised name comes before the name that the
    applicant gave. Fields that no submission has take their defaults.
    """
    needed = (*RECORD_DEFAULTS, *SHOWN_FIELDS, *OPTIONAL, "case_id")
    df = with_optional(submitted, needed)
    owner = with_optional(users, ("org_name",)).select(
        F.col("id").alias("user_id"), F.col("email").alias("owner_email"), F.col("role").alias("owner_role"), "org_name"
    )
    df = df.join(owner, "user_id", "left")
    texts = {
        name: F.coalesce(first_non_empty(F.col(name)), F.lit(default)) for name, default in RECORD_DEFAULTS.items()
    }
    texts["applicant_name"] = F.coalesce(first_non_empty(F.col("name"), F.col("applicant_name")), F.lit(fixed.DEFAULT_APPLICANT))
    shown = [F.coalesce(first_non_empty(F.col(f)), F.lit(fixed.NOT_DETECTED)).alias(f) for f in SHOWN_FIELDS]
    made_up = F.concat(F.lit("VERIF-"), F.upper(F.substring(F.sha2(F.col("result_key").cast("string").cast("binary"), 256), 1, 8)))
    return df.select(
        F.coalesce(first_non_empty(F.col("case_id")), made_up).alias("case_id"),
        F.when(F.col("owner_email").isNotNull(), F.col("user_id")).otherwise("ANONYMOUS").alias("owner_id"),
        F.coalesce("owner_email", F.lit("anonymous")).alias("owner_email"),
        F.coalesce("owner_role", F.lit("INDIVIDUAL")).alias("owner_role"),
        F.coalesce("org_name", F.lit("")).alias("org_name"),
        "timestamp",
        *[texts[c].alias(c) for c in ("applicant_name", "document_type", "source_display", "final_decision")],
        # A true zero is a score; only a missing one takes the default.
        F.coalesce(F.col("overall_risk_score"), F.lit(5)).cast("decimal(9,1)").alias("overall_risk_score"),
        texts["overall_status"].alias("overall_status"),
        texts["evidence_sha256"].alias("evidence_sha256"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
        F.coalesce("liveness_passed", F.lit(True)).alias("liveness_passed"),
        F.coalesce(F.col("face_similarity"), F.lit(95)).cast("decimal(9,1)").alias("face_similarity"),
        F.struct(*shown).alias("ocr_fields"),
    )


def display_fields() -> Column:
    """Label, value and presence flag of the five shown fields."""
    shown = (("Applicant Name", "name"), ("Document ID", "doc_number"), ("Date of Birth", "dob"),
             ("Address", "address"), ("Gender", "gender"))
    return F.array(
        *[
            F.struct(
                F.lit(label).alias("field"),
                F.coalesce(first_non_empty(F.col(c)), F.lit(fixed.NOT_DETECTED)).alias("value"),
                first_non_empty(F.col(c)).isNotNull().alias("is_consistent"),
            )
            for label, c in shown
        ]
    )


def sanitize_users(users: DataFrame) -> DataFrame:
    return users.drop(*SECRETS)


def latest_records(records: DataFrame, order=("timestamp", "version")) -> DataFrame:
    """Last version per owner and case.

    ``max_by`` combines on the map side, so a case that is re-submitted millions of
    times arrives at the reducer as one row per input partition.
    """
    rest = [c for c in records.columns if c not in KEY]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return records.groupBy(*KEY).agg(newest.alias("r")).select(*KEY, *[F.col(f"r.{c}") for c in rest])


def upsert(existing: DataFrame, batch: DataFrame, order=("timestamp", "version")) -> DataFrame:
    """Replace stored records that the batch repeats and add the others, in one aggregation over both.

    Any record of the batch comes before a stored one; of several, the newest counts. The owner is part of the key, so a
    batch can never overwrite another tenant's record.
    """
    both = existing.withColumn("_fresh", F.lit(0)).unionByName(batch.withColumn("_fresh", F.lit(1)))
    return latest_records(both, ("_fresh", *order)).drop("_fresh")


def tenant_history(records: DataFrame, owner) -> DataFrame:
    """Records of one owner; no owner, no rows. On a stored history (``owner_bucket``) only the owner's folder is read."""
    if owner is None:
        return records.filter(F.lit(False))
    mine = records.filter(F.col("owner_id") == owner)
    if BUCKET in records.columns:
        mine = mine.filter(F.col(BUCKET) == owner_bucket(F.lit(owner)))
    return mine


BUCKET, BUCKETS = "owner_bucket", 256


def owner_bucket(owner: Column, buckets: int = BUCKETS) -> Column:
    """Folder of an owner in a stored history."""
    return F.pmod(F.xxhash64(owner.cast("string")), F.lit(buckets)).cast("int")


def lookup_case(records: DataFrame, case, user=None, role: str = "INDIVIDUAL", order=("timestamp", "version")) -> DataFrame:
    """One record by case number, visible to its owner and to administrators; of several owners' the newest."""
    hit = records.filter(F.col("case_id") == case)
    if role != "ADMIN":
        hit = tenant_history(hit, user)
    return hit.orderBy(*[F.desc(c) for c in order], "owner_id").limit(1)


def lookup_cases(records: DataFrame, requests: DataFrame, order=("timestamp", "version")) -> DataFrame:
    """Bulk lookup: requests of (case_id, user_id, role) against the latest records, one row per answered request.

    Owners' requests join on owner and case. Administrators' join on the case with the newest record of it, chosen before the
    join, so no request meets more than one record.
    """
    asked = requests.select("case_id", "user_id", "role")
    admin = F.coalesce(F.col("role") == "ADMIN", F.lit(False))
    rest = [c for c in records.columns if c != "case_id"]
    newest = F.max_by(F.struct(*rest), F.struct(*order, "owner_id"))
    by_case = records.groupBy("case_id").agg(newest.alias("r")).select("case_id", *[F.col(f"r.{c}") for c in rest])
    own = asked.filter(~admin).join(records.withColumn("user_id", F.col("owner_id")), ["case_id", "user_id"])
    return own.unionByName(asked.filter(admin).join(by_case, "case_id"))


def search_history(records: DataFrame, text: str = "", decision: str = "ALL") -> DataFrame:
    """Case-insensitive substring search over three columns, and an optional decision."""
    needle = F.lit(text.lower())
    columns = ("case_id", "applicant_name", "document_type")
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c).cast("string")), needle) for c in columns])
    found = records.filter(hit)
    return found if decision == "ALL" else found.filter(F.col("final_decision") == decision)


def tenant_kpis(records: DataFrame, *keys: str) -> DataFrame:
    decision = F.col("final_decision")
    return records.groupBy(*(keys or ("owner_id",))).agg(
        F.count("*").alias("total"),
        F.count_if(decision == "VERIFIED").alias("verified"),
        F.count_if(decision.isin("SUSPICIOUS", "RECAPTURE REQUIRED")).alias("suspicious"),
        F.count_if(decision == "HIGH RISK").alias("high_risk"),
    )


def newest_first(records: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Position of each record in its owner's history, newest first.

    A window over the whole owner would put a large tenant into one task. Records are
    counted per owner and time bucket first; the counts of newer buckets give the offset,
    and rows are numbered only inside a bucket.
    """
    bucket = F.to_date("timestamp") if bucket is None else bucket
    rows = records.withColumn("_bucket", bucket)
    newer = Window.partitionBy("owner_id").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("owner_id", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select("owner_id", "_bucket", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("owner_id", "_bucket").orderBy(F.desc("timestamp"), "case_id")
    return (
        rows.join(offsets, ["owner_id", "_bucket"])
        .withColumn("position", F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )


def admit_registrations(requests: DataFrame, users: DataFrame, order=("request_id",)) -> DataFrame:
    """New users of a batch: valid, first of their address in the batch by ``order``, not yet known."""
    role = F.upper(F.coalesce(first_non_empty(F.col("role")), F.lit("INDIVIDUAL")))
    cleaned = requests.withColumns({"email": F.lower(F.trim("email")), "role": role}).filter(F.col("email").contains("@"))
    rest = [c for c in cleaned.columns if c != "email"]
    first = (
        cleaned.groupBy("email")
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
        .select("email", *[F.col(f"r.{c}") for c in rest])
        .join(users.select("email"), "email", "left_anti")
    )
    person = F.col("role") == "INDIVIDUAL"
    tag = F.upper(F.substring(F.md5(F.col("email").cast("binary")), 1, 8))
    org_tag = F.upper(F.substring(F.md5(F.concat(F.lit("org:"), "email").cast("binary")), 1, 6))
    return first.select(
        F.concat(F.when(person, "USR-").otherwise("ORG-"), tag).alias("id"),
        "email",
        F.coalesce("username", F.split("email", "@")[0]).alias("username"),
        "role",
        F.when(person, F.coalesce("full_name", F.lit(fixed.DEFAULT_APPLICANT))).alias("full_name"),
        F.when(~person, F.coalesce("org_name", F.lit(fixed.DEFAULT_ORGANISATION))).alias("org_name"),
        F.when(~person, F.coalesce("org_id", F.concat(F.lit("ORG-"), org_tag))).alias("org_id"),
        F.when(~person, F.coalesce("org_type", F.lit(fixed.DEFAULT_ORGANISATION_TYPE))).alias("org_type"),
        F.when(~person, F.coalesce("authorized_person", F.lit(fixed.DEFAULT_OFFICER))).alias("authorized_person"),
    )


def union_users(individuals: DataFrame, organisations: DataFrame) -> DataFrame:
    """Users of both roles; columns of the other role are NULL."""
    return individuals.unionByName(organisations, allowMissingColumns=True)


def records_with_owner(records: DataFrame, users: DataFrame) -> DataFrame:
    """Each record with its owner's profile. The user side is left to the size-based join choice."""
    return records.join(sanitize_users(users).withColumnRenamed("id", "owner_id"), "owner_id")


def sessions_with_user(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Session events of known users only, without secrets."""
    return sessions.join(sanitize_users(users), "email")
