"""Screening evaluation and review work: consistency, error rates, overrides, review queue.

They follow the written design of the original; its code does not contain them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.checksums import digits_only
from docuvet.functions.numbers import dec


def cross_field_findings(today: Column) -> Column:
    """Contradictions between printed fields, zone and barcode, as codes in fixed order."""
    letters = lambda c: F.regexp_replace(F.upper(F.col(c)), "[^A-Z]", "")
    name, zone_name = letters("name"), F.concat(letters("mrz_given_names"), letters("mrz_surname"))
    swapped = F.concat(letters("mrz_surname"), letters("mrz_given_names"))
    far = lambda other: F.levenshtein(name, other) > F.lit(2)
    differs = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    number = lambda c: F.regexp_replace(F.upper(F.col(c)), "[^A-Z0-9]", "")
    issue, expiry, birth = (F.col(c).try_cast("date") for c in ("issue_date", "expiry_date", "dob"))
    expected = (
        F.when(F.col("document_type") == fixed.AADHAAR, F.length(digits_only(F.col("doc_number"))) == 12)
        .when(F.col("document_type") == fixed.PAN, F.col("doc_number").rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"))
    )
    zone = F.col("mrz_status") != "NOT_APPLICABLE"
    checks = (
        ("NAME_MRZ", zone & F.col("name").isNotNull() & far(zone_name) & far(swapped) & ~F.contains(zone_name, name)),
        ("DOB_MRZ", zone & differs("dob", "mrz_dob")),
        ("NUMBER_MRZ", zone & F.col("doc_number").isNotNull() & (number("doc_number") != F.col("mrz_number"))),
        ("GENDER_MRZ", zone & (F.col("mrz_sex") != "UNSPECIFIED") & differs("gender", "mrz_sex")),
        ("BARCODE", F.col("barcode_status") == "MISMATCH"),
        ("ISSUE_AFTER_EXPIRY", issue > expiry),
        ("ISSUED_BEFORE_BIRTH", issue < birth),
        ("EXPIRED", expiry < today),
        ("BIRTH_IN_FUTURE", birth > today),
        ("NUMBER_FORMAT", ~expected),
    )
    return F.array_compact(F.array(*[F.when(hit, code) for code, hit in checks]))


def average_fusion(*scores: str) -> Column:
    """Plain mean of the available scores, the baseline of the weighted fusion."""
    values = F.array_compact(F.array(*[F.col(s).cast("decimal(9,1)") for s in scores]))
    total = F.aggregate(values, dec(0), lambda acc, v: dec(acc + v))
    return F.when(F.size(values) > 0, F.round(dec(total) / F.size(values), 1).cast("decimal(9,1)"))


def escalate(level: Column, part_levels: Column, confidence: Column, min_confidence: int = 60) -> Column:
    """Any single HIGH part lifts the case to at least MEDIUM; so does a low reading confidence."""
    lift = F.exists(part_levels, lambda p: p == "HIGH") | F.coalesce(confidence < min_confidence, F.lit(False))
    return F.when((level == "LOW") & lift, "MEDIUM").otherwise(level)


def _counts_below(scored: DataFrame, label: str, score: str, digits: int = 2) -> DataFrame:
    """Attacks and genuine cases per score value, below it, and in total.

    Scores are counted per value, values are summed in buckets of ``digits`` decimals, and only the buckets' totals are
    swept in one place; inside a bucket its values are. So a score with many decimals gathers nowhere.
    """
    attack = F.col(label) == 1
    counts = scored.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(attack).alias("attacks"), F.count_if(~attack).alias("genuine")
    ).withColumn("_bucket", F.floor(F.col("threshold").cast("double") * 10**digits))
    names = ("attacks", "genuine")
    below = Window.partitionBy("_all").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_all")
    buckets = counts.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in names]).withColumn("_all", F.lit(1)).select(
        "_bucket", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"_before_{c}") for c in names],
        *[F.sum(c).over(whole).alias(f"total_{c}") for c in names],
    )
    inside = Window.partitionBy("_bucket").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in names}).join(buckets, "_bucket")
    return placed.select(
        "threshold", *names, *[(F.col(f"_before_{c}") + F.col(f"_in_{c}")).alias(f"{c}_below") for c in names], *[f"total_{c}" for c in names]
    )


def error_rates(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Attack and bona fide error rates at every threshold (score at or above it counts as attack)."""
    counts = _counts_below(scored, label, score)
    return counts.select(
        "threshold", (F.col("attacks_below") / F.col("total_attacks")).alias("apcer"),
        ((F.col("total_genuine") - F.col("genuine_below")) / F.col("total_genuine")).alias("bpcer"),
    )


def equal_error_rate(rates: DataFrame) -> DataFrame:
    """Threshold at which the two error rates lie closest, and their mean there."""
    gap = F.struct(F.abs(F.col("apcer") - F.col("bpcer")).alias("gap"), F.col("threshold"))
    return rates.agg(F.min_by(F.struct("threshold", "apcer", "bpcer"), gap).alias("r")).select(
        "r.threshold", "r.apcer", "r.bpcer", ((F.col("r.apcer") + F.col("r.bpcer")) / 2).alias("eer")
    )


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the curve from counts per score: share of (attack, genuine) pairs in order."""
    counts = _counts_below(scored, label, score)
    number = lambda c: F.col(c).cast("double")
    ordered = F.sum(number("attacks") * (number("genuine_below") * 2 + number("genuine")))
    return counts.agg((ordered / (F.lit(2.0) * F.sum(number("attacks")) * F.sum(number("genuine")))).alias("auc"))


def confusion(cases: DataFrame, truth: str, decision: str, tiers: list[str]) -> DataFrame:
    """Cases by true class and decision tier, one column per tier."""
    return cases.groupBy(truth).pivot(decision, tiers).agg(F.count(F.lit(1))).na.fill(0)


def decision_rates(cases: DataFrame, is_fraud: Column, is_cleared: Column, is_rejected: Column) -> DataFrame:
    """False-clear and false-escalation rate, precision, recall and F1 of rejecting."""
    counted = cases.agg(
        F.count_if(is_fraud & is_cleared).alias("fc"), F.count_if(~is_fraud & ~is_cleared).alias("fe"),
        F.count_if(is_fraud).alias("fraud"), F.count_if(~is_fraud).alias("honest"),
        F.count_if(is_fraud & is_rejected).alias("tp"), F.count_if(is_rejected).alias("rejected"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counted.select(
        ratio("fc", "fraud").alias("false_clear"), ratio("fe", "honest").alias("false_escalation"),
        ratio("tp", "rejected").alias("precision"), ratio("tp", "fraud").alias("recall"),
        F.when(F.col("rejected") + F.col("fraud") > 0, F.col("tp") * 2 / (F.col("rejected") + F.col("fraud"))).alias("f1"),
    )


def with_overrides(cases: DataFrame, overrides: DataFrame) -> DataFrame:
    """Latest analyst decision per case over the computed one; the override log is only appended to."""
    latest = overrides.groupBy("case_id").agg(
        F.max_by(F.struct("action", "analyst"), F.struct("acted_at", "override_id")).alias("o"), F.count("*").alias("override_count")
    )
    joined = cases.join(latest, "case_id", "left")
    return joined.select(
        *cases.columns, F.coalesce("o.action", F.col("final_decision")).alias("effective_decision"),
        F.col("o.analyst").alias("analyst"), F.coalesce("override_count", F.lit(0)).alias("override_count"),
    )


def within_retention(records: DataFrame, now: Column, days: int) -> DataFrame:
    """Records still inside the retention time. The bound is one constant, so it prunes the scan."""
    return records.filter(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days)))


def above_type_threshold(cases: DataFrame, thresholds: DataFrame, score: str, default: float) -> DataFrame:
    """Compare scores with the threshold of their document type, or with the default."""
    joined = cases.join(thresholds, "document_type", "left").withColumn("limit", F.coalesce("threshold", F.lit(default)))
    return joined.withColumn("exceeds", F.col(score) > F.col("limit")).drop("threshold")


SOURCES = {
    "OCR": {"name": "name", "dob": "dob", "gender": "gender", "number": "doc_number"},
    "MRZ": {"name": "mrz_surname", "dob": "mrz_dob", "gender": "mrz_sex", "number": "mrz_number"},
    "QR": {"name": "qr_name", "dob": "qr_dob", "gender": "qr_gender", "number": "qr_uid_masked"},
}


def evidence_long(documents: DataFrame) -> DataFrame:
    """One row per document, field and source for the fields that several sources give."""
    rows = F.array(*[
        F.struct(F.lit(field).alias("field_name"), F.lit(source).alias("source"), F.col(column).alias("value"))
        for source, fields in SOURCES.items() for field, column in fields.items()
    ])
    # The outer form keeps the optimizer from repeating the column chain in an inferred filter.
    return documents.select("doc_id", F.inline_outer(rows)).filter(F.col("value").isNotNull())


def fields_by_source(long_rows: DataFrame) -> DataFrame:
    """Stored long rows back to one row per document and field, one column per source."""
    return long_rows.groupBy("doc_id", "field_name").pivot("source", list(SOURCES)).agg(F.min("value"))


def fields_side_by_side(documents: DataFrame) -> DataFrame:
    """The same straight from documents: all sources of a document are in its row, so nothing is shuffled."""
    rows = F.array(*[
        F.struct(F.lit(field).alias("field_name"), *[F.col(columns[field]).alias(source) for source, columns in SOURCES.items()]) for field in SOURCES["OCR"]
    ])
    return documents.select("doc_id", F.inline_outer(rows)).filter(F.coalesce(*SOURCES).isNotNull())


def review_queue(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Medium-risk cases that nobody has decided yet, oldest first."""
    open_cases = cases.filter(F.col("risk_level") == "MEDIUM").join(decisions.select("case_id"), "case_id", "left_anti")
    return open_cases.orderBy("screened_at", "case_id")


def top_contributions(names: list[str], values: Column, count: int = 3) -> Column:
    """The features that contribute most, largest first."""
    pairs = F.arrays_zip(values.alias("value"), F.array(*[F.lit(n) for n in names]).alias("name"))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, count), lambda p: p["name"])


def shared_evidence(records: DataFrame) -> DataFrame:
    """Evidence files that more than one owner submitted, with their owners and cases. Owners and cases count once each."""
    known = records.filter(F.length("evidence_sha256") > 0)
    cases = known.groupBy("evidence_sha256", "owner_id", "case_id").agg(F.min("timestamp").alias("first_at"))
    owners = cases.groupBy("evidence_sha256", "owner_id").agg(F.count("*").alias("cases"), F.min("first_at").alias("first_at"))
    return owners.groupBy("evidence_sha256").agg(
        F.count("*").alias("owners"), F.sum("cases").alias("cases"), F.min_by("owner_id", F.struct("first_at", "owner_id")).alias("first_owner")
    ).filter(F.col("owners") > 1)


SPLIT_SHARES = (("TRAIN", 70), ("VALIDATION", 15), ("TEST", 15))


def split_documents(documents: DataFrame, key: str, shares=SPLIT_SHARES) -> DataFrame:
    """Assign every document to a split by a hash of its key, so that all rows of a document, in every class, go together.

    The hash is independent of the class, so each class is split in the same shares; no shuffle is needed.
    """
    digest = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8)
    place = F.conv(digest, 16, 10).cast("long") % F.lit(sum(n for _, n in shares))
    split = F.lit(shares[-1][0])
    for name, share in reversed(shares[:-1]):
        bound = sum(n for other, n in shares[: [s for s, _ in shares].index(name) + 1])
        split = F.when(place < bound, name).otherwise(split)
    return documents.withColumn("split", split)


def split_leaks(rows: DataFrame, evidence: str) -> DataFrame:
    """Evidence that occurs in more than one split: empty if no copy of a training document is tested on."""
    found = rows.groupBy(evidence).agg(F.min("split").alias("first"), F.max("split").alias("last"), F.count("*").alias("rows"))
    return found.filter("first <> last")


def training_rows(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Screened cases with the analyst's latest decision as their label; undecided cases give no row."""
    latest = decisions.groupBy("case_id").agg(F.max_by("action", F.struct("acted_at", "override_id", "action")).alias("label"))
    return cases.join(latest, "case_id")
