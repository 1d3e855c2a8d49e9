"""Groups and splits, forest fusion, sketches and SQL functions on small made-up rows."""

import datetime
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from docuvet.functions import checksums, sql, text
from docuvet.operators import anomaly, evaluation, forest, groups, persons, sketches

RECORDS = "case_id long, evidence_sha256 string, owner_id string, fraud int, kind string, split string"


def brute_groups(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for column in (1, 2):
        first = {}
        for r in rows:
            if r[0] is not None and r[column]:
                a, b = find(first.setdefault(r[column], r[0])), find(r[0])
                parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in parent}


def test_groups_match_union_find(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice((None, "", f"e{rng.randrange(60)}")), rng.choice((None, "", f"o{rng.randrange(150)}")), n % 2, "k", "x") for n in range(200)]
    rows += [(1000 + n, f"chain{n}", f"link{(n + 1) // 2}", 0, "k", "x") for n in range(40)]  # a long chain
    rows += [(2000 + n, "hot", None, 0, "k", "x") for n in range(300)] + [(2000, "hot", None, 0, "k", "x")]
    got = groups.connected_groups(spark.createDataFrame(rows, RECORDS), "case_id", ("evidence_sha256", "owner_id"))
    assert {r.case_id: r.group_id for r in got.collect()} == brute_groups(rows)
    assert groups.connected_groups(spark.createDataFrame([], RECORDS), "case_id", ("owner_id",)).collect() == []


@pytest.mark.parametrize(("seed", "largest"), [(1, 6), (2, 40)])
def test_splits_keep_groups_and_shares(spark, seed, largest):
    rng, rows, n = random.Random(seed), [], 0
    while n < 3000:
        size = rng.randrange(2, largest) if rng.random() < 0.3 else 1
        evidence = f"e{n}" if size > 1 else rng.choice(("", f"e{n}"))
        for _ in range(size):
            rows.append((n, evidence, None, int(rng.random() < 0.1), rng.choice("abcdefgh"), "x"))
            n += 1
    df = spark.createDataFrame(rows, RECORDS).drop("split")
    found = groups.connected_groups(df, "case_id", ("evidence_sha256",))
    split = groups.split_groups(df, found, "case_id", "fraud", {"UNSEEN_TYPE": F.col("kind") == "a", "UNSEEN_ATTACK": (F.col("fraud") == 1) & (F.col("kind") == "b")})
    got = split.collect()
    assert len(got) == len(rows)
    by_group = {}
    for r in got:
        by_group.setdefault(r.group_id, []).append(r)
    assert all(len({r.split for r in g}) == 1 for g in by_group.values())
    assert evaluation.split_leaks(split.filter("evidence_sha256 <> ''"), "evidence_sha256").count() == 0
    for g in by_group.values():
        unseen = any(r.kind == "a" for r in g), any(r.fraud and r.kind == "b" for r in g)
        want = "UNSEEN_TYPE" if unseen[0] else "UNSEEN_ATTACK" if unseen[1] else None
        assert (g[0].split == want) if want else g[0].split in {n for n, _ in groups.SHARES}
    for stratum in (0, 1):
        sizes = {name: sum(len(g) for g in by_group.values() if max(r.fraud for r in g) == stratum and g[0].split == name) for name, _ in groups.SHARES}
        total = sum(sizes.values())
        assert all(abs(sizes[name] - total * share / 100) <= 1 for name, share in groups.SHARES), sizes


def test_splits_of_awkward_records(spark):
    rows = [(None, "e", None, 1, "k", "x"), (1, None, None, None, "k", "x"), (1, None, None, None, "k", "x"), (2, "e", None, 0, None, "x")]
    df = spark.createDataFrame(rows, RECORDS).drop("split")
    found = groups.connected_groups(df, "case_id", ("evidence_sha256",))
    split = groups.split_groups(df, found, "case_id", "fraud")
    assert split.count() == 4 and split.filter("split is null").count() == 0
    empty = df.filter("false")
    assert groups.split_groups(empty, groups.connected_groups(empty, "case_id", ("evidence_sha256",)), "case_id", "fraud").collect() == []


def test_forest_is_sparks_and_contributions_add_up(spark):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        a, b, c = rng.random(), rng.choice((None, 0.0, 1.0)), rng.random()
        rows.append((n, a, b, c, None if n % 50 == 0 else int(a + (b or 0) > 0.9), 7.0))
    cases = spark.createDataFrame(rows, "case_id long, a double, b double, c double, fraud int, contributions double").drop("contributions").coalesce(1)
    model = forest.fit_forest(cases, ("a", "b", "c"), "fraud", trees=7, depth=4)
    got = {r.case_id: r for r in forest.score_forest(cases, model).collect()}
    rows_of = lambda df: VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df.na.fill(0.0, ["a", "b", "c"]))
    known = rows_of(cases.filter("fraud is not null").select("a", "b", "c", F.col("fraud").cast("double").alias("y")))
    theirs = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=7, maxDepth=4, seed=forest.SEED).fit(known).transform(rows_of(cases))
    for r in theirs.select("case_id", vector_to_array("probability")[1].alias("p")).collect():
        assert got[r.case_id].fraud_probability == pytest.approx(r.p, abs=1e-12)
    base = forest.mean_probability(model)
    assert all(base + sum(r.contributions) == pytest.approx(r.fraud_probability, abs=1e-12) for r in got.values())
    # The score that decides nothing contributes least.
    share = np.abs(np.array([r.contributions for r in got.values()])).mean(0)
    assert share.argmin() == 2 and share[0] > 0.05


def test_sketches_merge_over_days(spark):
    rng, rows = random.Random(6), []
    for day in range(1, 21):
        rows += [("hot" if rng.random() < 0.9 else "rare", datetime.datetime(2026, 3, day, rng.randrange(24)), rng.gauss(day, 3.0)) for _ in range(500)]
    rows += [("hot", datetime.datetime(2026, 3, 5), None), ("none", datetime.datetime(2026, 3, 5), None)]
    df = spark.createDataFrame(rows, "document_type string, taken_at timestamp, blur double").repartition(6)
    early, late = df.filter("taken_at < '2026-03-12 12:00:00'"), df.filter("taken_at >= '2026-03-12 12:00:00'")
    keys, shares = ["document_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    days = sketches.add_sketches(*[sketches.daily_sketches(part, keys, "taken_at", "blur") for part in (early, late)], keys)
    assert days.count() == 40 and days.groupBy("document_type", "day").count().filter("count > 1").count() == 0
    for first, last in ((None, None), ("2026-03-04", "2026-03-15"), ("2026-03-12", "2026-03-12")):
        found = sketches.range_percentiles(days, keys, shares, first, last)
        inside = [r for r in rows if r[2] is not None and (first is None or first <= r[1].strftime("%Y-%m-%d") <= last)]
        rows_in = spark.createDataFrame(inside, df.schema)
        for r in found.collect():
            own = [x[2] for x in inside if x[0] == r.document_type]
            assert (r.n, r.low, r.high) == (len(own), min(own), max(own))
        errors = sketches.rank_errors(rows_in, keys, "blur", found, shares).collect()
        assert len(errors) == 2 and all(e[n] < sketches.RANK_ERROR for e in errors for n in shares)
    assert sketches.range_percentiles(days, keys, shares, "2027-01-01").collect() == []


def test_sql_functions_equal_column_functions(spark):
    sql.register(spark)
    sql.register(spark)
    values = ["234567890124", "2345 6789-0124", "", None, "12", "L898902C3", "abc<<é9", "٢٣٤٥٦٧٨٩٠١٢٤", "1234567", "999999990019x", "000000000000"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select(F.expr("icao_check_digit(s)"), F.expr("verhoeff_valid(s)"), F.expr("mask_id(s)"), F.expr("digits_only(s)"))
    s = F.col("s")
    want = df.select(checksums.icao_check_digit(s), checksums.verhoeff_valid(s), text.mask_doc_number(s), checksums.digits_only(s))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    # Inlined: the plan has no call left.
    assert "verhoeff_valid" not in got._jdf.queryExecution().optimizedPlan().toString().replace("verhoeff_valid(s)#", "").replace("AS verhoeff_valid", "")


def test_covariance_of_two_hundred_features(spark):
    rng = np.random.default_rng(3)
    names = [f"f{i}" for i in range(200)]
    values = rng.normal(size=(900, 200)) @ rng.normal(size=(200, 200)) * 0.1 + rng.normal(size=200) * 1e4
    rows = [tuple(map(float, v)) for v in values] + [(None, *map(float, values[0][1:]))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    model = anomaly.fit_genuine(df, tuple(names))
    assert np.allclose(model.means, values.mean(0), rtol=1e-12)
    assert np.allclose(np.array(model.precision) @ np.cov(values.T), np.eye(200), atol=1e-6)
    got = anomaly.with_anomaly(df, model).select("f1", "distance", "contributions").collect()
    gaps = values - values.mean(0)
    want = {v[1]: np.sqrt(g @ np.linalg.inv(np.cov(values.T)) @ g) for v, g in zip(values, gaps)}
    whole = [r for r in got if r.distance is not None]
    assert len(got) == 901 and len(whole) == 900
    assert all(abs(r.distance - want[r.f1]) < 1e-5 and abs(sum(r.contributions) - r.distance**2) < 1e-6 for r in whole)


def test_anomaly_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b double")
    model = anomaly.fit_genuine(empty, ("a", "b"))
    assert model.means == (0.0, 0.0) and anomaly.with_anomaly(empty, model).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("hot", [2, 64])
def test_persons_match_all_pairs(spark, hot):
    rng, rows = random.Random(hot), []
    slip = lambda t: t if not t or rng.random() < 0.6 else (lambda i: t[:i] + rng.choice(["", rng.choice("AB1")]) + t[i + 1 :])(rng.randrange(len(t)))
    for n in range(160):
        name = rng.choice(["ANNA MARIA LOPEZ", "RAVI KUMAR", "LI", "A B", "ABCDEFG", "HOT NAME"])
        name = slip(" ".join(rng.sample(name.split(), len(name.split()))))
        number = rng.choice([None, "", "000000", slip("AB123456"), slip("X"), slip(f"N{n % 9}00{n % 4}")])
        rows.append((None if n == 5 else n, rng.choice([None, "", name, name.lower() + "."]) if rng.random() < 0.2 else name, rng.choice([None, "1990-01-01", "1990-01-01", f"19{n % 7}0"]), number, "x"))
    rows.append(rows[20])
    df = spark.createDataFrame(rows, "case_id long, name string, dob string, doc_number string, person_id string")
    got = persons.same_persons(df, hot=hot).collect()
    key = lambda t: " ".join(sorted("".join(c if c.isalnum() else " " for c in (t or "").upper()).split())) or None
    clean = [(r[0], key(r[1]), r[2] or None, "".join(c for c in (r[3] or "").upper() if c.isalnum()) or None) for r in rows]

    def linked(a, b):
        if None in (a[0], b[0], a[1], b[1]) or edits(a[1], b[1]) > 1:
            return False
        return (a[2] is not None and a[2] == b[2]) or (None not in (a[3], b[3]) and edits(a[3], b[3]) <= 1)

    links = [[j for j in range(len(rows)) if i != j and linked(clean[i], clean[j])] for i in range(len(rows))]
    least = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in range(len(rows)):
        for i, found in enumerate(links):
            for j in found:
                low = min(least[clean[i][0]], least[clean[j][0]])
                least[clean[i][0]] = least[clean[j][0]] = low
    want = sorted((repr((clean[i][0], len(links[i]), least.get(clean[i][0])))) for i in range(len(rows)))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert persons.same_persons(df.filter("false")).collect() == []


def test_fields_side_by_side_equal_the_pivot(spark):
    names = sorted({c for columns in evaluation.SOURCES.values() for c in columns.values()})
    rng = random.Random(7)
    rows = [(n, *[rng.choice((None, f"v{rng.randrange(3)}")) for _ in names]) for n in range(60)] + [(99, *[None] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} string" for c in names))
    pivoted = evaluation.fields_by_source(evaluation.evidence_long(df))
    direct = evaluation.fields_side_by_side(df)
    assert direct.columns == pivoted.columns and sorted(direct.collect(), key=repr) == sorted(pivoted.collect(), key=repr)
    assert "Exchange" not in direct._jdf.queryExecution().executedPlan().toString()
