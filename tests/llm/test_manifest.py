"""The manifest of verification records against a plain walk over lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docuvet.llm import manifest, queries

FIELDS = ("case_id", "owner_id", "document_type", "overall_risk_score", "evidence_sha256")
SCHEMA = "case_id string, owner_id string, document_type string, overall_risk_score long, evidence_sha256 string, digest string, lo long, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """Levels of a tree over digests in order."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    """(before, after) of each level from the leaf up."""
    out = []
    for nodes in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
        at //= 16
    return out


def brute(rows):
    """(owner, case, leaf, subroot, root, path) of rows whose first two values are case and owner."""
    null_first = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((null_first(row[0]), leaf(row), row[0]))
    owners = sorted(trees, key=null_first)
    levels = {o: climb([x[1] for x in sorted(trees[o])]) for o in owners}
    top = climb([levels[o][-1][0] for o in owners])
    return [
        (o, x[2], x[1], levels[o][-1][0], top[-1][0], siblings(levels[o], n) + siblings(top, at))
        for at, o in enumerate(owners) for n, x in enumerate(sorted(trees[o]))
    ]


def records(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for owner, n in sizes.items():
        for i in range(n):
            case = None if i == 0 and owner == "ORG-2" else f"CYBER-{rng.randrange(10**9):09d}"
            rows.append((case, owner, rng.choice(("PASSPORT", "VOTER_ID", None, "")), rng.choice((None, 0, 95)), rng.choice((None, "ß" * 3, "ab"))))
    return rows


@pytest.mark.parametrize("sizes", [
    {"USR-1": 1}, {None: 2}, {"USR-1": 16, "ORG-2": 17}, {f"USR-{n}": 1 for n in range(18)}, {"ORG-2": 700, None: 3, "": 1, "Ä": 33, "z": 257},
])
def test_manifest_matches_lists(spark, sizes):
    rows = records(sizes)
    rows += rows[:2]  # repeated rows
    df = spark.createDataFrame([(*r, "d", 5, "p") for r in rows], SCHEMA)
    got = manifest.manifest_records(df, FIELDS, carried=("document_type", "digest")).collect()
    want = sorted(brute(rows), key=repr)
    assert sorted([(r.owner_id, r.case_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got], key=repr) == want
    assert {r.digest for r in got} == {"d"}
    assert sorted(map(repr, (r.document_type for r in got))) == sorted(map(repr, (r[2] for r in rows)))


def test_proofs_fold_to_the_root_and_show_changes(spark):
    df = spark.createDataFrame([(*r, "d", 5, "p") for r in records({"ORG-2": 40, "USR-1": 1, "USR-9": 20})], SCHEMA)
    proven = manifest.manifest_records(df, FIELDS)
    path = F.col("path")
    checked = proven.select(
        (manifest.folded_root(F.col("leaf"), path) == F.col("root")).alias("own"), (manifest.folded_root(F.sha2("leaf", 256), path) == F.col("root")).alias("other"),
        "path", manifest.proof_digest(path).alias("proof"),
    ).collect()
    assert all(r.own and not r.other for r in checked)
    assert all(r.proof == sha("".join(a + b for a, b in r.path)) for r in checked)


def test_nodes_are_nested_intervals(spark):
    df = spark.createDataFrame([(*r, "d", 5, "p") for r in records({"ORG-2": 300, "USR-1": 5})], SCHEMA)
    nodes = manifest.manifest_nodes(df, FIELDS).collect()
    inside = [n for n in nodes if n.tree == "owner" and n.owner_id == "ORG-2"]
    assert [sum(n.level == k for n in inside) for k in range(4)] == [300, 19, 2, 1]
    for n in inside:
        holders = [m for m in inside if m.level == n.level + 1 and m.lo <= n.lo and n.hi <= m.hi]
        assert len(holders) == (n.level < 3)
    assert sum(n.tree == "root" and n.level == 1 for n in nodes) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert manifest.manifest_records(df, FIELDS).collect() == []
    assert manifest.manifest_records(df, FIELDS).columns == ["owner_id", "case_id", "leaf", "subroot", "root", "path"]
    assert manifest.manifest_nodes(df, FIELDS).collect() == []


def test_query_on_awkward_documents(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "abc", "Abc\n", "ÄÖ Z", "X" * 100_000]
    rows = [(rng.choice((None, n)) if n < 3 else n, rng.choice(texts), rng.choice((None, "en")), rng.choice((None, "hot", "hot", f"s{n % 30}")), rng.choice((None, 3))) for n in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_interval_manifest"](spark, str(tmp_path)).collect()
    fields = {leaf((d, s, la, n, t)): (d, s, la, n, t) for d, t, la, s, n in rows}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def folded(values, path):
        changed = values[0] is not None and zlib.crc32(str(values[0]).encode()) % 5 == 0
        digest = leaf((*values[:4], values[4].translate(lower) if values[4] is not None and changed else values[4]))
        for before, after in path:
            digest = sha(before + digest + after)
        return digest

    want = [
        (case, x, subroot, root, sha("".join(a + b for a, b in path)), folded(fields[x], path), folded(fields[x], path) == root)
        for _, case, x, subroot, root, path in brute([(d, s, la, n, t) for d, t, la, s, n in rows])
    ]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert any(not r.verified for r in got)
