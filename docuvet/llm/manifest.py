"""A Merkle manifest of verification records: nodes are labelled by the intervals of leaf ranks that they cover.

Every owner has a tree over the owner's records in the order of their keys, and one tree over the owners' subroots holds them
all. A node of level L covers the ranks [lo, hi); its parent is the node of level L + 1 whose interval contains it, found by an
equi-join on the bucket of that level, and its siblings are what the parent's interval holds beside its own.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuvet.llm.storage import stored

#: Nodes that one parent covers.
FAN = 16
OWNER, CASE = "owner_id", "case_id"
#: Fields of a verification record that a leaf covers, in this order.
RECORD_FIELDS = (
    CASE, OWNER, "timestamp", "applicant_name", "document_type", "final_decision", "overall_risk_score", "overall_status",
    "evidence_sha256",
)
_PART_BITS = 33


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of fields in their order: ``-`` for a missing one, else its length in bytes, a colon and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _group() -> Column:
    return F.col("grp")


def _ranked(leaves: DataFrame, order: list[str], label: str) -> DataFrame:
    """``lo`` (rank from 0 in its group), ``hi`` and ``n`` (leaves of the group) for rows of ``grp``; written once.

    Rows are dealt by ranges of (group, order), equal ones too, so a group of any size spreads over partitions; only the counts
    per group and partition meet.
    """
    by = ["grp", *order, "_tie"]
    placed = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_at", _PART_BITS))
    every = Window.partitionBy("grp")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("grp", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select(
        F.col("grp").alias("_grp"), F.col("_part").alias("_own"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(every).alias("n"),
    )
    same = _group().eqNullSafe(F.col("_grp")) & (F.col("_part") == F.col("_own"))
    ranked = placed.join(counts, same).withColumn("lo", F.col("_at") - F.col("_first") + F.col("_before"))
    return ranked.withColumn("hi", F.col("lo") + 1).drop("_grp", "_own", "_first", "_before", "_at", "_part")


def _top() -> Column:
    """Whether a node covers all leaves of its group."""
    return (F.col("lo") == 0) & (F.col("hi") == F.col("n"))


def _bucket(lo: Column, level: int) -> Column:
    return F.floor(lo / F.lit(FAN**level)).cast("long") if FAN**level < 2**52 else F.lit(0).cast("long")


def _climbed(leaves: DataFrame, carried: list[str], label: str) -> list[DataFrame]:
    """Nodes of level 1 and above, one table a level: grp, lo, hi, n, digest, members (intervals and digests of the children).

    Level 1 keeps the ``carried`` columns of its leaves in ``rows``. Each node has at most ``FAN`` children.
    """
    levels, below, depth = [], leaves.filter(~_top()), leaves.agg(F.max("n")).first()[0] or 0
    level = 1
    while FAN ** (level - 1) < depth:
        child = ["lo", "hi", "digest", *(carried if level == 1 else [])]
        grouped = below.groupBy("grp", "n", _bucket(F.col("lo"), level).alias("_bucket")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("lo").alias("_lo"), F.struct(*child).alias("c")))).alias("_c")
        ).withColumn("rows", F.transform("_c", lambda x: x["c"]))
        nodes = grouped.select(
            "grp", "n", F.get("rows", 0)["lo"].alias("lo"), F.element_at("rows", -1)["hi"].alias("hi"),
            F.sha2(_joined(F.transform("rows", lambda c: c["digest"])), 256).alias("digest"), "rows",
        )
        nodes = stored(nodes, f"{label}-level-{level}")
        levels.append(nodes)
        below = nodes.filter(~_top())
        level += 1
    return levels


def _difference(children: Column, lo: Column, hi: Column) -> Column:
    """Digests of the siblings of [lo, hi): the parent's interval without it leaves one stretch before and one after."""
    stretch = lambda beside: _joined(F.transform(F.filter(children, beside), lambda c: c["digest"]))
    return F.struct(stretch(lambda c: c["hi"] <= lo).alias("before"), stretch(lambda c: c["lo"] >= hi).alias("after"))


def _descended(levels: list[DataFrame], above: DataFrame | None) -> DataFrame | None:
    """Nodes of level 1 with ``path``, the siblings on the way up from them, and ``subroot`` and ``root``.

    ``above`` has grp, path, subroot and root for the top node of each group; without it the top of the only group is the root.
    """
    paths = None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1]
        tops = nodes.filter(_top())
        if above is None:
            nothing = F.array().cast("array<struct<before:string,after:string>>")
            reached = tops.select("grp", "lo", "hi", "rows", nothing.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
        else:
            up = above.withColumnRenamed("grp", "_grp")
            reached = tops.join(up, _group().eqNullSafe(F.col("_grp"))).select("grp", "lo", "hi", "rows", "path", "subroot", "root")
        if paths is not None:
            parents = paths.select(
                F.col("grp").alias("_grp"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("rows").alias("_rows"), "path", "subroot", "root",
                _bucket(F.col("lo"), level + 1).alias("_up"),
            )
            inner = nodes.filter(~_top()).withColumn("_bucket", _bucket(F.col("lo"), level + 1))
            contained = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            held = inner.join(parents, _group().eqNullSafe(F.col("_grp")) & (F.col("_bucket") == F.col("_up")) & contained)
            beside = F.array(_difference(F.col("_rows"), F.col("lo"), F.col("hi")))
            reached = reached.unionByName(held.select("grp", "lo", "hi", "rows", F.concat(beside, "path").alias("path"), "subroot", "root"))
        paths = reached
    return paths


def _leaf_paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame | None, carried: list[str]) -> DataFrame:
    """Leaves with their whole path: each takes its siblings in its run and the path of the run."""
    shown = ["digest", "subroot", "root", "path", *carried]
    alone = leaves.filter(_top())
    if above is None:
        nothing = F.array().cast("array<struct<before:string,after:string>>")
        single = alone.select("grp", "digest", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), nothing.alias("path"), *carried)
    else:
        up = above.withColumnRenamed("grp", "_grp")
        single = alone.join(up, _group().eqNullSafe(F.col("_grp"))).select("grp", *shown)
    runs = _descended(levels, above)
    if runs is None:
        return single
    each = runs.select("grp", "rows", "path", "subroot", "root", F.explode("rows").alias("leaf"))
    beside = F.array(_difference(F.col("rows"), F.col("leaf.lo"), F.col("leaf.hi")))
    return single.unionByName(each.select(
        "grp", F.col("leaf.digest").alias("digest"), "subroot", "root", F.concat(beside, "path").alias("path"), *[F.col(f"leaf.{c}").alias(c) for c in carried]
    ))


def _trees(records: DataFrame, fields: tuple[str, ...], owner: str, case: str, carried: tuple[str, ...]):
    """Leaves and levels of all owners' trees, and those of the tree over the subroots."""
    keep = [c for c in carried if c not in (owner, case)]
    names = [f"c{n}" for n in range(len(keep))]
    leaves = records.select(
        F.col(owner).alias("grp"), F.col(case).alias("key"), leaf_digest(*[F.col(f) for f in fields]).alias("digest"),
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
    )
    leaves = _ranked(leaves, ["key", "digest"], "manifest-leaves")
    levels = _climbed(leaves, ["key", *names], "manifest")
    subroots = leaves.filter(_top()).select("grp", "digest")
    for nodes in levels:
        subroots = subroots.unionByName(nodes.filter(_top()).select("grp", "digest"))
    heads = _ranked(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("owner"), "digest"), ["owner"], "manifest-owners")
    return leaves, levels, heads, _climbed(heads, ["owner"], "manifest-top"), dict(zip(keep, names, strict=True))


def manifest_records(
    records: DataFrame, fields: tuple[str, ...] = RECORD_FIELDS, owner: str = OWNER, case: str = CASE, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Leaf, subroot, root and sibling path of every verification record.

    An owner's leaves ascend by ``case``; every ``FAN`` consecutive nodes (the last run: fewer) become the SHA-256 of their
    digests until one remains, the owner's subroot (a lone leaf is its own). The subroots, ordered by ``owner``, become the root
    alike. Returns ``owner``, ``case``, leaf, subroot, root, path (array of struct<before, after>: sibling digests at each level from
    the leaf up) and the ``carried`` columns. ``folded_root`` recomputes the root from a leaf and its path.
    Null owner: an owner of its own, first in order. Null case: first of its owner. Records of one case: ordered by leaf; whole
    repeated rows are leaves of their own. Null fields are ``-``, empty texts ``0:``. Columns that are neither named nor carried are
    not used, whatever their names. No rows in, none out. An owner of a third of all records spreads over ranges of its cases.
    """
    leaves, levels, heads, above, names = _trees(records, fields, owner, case, carried)
    owners = _leaf_paths(heads, above, None, ["owner"]).select(
        F.col("owner").alias("grp"), "path", F.col("digest").alias("subroot"), "root"
    )
    found = _leaf_paths(leaves, levels, owners, ["key", *names.values()])
    return found.select(
        F.col("grp").alias(owner), F.col("key").alias(case), F.col("digest").alias("leaf"), "subroot", "root", "path",
        *[F.col(names[c]).alias(c) for c in carried if c in names],
    )


def manifest_nodes(records: DataFrame, fields: tuple[str, ...] = RECORD_FIELDS, owner: str = OWNER, case: str = CASE) -> DataFrame:
    """All nodes as a table to keep: tree (``owner`` or ``root``), owner, level (leaves are 0), lo, hi, digest.

    The interval [lo, hi) of ranks labels a node: a node lies below another of its tree if its interval is inside the other's.
    """
    leaves, levels, heads, above, _ = _trees(records, fields, owner, case, ())
    out = None
    for tree, tables in (("owner", [leaves, *levels]), ("root", [heads, *above])):
        for level, nodes in enumerate(tables):
            who = F.col("grp").cast("string") if tree == "owner" else F.lit(None).cast("string")
            rows = nodes.select(F.lit(tree).alias("tree"), who.alias(owner), F.lit(level).alias("level"), "lo", "hi", "digest")
            out = rows if out is None else out.unionByName(rows)
    return out


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all sibling digests of a path, level by level, left to right."""
    return F.sha2(_joined(F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256)
