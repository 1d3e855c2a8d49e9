"""Groups of records that share evidence, and training splits that keep each group together."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuvet.sources.shared import new_path

SHARES = (("TRAIN", 70), ("VALIDATION", 15), ("TEST", 15))
#: Places of the hash by which groups are put in order, so that no order is made in one task.
PARTS = 4096


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written once in the shared folder: later rounds read it again, and a lost executor loses nothing of it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_groups(records: DataFrame, key: str, shared: tuple[str, ...]) -> DataFrame:
    """``key`` and ``group_id`` (smallest key reachable) of every record; records are linked by equal values in a ``shared`` column.

    Empty and null values link nothing; nor does a null key. A value that very many records share is a star round its smallest
    key, so no pairs are made. Stars are then hung below their smallest member, in turns for larger and smaller neighbours,
    until nothing changes; both steps combine their minima before the shuffle.
    """
    keyed = records.filter(F.col(key).isNotNull())
    stars = None
    for column in shared:
        value = F.col(column).cast("string")
        known = keyed.filter(F.length(value) > 0).select(F.col(key).alias("a"), value.alias("_value"))
        least = known.groupBy("_value").agg(F.min("a").alias("b"))
        links = known.join(least, "_value").filter("a <> b").select("a", "b")
        stars = links if stars is None else stars.union(links)
    edges, seen = _stored(stars.distinct(), "group-links"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        pair = lambda a: F.struct(F.col(a).alias("a"), F.col("low").alias("b"))
        small = large.join(low, "a").select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = _stored(small, "group-links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    found = edges.groupBy(F.col("a").alias("_key")).agg(F.min("b").alias("_group"))
    every = records.select(key).distinct()
    return every.join(found, every[key] == F.col("_key"), "left").select(key, F.coalesce("_group", key).alias("group_id"))


def _positions(units: DataFrame, weight: Column) -> DataFrame:
    """``before``: weight of the units before each in its stratum, in the order of a hash; and ``total``, that of the stratum."""
    hashed = units.withColumns({"_hash": F.xxhash64(F.col("group_id").cast("string")), "_w": weight})
    placed = hashed.withColumn("_part", F.pmod(F.col("_hash"), F.lit(PARTS)))
    stratum = Window.partitionBy("stratum")
    earlier = stratum.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("stratum", "_part").agg(F.sum("_w").alias("_sum")).select(
        F.col("stratum").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"),
        F.sum("_sum").over(stratum).alias("total"),
    )
    inside = Window.partitionBy("stratum", "_part").orderBy("_hash", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    same = F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))
    return ranked.join(parts, same).withColumn("before", F.col("_earlier") + F.col("_inside")).drop("_hash", "_part", "_s", "_p", "_earlier", "_inside", "_w")


def _targets(total: Column, shares) -> list[Column]:
    """Rows up to the end of each split; they differ from the exact shares by less than one row."""
    whole, upto, out = sum(n for _, n in shares), 0, []
    for _, n in shares:
        upto += n
        out.append(F.round(total * F.lit(upto) / F.lit(whole)).cast("long"))
    return out


def _split_at(position: Column, bounds: list[Column], names: list[str]) -> Column:
    found = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds[:-1], names[:-1], strict=True))):
        found = F.when(position < bound, name).otherwise(found)
    return found


def split_groups(records: DataFrame, groups: DataFrame, key: str, stratum: str, held_out: dict[str, Column] | None = None, shares=SHARES) -> DataFrame:
    """Records with ``group_id`` and ``split``: no group is in two splits, and every stratum is split in the exact shares.

    ``groups`` has ``key`` and ``group_id`` (``connected_groups``). A group belongs to the largest ``stratum`` value among its
    records. Groups of several records are placed first, by the place of their middle record in a hash order; single ones, in
    the same order, then fill each split up to its share: exact to one record wherever there are enough of them, else off by
    less than the largest group. ``held_out`` names further splits by conditions on the records, for kinds of document or of attack
    that training must not see: a group with such a record goes there as a whole, the first that applies, and counts in no share.
    """
    held_out, names = held_out or {}, [n for n, _ in shares]
    joined = records.join(groups.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    kind = F.coalesce(*[F.when(c, F.lit(n)) for n, c in enumerate(held_out.values())], F.lit(len(held_out)))
    # A null key is a group of its own; a number cannot be one of the others' ids as text, so both stay apart.
    units = joined.groupBy("group_id").agg(F.count("*").alias("size"), F.max(stratum).alias("stratum"), F.min(kind).alias("_held"))
    units = _stored(units, "split-groups")
    open_units = units.filter(F.col("_held") == len(held_out)).drop("_held")
    totals = open_units.groupBy(F.col("stratum").alias("_of")).agg(F.sum("size").alias("_rows"))
    several = _positions(open_units.filter("size > 1"), F.col("size"))
    several = several.withColumn("split", _split_at(F.col("before") + F.col("size") / 2, _targets(F.col("total"), shares), names)).drop("before", "total")
    several = _stored(several, "split-several")
    taken = several.groupBy(F.col("stratum").alias("_in")).agg(*[F.sum(F.when(F.col("split") == n, F.col("size")).otherwise(0)).alias(f"_taken{i}") for i, n in enumerate(names)])
    singles = _positions(open_units.filter("size = 1"), F.lit(1))
    need = singles.join(totals, F.col("stratum").eqNullSafe(F.col("_of"))).join(taken, F.col("stratum").eqNullSafe(F.col("_in")), "left")
    ends, wanted = _targets(F.col("_rows"), shares), []
    for i, end in enumerate(ends):
        share = end - (ends[i - 1] if i else F.lit(0))
        wanted.append(F.greatest(share - F.coalesce(F.col(f"_taken{i}"), F.lit(0)), F.lit(0)))
    # Where groups overfill one split, the others share what singles there are.
    bounds = [sum(wanted[1 : i + 1], wanted[0]) for i in range(len(wanted))]
    scaled = [F.round(b * F.col("total") / F.greatest(bounds[-1], F.lit(1))).cast("long") for b in bounds]
    placed = need.select("group_id", _split_at(F.col("before"), scaled, names).alias("split"))
    held = units.filter(F.col("_held") < len(held_out)).select("group_id", F.get(F.array(*[F.lit(n) for n in held_out] or [F.lit("")]), F.col("_held")).alias("split"))
    splits = several.select("group_id", "split").union(placed).union(held).withColumnRenamed("group_id", "_group")
    return joined.join(splits, F.col("group_id").eqNullSafe(F.col("_group"))).drop("_group")
