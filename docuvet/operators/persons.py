"""The same person on several records, written differently: names in another order or with a slip, numbers with a slip.

Two records are linked if their names, as sorted words, differ by one edit at most, and either the dates of birth are equal or the
numbers differ by one edit at most. Candidates come from keys that no such pair can miss: texts within one edit of each other
share a text with one character left out. Equal values are one class from the start, so a name, date or number that very many records
have makes no pairs; names of one date that differ in one place are counted as cliques, without pairs either.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuvet.operators.groups import connected_groups
from docuvet.sources.shared import new_path

#: Members of a candidate block above which it is split by a second set of keys.
HOT = 64


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def name_key(name: Column) -> Column:
    """Upper-case words of a name in alphabetical order; NULL without any."""
    words = F.filter(F.split(F.upper(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.nullif(F.array_join(F.array_sort(words), " "), F.lit(""))


def number_key(number: Column) -> Column:
    """Letters and digits of a number; NULL without any."""
    return F.nullif(F.regexp_replace(F.upper(number), "[^A-Z0-9]", ""), F.lit(""))


def one_left_out(text: Column) -> Column:
    """The text itself and every text with one of its characters left out."""
    without = lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    return F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.length(text)), without)))


def _near(a: str, b: str) -> Column:
    """At most one edit; the threshold lets the distance stop early."""
    return F.levenshtein(F.col(a), F.col(b), 1) >= 0


def _pairs(keyed: DataFrame) -> DataFrame:
    """Different members (a, b) of every block, each once; blocks are small by construction."""
    several = keyed.groupBy("block").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    met = _stored(keyed.join(several, "block"), "person-blocks")
    other = met.select("block", F.col("a").alias("b"))
    return met.join(other, "block").filter("a < b").select("a", "b").distinct()


def _met(keyed: DataFrame) -> DataFrame:
    """Rows of the blocks of several members, with the block's size ``_n``; one shuffle, and no block is held in memory."""
    return keyed.withColumn("_n", F.count("*").over(Window.partitionBy("block"))).filter("_n > 1")


def _rest(text: str, place: str = "place") -> Column:
    """A text without its character at a place, counted from 1; the whole text at place 0."""
    at, text = F.col(place), F.col(text)
    return F.concat(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substring(text, at + 1, F.length(text)))


def _each_left_out(df: DataFrame, text: str) -> DataFrame:
    """``one_left_out`` as rows: ``place`` and ``rest``. Of equal neighbours only the first is left out, so every rest comes once."""
    places = df.withColumn("place", F.explode(F.sequence(F.lit(0), F.length(text))))
    at = lambda place: F.substring(F.col(text), place, F.lit(1))
    return places.filter((F.col("place") < 2) | (at(F.col("place")) != at(F.col("place") - 1))).withColumn("rest", _rest(text))


def _cliques(classes: DataFrame) -> DataFrame:
    """Members (a, n, rep_key) of every clique (dob, place, rest): names of one date that are equal but for the character at ``place``.

    All members of a clique are linked, and names of one length are within one edit in exactly one clique. So their links need no
    pairs, which would grow with the square of the names. Cliques of one are left out.
    """
    places = classes.select(F.col("rep").alias("a"), "dob", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("place"))
    keyed = places.select("a", "place", F.xxhash64("dob", "place", _rest("name")).alias("block"))
    met = _met(keyed).select("a", "place").join(classes.withColumnRenamed("rep", "a"), "a")
    return _stored(met.select("a", "n", "rep_key", "dob", "place", _rest("name").alias("rest")), "person-cliques")


def _shortened_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of (name, dob) classes with one date, of which one name is the other with one character left out."""
    shorter = _each_left_out(classes.select(F.col("rep").alias("a"), "name", "dob"), "name").filter("place > 0")
    pairs = shorter.select("a", F.xxhash64("rest", "dob").alias("b")).join(classes.select(F.col("rep").alias("b")), "b")
    return _confirmed(pairs, classes, F.col("dob") == F.col("dob_b"))


def _number_pairs(classes: DataFrame, hot: int) -> DataFrame:
    """Pairs of (name, number) classes with both within one edit.

    Blocks are by the number with a character left out and by half of the name: an edit leaves the first three or the last three
    characters as they are. A number that many names share makes large blocks; those are split by the name with one left out too.
    """
    halves = F.array(F.concat(F.lit("<"), F.left("name", F.lit(3))), F.concat(F.lit(">"), F.right("name", F.lit(3))))
    numbers = classes.select(F.col("rep").alias("a"), "name", halves.alias("halves"), F.explode(one_left_out(F.col("number"))).alias("u"))
    # Names of fewer than seven characters have halves that one edit can touch both of.
    keyed = numbers.select("a", "name", "u", F.explode(F.when(F.length("name") >= 7, F.col("halves")).otherwise(F.array(F.lit("short")))).alias("half"))
    short = numbers.filter(F.length("name") == 7).select("a", "name", "u", F.lit("short").alias("half"))
    keyed = _stored(keyed.union(short).withColumn("block", F.xxhash64("u", "half")), "person-numbers")
    sizes = keyed.groupBy("block").agg(F.count("*").alias("_n"))
    marked = keyed.join(sizes.filter(F.col("_n") > 1), "block")
    small = marked.filter(F.col("_n") <= hot).select("a", "block")
    split = marked.filter(F.col("_n") > hot).select("a", "u", F.explode(one_left_out(F.col("name"))).alias("v")).distinct().select("a", F.xxhash64("u", "v", F.lit("split")).alias("block"))
    return _confirmed(_pairs(small.union(split)), classes, _near("number", "number_b"))


def _confirmed(pairs: DataFrame, classes: DataFrame, rule: Column) -> DataFrame:
    """Pairs whose names are within one edit and that meet the rule, by their values."""
    columns = [c for c in classes.columns if c not in ("rep", "n")]
    one = classes.select(F.col("rep").alias("a"), *columns)
    two = classes.select(F.col("rep").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(one, "a").join(two, "b").filter(_near("name", "name_b") & rule).select("a", "b")


def _both_ways(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Each class with itself and every class it is linked with."""
    return pairs.select("a", "b").union(pairs.select("b", "a")).union(classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")))


def same_persons(records: DataFrame, key: str = "case_id", name: str = "name", dob: str = "dob", number: str = "doc_number", hot: int = HOT) -> DataFrame:
    """``key``, n_links (other records linked directly) and person_id (smallest key reachable by links) of every record.

    Links are counted from the sizes of classes, never written out as pairs of records: those of one name and date, plus those of
    one name and number, less those that both rules link. A record without a name, or without date and number, is linked with
    nothing and is a person of its own; a null date or number meets no other. A repeated key counts as often as it comes. A null key
    has no person. Other columns are not used; no rows in, none out.
    """
    cleaned = records.select(
        F.col(key).alias("key"), name_key(F.col(name)).alias("name"), F.nullif(F.col(dob).cast("string"), F.lit("")).alias("dob"), number_key(F.col(number)).alias("number")
    )
    cleaned = _stored(cleaned, "persons")
    known = cleaned.filter("key is not null and name is not null")
    class_of = lambda *fields: known.filter(F.col(fields[-1]).isNotNull()).groupBy(*fields).agg(F.min("key").alias("rep_key"), F.count("*").alias("n"))
    dated, numbered = ("name", "dob"), ("name", "number")
    linked = {}
    for fields in (dated, numbered):
        classes = _stored(class_of(*fields).withColumn("rep", F.xxhash64(*fields)), "person-classes")
        pairs = _shortened_pairs(classes) if fields is dated else _number_pairs(classes, hot)
        linked[fields] = classes, _stored(pairs, "person-pairs")
    cliques = _cliques(linked[dated][0])

    def total(fields: tuple[str, ...]) -> DataFrame:
        classes, pairs = linked[fields]
        sizes = classes.select(F.col("rep").alias("b"), "n")
        return _both_ways(pairs, classes).join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))

    clique = ("dob", "place", "rest")
    others = cliques.join(cliques.groupBy(*clique).agg(F.sum("n").alias("_all")), [*clique]).groupBy(F.col("a").alias("rep")).agg(F.sum(F.col("_all") - F.col("n")).alias("n"))
    by_date, by_number = total(dated).union(others).groupBy("rep").agg(F.sum("n").alias("n")), total(numbered)
    # Records that both rules link: one date, linked by name and number.
    classes, pairs = linked[numbered]
    dates = known.filter("dob is not null and number is not null").groupBy(F.xxhash64(*numbered).alias("b"), "dob").agg(F.count("*").alias("n"))
    twice = _both_ways(pairs, classes).join(dates, "b").groupBy(F.col("a").alias("rep2"), F.col("dob").alias("_dob")).agg(F.sum("n").alias("n_both"))
    placed = known.withColumns({
        "rep1": F.when(F.col("dob").isNotNull(), F.xxhash64(*dated)), "rep2": F.when(F.col("number").isNotNull(), F.xxhash64(*numbered))
    })
    counted = placed.join(by_date.withColumnsRenamed({"rep": "rep1", "n": "n1"}), "rep1", "left").join(
        by_number.withColumnsRenamed({"rep": "rep2", "n": "n2"}), "rep2", "left"
    ).join(twice.withColumnRenamed("rep2", "_rep2"), (F.col("rep2") == F.col("_rep2")) & (F.col("dob") == F.col("_dob")), "left")
    number_of = lambda c: F.coalesce(c, F.lit(0))
    n_links = number_of(F.col("n1")) + number_of(F.col("n2")) - number_of(F.col("n_both")) - F.when(F.coalesce("rep1", "rep2").isNotNull(), 1).otherwise(0)
    rows = counted.select("key", n_links.cast("long").alias("n_links"))
    lonely = cleaned.filter("key is null or name is null").select("key", F.lit(0).cast("long").alias("n_links"))
    # Persons: records meet in the classes they are in, classes in the pairs between them.
    meets = placed.select("key", F.concat(F.lit("d"), F.col("rep1").cast("string")).alias("by_date"), F.concat(F.lit("n"), F.col("rep2").cast("string")).alias("by_number"), F.lit(None).cast("string").alias("pair"))
    meets = meets.union(cliques.select("rep_key", F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat_ws(":", F.lit("clique"), *clique)))
    for fields in (dated, numbered):
        classes, pairs = linked[fields]
        heads = classes.select("rep", "rep_key")
        ends = [pairs.join(heads.withColumnRenamed("rep", side), side).select("rep_key", F.concat_ws(":", F.lit(fields[1]), "a", "b").alias("pair")) for side in ("a", "b")]
        for end in ends:
            meets = meets.union(end.select(F.col("rep_key").alias("key"), F.lit(None).cast("string"), F.lit(None).cast("string"), "pair"))
    persons = connected_groups(meets, "key", ("by_date", "by_number", "pair")).withColumnsRenamed({"key": "_key", "group_id": "person_id"})
    every = rows.union(lonely)
    return every.join(persons, F.col("key") == F.col("_key"), "left").select(
        F.col("key").alias(key), "n_links", F.coalesce("person_id", "key").alias("person_id")
    )
