"""Near-duplicate document texts by SetSketch registers, banded, estimated by likelihood and verified on whole sets."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet.llm.graph import components
from docuvet.llm.storage import stored
from docuvet.llm.textops import FOLDED_VALUES, SPACES, mixed, portions, run_hashes, runs, shingles, utf8_of

#: Registers are BANDS times BAND_ROWS. At a similarity of 0.8 a link shares no band with a probability of 7e-5.
BANDS, BAND_ROWS = 24, 5
REGISTERS = BANDS * BAND_ROWS
#: Parameters of the registers: base of the exponential spacing, rate of the exponential values, largest value less one.
SPACING, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: A pair is compared on its whole sets unless its estimate lies this many standard errors below the threshold.
MARGIN = 5.0
#: Members and bytes of text of a block; blocks of one group meet two at a time.
BLOCK, BLOCK_BYTES = 256, 4_000_000

_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Register values of several sets of hashes that follow each other; ``starts`` are their first positions.

    Register i of a set is floor(1 - log_b h) with h the least of exponential values of rate ``RATE``, one per element, kept
    between 0 and ``TOP + 1``. The least exponential value belongs to the least uniform hash, so only that one is converted. The
    registers of a union are the element-wise maxima.
    """
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat(values * _FACTORS[i] + _TERMS[i], starts)
        uniform = (least.astype(np.float64) + 0.5) / 2.0**64
        exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(exponential) / math.log(SPACING)), 0, TOP + 1)
    return out


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 200) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows, given the sizes of both sets.

    The counts of registers that are larger, smaller and equal are trinomial, with probabilities that follow from the
    similarity and the relative sizes; the likelihood is taken on a grid of similarities that the sizes allow.
    """
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    similarity = most * (np.arange(grid + 1) / grid)[None, :]

    def reached(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / math.log(SPACING)

    more, less = reached(u - v * similarity), reached(v - u * similarity)
    tiny = 1e-12
    score = above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny)) + equal * np.log(np.maximum(1 - more - less, tiny))
    return np.take_along_axis(similarity, score.argmax(1)[:, None], 1)[:, 0]


def text_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a column."""
    data, offsets = utf8_of(column)
    starts, ends = runs(data, offsets, SPACES)
    words = run_hashes(data, starts, ends, FOLDED_VALUES)
    edges = np.searchsorted(starts, offsets)
    return [shingles(words[a:b], k) for a, b in zip(edges, edges[1:], strict=False)]


def sketch_documents(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (binary digest of the set), registers (binary) and bands of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            sets = text_sets(batch.column(1), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys: list[bytes | None] = [None] * len(sets)
            rows: list[bytes | None] = [None] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                found = registers(values, starts)
                sums = np.column_stack([np.add.reduceat(values, starts), np.add.reduceat(mixed(values + np.uint64(1)), starts)])
                band = np.zeros((len(full), BANDS), np.uint64)
                for j in range(BAND_ROWS):
                    band = mixed(band * np.uint64(31) + found[:, j * BANDS : (j + 1) * BANDS].astype(np.uint64) + np.uint64(1))
                band = mixed(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                for n, i in enumerate(full):
                    keys[i], rows[i], bands[i] = sums[n].tobytes(), found[n].tobytes(), band[n]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(rows, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "registers", "bands"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("raw_text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, registers binary, bands array<long>"
    )


def _cut(threshold: float) -> float:
    return threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity does not speak clearly against the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for all_rows in batches:
            for at in range(0, len(all_rows), 1000):
                rows = all_rows.iloc[at : at + 1000]
                a, b = (np.frombuffer(b"".join(rows[c]), np.uint16).reshape(len(rows), -1) for c in ("r_a", "r_b"))
                estimate = likely_similarity(a, b, rows["n_a"].to_numpy(float), rows["n_b"].to_numpy(float))
                yield rows.loc[estimate >= _cut(threshold), ["a", "b"]]

    left = sketches.select(F.col("doc_id").alias("a"), F.col("registers").alias("r_a"), F.col("n_shingles").alias("n_a"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("registers").alias("r_b"), F.col("n_shingles").alias("n_b"))
    sized = pairs.join(right, "b").join(left, "a").filter(F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))
    return sized.mapInPandas(run, "a long, b long")


def _spanning(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link of every id to a smaller one it reaches through ``near`` (symmetric): as many links as ids at most."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    ids, near = ids[order], near[np.ix_(order, order)]
    while True:
        best = np.where(near, label[None, :], len(ids)).min(1, initial=len(ids))
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def _blocked(members: DataFrame, key: str, weight: Column) -> DataFrame:
    """Members of each ``key`` in blocks of bounded number and weight; each row once for every pair (low, high) of blocks it is in."""
    sizes = members.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(weight) / BLOCK_BYTES)).cast("int").alias("_blocks"))
    placed = members.join(sizes, key).withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    pairs = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return pairs.withColumns({"low": F.least("_block", "_other"), "high": F.greatest("_block", "_other")}).drop("_other", "_blocks")


def _across(entries: DataFrame, groups: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes of one bucket that no label joins yet and whose estimate does not speak against the threshold.

    ``groups`` has doc_id and group_id; classes without are their own. In every bucket the members beside its largest group meet
    all others, in blocks of bounded size; members of one group are not compared again. A block pair gives as many links as join
    what it finds. So after this any two classes of a bucket are joined, or have been compared with each other.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, n, group = table["doc_id"].to_numpy(), table["n_shingles"].to_numpy().astype(float), table["group_id"].to_numpy()
        rows = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(len(ids), -1)
        beside = np.asarray(table["beside"])
        s, t = np.flatnonzero(beside), np.flatnonzero(~beside)
        equal = np.zeros((len(s), len(t)), np.int16)
        for i in range(rows.shape[1]):
            equal += rows[s, i, None] == rows[None, t, i]
        fits = np.minimum(n[s, None], n[None, t]) >= (threshold - 1e-9) * np.maximum(n[s, None], n[None, t])
        x, y = np.nonzero((equal >= (_cut(threshold) - 0.1) * REGISTERS) & fits & (group[s, None] != group[None, t]))
        near = np.zeros((len(ids), len(ids)), bool)
        for at in range(0, len(x), 1000):
            i, j = s[x[at : at + 1000]], t[y[at : at + 1000]]
            near[i, j] = near[j, i] = likely_similarity(rows[i], rows[j], n[i], n[j]) >= _cut(threshold)
        a, b = _spanning(ids, near)
        return pa.table({"a": a, "b": b})

    placed = entries.select("bucket", "doc_id").join(groups, "doc_id", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    sizes = placed.groupBy("bucket", "group_id").agg(F.count("*").alias("_n"))
    mixed_buckets = sizes.groupBy("bucket").agg(F.max_by("group_id", F.struct("_n", "group_id")).alias("main"), F.sum("_n").alias("all"), F.max("_n").alias("_main_n")).filter(
        F.col("all") > F.col("_main_n")
    )
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    members = placed.join(mixed_buckets, "bucket").withColumns({"_rows": blocks(F.col("all") - F.col("_main_n")), "_columns": blocks(F.col("all"))})
    members = stored(members.select("bucket", "doc_id", "group_id", "main", "_rows", "_columns"), "mixed")
    place = lambda count: F.pmod(F.xxhash64("doc_id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    small = members.filter("group_id <> main").select("bucket", "doc_id", "group_id", F.lit(True).alias("beside"), place("_rows").alias("low"), every("_columns").alias("high"))
    whole = members.select("bucket", "doc_id", "group_id", F.lit(False).alias("beside"), place("_columns").alias("high"), every("_rows").alias("low"))
    met = small.unionByName(whole).join(sketches.select("doc_id", "n_shingles", "registers"), "doc_id")
    return met.select("bucket", "low", "high", "doc_id", "group_id", "beside", "n_shingles", "registers").groupBy("bucket", "low", "high").applyInArrow(
        run, "a long, b long"
    )


def _common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from products of membership matrices, so many columns at a time."""
    n = len(sets)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = counts[inverse] > 1
    owner, place = owner[shared], (np.cumsum(counts > 1) - 1)[inverse[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        low, high = np.searchsorted(place, [at, at + columns])
        part = np.zeros((n, columns), np.float32)
        part[owner[low:high], place[low:high] - at] = 1
        out += part @ part.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _verified(texts: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Links (a, b) of members of each group (``group_id``, ``doc_id``, ``raw_text``) to its ``center``, confirmed on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in (part for whole in batches for part in portions(whole, 3)):
            found = []
            firsts = batch.column(2).to_pylist()
            others = text_sets(batch.column(3), k)
            for i, other in enumerate(others):
                if last[0] != firsts[i]:
                    last = (firsts[i], text_sets(batch.column(2).slice(i, 1), k)[0])
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                found.append(100 * both >= per_cent * (len(last[1]) + len(other) - both))
            kept = batch.filter(pa.array(found, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    centers = texts.filter("doc_id = center").select("group_id", F.col("raw_text").alias("text_a"))
    members = texts.filter("doc_id <> center").select("group_id", F.col("center").alias("a"), F.col("doc_id").alias("b"), F.col("raw_text").alias("text_b"))
    return members.join(centers, "group_id").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _compared(texts: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Links that join all members of each group which whole sets connect; a block pair is one comparison of matrices."""

    def run(table: pa.Table) -> pa.Table:
        sets = text_sets(table["raw_text"], k)
        both, n = _common(sets), np.array([len(s) for s in sets], float)
        near = 100 * both >= per_cent * (n[:, None] + n - both)
        a, b = _spanning(table["doc_id"].to_numpy(), near)
        return pa.table({"a": a, "b": b})

    blocks = _blocked(texts, "group_id", F.octet_length("raw_text"))
    return blocks.select("group_id", "low", "high", "doc_id", "raw_text").groupBy("group_id", "low", "high").applyInArrow(run, "a long, b long")


def link_documents(documents: DataFrame, k: int = 4, per_cent: int = 80) -> DataFrame:
    """Groups of near-duplicate document records (``doc_id``, ``raw_text``).

    Words are runs without ASCII white space, A-Z in lower case; a document's set are its distinct runs of ``k`` words, the whole
    sequence if it has fewer. Documents are linked if their sets share at least ``per_cent`` hundredths of the union. Returns
    doc_id, n_shingles, component_id (smallest doc_id reachable, itself included) and kept (doc_id = component_id).

    Equal sets become one class first, by a digest that sums hashes of all their elements. SetSketch registers of each class are
    hashed in bands. In every bucket, classes are compared with the one that shares most buckets by an estimate of joint
    likelihood; then all that lie in different groups after this are compared with each other. What the estimates join are
    candidate groups; their texts meet once. Each member is confirmed on full sets against its group's center, and groups that this leaves in parts are
    compared whole, in blocks. So copies cost one comparison a member, no pairs are written, and every link is confirmed.

    Null or empty text, or only white space: an empty set, linked with nothing. Rows of a repeated doc_id are one document with
    several sets, linked if any of them is. A null doc_id is linked with nothing and its kept is null. Other columns are not used.
    No rows in, none out.
    """
    threshold = per_cent / 100
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("raw_text").cast("string").alias("raw_text"))
    sketched = stored(sketch_documents(documents, k), "sketches")
    sets = sketched.filter("set_key is not null and doc_id is not null")
    heads = sets.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("head"))
    classes = sets.select("doc_id", "set_key", "n_shingles").join(heads, ["set_key", "n_shingles"]).select("doc_id", "head", "set_key")
    classes = stored(classes, "classes")
    firsts = stored(
        sets.join(classes.filter("doc_id = head").select("doc_id", "set_key").distinct(), ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"])
        .select("doc_id", "n_shingles", "registers", "bands"), "firsts",
    )
    within = classes.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))

    entries = firsts.select("doc_id", F.explode("bands").alias("bucket"))
    counts = entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    entries = stored(entries.join(counts, "bucket"), "bands")
    weights = stored(entries.groupBy("doc_id").agg(F.sum("members").alias("weight")), "weights")
    entries = entries.join(weights, "doc_id").select("bucket", "doc_id", "weight")
    leader = F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("a")
    starred = stored(entries.join(entries.groupBy("bucket").agg(leader), "bucket").filter("doc_id <> a"), "stars")
    near = stored(_estimated(starred.select("a", F.col("doc_id").alias("b")).distinct(), firsts, threshold), "near")
    # The least leader of each class, and that leader's: classes with one label are joined through it already.
    led = near.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("by"))
    above = led.select(F.col("doc_id").alias("by"), F.col("by").alias("above"))
    labels = led.join(above, "by", "left").select("doc_id", F.coalesce("above", "by").alias("group_id"))
    edges = near.union(_across(entries, labels, firsts, threshold))
    groups = stored(components(edges).withColumnsRenamed({"id": "doc_id", "component_id": "group_id"}), "groups")
    center = groups.join(weights, "doc_id").groupBy("group_id").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("center"))
    members = stored(groups.join(center, "group_id"), "members")
    # Merged at every size: the ids grow with the texts.
    texts = stored(members.hint("merge").join(documents.filter("doc_id is not null"), "doc_id"), "texts")
    links = stored(_verified(texts, k, per_cent), "links")
    joined = components(links).withColumnRenamed("id", "doc_id")
    labelled = members.join(joined, "doc_id", "left").withColumn("label", F.coalesce("component_id", "doc_id"))
    open_groups = stored(labelled.groupBy("group_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high and group_id is not null"), "open")
    more = _compared(texts.join(open_groups.select("group_id"), "group_id"), k, per_cent)
    final = components(within.union(links).union(more)).withColumnRenamed("id", "doc_id")
    return sketched.select("doc_id", "n_shingles").join(final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component_id", "doc_id")).alias("kept"),
    )
