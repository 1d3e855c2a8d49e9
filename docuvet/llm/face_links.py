"""Faces of one person across cases: a forest of random-projection trees with overlapping leaves."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuvet.llm.face_search import matrix, usable
from docuvet.llm.graph import components
from docuvet.llm.storage import stored

#: Trees; faces of a leaf that need no further split; faces of a block; faces that the trees are fitted on at most.
TREES, LEAF, BLOCK, SAMPLE = 5, 400, 512, 20_000
#: Faces this near to a split, times the square root of the vectors' length, go to both sides.
OVERLAP = 0.24
#: A node of fewer sampled faces is not split.
LEAST_SAMPLE = 40
#: A split that makes more entries than this a face saves no comparisons (half its square is one): so many directions are tried
#: for a better one, then the node stays a leaf. So it does where a face has this many entries along one path.
SPREAD, TRIES, COPIES = 1.4, 8, 16
#: A leaf of more faces is split further, by so many directions at a time.
LARGE, CUTS = 3_200, 3


class Tree:
    """Nodes of one tree: direction, threshold and both children; a child below zero is a leaf."""

    def __init__(self, number: int, sample: np.ndarray, faces: int):
        self.rng = np.random.default_rng([5, number])
        self.width = sample.shape[1] if len(sample) else 1
        self.overlap = OVERLAP / math.sqrt(self.width)
        self.directions: list[np.ndarray] = []
        self.thresholds: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, faces / max(1, len(sample)))

    def _grow(self, sample: np.ndarray, scale: float, copies: float = 1.0) -> int:
        tries = TRIES if len(sample) * scale > LEAF and len(sample) >= LEAST_SAMPLE else 0
        for _ in range(tries):
            direction = self.rng.normal(size=self.width)
            direction /= np.sqrt((direction**2).sum())
            at = sample @ direction
            threshold = float(np.median(at))
            left, right = sample[at <= threshold + self.overlap], sample[at >= threshold - self.overlap]
            spread = (len(left) + len(right)) / len(sample)
            if max(len(left), len(right)) < 0.9 * len(sample) and spread <= SPREAD and copies * spread <= COPIES:
                node = len(self.children)
                self.directions.append(direction)
                self.thresholds.append(threshold)
                self.children.append([0, 0])
                self.children[node] = [self._grow(left, scale, copies * spread), self._grow(right, scale, copies * spread)]
                return node
        self.leaves += 1
        return -self.leaves

    def leaves_of(self, vectors: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Leaf numbers with the positions of the vectors in them."""
        out, open_nodes = [], [(self.root, np.arange(len(vectors)))]
        while open_nodes:
            node, inside = open_nodes.pop()
            if node < 0:
                out.append((-node, inside))
                continue
            at = vectors[inside] @ self.directions[node]
            left, right = self.children[node]
            open_nodes += [(left, inside[at <= self.thresholds[node] + self.overlap]), (right, inside[at >= self.thresholds[node] - self.overlap])]
        return out


def _unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of an Arrow column at unit length, cut or filled with zeros to one width."""
    out = np.zeros((len(column), width))
    for row, vector in zip(out, column.to_pylist(), strict=True):
        whole = np.array(vector)
        row[: len(whole)] = (whole / np.sqrt((whole**2).sum()))[:width]
    return out


def _split_large(nodes: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Split leaves that the sample left too large, again and again: rows of (face_key, leaf) in, smaller leaves out.

    A large leaf is cut by three random directions of its own at the medians of its faces, which Spark estimates per leaf, so
    the depth of the forest follows the number of faces and no model of it is ever gathered. Faces near a median go to both
    sides. Leaves that a round does not make smaller, or only by too many copies of their faces, as where very many faces are
    nearly alike, stay as they are.
    """
    overlap = F.lit(OVERLAP / math.sqrt(width))
    done = None

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, leaf = _unit_rows(batch.column(2), width), batch.column(1).to_numpy()
            at = np.zeros((len(batch), CUTS))
            for one in np.unique(leaf):
                inside = leaf == one
                directions = np.random.default_rng([55, int(one) & (2**63 - 1)]).normal(size=(width, CUTS))
                at[inside] = unit[inside] @ (directions / np.sqrt((directions**2).sum(0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(at), pa.list_(pa.float64()))], names=["face_key", "leaf", "at"])

    while True:
        counts = nodes.groupBy("leaf").agg(F.count("*").alias("faces"))
        large = stored(counts.filter(F.col("faces") > LARGE), "large")
        if large.isEmpty():
            return nodes if done is None else done.unionByName(nodes)
        small = nodes.join(large.select("leaf"), "leaf", "left_anti").select("face_key", "leaf")
        inside = nodes.join(large, "leaf").join(classes.select("face_key", "selfie_embedding"), "face_key")
        at = stored(inside.select("face_key", "leaf", "selfie_embedding").mapInArrow(projected, "face_key binary, leaf long, at array<double>"), "cuts")
        middle = at.groupBy("leaf").agg(*[F.percentile_approx(F.col("at")[i], 0.5, 1000).alias(f"m{i}") for i in range(CUTS)])
        sides = F.lit("")
        cells = at.join(middle, "leaf").withColumn("cell", sides)
        for i in range(CUTS):
            below, above = F.col("at")[i] <= F.col(f"m{i}") + overlap, F.col("at")[i] >= F.col(f"m{i}") - overlap
            side = F.explode(F.array_compact(F.array(F.when(below, F.lit("a")), F.when(above, F.lit("b")))))
            cells = cells.withColumn("side", side).withColumn("cell", F.concat("cell", "side")).drop("side")
        cells = stored(cells.select("face_key", F.col("leaf").alias("parent"), F.xxhash64("leaf", "cell").alias("leaf")), "cells")
        grown = cells.groupBy("parent", "leaf").agg(F.count("*").alias("faces")).groupBy("parent").agg(F.max("faces").alias("most"), F.sum("faces").alias("all"))
        stuck = grown.join(large, grown["parent"] == large["leaf"]).filter(
            (F.col("most") > F.col("faces") * 0.8) | (F.col("all") > F.col("faces") * SPREAD**CUTS)
        ).select("parent")
        kept = nodes.join(stuck.withColumnRenamed("parent", "leaf"), "leaf").select("face_key", "leaf")
        smaller = cells.join(stuck, "parent", "left_anti").select("face_key", "leaf")
        finished = stored(small.unionByName(kept), "leaves")
        done = finished if done is None else done.unionByName(finished)
        nodes = stored(smaller, "leaves")


def _spanning(near: np.ndarray) -> np.ndarray:
    """Smallest position that each one reaches through a symmetric matrix."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(table: pa.Table, threshold: float) -> pa.Table:
    """For one pair of blocks of a leaf: weighted numbers of links that belong to this leaf, and links that join what is linked."""
    ids, size, block = table["case_id"].to_numpy(), table["size"].to_numpy(), table["_block"].to_numpy()
    low, high, leaf = table["low"][0].as_py(), table["high"][0].as_py(), table["leaf"][0].as_py()
    vectors = matrix(table["selfie_embedding"])
    norms = np.sqrt((vectors**2).sum(1))
    near = (vectors @ vectors.T) / (norms[:, None] * norms) >= threshold
    np.fill_diagonal(near, False)
    if low != high:
        near &= block[:, None] != block
    label = _spanning(near)
    # A pair that also shares a leaf of a smaller number is counted there: a product of membership matrices tells.
    earlier = [[x for x in row if x < leaf] for row in table["leaves"].to_pylist()]
    numbers = {x: n for n, x in enumerate(sorted({x for row in earlier for x in row}))}
    member = np.zeros((len(ids), max(1, len(numbers))), np.float32)
    for n, row in enumerate(earlier):
        member[n, [numbers[x] for x in row]] = 1
    links = ((near & (member @ member.T == 0)) @ size.astype(np.float64)).astype(np.int64)
    far = np.flatnonzero(label != np.arange(len(ids)))
    some = np.flatnonzero(links)
    return pa.table({
        "a": np.concatenate([ids[some], ids[far]]), "links": np.concatenate([links[some], np.zeros(len(far), np.int64)]),
        "b": pa.array(np.concatenate([ids[some], ids[label[far]]]), pa.int64()),
    })


def link_faces(faces: DataFrame, threshold: float = 0.95, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Faces (``case_id``, ``selfie_embedding``) linked by a cosine of at least ``threshold``, whatever their labels.

    Returns one row per input row: case_id, n_links (other faces linked directly), component_id (smallest case_id reachable, itself
    included), kept (case_id = component_id). Equal vectors become one class first. The trees' splits are fitted on at most
    ``sample`` classes, chosen by a hash, and leaves that stay large are split again by all their faces; all classes pass through all trees and go to both sides of a near split, so a pair at the
    threshold misses a leaf in a tree with a probability of about 0.06 (all five: under one in a million). Leaves of any size
    are compared in pairs of bounded blocks, in double precision; a pair that shares several leaves counts once; what leaves a
    block is counts and links that join, not pairs.
    Vectors that are null, zero or hold null or non-finite components link with nothing, vectors of different length not with
    each other. A row without case_id links with nothing and its kept is null. Rows of a repeated case_id are one face: n_links
    adds up over its vectors. Other columns are not used. No rows in, none out.
    """
    every = faces.select(F.col("case_id").cast("long").alias("case_id"), F.col("selfie_embedding").cast("array<double>").alias("selfie_embedding"))
    good = every.filter(usable(F.col("selfie_embedding")) & F.col("case_id").isNotNull())
    keyed = stored(good.withColumn("vector_key", F.sha2(F.array_join(F.transform("selfie_embedding", lambda x: (x + 0.0).cast("string")), ","), 256)), "faces")
    heads = keyed.groupBy("vector_key").agg(F.min("case_id").alias("head"), F.count("*").alias("size"))
    members = stored(keyed.select("case_id", "vector_key").join(heads, "vector_key"), "heads")
    classes = stored(
        keyed.join(members.filter("case_id = head").select("case_id", "vector_key", "size").distinct(), ["case_id", "vector_key"])
        .dropDuplicates(["vector_key"])
        .select(F.unhex(F.substring("vector_key", 1, 32)).alias("face_key"), "case_id", "size", "selfie_embedding"), "classes",
    )
    n = classes.count()
    chosen = classes.orderBy("face_key").limit(sample).select("selfie_embedding").toArrow()["selfie_embedding"].to_pylist()
    width = max((len(v) for v in chosen), default=1)
    points = np.zeros((len(chosen), width))
    for row, vector in zip(points, chosen, strict=True):
        row[: len(vector)] = np.array(vector) / math.sqrt(sum(x * x for x in vector))
    forest = [Tree(t, points, n) for t in range(trees)]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit_rows(batch.column(1), width)
            found: list[list[int]] = [[] for _ in range(len(batch))]
            for t, tree in enumerate(forest):
                for leaf, inside in tree.leaves_of(unit):
                    for p in inside:
                        found[p].append((t << 32) + leaf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["face_key", "leaves"])

    placed = classes.select("face_key", "selfie_embedding").mapInArrow(leaves, "face_key binary, leaves array<long>")
    nodes = _split_large(stored(placed.select("face_key", F.explode("leaves").alias("leaf")), "leaves"), classes, width)
    lists = nodes.groupBy("face_key").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    entries = classes.join(lists, "face_key").drop("face_key").withColumn("length", F.size("selfie_embedding"))
    entries = stored(entries.withColumn("leaf", F.explode("leaves")), "leaves")
    sizes = entries.groupBy("leaf", "length").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    blocks = entries.join(sizes, ["leaf", "length"]).withColumn("_block", F.pmod(F.xxhash64("case_id"), F.col("_blocks")).cast("int"))
    blocks = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns(
        {"low": F.least("_block", "_other"), "high": F.greatest("_block", "_other")}
    )

    def compared(table: pa.Table) -> pa.Table:
        return _linked(table, threshold)

    found = stored(blocks.groupBy("leaf", "length", "low", "high").applyInArrow(compared, "a long, links long, b long"), "found")
    counts = found.groupBy(F.col("a").alias("head")).agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b").union(members.filter("case_id <> head").select(F.col("case_id").alias("a"), F.col("head").alias("b"))))
    per_face = members.join(counts, "head", "left").groupBy("case_id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links")
    )
    return every.select("case_id").join(per_face, "case_id", "left").join(groups.withColumnRenamed("id", "case_id"), "case_id", "left").select(
        "case_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "case_id").alias("component_id"),
        (F.col("case_id") == F.coalesce("component_id", "case_id")).alias("kept"),
    )
