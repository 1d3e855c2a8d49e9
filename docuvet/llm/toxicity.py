"""Abusive texts by multiple-instance learning: sentence scores joined by noisy-or, trained from labels of documents."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet.llm.labelled import labelled_sample
from docuvet.llm.textops import FOLDED_VALUES, portions, prefix_hashes, runs, utf8_of

#: At most so many labelled documents are learnt from; they are chosen by a hash of doc_id.
MAX_LABELLED = 4_000
#: Only features that positive documents hold far more often than their share are learnt: so many standard errors, and
#: documents at least. All others keep weight 0, since a bag's label says little about most of its words.
LEAST_EXCESS, LEAST_DOCUMENTS = 4.0, 4
#: A word counts as itself and, if it is longer, as its first bytes: stems carry inflected words.
STEMS = (4, 5, 6)
THRESHOLD = 0.5
TABLE_BITS = 20

#: Bytes outside words: ASCII signs and white space. Bytes of other scripts belong to words.
BREAKS = np.ones(256, bool)
BREAKS[128:] = False
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
SENTENCE_ENDS = np.zeros(256, np.int64)
SENTENCE_ENDS[[ord(c) for c in ".!?\n"]] = 1


class Sentences:
    """Words and sentences of a text column: ``features`` and ``sentence`` per word; ``row``, ``start``, ``end`` per sentence."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8_of(column)
        starts, ends = runs(self.data, self.offsets, BREAKS)
        self.features = prefix_hashes(self.data, starts, ends, STEMS, FOLDED_VALUES)
        row = np.searchsorted(self.offsets, starts, "right") - 1
        number = np.cumsum(SENTENCE_ENDS[self.data])[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(number) != 0)
        self.sentence = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.row = row[first]
        self.start = starts[first]
        self.end = ends[np.append(first[1:] - 1, len(ends) - 1)] if len(first) else starts
        self.sentences = len(first)

    def logits(self, model: "Model") -> np.ndarray:
        """Bias plus the weights of the different features of each sentence."""
        found = [(f[hit], w[hit], self.sentence[hit]) for f in self.features for w in [model.weights_of(f)] for hit in [np.flatnonzero(w)]]
        feature, weight, sentence = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((feature, sentence))
        feature, weight, sentence = feature[order], weight[order], sentence[order]
        new = np.ones(len(feature), bool)
        new[1:] = (feature[1:] != feature[:-1]) | (sentence[1:] != sentence[:-1])
        return model.bias + np.bincount(sentence[new], weight[new], self.sentences)


class Model:
    """Weights of hashed features; the whole 64-bit hash decides, so a rare word never borrows another one's weight."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias, self.table = keys, weights, bias, None

    def weights_of(self, features: np.ndarray) -> np.ndarray:
        if self.table is None:
            order = np.argsort(np.abs(self.weights), kind="stable")
            place = (self.keys[order] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            key, weight = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.float32)
            key[place], weight[place] = self.keys[order], self.weights[order]
            self.table = key, weight
        place = (features >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        return np.where(self.table[0][place] == features, self.table[1][place], 0.0)

    def __reduce__(self):
        return Model, (self.keys, self.weights, self.bias)


def noisy_or(sentence_logits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """1 - product of (1 - p) over the sentences of each row; 0 for a row without sentences."""
    return -np.expm1(-np.bincount(row, np.logaddexp(0.0, sentence_logits), rows))


def _telling_features(parts: list[pa.RecordBatch], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features that positive documents hold far more often than their share, and their documents; portion after portion."""
    keys, documents, positive, first_row = [], [], [], 0
    for part in parts:
        bag = Sentences(part.column(0))
        for features in bag.features:
            hit = np.flatnonzero(features)
            if not len(hit):
                continue
            feature, row = features[hit], bag.row[bag.sentence[hit]] + first_row
            order = np.lexsort((row, feature))
            feature, row = feature[order], row[order]
            new = np.append(True, (feature[1:] != feature[:-1]) | (row[1:] != row[:-1]))
            feature, row = feature[new], row[new]
            first = np.flatnonzero(np.append(True, feature[1:] != feature[:-1]))
            keys.append(feature[first])
            documents.append(np.diff(np.append(first, len(feature))))
            positive.append(np.add.reduceat(y[row].astype(np.int64), first))
        first_row += len(part)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0)
    known, index = np.unique(np.concatenate(keys), return_inverse=True)
    held, found = np.bincount(index, np.concatenate(documents)), np.bincount(index, np.concatenate(positive))
    share = y.mean()
    excess = (found - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
    telling = (held >= LEAST_DOCUMENTS) & (excess >= LEAST_EXCESS)
    return known[telling], held[telling]


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 300, rate: float = 1.0, decay: float = 3e-5) -> Model:
    """Feature weights and bias from labelled documents by full-batch gradient steps.

    The gradient of the noisy-or likelihood for a sentence of probability p is -p (1 - P) / P in a positive document of
    probability P and p in a negative one. No labels of one kind: the bias alone, all scores low.
    """
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    y = np.asarray(labels).astype(bool)
    parts = portions(pa.RecordBatch.from_arrays([column], names=["text"]), 0, 1 << 20)
    keys, documents = _telling_features(parts, y)
    # A portion at a time: only what the chosen features need is kept of the whole sample.
    words, sentences, rows, total, first_row = [], [], [], 0, 0
    for part in parts:
        bag = Sentences(part.column(0))
        for features in bag.features if len(keys) else []:
            place = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == features)
            inside = np.unique(place[hit] * max(1, bag.sentences) + bag.sentence[hit])
            words.append(inside // max(1, bag.sentences))
            sentences.append(inside % max(1, bag.sentences) + total)
        rows.append(bag.row + first_row)
        total, first_row = total + bag.sentences, first_row + len(part)
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    word, sentence, row = joined(words), joined(sentences), joined(rows)
    used = len(keys)
    # Frequent features move faster.
    pace = np.append(np.sqrt(documents / max(1, len(y))), 1.0)
    theta, m, v = np.zeros(used + 1), np.zeros(used + 1), np.zeros(used + 1)
    theta[-1] = -6.0
    if y.all() or not y.any() or not used:
        return Model(keys[:0], np.zeros(0, np.float32), -6.0)
    for turn in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], total)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        whole = np.clip(noisy_or(z, row, len(y)), 1e-9, 1.0)
        pull = np.where(y, -(1 - whole) / whole, 1.0)[row] * p
        gradient = np.append(np.bincount(word, pull[sentence], used), pull.sum()) / len(y)
        gradient[:-1] += decay * theta[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta -= pace * rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    heavy = np.abs(theta[:-1]) > 0.01
    return Model(keys[heavy], theta[:-1][heavy].astype(np.float32), float(theta[-1]))


def fit_documents(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Model from document records (``doc_id``, ``raw_text``) and review labels (``doc_id``, ``abusive`` 0/1).

    Learns from at most ``most`` labelled documents, chosen by a hash of doc_id. Without positive or negative ones all scores
    stay low.
    """
    sample = labelled_sample(documents, labels, "abusive", most)
    return fit(sample["raw_text"], sample["label"].to_numpy())


def _judged(column: pa.Array, model: Model, threshold: float) -> pa.Array:
    bag = Sentences(column)
    z = bag.logits(model)
    score = noisy_or(z, bag.row, len(column))
    counts = np.bincount(bag.row, minlength=len(column))
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    best = np.full(len(column), -np.inf)
    np.maximum.at(best, bag.row, z)
    found = np.flatnonzero((score[bag.row] >= threshold) & ((p >= threshold) | (z == best[bag.row])))
    ends = np.zeros(len(column) + 1, np.int32)
    np.cumsum(np.bincount(bag.row[found], minlength=len(column)), out=ends[1:])
    if len(found):
        characters = np.concatenate([[0], np.cumsum((bag.data & 0xC0) != 0x80)])
        first = characters[bag.offsets[bag.row[found]]]
        start, end = characters[bag.start[found]] - first, characters[bag.end[found]] - first
    else:
        start = end = np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p[found], pa.float64())], ["start", "end", "score"])
    return pa.StructArray.from_arrays(
        [pa.array(np.clip(score, 0, 1)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), spans)],
        ["score", "n_sentences", "offending"],
    )


JUDGED = "struct<score:double, n_sentences:long, offending:array<struct<start:long, end:long, score:double>>>"


def judged(text: Column, model: Model, threshold: float = THRESHOLD) -> Column:
    """Struct of score (0 to 1), n_sentences and offending (spans in characters, with their scores) of a text column."""

    @F.arrow_udf(JUDGED)
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["t"])
        done = [_judged(part.column(0), model, threshold) for part in portions(batch, 0, 1 << 20)]
        return pa.concat_arrays(done) if done else _judged(texts, model, threshold)

    return run(text)


def score_documents(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """Abusiveness of every whole text of document records (``doc_id``, ``raw_text``), learnt from review labels of documents.

    A sentence's probability is logistic in its different words and word stems; a document is abusive if any sentence is: 1
    minus the product of their complements. Training sees labels of documents only; at a document's score of ``threshold`` or
    more its sentences that reach the threshold, or else its most suspicious one, are located.
    Returns doc_id, score, abusive (0/1), n_sentences, offending (array of start, end, score; positions in characters).
    Null or empty text, or one without words: score 0, no sentences. Repeated rows get equal scores; other columns are not used; no
    rows in, none out. No shuffle of the scored texts.
    """
    model = fit_documents(documents, labels, most)
    scored = documents.select("doc_id", judged(F.col("raw_text").cast("string"), model, threshold).alias("j"))
    return scored.select("doc_id", "j.score", (F.col("j.score") >= threshold).cast("int").alias("abusive"), "j.n_sentences", "j.offending")
