"""Quality of document texts by a factorisation machine over hashed words, structure statistics and metadata."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet.llm.labelled import labelled_sample
from docuvet.llm.textops import FOLDED_VALUES, SPACES, portions, run_hashes, runs, utf8_of

BUCKET_BITS = 16
FACTORS = 4
#: At most so many labelled documents are learnt from; they are chosen by a hash of doc_id.
MAX_LABELLED = 4_000
THRESHOLD = 0.7
#: Each statistic becomes one of several intervals between these quantiles of the sample.
QUANTILES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)

LINE_BREAKS = np.zeros(256, bool)
LINE_BREAKS[[0x0A, 0x0D]] = True
UPPER, LOWER, DIGIT, SIGN = (np.zeros(256, np.int64) for _ in range(4))
UPPER[65:91] = 1
LOWER[97:123] = 1
DIGIT[48:58] = 1
SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
#: Signs that end a sentence or clause say nothing about a word's form.
ODD_SIGN = SIGN.copy()
ODD_SIGN[[ord(c) for c in ".,;:?!'\"()-"]] = 0


class Texts:
    """Sparse rows of hashed words and a matrix of structure statistics of a text column.

    ``row``, ``bucket`` and ``value`` hold each row's different words once, with log-scaled counts of unit length.
    """

    def __init__(self, column: pa.Array):
        data, offsets = utf8_of(column)
        rows = len(column)
        starts, ends = runs(data, offsets, SPACES)
        hashed = run_hashes(data, starts, ends, FOLDED_VALUES)
        word_row = np.searchsorted(offsets, starts, "right") - 1
        key, count = np.unique((word_row << BUCKET_BITS) + (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
        self.row, self.bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
        value = np.log1p(count)
        self.value = value / np.sqrt(np.bincount(self.row, value**2, rows))[self.row] if len(key) else value

        def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.bincount(at, values, rows) if len(at) else np.zeros(rows)

        def inside(table: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(table[data])])
            return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

        words = np.bincount(word_row, minlength=rows)
        n = np.maximum(words, 1)
        last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
        lower, upper, signs = inside(LOWER), inside(UPPER), inside(SIGN)
        size = np.diff(offsets)
        letters = np.maximum(lower + upper, 1)
        first_odd = (SIGN[data[starts]] > 0) & (ends - starts == 1)
        twice = (SIGN[last] > 0) & (last == before) & (ends - starts > 1)
        again = np.zeros(len(starts), bool)
        again[1:] = (hashed[1:] == hashed[:-1]) & (word_row[1:] == word_row[:-1])
        shouted = (UPPER[data[starts]] > 0) & (UPPER[before] > 0) & (ends - starts > 2)
        line_starts, line_ends = runs(data, offsets, LINE_BREAKS)
        line_row = np.searchsorted(offsets, line_starts, "right") - 1
        lines = np.maximum(np.bincount(line_row, minlength=rows), 1)
        order = np.lexsort((line_hash := run_hashes(data, line_starts, line_ends), line_row))
        same = np.zeros(len(order), bool)
        same[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
        self.statistics = np.column_stack([
            per_row(ODD_SIGN[last], word_row) / n, per_row(twice, word_row) / n, per_row(first_odd, word_row) / n,
            per_row(again, word_row) / n, per_row(shouted, word_row) / n, np.bincount(self.row, minlength=rows) / n,
            upper / letters, inside(DIGIT) / np.maximum(size, 1), signs / np.maximum(size, 1),
            per_row(ends - starts, word_row) / n, np.log1p(words), np.log1p(words / lines), np.log1p(lines),
            per_row(same, line_row[order]) / lines,
        ])


class Model:
    """Bias, weights and factors; the first features are hashed words, the others intervals of statistics and metadata."""

    def __init__(self, edges: list[np.ndarray], bias: float, weights: np.ndarray, factors: np.ndarray):
        self.edges, self.bias, self.weights, self.factors = edges, bias, weights, factors

    def logits(self, texts: Texts, statistics: np.ndarray) -> np.ndarray:
        return _forward(texts, _intervals(statistics, self.edges), self.bias, self.weights, self.factors)[0]


def _intervals(statistics: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Feature number of each row's interval per statistic; a missing value has an interval of its own."""
    base, out = 1 << BUCKET_BITS, np.empty(statistics.shape, np.int64)
    for j, edge in enumerate(edges):
        x = statistics[:, j]
        out[:, j] = base + np.where(np.isnan(x), len(edge) + 1, np.searchsorted(edge, np.nan_to_num(x), "left"))
        base += len(edge) + 2
    return out


def _forward(texts: Texts, bins: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
    """Logits by the identity 2 * sum of pairs = square of the sum - sum of squares, and the sums per factor."""
    rows = len(bins)
    linear = bias + np.bincount(texts.row, weights[texts.bucket] * texts.value, rows) + weights[bins].sum(1)
    sums = np.empty((rows, factors.shape[1]))
    pairs = np.zeros(rows)
    for f in range(factors.shape[1]):
        part, binned = factors[texts.bucket, f] * texts.value, factors[bins, f]
        sums[:, f] = np.bincount(texts.row, part, rows) + binned.sum(1)
        pairs += sums[:, f] ** 2 - np.bincount(texts.row, part**2, rows) - (binned**2).sum(1)
    return linear + pairs / 2, sums


def fit(column: pa.Array, metadata: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.1, decay: float = 1.0) -> Model:
    """Full-batch gradient steps on the logistic loss. No labels of one kind: a constant score of their side."""
    texts = Texts(column)
    statistics = np.column_stack([texts.statistics, metadata])
    y = np.asarray(labels, float)
    edges = [np.unique(np.quantile(x[~np.isnan(x)], QUANTILES)) if (~np.isnan(x)).any() else np.zeros(0) for x in statistics.T]
    size = (1 << BUCKET_BITS) + sum(len(e) + 2 for e in edges)
    rng = np.random.default_rng(10)
    share = (y.sum() + 1) / (len(y) + 2)
    bias, weights, factors = float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    if not len(y) or y.min() == y.max():
        return Model(edges, bias, weights, np.zeros_like(factors))
    bins = _intervals(statistics, edges)
    seen = np.zeros(size, bool)
    seen[texts.bucket] = seen[bins] = True
    factors[~seen] = 0
    state = [np.zeros(size), np.zeros(size), np.zeros_like(factors), np.zeros_like(factors)]
    flat = bins.ravel()
    for turn in range(1, rounds + 1):
        z, sums = _forward(texts, bins, bias, weights, factors)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        pull = error[texts.row] * texts.value
        gradient = np.bincount(texts.bucket, pull, size) + np.bincount(flat, np.repeat(error, bins.shape[1]), size) + decay * weights / len(y)
        steps = np.empty_like(factors)
        for f in range(FACTORS):
            words = pull * (sums[texts.row, f] - factors[texts.bucket, f] * texts.value)
            others = error[:, None] * (sums[:, f : f + 1] - factors[bins, f])
            steps[:, f] = np.bincount(texts.bucket, words, size) + np.bincount(flat, others.ravel(), size) + decay * factors[:, f] / len(y)
        bias -= rate * error.sum()
        for theta, g, m, v in ((weights, gradient, state[0], state[1]), (factors, steps, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            theta -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return Model(edges, bias, weights.astype(np.float32), factors.astype(np.float32))


def _scores(column: pa.Array, metadata: np.ndarray, model: Model) -> np.ndarray:
    texts = Texts(column)
    return 1 / (1 + np.exp(-np.clip(model.logits(texts, np.column_stack([texts.statistics, metadata])), -40, 40)))


def _numbers(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Metadata as signed logarithms, one column each; null and NaN are missing values."""
    if not columns:
        return np.zeros((rows, 0))
    values = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in columns])
    return np.sign(values) * np.log1p(np.abs(values))


def quality_score(model: Model, text: Column, *metadata: Column) -> Column:
    """Score between 0 and 1 of a text column and its numeric metadata."""

    @F.arrow_udf("double")
    def run(texts: pa.Array, *others: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts, *others], names=[str(n) for n in range(len(others) + 1)])
        done = [_scores(p.column(0), _numbers(p.columns[1:], len(p)), model) for p in portions(batch, 0, 1 << 20)]
        return pa.array(np.concatenate(done) if done else np.zeros(0))

    return run(text, *metadata)


def fit_documents(documents: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), most: int = MAX_LABELLED) -> Model:
    """Model from document records (``doc_id``, ``raw_text``, numeric ``metadata``) and review labels (``doc_id``, ``accepted`` 0/1)."""
    sample = labelled_sample(documents, labels, "accepted", most, metadata)
    numbers = _numbers([sample[f"_{n}"].combine_chunks() for n in range(len(metadata))], len(sample))
    return fit(sample["raw_text"], numbers, sample["label"].to_numpy())


def score_documents(
    documents: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), most: int = MAX_LABELLED, threshold: float = THRESHOLD
) -> DataFrame:
    """Quality of every whole text of document records (``doc_id``, ``raw_text``), learnt from reviewers' acceptance.

    A factorisation machine: hashed words, intervals of structure statistics and of ``metadata`` columns are features, and every
    pair of them interacts by the product of low-rank vectors, summed in linear time. Learns from at most ``most`` labelled
    documents. Returns doc_id, score (0 to 1) and accepted (1 from ``threshold``).
    Null and empty texts have the statistics of nothing and are scored by them; a null metadata value is an interval of its own.
    Without labels of both kinds all scores are alike. Repeated rows get equal scores; other columns are not used; no rows in,
    none out. No shuffle of the scored texts.
    """
    model = fit_documents(documents, labels, metadata, most)
    score = quality_score(model, F.col("raw_text").cast("string"), *[F.col(c).cast("double") for c in metadata])
    return documents.select("doc_id", score.alias("score")).withColumn("accepted", (F.col("score") >= threshold).cast("int"))
