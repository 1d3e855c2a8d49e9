"""Hashes of words and word runs for whole Arrow batches, without a Python step per word."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPAN = 1 << 20
_RNG = np.random.default_rng(20240501)
#: A random value per byte, the same on every executor.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[FOLD]

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, SPAN + 4096), base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the input; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def runs(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes that do not break, none across a row's end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of each run, from differences of one running sum; about a megabyte of text at a time."""
    return prefix_hashes(data, starts, ends, (), values)[0]


def prefix_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...], values: np.ndarray = BYTE_VALUES
) -> list[np.ndarray]:
    """Hashes of the runs, then for every length those of their first bytes; a run that is not longer has the hash 0."""
    out = [np.zeros(len(starts), np.uint64) for _ in range(len(lengths) + 1)]
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * _power(BASE, high - low), out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        back = _power(INVERSE, high - low)[s]
        out[0][at:stop] = mixed((sums[e] - sums[s]) * back + (e - s).astype(np.uint64))
        for n, length in enumerate(lengths):
            longer = np.flatnonzero(e - s > length)
            first = s[longer]
            found = mixed((sums[first + length] - sums[first]) * back[longer] + np.uint64(length + 1000))
            out[n + 1][at + longer] = found
        at = stop
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words of one text; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mixed(total * np.uint64(BASE) + words[i : i + n])
    return np.unique(total)


def portions(batch: pa.RecordBatch, column: int, limit: int = 1 << 21) -> list[pa.RecordBatch]:
    """The batch in consecutive slices of about ``limit`` bytes of one text column; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
