"""Words of many texts at once, on their UTF-8 bytes, with 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute

PIECE = 1 << 20  # bytes hashed at once
WORD_BASE, RUN_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text starts (one more than there are texts). Null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(texts) + 1] if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def find_words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes with is_word), and the number of the first word of each text."""
    inside = np.concatenate(([False], is_word[data], [False]))
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word doesn't go on in the next text
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray | None = None) -> np.ndarray:
    """A hash of each word's bytes (through the table letters), the same wherever the word stands."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        a, b = int(starts[first]), int(ends[last - 1])
        piece = data[a:b] if letters is None else letters[data[a:b]]
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers(WORD_BASE, b - a), out=sums[1:])
        s = starts[first:last] - a
        out[first:last] = (sums[ends[first:last] - a] - sums[s]) * powers(inverse(WORD_BASE), b - a)[s]
        first = last
    return mixed(out)


SHORT = 64  # bytes of a word that the table covers
_TABLES: dict[int, np.ndarray] = {}


def secret_table(key: int) -> np.ndarray:
    """Random values for each place in a word and each byte there."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = np.random.default_rng(key).integers(0, 2**64, SHORT * 256, np.uint64)
    return _TABLES[key]


def secret_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """A hash of each word's bytes by a secret key: sums of random table values (longer words: keyed BLAKE2). Who doesn't know the key
    can't make words that collide, unlike with word_hashes()."""
    table, out, first = secret_table(key), np.zeros(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE // 8, "right")))
        s, n = starts[first:last], np.minimum(ends[first:last] - starts[first:last], SHORT)
        offsets = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(offsets, n)
        out[first:last] = np.add.reduceat(table[place * 256 + data[np.repeat(s, n) + place]], offsets)
        first = last
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.to_bytes(16, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return mixed(out)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for first in range(0, n, PIECE // 8):
        part = words[first : first + PIECE // 8 + k - 1]
        m = len(part) - k + 1
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * powers(RUN_BASE, len(part)), out=sums[1:])
        out[first : first + m] = (sums[k : k + m] - sums[:m]) * powers(inverse(RUN_BASE), len(part))[:m]
    return mixed(out)


def spans_of(batch: pa.RecordBatch, column: str, most_bytes: int = 2 * PIECE, most_rows: int = 4096):
    """The batch in slices of so many bytes of text (one row at least)."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        stop = max(start + 1, min(start + most_rows, int(np.searchsorted(total, done + most_bytes, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def covered(marks: np.ndarray, k: int) -> np.ndarray:
    """Of n - k + 1 marked windows of k words: which of the n words some marked window covers."""
    n = len(marks) + k - 1
    steps = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps[:n]) > 0


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
