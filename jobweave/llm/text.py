"""Texts of Arrow batches as flat arrays, in pieces of bounded size; word shingles and 64-bit mixing."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Bytes of text that a Python task handles at once; one longer document is a piece of its own.
PIECE_BYTES = 1 << 20

# The six characters that part words.
SPACES = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents of a folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts as (rows, bytes of all texts, offsets of each text); a null text is empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin), data[at[begin]:at[end]], at[begin:end + 1] - at[begin]
            begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


# Odd, so that its powers have inverses modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_SYMBOLS = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol x base ** position: the hash of any stretch is a difference (see `stretch_hashes`)."""
    out = np.zeros(len(data) + 1, np.uint64)
    symbols = _SYMBOLS[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + np.uint64(1))
    np.cumsum(symbols * powers(BASE, len(data)), out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    """The powers that bring the hash of a stretch to position 0."""
    return powers(_INVERSE, n)


def stretch_hashes(prefix: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the stretches [start, end), whatever their place."""
    return (prefix[end] - prefix[start]) * back[start]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each; a word never crosses texts."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # two texts meet without a space between
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return mix(stretch_hashes(prefix_hashes(data), inverse_powers(len(data) + 1), start, end) + (end - start).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def shingles(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each text, lower-cased, as (hashes by row in rising order, offsets of each row).

    A text with fewer words than `width` has its whole word sequence as its one shingle; without words it has none.
    """
    data = lower_ascii(data)
    start, end, row = words(data, at)
    h = word_hashes(data, start, end)
    n_words = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    of = np.repeat(np.arange(len(n)), n)
    begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of]
    key = np.zeros(len(of), np.uint64)
    for j in range(width):
        there = n_words[of] > j
        key = np.where(there, mix(key * np.uint64(BASE) + h[np.minimum(begin + j, max(len(h) - 1, 0))] if len(h) else key), key)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[new], of[new]
    return key, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(at) - 1))])
