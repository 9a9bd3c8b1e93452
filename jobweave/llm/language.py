"""Language of documents by hyperdimensional profiles."""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.text import pieces
from jobweave.llm.tokens import LETTER, classes

# Symbols of the item memory: 0 is what parts words, 1-26 are a-z, all other letters share the rest.
SYMBOLS = 64
# Most counts (documents x distinct n-grams) held at once.
CELLS = 8_000_000


@functools.lru_cache(1)
def symbols() -> np.ndarray:
    """Symbol of every code point, in lower case."""
    points = np.arange(len(classes()))
    low = points.copy()
    low[:0x2000] = [ord(chr(c).lower()[0]) for c in range(0x2000)]
    out = 27 + low % (SYMBOLS - 27)
    latin = (low >= 97) & (low <= 122)
    out[latin] = low[latin] - 96
    out[classes() != LETTER] = 0
    return out.astype(np.uint8)


@functools.lru_cache(2)
def letter_vectors(dims: int) -> np.ndarray:
    """A random vector of +1 and -1 for each symbol."""
    return np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))


def gram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of 3-grams: the letters' vectors, shifted by their place, bound by multiplication."""
    v = letter_vectors(dims)
    return (np.roll(v, 2, 1)[codes >> 12] * np.roll(v, 1, 1)[codes >> 6 & 63] * v[codes & 63]).astype(np.float32)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter 3-grams of texts given as UTF-8 with offsets, and their rows. Word borders count as a letter."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    begin = np.searchsorted(lead, at)
    sym = np.append(np.insert(symbols()[points], begin[:-1], 0), 0).astype(np.int64)
    row = np.append(np.repeat(np.arange(len(at) - 1), np.diff(begin) + 1), len(at) - 1)
    keep = np.append(True, (sym[1:] != 0) | (sym[:-1] != 0))
    sym, row = sym[keep], row[keep]
    middle = np.flatnonzero(sym[1:-1]) + 1
    return sym[middle - 1] << 12 | sym[middle] << 6 | sym[middle + 1], row[middle]


def bundles(code: np.ndarray, row: np.ndarray, n: int, dims: int) -> np.ndarray:
    """The sum of the n-gram vectors of each row."""
    out = np.zeros((n, dims), np.float32)
    there = np.flatnonzero(np.bincount(code, minlength=SYMBOLS ** 3))
    if not len(there):
        return out
    place = np.zeros(SYMBOLS ** 3, np.int64)
    place[there] = np.arange(len(there))
    step = max(1, CELLS // len(there))
    wide = max(1, 4 * CELLS // dims)
    for a in range(0, n, step):
        lo, hi = np.searchsorted(row, [a, a + step])
        size = min(step, n - a)
        counts = np.bincount((row[lo:hi] - a) * len(there) + place[code[lo:hi]], minlength=size * len(there))
        counts = counts.reshape(size, -1).astype(np.float32)
        for b in range(0, len(there), wide):
            out[a:a + size] += counts[:, b:b + wide] @ gram_vectors(there[b:b + wide], dims)
    return out


def held_out(doc_id: Column) -> Column:
    """The fourth of the documents that learning never sees; a null id is not part of it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame, dims: int) -> dict[str, np.ndarray]:
    """The bundle of all texts of each language, from rows with text and lang outside the held-out fourth.

    Tasks bundle what they read; sums of whole numbers per language and dimension meet on the driver, which holds
    languages x dims of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches):
            names = rows.column("lang").dictionary_encode()
            code, row = grams(data, at)
            lang = names.indices.to_numpy(zero_copy_only=False)[row]
            order = np.argsort(lang, kind="stable")
            total = bundles(code[order], lang[order], len(names.dictionary), dims)
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(np.repeat(np.arange(len(total)), dims))),
                 pa.array(np.tile(np.arange(dims), len(total))), pa.array(total.ravel().astype(np.int64))], ["lang", "dim", "total"])

    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    out: dict[str, np.ndarray] = {}
    for r in learn.mapInArrow(run, "lang string, dim long, total long").groupBy("lang", "dim").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["lang"], np.zeros(dims))[r["dim"]] = r["total"]
    return out


def predict_language(docs: DataFrame, dims: int = 1024) -> DataFrame:
    """doc_id, held_out, lang_pred and score (cosine with the nearest prototype, 0 to 1) of every document.

    A document's vector is the sum of its letter 3-grams' vectors; only its text is used. `und` with score 0 where the
    text is null or has no letter, or nothing could be learned. Ties go to the first language by name; repeated rows get
    equal results; an empty table gives none; other columns are ignored. Two map passes, no shuffle of texts.
    """
    learned = {k: v for k, v in sorted(prototypes(docs, dims).items()) if np.any(v)}
    names = list(learned)
    table = np.stack([v / np.linalg.norm(v) for v in learned.values()]).astype(np.float32) if names else None
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches):
            n = len(at) - 1
            code, row = grams(data, at)
            lang, score = np.full(n, "und", object), np.zeros(n)
            known = np.bincount(row, minlength=n) > 0
            if names and known.any():
                v = bundles(code, row, n, dims)
                cosine = v @ table.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(1)
                lang[known] = np.array(names, object)[best[known]]
                score[known] = np.clip(cosine[np.arange(n), best], 0, 1)[known]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(lang, pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"))
