"""Packing of documents into fixed-length token sequences, neighbours on a space-filling curve together."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.text import mix, pieces
from jobweave.llm.tokens import merger
from jobweave.session import written

# Size of the hashed document vectors, dimensions and bits per dimension of the curve.
HASHED, DIMENSIONS, BITS = 256, 3, 10


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (0 .. 2 ** bits - 1 in every dimension)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the largest cube to the smallest
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hilbert key of each document: token counts hashed to a vector, projected to a few dimensions, cut into cells."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    place = (mix(ids.astype(np.uint64)) % np.uint64(HASHED)).astype(np.int64)
    v = np.log1p(np.bincount(row * HASHED + place, minlength=n * HASHED).reshape(n, HASHED).astype(np.float32))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    directions = np.random.default_rng(7).standard_normal((HASHED, DIMENSIONS)).astype(np.float32)
    share = 1 / (1 + np.exp(-1.702 * (v @ directions)))
    return hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenize(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, curve key, and ids (packed unsigned 16-bit numbers) of every whole text, with `end_id` at the end."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for rows, data, at in pieces(batches):
            ids, of = m.encode(data, at)
            key = curve_keys(ids, of)
            full = np.insert(ids, of[1:], end_id).astype("<u2")
            ends = of + np.arange(len(of))
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(at) - 1, [None, pa.py_buffer((ends * 2).astype(np.int64)), pa.py_buffer(full)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(key), packed.cast(pa.binary())], ["doc_id", "key", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, ids binary")


def _cut(doc_id: pa.Array, start: np.ndarray, total: np.ndarray, ids: np.ndarray, at: np.ndarray,
         cuts: np.ndarray, first_sequence: int) -> pa.RecordBatch:
    """Pieces of documents that lie end to end at offsets `at`, cut at the sequences' limits `cuts` (from 0 to the end)."""
    bounds = np.union1d(at, cuts)
    begin, end = bounds[:-1], bounds[1:]
    doc, seq = np.searchsorted(at, begin, "right") - 1, np.searchsorted(cuts, begin, "right") - 1
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
    return pa.RecordBatch.from_arrays(
        [doc_id.take(pa.array(doc)), pa.array(start[doc] + begin - at[doc]), pa.array(end - begin), pa.array(crc, pa.int64()),
         pa.array(total[doc]), pa.array(first_sequence + seq), pa.array(begin - cuts[seq])],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most `size` tokens, in the order of a Hilbert curve through their content.

    Ids are those that the vocabulary's own library gives without special tokens, then `end_id`. The curve's order is a
    range sort by (key, hash of doc_id, doc_id): a key that many copies share is split by the hash. Each task packs its
    range end to end, so only its last sequence can fall short; that rest is cut into sequences whose lengths are powers
    of two, which need no padding. A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The tokenized table is written to the shared folder first: sampling the range limits then reads keys only, and a lost
    executor costs no second tokenization. Null and empty texts are the one token `end_id`; a null doc_id stays null;
    repeated rows are packed each; an empty table gives no rows; other columns are ignored. A long document takes the
    memory of its own ids.
    """
    kind = dict(docs.dtypes)["doc_id"]
    tokens = written(tokenize(docs, path, end_id), "tokens")
    ordered = (tokens.withColumn("salt", F.xxhash64("doc_id", F.crc32("ids"))).repartitionByRange("key", "salt", "doc_id")
               .sortWithinPartitions("key", "salt", "doc_id").select("doc_id", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held = None
        for rows, data, at in pieces(batches, "ids", 4 << 20):
            ids, at = data.view("<u2") if len(data) else np.zeros(0, np.uint16), at // 2
            doc_id, start, total = rows.column("doc_id"), np.zeros(len(at) - 1, np.int64), np.diff(at)
            if held:
                doc_id, ids = pa.concat_arrays([held[0], doc_id]), np.concatenate([held[3], ids])
                at = np.concatenate([held[4][:-1], at + held[4][-1]])
                start, total = np.concatenate([held[1], start]), np.concatenate([held[2], total])
            whole = at[-1] // size * size
            last = int(np.searchsorted(at, whole, "right")) - 1  # document with the first token that is held back
            if whole:
                stop = last + (whole > at[last])
                yield _cut(doc_id[:stop], start[:stop], total[:stop], ids[:whole], np.append(at[:stop], whole),
                           np.arange(0, whole + 1, size), sequence)
                sequence += whole // size
            held = None
            if at[-1] > whole:
                start = start[last:].copy()
                start[0] += whole - at[last]
                held = doc_id[last:], start, total[last:], ids[whole:].copy(), np.maximum(at[last:] - whole, 0)
        if held:
            rest = int(held[4][-1])
            parts = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
            yield _cut(*held, np.append(0, np.cumsum(parts)), sequence)

    return ordered.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
