"""Quality rules: counts per document, and an isolation forest on them with a threshold from labelled rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.text import BASE, _IS_SPACE, inverse_powers, mix, pieces, prefix_hashes, stretch_hashes, word_hashes, words

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbols", "repeats", "upper", "marks"]


def _per_text(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flag, dtype=np.int64))
    return total[at[1:]] - total[at[:-1]]


def _among(data: np.ndarray, values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table[data]


def rule_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts (a column for each of COUNTS) and the forest's statistics (FEATURES) of texts given as UTF-8 with offsets."""
    n = len(at) - 1
    start, end, row = words(data, at)
    n_words = np.bincount(row, minlength=n)
    solid = ~_IS_SPACE[data]
    word_chars = _per_text(solid & ((data & 0xC0) != 0x80), at)
    symbols = _per_text(_among(data, SYMBOLS), at)

    line_start = np.unique(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(at, line_start, "right") - 1
    line_end = np.append(line_start[1:], len(data))
    line_end -= (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else 0
    filled = np.append(0, np.cumsum(solid, dtype=np.int64))
    has_word = filled[line_end] > filled[line_start]
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    key = stretch_hashes(prefix_hashes(data), inverse_powers(len(data) + 1), line_start, line_end)
    key = mix(key + mix((line_end - line_start).astype(np.uint64)) + mix(line_row.astype(np.uint64)) * np.uint64(BASE))
    code, _ = pd.factorize(key)
    lines = np.bincount(line_row, minlength=n)
    first = np.zeros(len(code), bool)
    if len(code):
        head = np.zeros(code.max() + 1, np.int64)
        head[code[::-1]] = np.arange(len(code))[::-1]
        first[head] = True
    dup_lines = lines - np.bincount(line_row[first], minlength=n)

    h = word_hashes(data, start, end)
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        three = mix(mix(mix(h[:-2] + mix(row[:-2].astype(np.uint64))) + h[1:-1]) + h[2:])
        whole = row[:-2] == row[2:]
        code, _ = pd.factorize(three)
        often = np.bincount(code, weights=whole)[code] >= 2
        hit = np.flatnonzero(whole & often)
        for j in range(3):
            repeated[hit + j] = True
    repeats = np.bincount(row[repeated], minlength=n)
    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeats], 1)
    some, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    upper = _per_text((data >= 65) & (data <= 90), at)
    marks = _per_text(_among(data, b"!\"'()+-/:;<=>?@[\\]^_`{|}~#$%&*"), at)
    stats = np.stack([np.log1p(word_chars / some), np.log1p(10 * symbols / some), repeats / some, upper / chars, np.log1p(10 * marks / some)], 1)
    return counts.astype(np.int64), stats.astype(np.float64)


def fails_base(counts: np.ndarray) -> np.ndarray:
    """The base rules: fewer than 50 words, or over half of them in repeated 3-word windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def _unused_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n points: what a leaf of n points stands for."""
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


class Forest:
    """Isolation trees as arrays; node i has the children 2 i + 1 and 2 i + 2.

    Splits are random in the box of all labelled rows, and a path ends where at most one of the good rows of the tree's
    sample is left: documents in regions that good rows don't reach have short paths, however many they are.
    """

    def __init__(self, good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, sample: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        sample, self.depth, nodes = min(sample, len(good)), depth, (2 << depth) - 1
        self.feature, self.limit = np.full((trees, nodes), -1, np.int8), np.zeros((trees, nodes), np.float32)
        self.length = np.zeros((trees, nodes), np.float32)
        self.usual = float(_unused_depth(sample)) or 1.0
        for t in range(trees):
            todo = [(0, good[rng.choice(len(good), sample, replace=False)], low.copy(), high.copy(), 0)]
            while todo:
                i, own, low_i, high_i, at = todo.pop()
                free = np.flatnonzero(high_i > low_i)
                if at == depth or len(own) < 2 or not len(free):
                    self.length[t, i] = at + float(_unused_depth(len(own)))
                    continue
                f = rng.choice(free)
                cut = np.float32(rng.uniform(low_i[f], high_i[f]))
                self.feature[t, i], self.limit[t, i] = f, cut
                side, left_high, right_low = own[:, f] < cut, high_i.copy(), low_i.copy()
                left_high[f] = right_low[f] = cut
                todo += [(2 * i + 1, own[side], low_i, left_high, at + 1), (2 * i + 2, own[~side], right_low, high_i, at + 1)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1: the shorter its mean path, the higher."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, limit, length in zip(self.feature, self.limit, self.length):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (rows[each, f] >= limit[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def fit(stats: np.ndarray, good: np.ndarray, max_loss: float, trees: int = 100, sample: int = 256, depth: int = 10,
        seed: int = 13) -> tuple[Forest | None, float]:
    """A forest on labelled rows and the score above which a document is anomalous.

    The threshold is the score that parts good from bad labelled rows best (the share of bad ones above it less the share
    of good ones), among those that lose at most the share `max_loss` of the good ones. Without rows of both labels
    nothing is anomalous.
    """
    if not good.any() or good.all():
        return None, 1.0
    forest = Forest(stats[good], stats.min(0), stats.max(0), trees, sample, depth, seed)
    score = forest.score(stats)
    limits = np.unique(score)
    lost = 1 - np.searchsorted(np.sort(score[good]), limits, "right") / good.sum()
    caught = 1 - np.searchsorted(np.sort(score[~good]), limits, "right") / (~good).sum()
    allowed = lost <= max_loss
    best = np.flatnonzero(allowed)[np.argmax((caught - lost)[allowed])]
    return forest, float(limits[best:best + 2].mean())  # halfway to the next labelled row


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_loss: float = 0.005) -> DataFrame:
    """Rows of `docs` with their rule counts, base_failed, anomaly score and kept.

    Words are runs of other than ASCII white space. Base rules: fewer than 50 words, or over half of the words in 3-word
    windows that the text has twice or more, fail. The others are kept unless the isolation forest calls them anomalous.
    The forest and its threshold come from a bounded sample: the at most `max_rows` labelled rows (doc_id, quality 0 or 1)
    lowest in a hash of doc_id, of which those that pass the base rules count, at most `max_loss` of the good ones lost. All documents are counted and scored, without a
    shuffle. Null and empty texts have no words and fail; null labels and ids are no part of the sample; repeated rows get
    equal results; without labels of both kinds only the base rules act; an empty table gives none. Columns with
    the names of results are replaced.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # of at most max_rows ids and numbers

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches):
            counts, stats = rule_counts(data, at)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("_quality").cast(pa.int64()), pa.array(fails_base(counts)), *map(pa.array, stats.T)],
                ["doc_id", "good", "failed", *FEATURES])

    fields = ", ".join(f"{f} double" for f in FEATURES)
    kind = dict(docs.dtypes)["doc_id"]
    rows = (sample.mapInArrow(measure, f"doc_id {kind}, good long, failed boolean, {fields}")
            .where("not failed").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(max_rows).toPandas())
    forest, limit = fit(rows[FEATURES].to_numpy(float), rows["good"].to_numpy() > 0, max_loss)

    new = [*COUNTS, "base_failed", "anomaly", "kept"]
    kept = docs.select([c for c in docs.columns if c not in new])
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches):
            counts, stats = rule_counts(data, at)
            failed = fails_base(counts)
            score = forest.score(stats) if forest else np.zeros(len(stats))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score <= limit))],
                [*rows.schema.names, *new])

    return kept.mapInArrow(judge, f"{schema}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, anomaly double, kept boolean")
