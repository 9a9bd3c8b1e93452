"""Removal of long byte strings that occur more than once, by sorted suffixes and hashed common extensions."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.text import BASE, inverse_powers, mix, pieces, powers, prefix_hashes, stretch_hashes
from jobweave.session import discard, written

# Bytes of a repeated string, and of the anchors: short strings that both copies of a repeated one choose alike.
LENGTH, ANCHOR = 200, 32
# Lengths to which an anchor is extended on either side, to see how far any other occurrence can agree.
LEVELS = (6, 24, 84, 144, LENGTH - ANCHOR)
# First bytes of suffixes that are compared as numbers, before any are merged.
HEAD = 24
# Bytes of text that a task works on at once: its arrays are a hundred times as large.
PIECE = 256 << 10

_SECOND = 0xD6E8FEB86659FD93
_SECOND_SYMBOLS = mix(np.arange(1001, 1257, dtype=np.uint64))


def _leftmost_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value in each window x[i:i + w]."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    g = np.full(rows * w, np.uint64(2 ** 64 - 1))
    g[:len(x)] = x
    g = g.reshape(rows, w)
    column = np.arange(w, dtype=np.int64)

    def running(a: np.ndarray, tie: bool) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum.accumulate(a, axis=1)
        new = np.ones(a.shape, bool)
        new[:, 1:] = a[:, 1:] <= low[:, :-1] if tie else a[:, 1:] < low[:, :-1]
        return low, np.maximum.accumulate(np.where(new, column, 0), axis=1)

    base = np.arange(rows, dtype=np.int64)[:, None] * w
    low, place = running(g, False)
    head, head_at = low.ravel(), (base + place).ravel()
    low, place = running(g[:, ::-1], True)
    tail, tail_at = low[:, ::-1].ravel(), (base + w - 1 - place[:, ::-1]).ravel()
    i = np.arange(n)
    return np.where(tail[i] <= head[i + w - 1], tail_at[i], head_at[i + w - 1])


class Runs:
    """The strings of LENGTH bytes of some texts, as runs of starts that share an anchor.

    A string's anchor is the leftmost of its substrings of ANCHOR bytes with the least hash, so equal strings have equal
    anchors at equal distance. Runs of a text are numbered from 0.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.prefix, self.back = prefix_hashes(data), inverse_powers(len(data) + 1)
        empty = np.zeros(0, np.int64)
        self.row = self.low = self.high = self.number = self.place = empty
        self.anchor = self.content = empty.view(np.uint64)
        if len(data) < LENGTH:
            return
        begin = np.arange(len(data) - ANCHOR + 1)
        value = mix((self.prefix[ANCHOR:] - self.prefix[:-ANCHOR]) * self.back[:len(begin)])
        anchor = _leftmost_minima(value, LENGTH - ANCHOR + 1)
        long = np.flatnonzero(np.diff(at) >= LENGTH)
        if not len(long):
            return
        # a run begins with its text or where the anchor changes, and ends before the next one or with its text
        begins, ends = at[long], at[long + 1] - LENGTH
        first = np.zeros(len(anchor) + 1, bool)
        first[1:-1] = anchor[1:] != anchor[:-1]
        first[begins] = first[ends + 1] = True
        cut = np.flatnonzero(first)
        of = np.searchsorted(begins, cut, "right") - 1
        inside = (of >= 0) & (cut <= ends[of])
        cut, of = cut[inside], of[inside]
        self.row, self.low = long[of], cut
        self.high = np.minimum(np.append(cut[1:] - 1, ends[-1]), ends[of])
        self.number = np.arange(len(cut)) - np.searchsorted(self.row, self.row)
        self.place = anchor[self.low]
        self.anchor = value[self.place]
        place = (self.place - self.low).astype(np.uint64)
        end = self.high + LENGTH
        self.content = mix(stretch_hashes(self.prefix, self.back, self.low, end) + mix((end - self.low).astype(np.uint64) << np.uint64(20) | place))


def _keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text."""
    prefix, back = prefix_hashes(data), inverse_powers(len(data) + 1)
    return mix(stretch_hashes(prefix, back, at[:-1], at[1:]) + np.diff(at).astype(np.uint64)).view(np.int64)


class Suffixes:
    """Suffixes of a byte array, compared over LENGTH bytes by their hashed common extensions."""

    def __init__(self, data: np.ndarray, prefix: np.ndarray, back: np.ndarray):
        self.data, self.prefix, self.back = data, prefix, back

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes at x and y, at most LENGTH: binary search over equal hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH)
        while True:
            if (low == high).all():
                return low
            middle = (low + high + 1) // 2
            same = stretch_hashes(self.prefix, self.back, x, x + middle) == stretch_hashes(self.prefix, self.back, y, y + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y: by the byte after their common extension."""
        n = self.common(x, y)
        inside = np.minimum(n, LENGTH - 1)
        return (n < LENGTH) & (self.data[x + inside] < self.data[y + inside])

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """The starts in the order of their suffixes: by the first HEAD bytes, and among suffixes that agree in those by merging
        sorted runs from the bottom up.

        All runs of a level merge at once: each suffix finds its rank in the neighbouring run by binary search. Merging takes place
        only among suffixes with the same first bytes, so most suffixes meet few others.
        """
        keys = []
        for a in range(0, HEAD, 8):
            key = np.zeros(len(starts), np.uint64)
            for i in range(a, a + 8):
                key = key << np.uint64(8) | self.data[starts + i].astype(np.uint64)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        x, new = starts[order], np.ones(len(starts), bool)
        if len(x) > 1:
            new[1:] = np.any([key[order[1:]] != key[order[:-1]] for key in keys], axis=0)
        group = np.flatnonzero(new)
        size = np.diff(np.append(group, len(x)))
        width = 1
        while True:
            more = size > width  # in larger groups there is still more than one run
            if not more.any():
                return x
            group, size = group[more], size[more]
            begin, n = np.repeat(group, size), np.repeat(size, size)
            local = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            block, right = local // (2 * width) * (2 * width), (local // width) % 2 == 1
            other = np.where(right, block, np.minimum(block + width, n))
            low, high = other.copy(), np.minimum(other + width, n)
            mine = x[begin + local]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                theirs, on_right = x[begin[open_] + middle], right[open_]
                # equal suffixes keep the left run's first
                before = self.less(np.where(on_right, mine[open_], theirs), np.where(on_right, theirs, mine[open_])) ^ on_right
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            x[begin + local + low - other - np.where(right, width, 0)] = mine
            width *= 2

    def classes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One start and the number of starts for each different string of LENGTH bytes. Equal hashes are checked on bytes."""
        x = self.sort(starts)
        new = np.ones(len(x), bool)
        if len(x) > 1:
            alike = np.flatnonzero(self.common(x[:-1], x[1:]) == LENGTH)
            for a in range(0, len(alike), 20_000):
                part = alike[a:a + 20_000]
                span = np.arange(LENGTH)
                new[part + 1] = (self.data[x[part][:, None] + span] != self.data[x[part + 1][:, None] + span]).any(1)
        heads = np.flatnonzero(new)
        return x[heads], np.diff(np.append(heads, len(x)))


def _window_hashes(data: np.ndarray, runs: Runs, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each string of LENGTH bytes, from two independent polynomials."""
    second = np.append(np.uint64(0), np.cumsum(_SECOND_SYMBOLS[data] * powers(_SECOND, len(data))))
    back = powers(pow(_SECOND, -1, 1 << 64), len(data) + 1)
    return (mix(stretch_hashes(runs.prefix, runs.back, starts, starts + LENGTH)).view(np.int64),
            mix(stretch_hashes(second, back, starts, starts + LENGTH)).view(np.int64))


def _chosen(rows: pa.RecordBatch, runs: Runs, states: tuple[int, ...]) -> np.ndarray:
    """Places among the runs of those that the column `runs` (anchor, number, state) lists with one of the states."""
    lists = rows.column("runs")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    anchor, number, state = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    first = np.searchsorted(runs.row, np.arange(len(lists) + 1))
    place = first[row] + number
    ok = (place < first[row + 1]) & np.isin(state, states)
    ok[ok] &= runs.anchor[place[ok]].view(np.int64) == anchor[ok]  # else it is of another text with this doc_id
    return np.unique(place[ok])


def _extensions(texts: DataFrame) -> DataFrame:
    """Rows (h, doc_id, key, number, side, level): hashes of the anchors of runs that are to be compared, with LEVELS more bytes."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches, most=PIECE):
            r = Runs(data, at)
            places = _chosen(rows, r, (SINGLE, SHARED))
            out = []
            for side in (0, 1):
                for level, n in enumerate(LEVELS):
                    low, high = (r.place - n, r.place + ANCHOR) if side == 0 else (r.place, r.place + ANCHOR + n)
                    ok = places[(low[places] >= at[r.row[places]]) & (high[places] <= at[r.row[places] + 1])]
                    h = mix(stretch_hashes(r.prefix, r.back, low[ok], high[ok]) + np.uint64(1 + side * len(LEVELS) + level))
                    out.append((ok, h, np.full(len(ok), side), np.full(len(ok), level)))
            ok, h, side, level = (np.concatenate([x[i] for x in out]) for i in range(4))
            row = pa.array(r.row[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), rows.column("doc_id").take(row), rows.column("key").take(row), pa.array(r.number[ok].astype(np.int32)),
                 pa.array(side.astype(np.int8)), pa.array(level.astype(np.int8))], ["h", "doc_id", "key", "number", "side", "level"])

    return texts.mapInArrow(run, f"h long, doc_id {kind}, key long, number int, side byte, level byte")


def _starts(rows: pa.RecordBatch, runs: Runs) -> np.ndarray:
    """Starts of the runs in the column `limits` (number, left, right) that reach no further than these from their anchor."""
    lists = rows.column("limits")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    number, left, right = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    place = np.searchsorted(runs.row, row) + number
    low = np.maximum(runs.low[place], runs.place[place] - left)
    high = np.minimum(runs.high[place], runs.place[place] + ANCHOR + right - LENGTH)
    size = np.maximum(high - low + 1, 0)
    return np.sort(np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum()))


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, anchor, content hash and number of the runs of all texts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches, most=PIECE):
            r = Runs(data, at)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(r.row)), pa.array(r.anchor.view(np.int64)), pa.array(r.content.view(np.int64)),
                 pa.array(r.number.astype(np.int32))], ["doc_id", "anchor", "content", "number"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, anchor long, content long, number int")


def _windows(texts: DataFrame, counted: bool) -> DataFrame:
    """Hashes (h1, h2) of the strings in runs that are to be compared: with their number per task, or with their places."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches, most=PIECE):
            r = Runs(data, at)
            starts = _starts(rows, r)
            if counted:
                starts, n = Suffixes(data, r.prefix, r.back).classes(starts) if len(starts) else (starts, starts)
                h1, h2 = _window_hashes(data, r, starts)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(n.astype(np.int64))], ["h1", "h2", "n"])
            else:
                h1, h2 = _window_hashes(data, r, starts)
                row = np.searchsorted(at, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), rows.column("doc_id").take(pa.array(row)), rows.column("key").take(pa.array(row)),
                     pa.array((starts - at[row]).astype(np.int32))], ["h1", "h2", "doc_id", "key", "start"])

    schema = "h1 long, h2 long, n long" if counted else f"h1 long, h2 long, doc_id {kind}, key long, start int"
    return texts.mapInArrow(run, schema)


# What is known of a run: all its strings repeat; they do, and it stands for its copies in comparisons; none is known to.
WHOLE, SHARED, SINGLE = 1, 2, 3


def _null_safe(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a[left].eqNullSafe(b[right])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) without bytes of any string of LENGTH bytes that
    starts more than once in the corpus.

    Every string belongs to a run of neighbouring starts with a common anchor (see `Runs`), one run for some 80 bytes.
    1. Anchors that occur once are done: their strings are unique. Counts and least and greatest content hash of each
       anchor come from one aggregation with sums per task.
    2. Runs whose whole content occurs again are removed whole. Where an anchor has different contents, hashes of the anchor
       extended to some lengths on either side tell how far any other occurrence can agree. Only strings within that
       reach are left: tasks sort these as suffixes (`Suffixes`), so that equal ones become one row with a number, and the
       numbers meet by a 128-bit hash.
    3. Texts that have any such run travel once to their runs, and once to the strings found.

    The result is exact but for collisions of hashes: 64 bits among runs of one anchor, 128 among strings. Strings are judged
    on the input. Null and empty texts have 0 bytes; strings never cross texts; rows that repeat a doc_id and text repeat
    each other's strings; an empty table gives none; other columns are ignored. A text takes some 100 times its size
    in memory while its task works on it. kept_text replaces bytes that a cut left without their character.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    runs = written(find_runs(rows), "runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("z"))
    # a table, so that the join's hot anchors can be split: an aggregate in the join's own stage would prevent it
    anchors = written(anchors.where("n > 1").select("anchor", (F.col("a") != F.col("z")).alias("mixed")), "anchors")
    found = written(runs.join(anchors, "anchor"), "repeated-anchors")
    discard(runs, anchors)
    mixed = found.where("mixed")
    token = F.xxhash64("doc_id", "number", "anchor", "content")
    contents = mixed.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(token).alias("first"))
    again = written(contents.where("n > 1").drop("n"), "contents")
    state = F.when(F.col("first").isNull(), SINGLE).when(F.col("first") == token, SHARED).otherwise(WHOLE)
    judged = mixed.join(again, ["anchor", "content"], "left").select("doc_id", "anchor", "number", state.alias("state"))
    judged = judged.unionByName(found.where("not mixed").select("doc_id", "anchor", "number", F.lit(WHOLE).alias("state")))
    listed = judged.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "number", "state")).alias("runs")).withColumnRenamed("doc_id", "_id")

    joined = rows.join(listed, _null_safe(rows, listed, "doc_id", "_id"), "left")
    some = F.col("runs").isNotNull()
    texts = written(joined.select("doc_id", "runs", F.when(some, F.xxhash64("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"),
                                  F.when(~some, F.sha2("text", 256)).alias("sha"), F.when(some, F.col("text")).alias("text")), "texts")
    discard(found, again)
    open_texts = texts.where(F.exists("runs", lambda r: r["state"].isin(SINGLE, SHARED)))
    shared = written(_extensions(open_texts), "extensions")
    agreed = shared.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    beyond = F.array(*map(F.lit, [n - 1 for n in LEVELS] + [LEVELS[-1]]))  # less than the first length that nobody shares

    def reach(side: int) -> Column:
        return F.element_at(beyond, F.coalesce(F.max(F.when(F.col("side") == side, F.col("level").cast("int"))), F.lit(-1)) + 2)

    limits = (shared.join(agreed, "h").groupBy("doc_id", "key", "number").agg(reach(0).alias("left"), reach(1).alias("right"))
              .where(F.col("left") + F.col("right") >= LENGTH - ANCHOR)
              .groupBy("doc_id", "key").agg(F.collect_list(F.struct("number", "left", "right")).alias("limits"))
              .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "limits"))
    open_texts = open_texts.select("doc_id", "key", "text")
    open_texts = written(open_texts.join(limits, _null_safe(open_texts, limits, "doc_id", "_id") & _null_safe(open_texts, limits, "key", "_key"))
                         .select("doc_id", "key", "text", "limits"), "open-texts")
    discard(shared)
    twice = written(_windows(open_texts, True).groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2"), "strings")
    places = (_windows(open_texts, False).join(twice, ["h1", "h2"]).groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
              .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "starts"))
    places = written(places, "places")  # before the texts are shuffled, so that the places of all strings aren't kept beside them
    discard(open_texts, twice)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches, most=PIECE):
            r = Runs(data, at)
            change = np.zeros(len(data) + 1, np.int64)
            whole = _chosen(rows, r, (WHOLE, SHARED))
            np.add.at(change, r.low[whole], 1)
            np.add.at(change, r.high[whole] + LENGTH, -1)
            lists = rows.column("starts")
            n = lists.value_lengths().fill_null(0).to_numpy()
            starts = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(at[:-1], n)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + LENGTH, -1)
            gone = np.append(np.cumsum(change)[:-1] > 0, False)
            total = np.append(0, np.cumsum(gone))
            edges = gone & ~np.append(False, gone[:-1])
            edges[at[:-1]] |= gone[at[:-1]]
            spans = np.append(0, np.cumsum(edges[:len(data)]))
            kept, sha = [], []
            for a, b, old in zip(at[:-1], at[1:], rows.column("sha").to_pylist()):
                left = data[a:b][~gone[a:b]].tobytes()
                sha.append(old or hashlib.sha256(left).hexdigest())
                kept.append(left.decode(errors="replace") if not old else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_bytes"), pa.array(total[at[1:]] - total[at[:-1]]), pa.array(spans[at[1:]] - spans[at[:-1]]),
                 pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    last = texts.join(places, _null_safe(texts, places, "doc_id", "_id") & _null_safe(texts, places, "key", "_key"), "left")
    return last.select("doc_id", "n_bytes", "sha", "text", "runs", "starts").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
