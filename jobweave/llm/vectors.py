"""Vector code compression: codebooks for the parts of vectors, refined with bounds on the norm of summed displacements."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.session import discard, written

# Components become floor(SCALE * x), and are held to 2 ** LIMIT_BITS in size so that every distance fits in 64 bits.
SCALE, LIMIT_BITS = 1024, 24
# Entries of a codebook are bounded in groups of this size.
GROUP = 32
# Bytes of vectors that a task handles at once.
PIECE_BYTES = 4 << 20


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries (whole numbers)."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every sum below is then exact in floating point
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
        return d.astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = ((x - entry) ** 2).sum(1)
    return out


class Rounds:
    """The codebooks of one part position, one per round, and how far entries have moved between any round and the last.

    A bound is a distance with the stamp of the round it was measured in. Between then and now an entry has moved by the
    norm of the sum of its steps, which the kept codebooks give as one difference; the sum of the steps' norms, that
    drifting bounds add up, is never less.
    """

    def __init__(self, history: np.ndarray):
        self.entries = history[-1]
        k = len(self.entries)
        self.groups = [(b, min(b + GROUP, k)) for b in range(0, k, GROUP)]
        self.moved = np.sqrt(((history - self.entries) ** 2).sum(2).astype(np.float64))  # (round, entry)
        shape = len(history), len(self.groups)
        # of each group: the entry that moved most since each round, its way, and the longest way of the others
        self.mover, self.most, self.others = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
        for g, (a, b) in enumerate(self.groups):
            self.mover[:, g] = a + self.moved[:, a:b].argmax(1)
            ordered = np.sort(self.moved[:, a:b], 1)
            self.most[:, g] = ordered[:, -1]
            self.others[:, g] = ordered[:, -2] if b - a > 1 else 0


def assign(x: np.ndarray, rounds: Rounds, now: int, code, near, near_round, far, far_round) -> int:
    """Bring one part's assignment up to round `now`, in place; the number of distances that had to be computed.

    Of each row: `code` the nearest entry, `near` the exact squared distance to it as of `near_round`; of each group of
    entries `far`, the exact squared distance to the nearest of its other entries as of `far_round`. A group is passed over
    while its bound lies strictly above the distance to the row's entry; ties go to the lower index.
    """
    n, groups, computed = len(x), rounds.groups, 0
    own = code // GROUP
    if now:
        lowest = np.sqrt(far.astype(np.float64)) - np.where(
            rounds.mover[far_round, np.arange(len(groups))] == code[:, None],
            rounds.others[far_round, np.arange(len(groups))], rounds.most[far_round, np.arange(len(groups))])
        lowest = lowest * (1 - 1e-9) - 1e-6  # rounding never makes a bound hold
        upper = (np.sqrt(near.astype(np.float64)) + rounds.moved[near_round, code]) * (1 + 1e-9)
        todo = np.flatnonzero((upper[:, None] >= lowest).any(1))
        near[todo] = ((x[todo] - rounds.entries[code[todo]]) ** 2).sum(1)
        near_round[todo], computed = now, len(todo)
        open_ = np.sqrt(near[todo].astype(np.float64))[:, None] * (1 + 1e-9) >= lowest[todo]
        todo, open_ = todo[open_.any(1)], open_[open_.any(1)]
        open_[np.arange(len(todo)), own[todo]] = True
    else:
        todo, open_ = np.arange(n), np.ones((n, len(groups)), bool)
    if not len(todo):
        return computed
    huge = np.iinfo(np.int64).max
    first, place, second = (np.full((len(todo), len(groups)), huge) for _ in range(3))
    for g, (a, b) in enumerate(groups):
        r = np.flatnonzero(open_[:, g])
        if len(r):
            d = distances(x[todo[r]], rounds.entries[a:b])
            at = d.argmin(1)
            first[r, g], place[r, g] = d[np.arange(len(r)), at], a + at
            d[np.arange(len(r)), at] = huge
            second[r, g] = d.min(1)
            computed += d.size
    best = first.argmin(1)  # groups are in order of index, so the first is the lowest
    each = np.arange(len(todo))
    code[todo], near[todo], near_round[todo] = place[each, best], first[each, best], now
    first[each, best] = second[each, best]
    far[todo] = np.where(open_, first, far[todo])
    far_round[todo] = np.where(open_, now, far_round[todo])
    return computed


def _whole(embeddings: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, whole-number vector of the rows that are kept, all vectors filled up to one length that the parts divide."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = F.lit(float(1 << LIMIT_BITS))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, -limit), limit)).cast("int"))
    return embeddings.where(sound).select(F.col(key).alias("id"), F.col(label).alias("label"), whole.alias("vector"))


def _first_codebooks(kept: DataFrame, parts: int, size: int, width: int) -> np.ndarray:
    """The parts of the vectors with the `size` smallest ids, as (part, entry, component); a null id is the largest.

    Where rows share an id, the smallest vector counts.
    """
    ids = kept.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(size)
    last = ids.collect()
    given = [r["id"] for r in last if r["id"] is not None]
    chosen = F.col("id") <= F.lit(given[-1]) if given else F.lit(False)
    if len(given) < len(last):
        chosen = chosen | F.col("id").isNull()
    rows = (kept.where(chosen).groupBy("id").agg(F.min("vector").alias("vector"))
            .orderBy(F.col("id").asc_nulls_last()).limit(size).collect())  # of at most `size` vectors
    out = np.zeros((len(rows), width), np.int64)
    for row, r in zip(out, rows):
        row[:len(r["vector"])] = r["vector"]
    return out.reshape(len(rows), parts, width // parts).transpose(1, 0, 2)


def _batches(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        step = max(1, PIECE_BYTES // (8 * max(width, 1)))
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)


def _matrix(column: pa.Array, rows: int, kind, *shape: int) -> np.ndarray:
    """Binary values of equal length as one array, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, *shape).copy()


def _filled(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of one length, filled up with zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), np.int32)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _binary(values: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def compress(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
             entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors and the final codebooks (part, entry, component).

    Rows: id, label, code (binary, an entry's index per part), error (squared distance to what the code stands for).

    Components become floor(1024 x) and vectors are cut into `parts` equal parts. The codebook of a part position starts
    with the parts of the vectors with the smallest ids; in each round all parts go to their nearest entry, and entries
    become the floor of their parts' mean; then parts are assigned once more. Every row keeps its bounds with the round they
    were measured in (`assign`), so later rounds compute distances only to groups of entries that may have come nearer.
    Rows and bounds are a table in the shared folder per round; the one before is deleted once the next is written. Sums
    are added up in tasks, then by entry, so that only codebooks (parts x entries) reach the driver.

    Vectors that are null or hold null or non-finite components are dropped. Shorter vectors, and such as the parts don't
    divide, are filled up with zeros; components beyond 2 ** 24 after scaling count as 2 ** 24. Ties go to the lower index;
    equal vectors get equal codes; a null id sorts last and a null label stays; an empty table gives none; other columns
    are ignored. Codebooks in tasks grow with `entries` x width x rounds.
    """
    assert entries <= 256, "a code is one byte per part"
    kept = _whole(embeddings, key, vector, label)
    kind = dict(kept.dtypes)
    head = f"id {kind['id']}, label {kind['label']}"
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    width = -(-(longest or 0) // parts) * parts or parts
    history = _first_codebooks(kept, parts, entries, width)[None]  # (round, part, entry, component)
    per = width // parts
    n_groups = -(-history.shape[2] // GROUP)
    if not history.shape[2]:
        return kept.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), history[-1]

    size = history.shape[2]
    state = [("code", "u1", ()), ("near", "i8", ()), ("near_round", "u1", ()), ("far", "i8", (n_groups,)), ("far_round", "u1", (n_groups,))]
    plain = f"{head}, code binary, error long"

    def brought_up(now: int, history: np.ndarray):
        """A task that assigns all parts as of round `now`: rows with their bounds, or with their errors after the last round."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = [Rounds(history[:, p]) for p in range(parts)]
            for rows in _batches(batches, width):
                n = rows.num_rows
                if now:
                    x = _matrix(rows.column("vector"), n, "i4", width)
                    own = [_matrix(rows.column(name), n, t, parts, *shape).astype(np.int64) for name, t, shape in state]
                else:
                    x = _filled(rows.column("vector"), width)
                    own = [np.zeros((n, parts, *shape), np.int64) for _, _, shape in state]
                error = np.zeros(n, np.int64)
                for p, book in enumerate(books):
                    part = x[:, p * per:(p + 1) * per].astype(np.int64)
                    assign(part, book, now, *(s[:, p] for s in own))
                    if now == rounds:
                        error += ((part - book.entries[own[0][:, p]]) ** 2).sum(1)
                packed = [_binary(s.astype(t).reshape(n, -1)) for s, (_, t, _) in zip(own, state)]
                if now == rounds:
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), packed[0], pa.array(error)],
                                                     ["id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), _binary(x), *packed],
                                                     ["id", "label", "vector", *(name for name, _, _ in state)])
        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, size, per + 1), np.int64)
        for rows in _batches(batches, width):
            n = rows.num_rows
            x, code = _matrix(rows.column("vector"), n, "i4", parts, per), _matrix(rows.column("code"), n, "u1", parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, begin = np.unique(code[order, p], return_index=True)
                total[p, used, :per] += np.add.reduceat(x[order, p].astype(np.int64), begin)
                total[p, used, per] += np.diff(np.append(begin, n))
        places = np.flatnonzero(np.repeat(total[..., per] > 0, per + 1))
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.ravel()[places])], ["place", "total"])

    bounded = f"{head}, vector binary, " + ", ".join(f"{name} binary" for name, _, _ in state)
    table = written(kept.mapInArrow(brought_up(0, history), bounded if rounds else plain), "vector-rounds")
    for now in range(1, rounds + 1):
        added = table.select("vector", "code").mapInArrow(sums, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
        total = np.zeros(parts * size * (per + 1), np.int64)
        for r in added.collect():  # one row per component of the codebooks
            total[r["place"]] = r["total"]
        total = total.reshape(parts, size, per + 1)
        count = total[..., per:]
        history = np.concatenate([history, np.where(count > 0, total[..., :per] // np.maximum(count, 1), history[-1])[None]])
        before, table = table, written(table.mapInArrow(brought_up(now, history), bounded if now < rounds else plain), "vector-rounds")
        discard(before)
    return table, history[-1]


def decode(code: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The whole-number vectors that codes (a row of indexes each) stand for."""
    return np.concatenate([codebooks[p][code[:, p]] for p in range(len(codebooks))], 1)


def codebooks_hash(codebooks: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def code_report(embeddings: DataFrame, **options) -> DataFrame:
    """vec_id, code in hex, error, error summed over the rows of equal label, and the hash of all codebooks."""
    rows, codebooks = compress(embeddings, **options)
    per_label = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = rows.join(per_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
                         F.lit(codebooks_hash(codebooks)).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same in SQL, by all distances in every round."""
    def assigned(n: int) -> str:
        return f"""near{n} AS MATERIALIZED (
  SELECT v.vec_id, v.label, v.p, v.x, min({{'d': list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))), 'e': b.e}}) AS best
  FROM split v JOIN book{n} b ON v.p = b.p GROUP BY ALL)"""

    def moved(n: int) -> str:
        return f"""book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN (
    SELECT p, e, list(mean ORDER BY i) AS x FROM (
      SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS mean FROM near{n}, range(1, len(x) + 1) AS r(i) GROUP BY ALL) GROUP BY p, e) m
  ON b.p = m.p AND b.e = m.e)"""

    steps = [s for n in range(rounds) for s in (assigned(n), moved(n))] + [assigned(rounds)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
split AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS r(p)),
book0 AS MATERIALIZED (SELECT * FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM split) WHERE e < {entries}),
{", ".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""
