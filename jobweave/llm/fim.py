"""Fill-in-middle transformation: texts cut at hashed places, found by a learned index of code point offsets."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.text import pieces

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Of 100 texts, how many are transformed, and how many of those give the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


class RankIndex:
    """Offsets by rank as line segments and residuals.

    Segment s predicts the offset of rank r as floor(base + slope x (r - first rank of s)), at most `error` off; what is
    missing is stored in one byte per rank, so every offset comes back exactly. Segments are as long as the bound lets
    them be: with lines through its first point, a segment ends where the steepest lower and the flattest upper limit of
    the slope cross. Limits are running extrema over a stretch that doubles until they cross.
    """

    def __init__(self, offsets: np.ndarray, error: int = 63, stretch: int = 1024):
        n, self.first, self.base, self.slope = len(offsets), [], [], []
        self.residual = np.empty(n, np.int8)
        begin = 0
        while begin < n:
            size = stretch
            while True:
                end = min(begin + size, n)
                step = np.arange(1, end - begin, dtype=np.float64)
                rise = (offsets[begin + 1:end] - offsets[begin]).astype(np.float64)
                low = np.maximum.accumulate((rise - error + 1) / step)  # one less than the bound, for rounding
                high = np.minimum.accumulate((rise + error - 1) / step)
                crossed = np.flatnonzero(low > high)
                if len(crossed) or end == n:
                    break
                size *= 2
            last = int(crossed[0]) if len(crossed) else len(step)  # ranks after the first that the line serves
            slope = float((low[last - 1] + high[last - 1]) / 2) if last else 0.0
            predicted = offsets[begin] + np.floor(slope * np.arange(last + 1))
            self.residual[begin:begin + last + 1] = offsets[begin:begin + last + 1] - predicted.astype(np.int64)
            self.first.append(begin)
            self.base.append(int(offsets[begin]))
            self.slope.append(slope)
            begin += last + 1
        self.first = np.array(self.first, np.int64)
        self.base, self.slope = np.array(self.base, np.int64), np.array(self.slope, np.float64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The offset of each rank: predicted by its segment, then corrected."""
        s = np.searchsorted(self.first, ranks, "right") - 1
        predicted = self.base[s] + np.floor(self.slope[s] * (ranks - self.first[s])).astype(np.int64)
        return predicted + self.residual[ranks]


def draws(doc_id, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the id and the seed only."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def _arranged(text: bytes, form: str, first: int, second: int) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    head = p + prefix + s + suffix if form == "psm" else s + suffix + p + prefix
    return head + m + middle


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, transformed: int = TRANSFORMED,
                   suffix_first: int = SUFFIX_FIRST, error: int = 63) -> DataFrame:
    """Rows of `docs` with n (code points of the text), form, prefix_chars, middle_chars and output.

    A hash of seed and id draws two cuts between code points, whether the text is transformed (`transformed` of 100), and
    whether its suffix comes first (`suffix_first` of 100 of those). Forms: `psm` is prefix, suffix, middle, each behind
    its mark; `spm` is suffix, prefix, middle; `plain` is the text itself, for texts that are empty, hold a mark or are
    drawn out. `restored` gives the text back.

    The offsets of all code points of a piece of texts go into one `RankIndex`, which then gives the byte of every cut.
    Whole texts, no shuffle. A null text counts as empty, a null id as an empty one; rows of equal id are cut by the same
    draws, equal rows alike; an empty table gives none; columns with the names of results are replaced, others stay. A
    very long text is a piece of its own and takes some 40 times its size in memory.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = docs.select([c for c in docs.columns if c.lower() not in new or c in (text, key)])
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches, text, 1 << 20):
            starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the boundaries between code points
            rank = np.searchsorted(starts, at)  # of each text's begin, and of the end
            n = np.diff(rank)
            drawn = np.array([draws(i, seed) for i in rows.column(key).to_pylist()], np.int64).reshape(-1, 4)
            cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], 1)
            byte = RankIndex(starts, error).offsets((rank[:-1, None] + cuts).ravel()).reshape(-1, 2)
            raw, forms, outputs = data.tobytes(), [], []
            for i in range(len(n)):
                own = raw[at[i]:at[i + 1]]
                plain = not own or drawn[i, 2] % 100 >= transformed or any(m in own for m in marks)
                forms.append("plain" if plain else "spm" if drawn[i, 3] % 100 < suffix_first else "psm")
                outputs.append(_arranged(own, forms[-1], int(byte[i, 0] - at[i]), int(byte[i, 1] - at[i])))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(n.astype(np.int64)), pa.array(forms, pa.string()),
                 pa.array(cuts[:, 0], mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], mask=plain),
                 pa.array(outputs, pa.binary()).cast(pa.string())], [*rows.schema.names, *new])

    return kept.mapInArrow(run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # the first part is empty
    first, second = F.get(part, F.lit(1)), F.get(part, F.lit(2))
    return (F.when(form == "psm", F.concat(first, F.get(part, F.lit(3)), second))
            .when(form == "spm", F.concat(second, F.get(part, F.lit(3)), first)).otherwise(output))


ORACLE = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {TRANSFORMED} THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, least(a, b) AS p, greatest(a, b) - least(a, b) AS m, substr(t, 1, least(a, b)) AS prefix,
         substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(t, greatest(a, b) + 1) AS suffix FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
