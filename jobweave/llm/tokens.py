"""Token ids and counts of a public byte-level BPE vocabulary, by array merging."""
from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from jobweave.llm.text import BASE, inverse_powers, mix, pieces, prefix_hashes, stretch_hashes

_NONE = np.int32(2 ** 31 - 1)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

# White space of the pre-tokenizer's pattern, and the endings it cuts off after an apostrophe.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[_WHITE] = SPACE
    return out


def pre_tokens(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts given as code points with offsets; each ends where the next one starts.

    The rules are those of the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    edge = at[(at > 0) & (at < n)]
    begin[edge] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    last = np.zeros(n + 1, bool)
    last[at] = True
    white = kind[starts] == SPACE
    inner = starts[white & ~last[ends]], ends[white & ~last[ends]]  # white space before something of the same text
    begin[inner[1] - 1] = True                      # its last character stands apart
    joined = points[inner[1] - 1] == 32
    begin[inner[1][joined]] = False                 # and a blank goes to what follows
    quote = np.flatnonzero((points == 39) & begin)  # an apostrophe that a token starts with
    if len(quote):
        padded = np.append(points, [0, 0, 0])
        inside = np.searchsorted(at, quote, "right")
        left = at[np.minimum(inside, len(at) - 1)] - quote
        done = np.zeros(len(quote), bool)
        for ending in _ENDINGS:
            hit = ~done & (left > len(ending))
            for j, c in enumerate(ending):
                hit &= padded[quote + 1 + j] == ord(c)
            q = quote[hit]
            begin[q + 1] = False
            stop = q + 1 + len(ending)
            after = stop[stop < n]
            # what is left of the letters starts a token of its own
            begin[after] |= kind[after] == LETTER
            done |= hit
    return np.flatnonzero(begin)


class Merger:
    """The vocabulary as arrays: byte ids, and the merges sorted by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        shown = _byte_letters()
        self.of_byte = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.known, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; `_NONE` where they never merge."""
        key = (left.astype(np.int64) << 20) | right
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[i] == key, self.rank[i], _NONE)

    def merge(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All sequences at once: in each round every sequence merges its lowest-ranked pair, from left to right.

        Sequences without a pair left go aside, so a round costs what is still at work.
        """
        n = len(at) - 1
        out, lengths, done = [], np.zeros(n, np.int64), []
        seq = np.repeat(np.arange(n), np.diff(at))
        rank = np.full(len(ids), _NONE, np.int32)
        same = np.flatnonzero(seq[1:] == seq[:-1])
        rank[same] = self.ranks(ids[same], ids[same + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            size = np.diff(np.append(first, len(ids)))
            low = np.minimum.reduceat(rank, first)
            over = low == _NONE
            if over.any():
                gone = np.repeat(over, size)
                out.append(ids[gone])
                done.append(seq[first[over]])
                lengths[seq[first[over]]] = size[over]
                ids, seq, rank = ids[~gone], seq[~gone], rank[~gone]
                low, size = low[~over], size[~over]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, size)
            at_hit = np.flatnonzero(hit)
            # of overlapping pairs (a a a) every second one merges, counted from the left of their run
            run = np.append(True, np.diff(at_hit) != 1)
            head = np.maximum.accumulate(np.where(run, np.arange(len(at_hit)), 0))
            at_hit = at_hit[(np.arange(len(at_hit)) - head) % 2 == 0]
            ids[at_hit] = self.made[rank[at_hit]]
            keep = np.ones(len(ids), bool)
            keep[at_hit + 1] = False
            moved = np.cumsum(keep) - 1
            ids, seq, rank = ids[keep], seq[keep], rank[keep]
            new = moved[at_hit]
            for place in (new, new[new > 0] - 1):
                ok = place + 1 < len(ids)
                rank[place[~ok]] = _NONE
                place = place[ok]
                here = seq[place] == seq[place + 1]
                rank[place] = np.where(here, self.ranks(ids[place], ids[place + 1]), _NONE)
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        order = np.concatenate(done) if done else np.zeros(0, np.int64)
        began = np.zeros(n, np.int64)
        began[order] = np.cumsum(lengths[order]) - lengths[order]
        ends = np.cumsum(lengths)
        pick = np.arange(ends[-1] if n else 0) - np.repeat(ends - lengths, lengths) + np.repeat(began, lengths)
        return flat[pick], np.append(0, ends)

    def distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Places in the table of known pre-tokens; new ones are merged and added. `key`: a hash of each."""
        if len(self.known) > 1 << 20:  # only a cache: it starts anew before it grows large
            self.known, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)
        code, unique = pd.factorize(key)
        first = np.zeros(len(unique), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        sort = np.argsort(self.known, kind="stable")
        place = np.minimum(np.searchsorted(self.known, unique, sorter=sort), max(len(self.known) - 1, 0))
        found = self.known[sort[place]] == unique if len(self.known) else np.zeros(len(unique), bool)
        out = np.empty(len(unique), np.int64)
        if len(self.known):
            out[found] = sort[place[found]]
        new = first[~found]
        size = end[new] - start[new]
        ends = np.cumsum(size)
        pick = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start[new], size)
        ids, at = self.merge(self.of_byte[data[pick]], np.append(0, ends))
        out[~found] = len(self.known) + np.arange(len(new))
        self.known = np.concatenate([self.known, unique[~found]])
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
        self.ids = np.concatenate([self.ids, ids])
        return out[code]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts given as UTF-8 with offsets, and the offsets of each text's ids."""
        place, row = self._words(data, at)
        size = self.at[place + 1] - self.at[place]
        ends = np.cumsum(size)
        pick = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.at[place], size)
        per_row = np.bincount(row, weights=size, minlength=len(at) - 1).astype(np.int64)
        return self.ids[pick], np.append(0, np.cumsum(per_row))

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        place, row = self._words(data, at)
        return np.bincount(row, weights=self.at[place + 1] - self.at[place], minlength=len(at) - 1).astype(np.int64)

    def _words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pre-tokens in the table, and their rows. A special token's string is one token by itself."""
        raw = data.tobytes()
        marks = []
        for text, number in self.special.items():
            mark, i = text.encode(), raw.find(text.encode())
            while i >= 0:
                if at[np.searchsorted(at, i, "right")] >= i + len(mark):
                    marks.append((i, i + len(mark), number))
                i = raw.find(mark, i + 1 if at[np.searchsorted(at, i, "right")] < i + len(mark) else i + len(mark))
        marks.sort()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte at which each code point starts
        cuts = np.unique(np.concatenate([at, *([a, b] for a, b, _ in marks)])).astype(np.int64)
        begin = np.append(lead, len(data))[pre_tokens(points, np.searchsorted(lead, cuts))]
        end = np.append(begin[1:], len(data))
        key = mix(stretch_hashes(prefix_hashes(data), inverse_powers(len(data) + 1), begin, end) + (end - begin).astype(np.uint64))
        if not marks:
            return self.distinct(data, begin, end, key), np.searchsorted(at, begin, "right") - 1
        # inside a mark only its first pre-token counts, and it stands for the special id
        which = np.searchsorted([a for a, _, _ in marks], begin, "right") - 1
        inside = (which >= 0) & (begin < np.array([b for _, b, _ in marks])[which])
        plain = ~inside
        place = np.empty(len(begin), np.int64)
        place[plain] = self.distinct(data, begin[plain], end[plain], key[plain])
        heads = np.isin(begin, [a for a, _, _ in marks])
        for number in {m[2] for m in marks}:
            self.known = np.append(self.known, np.uint64(2 ** 64 - 1 - number))
            self.at = np.append(self.at, self.at[-1] + 1)
            self.ids = np.append(self.ids, np.int32(number))
            of = np.array([a for a, _, x in marks if x == number])
            place[np.isin(begin, of)] = len(self.known) - 1
        used = plain | heads
        return place[used], np.searchsorted(at, begin[used], "right") - 1


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(other.get(b, b)) for b in range(256)]


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    """The vocabulary of a file, read once per Python worker."""
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Rows with the number of tokens of their whole text, as the vocabulary's own library counts them.

    Adds n_bytes, n_tokens (long) and over_limit (more than `limit` tokens); a column of that name is replaced, others
    stay. No shuffle: every task merges the distinct pre-tokens of its texts as ragged arrays and sums per text. Null and
    empty texts have 0 tokens. Equal rows get equal counts; an empty table gives an empty result. The cost of one unbroken
    word grows with its length times its distinct merges, and its memory with its length.
    """
    kept = docs.select([c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")])
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for rows, data, at in pieces(batches, text):
            n = m.count(data, at)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)],
                [*rows.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return kept.mapInArrow(run, schema + ", n_bytes long, n_tokens long, over_limit boolean")
