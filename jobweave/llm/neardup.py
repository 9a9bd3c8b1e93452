"""Near duplicates by b-bit MinHash, with links confirmed on full shingle sets."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.graph import components
from jobweave.llm.text import BASE, mix, pieces, shingles
from jobweave.session import written

# Bands of ROWS minima each, and the low bits kept of each minimum. A pair of similarity 0.75 shares no band in 3 of
# ten million cases.
BANDS, ROWS, BITS = 40, 4, 2
HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64
# A pair whose estimate is below this is no link: six standard errors of the estimate below 0.75.
LEAST_ESTIMATE = 0.5
# One-bit minima of the long signatures, and the least estimate from them: almost five standard errors below 0.75.
LONG_HASHES, LEAST_LONG = 2048, 0.68
# Members of a bucket that are compared in one task with as many others.
BLOCK = 512

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the shingle set (s1, s2), packed low bits of the minima, band keys."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches):
            h, of = shingles(data, at)
            n, size = len(at) - 1, np.diff(of)
            some = np.flatnonzero(size)
            s = np.zeros((2, n), np.uint64)
            low = np.zeros((n, HASHES), np.uint64)
            if len(some):
                s[:, some] = np.add.reduceat(mix(h), of[some]), np.add.reduceat(mix(h ^ np.uint64(BASE)), of[some])
                for j, factor in enumerate(_FACTORS):
                    low[some, j] = np.minimum.reduceat(h * factor, of[some])
            keys = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for j in range(ROWS):
                keys = mix(keys * np.uint64(BASE) + low[:, j::ROWS])
            small = mix(low)  # the low bits of a scrambled minimum; the minimum itself has been picked by its high bits
            bits = np.packbits(np.stack([(small >> np.uint64(k)) & np.uint64(1) for k in range(BITS)], 2).astype(np.uint8).reshape(n, -1), axis=1)
            sig = bits.reshape(-1).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))
                     for w, x in ((LONGS, sig), (BANDS, np.ascontiguousarray(keys)))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size.astype(np.int64)), *map(pa.array, s.view(np.int64)), *lists],
                                             ["doc_id", "n_shingles", "s1", "s2", "sig", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id and its whole set of hashed shingles."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches):
            h, of = shingles(data, at)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(h.view(np.int64)))], ["id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {kind}, items array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two packed signatures: equal symbols by bit counts, less the share that agrees by chance."""
    symbols = 64 // BITS
    mask = F.lit(sum(1 << (BITS * k) for k in range(symbols)))

    def unequal(i: int) -> Column:
        d = x[i].bitwiseXOR(y[i])
        folded = reduce(lambda s, k: s.bitwiseOR(F.shiftrightunsigned(d, k)), range(1, BITS), d)
        return F.bit_count(folded.bitwiseAND(mask))

    same = 1 - reduce(add, [unequal(i) for i in range(LONGS)]) / HASHES
    return (same - 2.0 ** -BITS) / (1 - 2.0 ** -BITS)


def _linked(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: first by estimate, then by their full sets."""
    sig_a = signed.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    sig_b = signed.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    near = pairs.join(sig_a, "a").join(sig_b, "b").where(estimate(F.col("sig_a"), F.col("sig_b")) >= LEAST_ESTIMATE).select("a", "b")
    return _confirmed(near, sets, percent)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    full = (pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"))
    both = F.size(F.array_intersect("x", "y"))
    return full.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the component of their id, which is itself where it has no link."""
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _long_signatures(sets: DataFrame) -> DataFrame:
    """id and one low bit of each of LONG_HASHES minima, packed."""
    factors = mix(np.arange(10_001, 10_001 + LONG_HASHES, dtype=np.uint64)) | np.uint64(1)
    kind = dict(sets.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            h, size = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
            at = np.cumsum(size) - size
            bits = np.zeros((len(size), LONG_HASHES), np.uint8)
            for j, factor in enumerate(factors if len(h) else []):
                bits[:, j] = mix(np.minimum.reduceat(h * factor, at)) & np.uint64(1)
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "long"])

    return sets.where(F.size("items") > 0).mapInArrow(run, f"id {kind}, long binary")


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's members that lie in different components and may be linked by their long signatures.

    `rows` has band, members (the bucket's number of them), id, component, long and bands. A large bucket is split by a hash
    of the id, and each two of its parts meet in a task of their own, so that a task holds some 2 x BLOCK rows. A pair that
    shares several buckets comes out of the first one only.
    """
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("id"), parts).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "component", "long", "bands")
    kind = dict(rows.dtypes)["id"]

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sig = np.frombuffer(b"".join(table["long"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
        bands = pa.concat_arrays(table["bands"].chunks).flatten().to_numpy().reshape(table.num_rows, -1)
        code = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        part, here = table["part"].to_numpy(), table["band"][0].as_py()
        across = table["i"][0].as_py() != table["j"][0].as_py()
        a, b = [], []
        for x in range(table.num_rows if code.max() > 0 else 0):
            rest = np.arange(x + 1, table.num_rows)
            rest = rest[(code[rest] != code[x]) & ((part[rest] != part[x]) | (not across))]
            agree = 1 - np.bitwise_count(sig[rest] ^ sig[x]).sum(1) / LONG_HASHES
            rest = rest[2 * agree - 1 >= LEAST_LONG]
            rest = rest[bands[x][(bands[rest] == bands[x]).argmax(1)] == here] if len(rest) else rest
            a += [x] * len(rest)
            b += rest.tolist()
        ids = table["id"]
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    return rows.groupBy("band", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents whose sets of 5-word shingles have at least `percent` % of their union in common are linked; component_id
    is the smallest doc_id that links lead to, kept marks that document.

    1. Equal sets are one class, found by a 128-bit hash of the set; only its smallest doc_id goes on.
    2. Band keys of minima give buckets. Every member of a bucket is compared with its smallest id only, never with all:
       first by bit counts of the packed signatures, then on full sets. These links give first components.
    3. Buckets whose other members still lie in several components leave possible links unseen. Their members get long
       signatures and meet in tasks of bounded size that compare the packed bits of members of different components only;
       what may be a link is confirmed on full sets. A bucket's work here grows with the square of its members that
       step 2 has not brought together, spread over tasks; nothing is left out.

    Null and empty texts have no shingles and no links; a null doc_id cannot be named, so its row is linked with nothing,
    has a null component and is kept; rows that share a doc_id count as one document; other columns are ignored.
    """
    signed = written(sign(docs), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("id")), "classes")
    ones = written(real.withColumnRenamed("doc_id", "id").join(classes, ["s1", "s2", "id"]).dropDuplicates(["s1", "s2", "id"])
                   .select("id", "n_shingles", "sig", "bands"), "representatives")
    banded = ones.select("id", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("members")).where("members > 1").select("band", "head")
    members = written(banded.join(heads, "band").where("id <> head"), "buckets")
    involved = members.select("id").unionByName(members.select(F.col("head").alias("id"))).distinct()
    sets = written(shingle_sets(docs.join(involved.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")), "sets")

    links = written(_linked(members.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), ones, sets, percent), "pairs")
    # rows that share a doc_id but not a text tie their classes together
    owners = real.join(classes, ["s1", "s2"]).groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    several = owners.where("a <> z").select("doc_id", "a")
    tied = real.join(classes, ["s1", "s2"]).join(several, "doc_id").select("a", F.col("id").alias("b"))
    links = links.unionByName(tied)
    found = components(links)

    rows = _labelled(members, found)
    mixed = (rows.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("z"), F.count("*").alias("members"))
             .where("x <> z").select("band", "members"))
    rows = written(rows.join(mixed, "band").select("band", "members", "id", "component"), "mixed-buckets")
    rest = rows.select("id").distinct()
    long = written(_long_signatures(sets.join(rest, "id", "left_semi")).join(ones.select("id", "bands"), "id"), "long-signatures")
    more = _confirmed(_candidates(rows.join(long, "id")), sets, percent)
    found = components(written(links.unionByName(more), "pairs"))

    named = found.withColumnRenamed("component", "named")
    result = (signed.where("n_shingles > 0").join(classes, ["s1", "s2"], "left").join(named, "id", "left")
              .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("named", "id")).alias("component_id")))
    none = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE low AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM low),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c
  FROM items x JOIN items y ON x.item = y.item AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (n + m - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_id ON doc_id = a
"""
