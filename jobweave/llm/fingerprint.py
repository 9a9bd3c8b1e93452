"""Document fingerprints by one-permutation MinHash."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.session import written

# Bins (a power of two), and the low bits kept of each bin's minimum: 128 x 4 bits are 8 longs, 128 hex digits.
BINS, BITS = 128, 4
PER_LONG = 64 // BITS
WIDTH = 5
# Probes of an empty bin before all bins are listed in its order.
PROBES = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column) -> Column:
    """Hashes of the word shingles; of all words as one shingle if they are fewer; none without words."""
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(w, i, WIDTH)))
        return F.when(F.size(w) >= WIDTH, each).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    return _let(words, of)


def _let(value: Column, body) -> Column:
    """The body's result with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _bin(h: Column) -> Column:
    """Bin by the highest bits, in the order in which signed numbers sort."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-2 ** 63)), 64 - BINS.bit_length() + 1)


def minima(hashes: Column) -> Column:
    """The least hash of each bin; an empty bin takes that of the first bin with one in the bin's own probing order.

    The order runs through all bins from a start and in odd steps that are hashes of the empty bin's number, so every
    document with the same filled bins probes alike.
    """
    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def spread(own: Column) -> Column:
        def laid(bins: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(own, F.array_position(bins, b.cast("long")).cast("int") - 1))
        return _let(F.transform(own, _bin), laid)

    def filled(dense: Column) -> Column:
        def probe(b: Column, tries: int) -> Column:
            seed = F.xxhash64(b)
            start, stride = F.pmod(seed, F.lit(BINS)).cast("int"), F.pmod(F.shiftright(seed, 20), F.lit(BINS)).cast("int").bitwiseOR(F.lit(1))
            seen = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.get(dense, F.pmod(start + t * stride, F.lit(BINS))))
            return F.get(F.filter(seen, lambda x: x.isNotNull()), F.lit(0))
        return F.transform(dense, lambda x, b: F.coalesce(x, probe(b, PROBES), probe(b, BINS)))

    def dense(own: Column) -> Column:
        return F.when(F.size(own) == BINS, own).when(F.size(own) > 0, _let(spread(own), filled))

    return _let(_let(F.sort_array(hashes), firsts), dense)


def packed(least: Column) -> Column:
    """The low bits of the minima, packed into longs.

    The bits are those of a hash with the bin's number: bins filled by the same minimum then agree or differ by chance each
    on its own, as the correction for chance supposes.
    """
    own = F.transform(least, lambda x, b: F.xxhash64(x, b))
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda k: F.aggregate(
        F.slice(own, k * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"),
        lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit(2 ** BITS - 1)))))


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text, array<long>; null if it has no word."""
    return _let(minima(shingle_hashes(text)), lambda least: F.when(least.isNotNull(), packed(least)))


def shown(sig: Column) -> Column:
    """A fingerprint as hex digits, one for each bin; empty without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(x: Column, y: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1: the share of equal bins, less what agrees by chance.

    Two documents without words are alike, one without and one with words are not.
    """
    mask = F.lit(sum(1 << (BITS * k) for k in range(PER_LONG)))

    def unequal(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(mask))

    chance = 2.0 ** -BITS
    same = 1 - F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda s, n: s + n) / BINS
    known = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(x.isNotNull() & y.isNotNull(), known).otherwise(F.when(x.isNull() & y.isNull(), 1.0).otherwise(0.0))


def neighbours(rows: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, hash, n) with next_id, next_hash, prev_id, prev_hash and prev_n, in a ring by (doc_id, hash).

    A range sort gives parts, windows work inside them, and the parts' ends meet in a table of one row per part.
    """
    one = F.struct("doc_id", "hash", "n")
    sort = ["doc_id", "hash"]
    parts = written(rows.distinct().repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()), "order")
    ends = parts.groupBy("part").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    along, ring = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(ring)).alias("after"),
                       F.coalesce(F.lag("last").over(along), F.last("last").over(ring)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*sort)
    linked = parts.withColumn("next", F.lead(one).over(inside)).withColumn("prev", F.lag(one).over(inside)).join(ends, "part")
    after, before = F.coalesce("next", "after"), F.coalesce("prev", "before")
    return linked.select("doc_id", "hash", "n", after["doc_id"].alias("next_id"), after["hash"].alias("next_hash"),
                         before["doc_id"].alias("prev_id"), before["hash"].alias("prev_hash"), before["n"].alias("prev_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has its last quarter of code points replaced by the first as many of the next document by doc_id (the
    first one, after the last). A fingerprint hashes the 5-word shingles once, keeps the least hash of each of BINS bins,
    fills empty bins from filled ones, and packs their low BITS bits. Likeness corrects for bins that agree by chance.

    Each text is shuffled once, and a quarter of it to its neighbour; ids and lengths are sorted without texts. Null and
    empty texts have an empty fingerprint. A null doc_id comes first in the order; rows of one doc_id are ordered by a hash
    of their text, and rows that also have equal texts are one document with equal results on each row; a single document is
    its own next; an empty table gives none; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # both joins below read the same three columns by the same keys, so that Spark shuffles the texts once for the two
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    order = written(neighbours(rows.select("doc_id", "hash", F.length("text").alias("n"))), "neighbours")

    def same(a: DataFrame, b: DataFrame, id_b: str, hash_b: str) -> Column:
        return a["doc_id"].eqNullSafe(b[id_b]) & (a["hash"] == b[hash_b])

    to = order.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "prev_id", "prev_hash", "prev_n")
    gifts = (rows.join(to, same(rows, to, "_id", "_hash")).select("prev_id", "prev_hash", F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("gift"))
             .groupBy("prev_id", "prev_hash").agg(F.max("gift").alias("gift")))
    on = order.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "next_id", "next_hash")
    joined = rows.join(gifts, same(rows, gifts, "prev_id", "prev_hash"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), "gift")
    signed = written(joined.withColumn("edited", edited).select(
        "doc_id", "hash", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("sig"), fingerprint(F.col("edited")).alias("edited_sig")), "fingerprints")
    after = signed.dropDuplicates(["doc_id", "hash"]).select(F.col("doc_id").alias("n_id"), F.col("hash").alias("n_hash"), F.col("sig").alias("next_sig"))
    on = on.join(after, on["next_id"].eqNullSafe(after["n_id"]) & (on["next_hash"] == after["n_hash"]))
    return signed.join(on, same(signed, on, "_id", "_hash")).select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("sig")).alias("fingerprint"), shown(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
