"""Document fingerprints by a homomorphic multiset hash.

A document is a multiset of paragraphs (lines, and sentences in them).  Each
paragraph hashes to a wide vector, and a document's vector is their sum, lane by
lane modulo powers of two: order does not count, and a paragraph is inserted or
deleted by adding or subtracting its vector.  ``DENSE`` lanes get a hash of every
paragraph and decide equality.  The other lanes come in ``BUCKETS``: a paragraph
adds only to its own bucket, its hash to the upper 36 bits and its length to the
lower 24 bits of the lane.  Buckets with equal hash sums hold, but for collisions,
the same paragraphs, so the characters in them are a lower bound of what two
documents share.  In long texts few buckets stay equal; so each bucket also has a
signed sum (two in a lane): a paragraph adds the square root of its length, with a
sign by its hash.  Squares of the differences of these sums add up to the
characters in changed paragraphs on average, at any length, with a standard error
of ``sqrt(2 / BUCKETS)`` of them (18 %).  Paragraphs of more than ``LONG``
characters are split at places that only the text around them decides.

Defined results: NULL text counts as empty, whose vector is zero; two empty texts
are alike (1.0); rows with equal id and text are one document, listed as often as
it occurs; NULL ids come first; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import frozen, text_or_empty

DENSE = 4
BUCKETS = 64
PARAGRAPHS = r"\n+|(?<=[.!?])\x20+"
LONG = 400
PIECES = r"(?<=[dt,;:])\x20+|(?<=[\u3001\u3002\uff0c\uff1b\uff01\uff1f\u7684\u4e86\u662f\u306f\u3092])"
SIGNED_BITS, ROOT_SCALE = 30, 16
SIGNED_MASK = (1 << SIGNED_BITS) - 1
DENSE_MASK = (1 << 60) - 1
HASH_BITS, WEIGHT_BITS = 36, 24
HASH_MASK, WEIGHT_MASK = (1 << HASH_BITS) - 1, (1 << WEIGHT_BITS) - 1


def paragraphs_of(text: Column) -> Column:
    pieces = F.flatten(F.transform(F.split(text, PARAGRAPHS), lambda p: F.when(
        F.length(p) > LONG, F.split(p, PIECES)).otherwise(F.array(p))))
    return F.filter(pieces, lambda p: F.length(p) > 0)


def vector(paragraphs: Column) -> Column:
    """The lanes of a multiset of paragraphs (array column): ``DENSE`` sums, then one lane per bucket,
    then one lane per two signed sums.

    Paragraphs are sorted by bucket, so one pass sums all lanes.
    """
    zero = F.lit(0).cast("long")
    hashed = F.sort_array(F.transform(paragraphs, lambda p: F.struct(
        F.pmod(F.xxhash64(p), F.lit(BUCKETS)).alias("b"), F.xxhash64(p).alias("x"), F.xxhash64(p, F.lit(-1)).alias("y"),
        F.length(p).cast("long").alias("w"))))

    def lane(acc: Column) -> Column:
        return F.struct(acc["b"].alias("b"), F.struct((F.shiftleft(acc["h"], WEIGHT_BITS) + acc["w"]).alias("v"),
                                                      acc["s"].alias("s")).alias("vs"))

    def plus(x: Column, y: Column, mask: int) -> Column:
        return (x + y.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(mask))

    def step(acc: Column, p: Column) -> Column:
        same = acc["b"] == p["b"]
        dense = [plus(acc[f"d{j}"], F.xxhash64(p["x"] if j % 2 else p["y"], F.lit(j)), DENSE_MASK).alias(f"d{j}")
                 for j in range(DENSE)]
        root = F.round(F.sqrt(p["w"]) * ROOT_SCALE).cast("long")
        signed = F.when(F.shiftright(p["x"], 40).bitwiseAND(F.lit(1)) == 1, root).otherwise(-root)
        return F.struct(
            p["b"].alias("b"), plus(F.when(same, acc["h"]).otherwise(zero), p["y"], HASH_MASK).alias("h"),
            plus(F.when(same, acc["w"]).otherwise(zero), p["w"], WEIGHT_MASK).alias("w"),
            plus(F.when(same, acc["s"]).otherwise(zero), signed, SIGNED_MASK).alias("s"), *dense,
            F.when(same, acc["out"]).otherwise(F.concat(acc["out"], F.array(lane(acc)))).alias("out"))

    start = F.struct(F.lit(-1).cast("long").alias("b"), zero.alias("h"), zero.alias("w"), zero.alias("s"),
                     *(zero.alias(f"d{j}") for j in range(DENSE)),
                     F.array().cast("array<struct<b:bigint,vs:struct<v:bigint,s:bigint>>>").alias("out"))

    def lanes(acc: Column) -> Column:
        filled = F.map_from_entries(F.concat(acc["out"], F.array(lane(acc))))  # with one lane for the start, -1
        of = lambda j, field: F.coalesce(F.try_element_at(filled, j)[field], zero)
        buckets = F.transform(F.sequence(zero, F.lit(BUCKETS - 1).cast("long")), lambda j: of(j, "v"))
        signed = F.transform(F.sequence(zero, F.lit(BUCKETS // 2 - 1).cast("long")), lambda j: F.shiftleft(
            of(j * 2, "s"), SIGNED_BITS) + of(j * 2 + 1, "s"))
        return F.concat(F.array(*(acc[f"d{j}"] for j in range(DENSE))), buckets, signed)

    return F.aggregate(hashed, start, step, lanes)


def inserted(a: Column, b: Column) -> Column:
    """The vector of the union of two multisets: paragraphs with vector ``b`` put into ``a``."""
    return _lanewise(a, b, 1)


def deleted(a: Column, b: Column) -> Column:
    """The vector after paragraphs with vector ``b`` are taken out of ``a``."""
    return _lanewise(a, b, -1)


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    def one(x: Column, y: Column, mask: int) -> Column:
        return (x + F.lit(sign) * y + F.lit(mask + 1 if sign < 0 else 0)).bitwiseAND(F.lit(mask))

    def pair(z: Column, i: Column) -> Column:
        x, y = z["a"], z["b"]
        high = one(F.shiftright(x, WEIGHT_BITS), F.shiftright(y, WEIGHT_BITS), HASH_MASK)
        low = one(x.bitwiseAND(F.lit(WEIGHT_MASK)), y.bitwiseAND(F.lit(WEIGHT_MASK)), WEIGHT_MASK)
        first = one(F.shiftright(x, SIGNED_BITS), F.shiftright(y, SIGNED_BITS), SIGNED_MASK)
        second = one(x.bitwiseAND(F.lit(SIGNED_MASK)), y.bitwiseAND(F.lit(SIGNED_MASK)), SIGNED_MASK)
        return (F.when(i < DENSE, one(x, y, DENSE_MASK))
                .when(i < DENSE + BUCKETS, F.shiftleft(high, WEIGHT_BITS) + low)
                .otherwise(F.shiftleft(first, SIGNED_BITS) + second))

    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), pair)


def as_text(v: Column) -> Column:
    """Lanes in hex, 15 digits each."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the characters in common paragraphs (0 to 1).

    The larger of the share in buckets with equal hash sums and the estimate by the signed sums.
    """
    lanes = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), DENSE + 1, BUCKETS)
    weight = lambda x: x.bitwiseAND(F.lit(WEIGHT_MASK))
    zero = F.lit(0).cast("long")
    share = F.aggregate(
        lanes, F.struct(zero.alias("same"), zero.alias("all")), lambda acc, z: F.struct(
            (acc["same"] + F.when(z["a"] == z["b"], weight(z["a"])).otherwise(zero)).alias("same"),
            (acc["all"] + F.greatest(weight(z["a"]), weight(z["b"]))).alias("all")),
        lambda s: F.when(s["all"] > 0, s["same"].cast("double") / s["all"].cast("double")).otherwise(F.lit(1.0)))
    def square(x: Column, y: Column) -> Column:
        d = (x - y).bitwiseAND(F.lit(SIGNED_MASK)).cast("double")
        d = F.when(d >= float(1 << SIGNED_BITS - 1), d - float(1 << SIGNED_BITS)).otherwise(d)
        return d * d

    pairs = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), DENSE + BUCKETS + 1, BUCKETS // 2)
    low = lambda x: x.bitwiseAND(F.lit(SIGNED_MASK))
    changed = F.aggregate(pairs, F.lit(0.0), lambda acc, z: (
        acc + square(F.shiftright(z["a"], SIGNED_BITS), F.shiftright(z["b"], SIGNED_BITS))
        + square(low(z["a"]), low(z["b"])))) / float(ROOT_SCALE ** 2)
    total = F.aggregate(lanes, zero, lambda acc, z: acc + weight(z["a"]) + weight(z["b"])).cast("double")
    estimate = F.when(total > 0, F.lit(1.0) - changed / total).otherwise(F.lit(0.0))
    equal = F.slice(a, 1, DENSE) == F.slice(b, 1, DENSE)
    return F.when(equal, F.lit(1.0)).otherwise(F.least(F.greatest(share, estimate), F.lit(1.0)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (NULL: empty) and ``vector`` of every row."""
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return (rows.withColumn("paragraphs", paragraphs_of(F.col("text")))
            .withColumn("vector", vector(F.col("paragraphs"))).drop("paragraphs"))


def _previous(ids: DataFrame) -> DataFrame:
    """For each distinct (``nil``, ``id``, ``h``) row, in order of id: the row before it (``p_`` columns);
    before the first comes the last.

    Ranges of ids are sorted each on their own; a range's first row follows the
    last row of the range before, of which there is one row per range.
    """
    cut = frozen(ids.distinct().repartitionByRange(F.col("nil").desc(), "id", "h")
                 .withColumn("part", F.spark_partition_id()))
    row = F.struct((~F.col("nil")).alias("has"), "id", "h", "n")
    inside = Window.partitionBy("part").orderBy(F.col("nil").desc(), "id", "h")
    ends = cut.groupBy(F.col("part").alias("part_")).agg(F.max(row).alias("end"))
    by_part = Window.orderBy("part_")
    ends = ends.select("part_", F.coalesce(
        F.lag("end").over(by_part),
        F.last("end").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    placed = cut.withColumn("p", F.lag(row).over(inside)).join(F.broadcast(ends), F.col("part") == F.col("part_"))
    p = F.coalesce("p", "end")
    return placed.select("nil", "id", "h", (~p["has"]).alias("p_nil"), p["id"].alias("p_id"), p["h"].alias("p_h"),
                         p["n"].alias("p_n"))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited one, whose last quarter is the start of the next document.

    Columns: ``doc_id, n_chars, edited, vector, edited_vector, near_edited, near_next``.
    Texts are shuffled once by key; each document then sends the start of its text
    and its vector to the document before it.
    """
    key = ("nil", "id", "h")
    rows = fingerprint(docs, id_col, text_col).select(
        F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
        F.xxhash64("text").alias("h"), "text", "vector")
    ids = docs.select(q(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
        F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n"))
    dealt = rows.repartition(*key)
    sent = (dealt.join(_previous(ids), list(key))
            .select(F.col("p_nil").alias("nil"), F.col("p_id").alias("id"), F.col("p_h").alias("h"),
                    F.substr("text", F.lit(1), F.floor(F.col("p_n") / 4).cast("int")).alias("head"),
                    F.col("vector").alias("next_vector"))
            .groupBy(*key).agg(F.first("head").alias("head"), F.first("next_vector").alias("next_vector")))
    n = F.length("text")
    both = dealt.join(sent, list(key))
    both = both.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head")))
    both = both.withColumn("paragraphs", paragraphs_of(F.col("edited")))
    both = both.withColumn("edited_vector", vector(F.col("paragraphs")))
    return both.select(F.when(~F.col("nil"), F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"), "edited",
                       "vector", "edited_vector", likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
                       likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))
