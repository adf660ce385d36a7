"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a
text's five-word shingles. Everything is a Column expression, so sketches are
built inside the scan and no Python runs.

* ``merge`` of two sketches is the sketch of the union of the two texts'
  shingles, so parts of a document (or documents of a site) can be sketched
  apart and merged in any order; ``merge_agg`` does this for a group.
* ``resemblance`` estimates |A and B| / |A or B| from the k smallest of the
  union, ``containment`` estimates |A and B| / |A|, ``distinct_count`` the
  number of shingles. All are exact while a union has at most k shingles.

Defined results: a null text counts as empty; an empty text has an empty
sketch, and two empty sketches resemble each other fully (1.0). A text of
fewer than five words has one shingle, all its words. Equal texts have equal
sketches, repeated rows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK, materialize, tasks

#: Hashes in a sketch, words in a shingle.
K, SHINGLE = 128, 5
#: Hashes lie in [0, 2**60).
SPACE = float(1 << 60)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text column, array<bigint>."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        whole = F.array(F.xxhash64(h, F.size(h)))
        many = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(n)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < n, whole).otherwise(many)

    # The array is bound once by a one-element transform; a lambda's argument is not computed again for each use.
    shingles = F.get(F.transform(F.array(hashed), of), F.lit(0))
    small = F.transform(shingles, lambda h: F.shiftrightunsigned(h, 4))
    return F.slice(F.sort_array(F.array_distinct(small)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_agg(hashes: Column, k: int = K) -> Column:
    """For use in ``agg`` over exploded, distinct hashes: the k smallest of a group."""
    return F.slice(F.sort_array(F.collect_set(hashes)), 1, k)


def merge_groups(df: DataFrame, key: str, column: str, k: int = K, salts: int = 16) -> DataFrame:
    """The merged sketch of each key, (key, column).

    A hot key is dealt to ``salts`` partial merges first; each hands on k
    hashes, found by rank within its part, so no group is gathered whole.
    """
    spread = F.pmod(F.xxhash64(column), F.lit(salts))
    flat = df.select(key, spread.alias("_s"), F.explode(column).alias("_h")).distinct()
    part = flat.withColumn("_r", F.row_number().over(W.partitionBy(key, "_s").orderBy("_h"))).where(F.col("_r") <= k)
    few = part.select(key, "_h").distinct()
    return few.groupBy(key).agg(merge_agg(F.col("_h"), k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    lowest = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(lowest, a), b))
    return F.when(F.size(lowest) == 0, F.lit(1.0)).otherwise(common / F.size(lowest))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / (k-th smallest as a share of the range)."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * SPACE) / F.get(a, F.lit(k - 1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    union = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """Fifteen hexadecimal digits for each hash, joined."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 15, "0")), "")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: the values of the row with the next smaller doc_id (after the smallest: the largest).

    Ids are cut into ranges at quantiles, so each range is sorted by a task of
    its own; a range's first row finds its neighbour in the largest row of the
    range before, which is sent along as a guest. Only the borders of the
    ranges (a few for each task) pass the driver. Null ids order as smallest,
    equal ids by text.
    """
    spark = rows.sparkSession
    n = 4 * tasks(spark)
    ids = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = rows.agg(F.percentile_approx(ids, [(i + 1) / n for i in range(n - 1)], 100 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < ids))
    rows = rows.withColumn("_part", part)
    tops = sorted((r["_part"], r["top"]) for r in rows.groupBy("_part").agg(F.max(ids).alias("top")).collect())
    to = {tops[i][0]: tops[(i + 1) % len(tops)][0] for i in range(len(tops))}
    goes = F.lit(None).cast("int")
    if tops:
        lookup = F.create_map(*[F.lit(x) for p, t in tops for x in (t, to[p])])
        goes = F.element_at(lookup, ids)
    own = F.struct(F.col("_part").cast("int").alias("part"), F.lit(False).alias("guest"))
    also = F.struct(goes.alias("part"), F.lit(True).alias("guest"))
    sent = rows.withColumn("_to", F.explode(F.when(goes.isNotNull(), F.array(own, also)).otherwise(F.array(own))))
    order = W.partitionBy("_to.part").orderBy(F.col("_to.guest").desc(), ids, *[F.col(c) for c in columns[:1]])
    near = sent.select("*", *[F.lag(c).over(order).alias(f"next_{c}") for c in columns])
    return near.where(~F.col("_to.guest")).drop("_to", "_part")


def op1_fingerprint(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    rows = with_next(rows, ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
        distinct_count(F.col("sketch")).alias("n_shingles"),
    )
