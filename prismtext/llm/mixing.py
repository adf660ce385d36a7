"""Mixing sources to target weights by hash-threshold histograms.

Only DataFrame operations are used. Sizes are summed by source and hash
bucket; where the running sum passes a source's budget lies its boundary
bucket, and only the rows of that bucket are summed again by the next bits of
the hash. After four rounds of 12 bits the threshold separates single
documents, and the mix is a filter: nothing is sorted by document.

The budgets nest: a document under the threshold of a smaller budget is under
that of every larger one, so a growing mix only ever adds documents.

Defined results: a null text has size 0, a null source is a source of its own
(ordered last), a null id hashes as the empty text; repeated rows hash alike
and are taken alike; an empty table gives an empty result. Columns beyond
``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize, small_join

#: Hash bits of a bucket, and rounds of refinement.
BITS, ROUNDS = 12, 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash48(doc_id: Column) -> Column:
    """48 bits of the id's md5, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row for each source: its size and its target.

    Sources in code-point order, null last, get ``weights`` in turn and share
    ``share`` times all sizes; no target exceeds ``most`` times its source's
    size. Targets are min(cap, level * weight) for one common level: sources
    sorted by cap/weight fill up first, the rest share what is left. The table
    has a row for each source, not for each document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_n", F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    every = W.partitionBy()
    before = W.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    by = by.withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    by = by.withColumn("_level", F.col("_left") / F.col("_open"))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    by = by.withColumn("_all", F.max(fits).over(every))
    target = F.least("_cap", F.coalesce(F.col("_all") * F.col("_w"), F.col("_cap")))
    return by.select("source", "source_size", target.alias("target"))


def budget_thresholds(sizes: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """For each row of ``budgets`` (key, budget) the hash below which documents are taken.

    ``sizes`` has key, size and u (48 hash bits); ``n`` is the number of keys.
    The boundary document is taken if that ends nearer to the budget. A budget
    that all documents together don't pass has no row: everything is taken.
    """
    state = budgets.select("key", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("below"))
    for step in range(ROUNDS):
        left = 48 - BITS * (step + 1)
        inside = small_join(sizes, state, ["key"], n, "inner")
        if step:
            inside = inside.where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.lit(1 << (left + BITS))))
        histogram = inside.groupBy("key", F.shiftright("u", left).alias("bucket")).agg(F.sum("size").alias("s"), F.first("budget").alias("budget"), F.first("below").alias("below"))
        upto = F.col("below") + F.sum("s").over(W.partitionBy("key").orderBy("bucket"))
        passed = histogram.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        state = passed.groupBy("key").agg(F.min(F.struct("bucket", "upto", "s", "budget")).alias("at")).select(
            "key", "at.budget", F.shiftleft("at.bucket", left).alias("low"), (F.col("at.upto") - F.col("at.s")).alias("below"), F.col("at.s").alias("edge"))
    nearer = F.col("below") + F.col("edge") - F.col("budget") < F.col("budget") - F.col("below")
    return state.select("key", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))


def source_cuts(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame, int]:
    """The documents' sizes and hashes; for each source (key) its size, target, whole passes, rest and threshold; the number of sources."""
    sizes = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash48(F.col("doc_id")).alias("u")), "sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    n = targets.count()
    keyed = targets.select(_key().alias("key"), "source_size", "target")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    keyed = keyed.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    cuts = budget_thresholds(sizes.select(_key().alias("key"), "size", "u"), keyed.select("key", "budget"), n)
    return sizes, materialize(keyed.join(cuts, "key", "left"), "cuts"), n


def _copies(u: Column, passes: Column, budget: Column, threshold: Column) -> Column:
    """A source's whole passes, and one more below its threshold."""
    return passes + F.when(budget <= 0, 0).when(threshold.isNull() | (u < threshold), 1).otherwise(0)


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and copies.

    A source's target is a number of whole passes over it plus a rest; every
    document is taken once for each pass, and those under the source's hash
    threshold once more, so no document exceeds ``most`` passes rounded up.
    """
    sizes, cuts, n = source_cuts(docs, **how)
    rows = sizes.withColumn("key", _key())
    return small_join(rows, cuts, ["key"], n).select("doc_id", "source", "size", "source_size", "target", _copies(*map(F.col, ("u", "passes", "budget", "threshold"))).alias("copies"))


def op10_mix(docs: DataFrame) -> DataFrame:
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, with the columns of ``docs``.

    Copies follow from a row's id and its source's threshold, so only the sources' table is joined and no text is shuffled.
    """
    _, cuts, n = source_cuts(docs, **how)
    key, copies, copy = fresh([*docs.columns, *cuts.columns], "mix_key", "copies", "copy")
    own = fresh(docs.columns, "passes", "budget", "threshold")
    cuts = cuts.select(F.col("key").alias(key), *[F.col(c).alias(o) for c, o in zip(("passes", "budget", "threshold"), own)])
    taken = small_join(docs.withColumn(key, _key()), cuts, [key], n, "inner").withColumn(copies, _copies(hash48(F.col("doc_id")), *map(F.col, own))).where(F.col(copies) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
b AS (SELECT *, target - passes * source_size AS budget FROM p),
h AS (SELECT source, u, sum(size)::BIGINT AS s FROM d GROUP BY source, u),
c AS (SELECT source, u, s, sum(s) OVER (PARTITION BY source ORDER BY u)::BIGINT AS upto FROM h),
k AS (SELECT c.source, c.u, CASE WHEN b.budget <= 0 THEN 0 WHEN c.upto <= b.budget THEN 1
         WHEN c.upto - c.s <= b.budget AND c.upto - b.budget < b.budget - (c.upto - c.s) THEN 1 ELSE 0 END AS more
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, d.size * (b.passes + k.more) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.u = k.u
"""
