"""Pseudonym tables: build them from findings, keep and extend them, put names into texts and values back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtext.operators.mask import MARK, free, mask_text, pseudonym
from prismtext.operators.rules import Rule
from prismtext.storage import committed, numbered, read_batches, stored, write_batch

#: A name in braces, as masking writes it.
TOKEN = r"\{[A-Z_]+_[0-9a-z]+(?:_[0-9]+)?\}"
#: Columns of a kept mapping.
MAPPING = "original string, pseudonym string, tag string, number long, batch string"


def _values(found: DataFrame) -> DataFrame:
    """original, tag: one row per value; its tag is the first by ``doc_id``, rule and order (a null id first)."""
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "rule", "ord")
    return found.groupBy("original").agg(F.min_by("tag", place).alias("tag"))


def mapping_table(found: DataFrame) -> DataFrame:
    """original, pseudonym, tag: one row per value, numbered in order of code points.

    ``found`` is the result of ``mask.findings`` keyed by doc_id; it is worked out once.
    """
    rows = numbered(_values(found), [F.col("original")])
    return rows.select("original", F.concat("tag", F.lit("_"), (F.col("number") + 1).cast("string")).alias("pseudonym"), "tag")


def kept_mapping(spark: SparkSession, store: str) -> DataFrame:
    """original, pseudonym, tag, number and batch of every value that a store knows."""
    return read_batches(spark, store, MAPPING)


def get_or_create(found: DataFrame, store: str, batch: str) -> DataFrame:
    """The store's mapping after a batch of findings: known values keep their names, new ones are numbered after them.

    A value's tag is that of its first finding, and stays whatever later
    findings call it. A batch is written once: run again under its name, it
    adds nothing, and one that was broken off is written anew. One batch is
    written at a time.
    """
    spark = found.sparkSession
    if batch not in committed(spark, store):
        known = kept_mapping(spark, store)
        last = known.agg(F.max("number")).first()[0] or 0
        new = numbered(_values(found).join(known.select("original"), "original", "left_anti"), [F.col("original")])
        number = F.col("number") + last + 1
        write_batch(new.select("original", F.concat("tag", F.lit("_"), number.cast("string")).alias("pseudonym"), "tag", number.alias("number")), store, batch)
    return kept_mapping(spark, store)


def save_mapping(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("pseudonym").cast("string"), F.col("original").cast("string"))


def _replaced(df: DataFrame, text: str, table: DataFrame, into: str, write: Column) -> DataFrame:
    """``df`` with the column ``into``: each ``{name}`` of the text that ``table`` (name, value) knows becomes ``write`` of its value.

    Only a text's names are joined, under the text's hash; what a text becomes
    depends on it alone, so rows need no key and may repeat. Of several values
    of one name the least counts.
    """
    mark, names = free(df.columns, "text_hash", "names")
    rows = df.withColumn(mark, F.when(F.regexp_like(text, F.lit(TOKEN)), F.sha2(text, 256)))
    asked = rows.where(F.col(mark).isNotNull()).select(F.col(mark).alias("hash"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})")))).alias("token")).distinct()
    known = table.groupBy(F.concat(F.lit("{"), "name", F.lit("}")).alias("token")).agg(F.min("value").alias("value"))
    found = asked.join(known, "token").groupBy(F.col("hash").alias(mark)).agg(F.map_from_entries(F.collect_list(F.struct("token", write.alias("value")))).alias(names))
    parts = F.split(F.regexp_replace(text, TOKEN, f"{MARK}$0{MARK}"), MARK, -1)
    put = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(F.col(names), p), p)).otherwise(p)), "")
    out = rows.join(found, mark, "left")
    return out.withColumn(into, F.when(F.col(names).isNull(), F.col(text)).otherwise(put)).drop(mark, names)


def restore(df: DataFrame, text: str, table: DataFrame, keep_braces: bool = True, into: str = "restored") -> DataFrame:
    """``df`` with restored: each ``{pseudonym}`` known to the table replaced by its value.

    ``table`` has pseudonym (no braces) and original. Longer names never lose
    to shorter ones, because whole names are compared. With ``keep_braces`` the
    braces around a value stay. A null text stays null.
    """
    write = F.concat(F.lit("{"), F.col("value"), F.lit("}")) if keep_braces else F.col("value")
    return _replaced(df, text, table.select(F.col("pseudonym").alias("name"), F.col("original").alias("value")), into, write)


def mask_stored(df: DataFrame, text: str, store: str, batch: str, rules: Sequence[Rule] | None = None, key: str = "doc_id") -> DataFrame:
    """``df`` with masked (``masked_`` if it has such a column): values under the names that a store keeps; it learns the new ones as this batch.

    The texts are masked once, under hashed names, and written; the findings
    extend the store, and its names take the hashed ones' place.
    """
    hidden, found = free(df.columns, "masked", "findings")
    once = stored(mask_text(df, text, rules, pseudonym(), names=(hidden, found)), "hidden")
    hits = once.select(F.col(key).alias("doc_id"), F.explode_outer(found).alias("f")).where("f.tag is not null")
    kept = get_or_create(hits.select("doc_id", "f.*"), store, batch)
    hashed = hits.select(F.expr("substring(f.replacement, 2, length(f.replacement) - 2)").alias("name"), "f.original").distinct()
    names = hashed.join(kept.select("original", "pseudonym"), "original").select("name", F.col("pseudonym").alias("value"))
    return _replaced(once, hidden, names, hidden, F.concat(F.lit("{"), F.col("value"), F.lit("}"))).drop(found)
