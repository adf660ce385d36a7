"""Text files of a folder tree as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """path and text of every file below ``path`` with one of the endings (case counts; the dot may be left out).

    Raises ValueError if there is none.
    """
    ends = [e if e.startswith(".") else f".{e}" for e in extensions]
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    keep = F.lit(False)
    for end in ends:
        keep = keep | F.col("path").endswith(end)
    found = files.where(keep)
    if found.isEmpty():
        raise ValueError(f"no file with {', '.join(ends)} below {path}")
    return found
