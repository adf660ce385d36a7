"""Vectors of texts whose words cancel each other."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prismtext.operators import retrieval
from prismtext.queries import QUERIES


def opposites(size: int) -> tuple[str, str]:
    """Two words of one place and of unlike signs."""
    seen = {}
    for word in map("w{}".format, range(10_000)):
        h = zlib.crc32(word.encode())
        other = seen.setdefault((h % size, 1 - (h >> 31)), None)
        if other:
            return other, word
        seen[h % size, h >> 31] = word
    raise AssertionError


def test_words_that_cancel_have_a_unit_vector():
    a, b = opposites(64)
    got = retrieval.hashed(pd.Series([f"{a} {b}", f"{b} {a} {a} {b}", a, f"{a} {b} {b}", " ", None]), 64)
    place = zlib.crc32(a.encode()) % 64
    want = np.zeros((6, 64))
    want[[0, 1], place] = 1
    want[2, place] = 1 if zlib.crc32(a.encode()) >> 31 else -1
    want[3] = -want[2]
    assert (got == want).all()


def test_index_build_has_unit_vectors_of_all_chunks(spark, tmp_path):
    """The second document's last chunk holds nothing but words that cancel each other."""
    a, b = opposites(64)
    rows = [(1, f"{a} {b}"), (2, " ".join([*["x"] * 300, a, b])), (3, " "), (None, "one more")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["index_build"](spark, str(tmp_path)).orderBy(F.col("chunk_id"))
    assert [(r["doc_id"], r["chunk_no"], r["chunk_id"], r["first_word"], r["unit"]) for r in got.collect()] == [(None, 0, 0, "one", True), (1, 0, 1, a, True), (2, 0, 2, "x", True), (2, 1, 3, a, True)]


def test_embedders_get_bounded_runs_of_texts(spark):
    texts = [None if i % 50 == 0 else f"t{i} a{i % 7}" for i in range(3500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    sizes = retrieval.embed(rows, "text", lambda part, size: np.full((len(part), size), len(part), np.float32), 1)
    assert {r[0] for r in sizes.select(F.col("embedding")[0]).distinct().collect()} == {500, 1000}
    got = [r["embedding"] for r in retrieval.embed(rows, "text", size=8).orderBy("id").collect()]
    assert np.array_equal(got, retrieval.hashed(pd.Series(texts), 8))
