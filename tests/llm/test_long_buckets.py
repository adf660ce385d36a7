"""Paths that only large tables take, and the quality of scores on held-out texts."""

import random

from pyspark.sql import functions as F

from prismtext.llm import suffix_dedup
from prismtext.llm.lm_score import op6_lm_score


def test_long_buckets_give_the_same_bytes(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join([*(word() for _ in range(40)), passage[r.randrange(60) : len(passage) - r.randrange(200)], word()]) for _ in range(30)]
    rows = [*enumerate(texts), (30, None), (31, ""), (None, texts[0]), (3, texts[3]), (3, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, suffix_dedup.op4_suffix_dedup(docs).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)
    got = sorted(map(tuple, suffix_dedup.op4_suffix_dedup(docs).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == want and len(got) == len(rows)
    assert sum(x[2] > 0 for x in got) >= 30
    monkeypatch.setattr(suffix_dedup, "FEW", 0)  # no broadcast
    plain = sorted(map(tuple, suffix_dedup.op4_suffix_dedup(docs).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert plain == want


def test_held_out_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = op6_lm_score(docs).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.count(F.lit(1)).alias("n")).first()
    assert held["n"] > 0 and held["score"] > held["base"]
