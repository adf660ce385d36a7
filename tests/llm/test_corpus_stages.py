"""Stages that keep every document they should: unlike texts of one id, the mix against a plain loop, results that outlive others."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from prismtext.llm.common import documents
from prismtext.llm.mixing import mix_plan, mixed
from prismtext.llm.pieces import encode, op5_pieces

DIR = "/root/testdata/sf0.001"


def words(start, n=60):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_unlike_texts_of_one_id_stay(spark):
    near = words(1000).replace("w1003", "other")
    rows = [(1, words(0)), (1, words(100)), (1, words(100)), (2, words(200)), (3, words(200)), (4, words(1000)), (4, near), (5, near), (6, ""), (6, " "), (6, " "), (7, None), (None, words(300)), (None, words(0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("own"))
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()]
    one = [x for x in left if x[0] == 4]
    assert len(one) == 1 and one[0][1] in (words(1000), near)
    want = [(1, words(0)), (1, words(100)), (2, words(200)), (6, ""), (6, " "), (7, None), (None, words(300))]
    assert sorted(map(repr, (x for x in left if x[0] != 4))) == sorted(map(repr, want))


def test_the_mix_takes_what_its_plan_says(spark):
    docs = documents(spark, DIR).withColumns({"passes": F.lit("own"), "key": F.lit(1), "u": F.lit(2)})
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    plan = {(r["doc_id"], r["source"]): r["copies"] for r in mix_plan(docs).collect()}
    want = Counter()
    for r in docs.select("doc_id", "source", "text").collect():
        want[r["doc_id"], r["source"], r["text"]] += plan[r["doc_id"], r["source"]]
    out = mixed(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in out.collect()) == +want
    steps = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in steps and "ShuffledHashJoin" not in steps


def test_a_lazy_result_outlives_later_ones(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    lazy = encode(rows)
    assert op5_pieces(rows).count() == 2
    assert {r["doc_id"]: len(r["ids"]) > 0 for r in lazy.collect()} == {1: True, 2: False}
