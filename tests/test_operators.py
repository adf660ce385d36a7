"""Routing, maskers in turn, the index of chunks, and plans."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prismtext.operators import clusters, mask, retrieval, route
from prismtext.operators.rules import IBAN_LENGTHS, RULES
from prismtext.queries import CATALOGUE
from prismtext.storage import numbered


def rule(tag):
    return [r for r in RULES if r.tag == tag]


def test_terms_of_an_intent(spark):
    intent = route.Intent("x", ["Python", "code"], [" stack trace : 4", "plain"], ["(unclosed", "a+b"], {"code": 3})
    rows = spark.createDataFrame([("python code",), ("a stack trace",), ("plain aab",), ("",)], "t string")
    got = [r[0] for r in rows.select(route.score(F.col("t"), intent)).collect()]
    assert got == [3.0, 4.0, 5.0, 0.0]
    assert [r[0] for r in rows.select(route.score(F.col("t"), intent, compat=False)).collect()] == [4.0, 4.0, 5.0, 0.0]


def test_routing_from_a_file_with_overrides(spark, tmp_path):
    import json

    (tmp_path / "r.json").write_text(json.dumps(CATALOGUE))
    plain = route.read_routing(spark, str(tmp_path / "r.json"), ["s", "m", "l"])
    assert (plain.simple, plain.medium, len(plain.intents)) == (25, 150, 8)
    other = route.read_routing(spark, str(tmp_path / "r.json"), ["s", "m", "l"], {"thresholds": "5|x", "INTENT_MATH": "pi|round number:4", "models": "a|b|c"})
    assert (other.simple, other.models) == (25, ["a", "b", "c"])
    math = next(i for i in other.intents if i.name == "math")
    assert (math.keywords, math.phrases, math.patterns) == (["pi"], ["round number:4"], ())
    rows = spark.createDataFrame([("auto", ""), ("auto", None), ("mine", "x"), ("auto", "a round number")], "m string, t string")
    assert [r[0] for r in rows.select(route.route(F.col("m"), F.col("t"), other)).collect()] == ["small", "small", "mine", "b"]


def test_maskers_in_turn_unite_their_mappings(spark):
    rows = spark.createDataFrame([(1, "a@b.org, ORDER-1234, c@d.org"), (2, "none"), (3, None)], "id int, text string")
    out = mask.mask_in_turn(rows, "text", [mask.masker(rule("EMAIL")), mask.masker(rule("ORDER_NUMBER"))]).orderBy("id").collect()
    assert [r["text"] for r in out] == ["{{EMAIL}}, {{ORDER_NUMBER}}, {{EMAIL}}", "none", None]
    assert out[0]["mappings"] == {"{{EMAIL}}": "c@d.org", "{{ORDER_NUMBER}}": "ORDER-1234"} and out[1]["mappings"] == {}


def test_findings_work_out_each_rule_once(spark):
    rows = spark.createDataFrame([(1, "a@b.org")], "id int, text string")
    two = rule("EMAIL") + rule("ORDER_NUMBER")
    plan = mask.findings(rows, "text", ["id"], two)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == len(two)


def test_gates_leave_nothing_out(spark):
    """Names that may bring digits into a text switch gates off; both ways find the same where names bring none."""
    texts = ["mail a@b.org 10.0.0.1:80", "www.a.example/x", "GB82 WEST 1234 5698 7654 32", "12 maja 2023, 5 euro", "a:b:c:d:e:f:a:b", "localhost", "٤٤٠٥١٤٠١٣٥٩"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ungated = lambda tag, original: mask.placeholder(tag, original)
    first = [(r["masked"], r["findings"]) for r in mask.mask_text(rows, "text").orderBy("id").collect()]
    assert first == [(r["masked"], r["findings"]) for r in mask.mask_text(rows, "text", name=ungated).orderBy("id").collect()]


def test_account_lengths():
    assert len(IBAN_LENGTHS) > 60
    assert IBAN_LENGTHS["PL"] == 28 and IBAN_LENGTHS["NO"] == 15


def test_index_is_updated_and_searched(spark, tmp_path):
    store = str(tmp_path / "store")
    assert retrieval.load_store(spark, store) is None
    assert retrieval.search(None, spark.createDataFrame([(1, "x")], "query_id long, q string"), "q").count() == 0
    first = spark.createDataFrame([(1, "red  apples\n and pears"), (2, None), (3, " ")], "id long, text string")
    assert retrieval.update_index(first, "id", "text", store, "1").count() == 1
    more = spark.createDataFrame([(4, "blue whales"), (5, "green apples")], "id long, text string")
    kept = retrieval.update_index(more, "id", "text", store, "2")
    assert sorted(r["chunk_id"] for r in kept.collect()) == [0, 1, 2]
    got = retrieval.search(kept, spark.createDataFrame([(7, "whales blue")], "query_id long, q string"), "q", 1).collect()
    assert [(r["query_id"], r["chunk"], r["rank"]) for r in got] == [(7, "blue whales", 1)]


def chunks_of(kept):
    return sorted((r["id"] is not None, r["id"] or 0, r["chunk"]) for r in kept.collect())


def test_index_batches_run_once_and_replace_what_changed(spark, tmp_path):
    """Repeated and null ids, a batch run again, one that was broken off, edits, removals, and columns called like the operator's own."""
    store = str(tmp_path / "store")
    schema = "id long, text string, n int, first int, batch string, chunks int"
    table = lambda *rows: spark.createDataFrame([(*r, 1, 2, "b", 3) for r in rows], schema)
    a = table((1, "one"), (1, "other one"), (2, "two"), (2, "two"), (None, "no id"), (3, "three"), (4, None))
    assert chunks_of(retrieval.update_index(a, "id", "text", store, "a")) == [(False, 0, "no id"), (True, 1, "one"), (True, 1, "other one"), (True, 2, "two"), (True, 2, "two"), (True, 3, "three")]
    before = {(r["id"], r["chunk"], r["chunk_id"]) for r in retrieval.load_store(spark, store).collect()}
    assert len({c for _, _, c in before}) == 6
    again = retrieval.update_index(a, "id", "text", store, "a")
    same = retrieval.update_index(a.repartition(3), "id", "text", store, "b")
    assert {(r["id"], r["chunk"], r["chunk_id"]) for r in again.collect()} == before == {(r["id"], r["chunk"], r["chunk_id"]) for r in same.collect()}
    # A batch whose chunks were written but not its marks counts for nothing.
    retrieval.index_texts(table((9, "lost")), "id", "text").withColumn("batch", F.lit("c")).write.parquet(f"{store}/chunks/c")
    assert chunks_of(retrieval.load_store(spark, store)) == chunks_of(again)
    c = table((1, "one"), (2, None), (None, "an id"), (5, "five"))
    now = retrieval.update_index(c, "id", "text", store, "c")
    assert chunks_of(now) == [(False, 0, "an id"), (True, 1, "one"), (True, 3, "three"), (True, 5, "five")]
    ids = [r["chunk_id"] for r in now.collect()]
    assert len(set(ids)) == 4 and min(r["chunk_id"] for r in now.where("id in (1, 5) or id is null").collect()) > 5


def test_chunk_numbers_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "d"), (1, "d"), (None, "e f g"), (0, ""), (2, None)], "id long, text string")
    got = retrieval.numbered_chunks(rows, "id", "text", 2, 1).collect()
    assert sorted(r["chunk_id"] for r in got) == list(range(8))
    assert sorted(r["chunk_id"] for r in got if r["id"] is None) == [0, 1, 2]
    one = sorted((r["chunk_id"], r["chunk"]) for r in got if r["id"] == 1 and r["chunk"] not in ("d",))
    assert [b[0] - a[0] for a, b in zip(one, one[1:])] == [1, 1]


def test_numbers_of_rows_with_one_hot_key(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    got = sorted((r["k"], r["id"], r["number"]) for r in numbered(rows, [F.col("k"), F.col("id")]).collect())
    assert [n for _, _, n in got] == list(range(1000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges are put together otherwise
    try:
        dealt = rows.repartitionByRange(F.col("k"), F.col("id")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert dealt < 300
        assert sorted(r["number"] for r in numbered(rows, [F.col("k"), F.col("id")]).collect()) == list(range(1000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered(rows.limit(0), [F.col("k")]).count() == 0


def test_clusters_equal_a_full_scan_and_are_skipped(spark, tmp_path):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 16))
    rows = centres[rnd.integers(0, 20, 900)] + 0.05 * rnd.normal(size=(900, 16))
    rows = np.concatenate([rows, rows[:5], np.zeros((2, 16))]).round(3)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(5000, None)], "vec_id long, embedding array<float>")
    queries = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    clusters.write_clusters(base, str(tmp_path / "s"), 20)
    found, skipped = clusters.nearest_in_clusters(spark, str(tmp_path / "s"), queries, 12)
    want = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.nearest(base, queries, 12).collect()}
    assert {(r["query_id"], r["rank"]): r["key"] for r in found.collect()} == want
    assert skipped > 0.5
    clusters.write_clusters(base.limit(3), str(tmp_path / "few"), 20)
    assert clusters.nearest_in_clusters(spark, str(tmp_path / "few"), queries.limit(1), 12)[0].count() == 3
    clusters.write_clusters(base.limit(0), str(tmp_path / "none"), 20)
    assert clusters.nearest_in_clusters(spark, str(tmp_path / "none"), queries)[0].count() == 0


def test_pooled_states_are_averaged_under_the_mask():
    states = lambda texts: (np.array([[[3.0, 4.0], [9.0, 9.0]]] * len(texts)), np.array([[1, 0]] * len(texts)))
    assert np.allclose(retrieval.pooled(states)(pd.Series(["a", None]), 2), [[0.6, 0.8]] * 2)
    off = retrieval.Settings.read({"RAG_COLLECTION": "c"})
    on = retrieval.Settings.read({"RAG_COLLECTION": "c", "RAG_EMBEDDER": "e", "RAG_CHUNK_SIZE": "50"})
    assert not off.enabled and on.enabled and on.size == 50 and on.overlap == 100


def test_hashed_equals_a_plain_loop():
    import zlib

    texts = ["a b a", "", None, "B c"]
    want = np.zeros((4, 8))
    for row, t in zip(want, texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            row[h % 8] += 1 if h >> 31 else -1
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(retrieval.hashed(pd.Series(texts), 8), want / np.where(norm > 0, norm, 1))
