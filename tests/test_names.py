"""Names that are kept: mappings in batches, restoring by names, streams that are stopped, and JSON of any form."""

import json
import re

import pytest
from pyspark.sql import functions as F

from prismtext.operators import mapping, mask
from prismtext.operators.rules import RULES
from prismtext.storage import committed, read_batches
from prismtext.streaming import pseudonyms

EMAIL = [r for r in RULES if r.tag == "EMAIL"]
TEXTS = [(1, "a@b.org one"), (1, "c@d.org two"), (None, "a@b.org and e@f.org"), (2, None), (3, ""), (3, "none"), (4, "c@d.org, a@b.org"), (4, "c@d.org, a@b.org"), (5, "z@a.org")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(spark, rows):
    return mask.findings(docs(spark, rows), "text", ["doc_id"], EMAIL)


def test_restoring_keeps_rows_of_one_id_apart(spark):
    hidden = mask.mask_text(docs(spark, TEXTS), "text", EMAIL, mask.pseudonym())
    table = hidden.select(F.explode("findings").alias("f")).select(F.expr("substring(f.replacement, 2, length(f.replacement) - 2)").alias("pseudonym"), "f.original").distinct()
    back = mapping.restore(hidden, "masked", table, keep_braces=False)
    assert sorted(map(repr, ((r["doc_id"], r["restored"]) for r in back.collect()))) == sorted(map(repr, TEXTS))


def test_only_names_are_joined(spark):
    """No row without a name takes part in the look-up, so no null key gathers them."""
    hidden = docs(spark, TEXTS).withColumn("masked", F.col("text"))
    plan = mapping.restore(hidden, "masked", spark.createDataFrame([("EMAIL_1", "x")], "pseudonym string, original string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and plan.count("Join") == 2 and "Inner" in plan


@pytest.mark.parametrize("cuts", [[3, 6], [1, 2], [5], []])
def test_any_split_gives_one_name_a_value(spark, tmp_path, cuts):
    store = str(tmp_path / "names")
    ends = [0, *cuts, len(TEXTS)]
    batches = [TEXTS[a:z] for a, z in zip(ends, ends[1:])]
    seen = []
    for n, rows in enumerate(batches):
        kept = mapping.get_or_create(found(spark, rows), store, f"{n:03d}").collect()
        now = {r["original"]: r["pseudonym"] for r in kept}
        assert len(kept) == len(now) == len(set(now.values()))
        assert all(now[k] == v for names in seen for k, v in names.items())
        seen.append(now)
    assert sorted(r["number"] for r in kept) == [1, 2, 3, 4] and set(now) == {"a@b.org", "c@d.org", "e@f.org", "z@a.org"}
    again = mapping.get_or_create(found(spark, TEXTS), store, "000")
    assert {r["original"]: r["pseudonym"] for r in again.collect()} == now
    assert mapping.get_or_create(found(spark, []), store, "999").count() == 4


def test_a_broken_batch_is_written_anew(spark, tmp_path):
    store = str(tmp_path / "names")
    mapping.get_or_create(found(spark, TEXTS[:1]), store, "0")
    mapping.get_or_create(found(spark, TEXTS[:2]), store, "1")
    (tmp_path / "names" / "1" / "_SUCCESS").unlink()
    assert committed(spark, store) == ["0"] and mapping.kept_mapping(spark, store).count() == 1
    kept = mapping.get_or_create(found(spark, TEXTS), store, "1")
    assert sorted((r["number"], r["original"]) for r in kept.collect()) == [(1, "a@b.org"), (2, "c@d.org"), (3, "e@f.org"), (4, "z@a.org")]


def test_a_value_keeps_its_first_tag(spark, tmp_path):
    rows = spark.createDataFrame([(2, "X", "v", 0, 0), (1, "Y", "v", 1, 0), (None, "Z", "v", 5, 5)], "doc_id long, tag string, original string, rule int, ord int")
    assert mapping.get_or_create(rows.where("doc_id is not null"), str(tmp_path / "a"), "0").first()["pseudonym"] == "Y_1"
    assert mapping.get_or_create(rows, str(tmp_path / "a"), "1").first()["tag"] == "Y"
    assert [tuple(r) for r in mapping.mapping_table(rows).collect()] == [("v", "Z_1", "Z")]


def test_texts_under_kept_names(spark, tmp_path):
    rows = docs(spark, TEXTS).withColumns({"findings": F.lit("own"), "names": F.lit(1)})
    out = mapping.mask_stored(rows, "text", str(tmp_path / "names"), "0", EMAIL)
    assert out.columns == ["doc_id", "text", "findings", "names", "masked"]
    want = {"a@b.org": "{EMAIL_1}", "c@d.org": "{EMAIL_2}", "e@f.org": "{EMAIL_3}", "z@a.org": "{EMAIL_4}"}
    put = lambda t: None if t is None else re.sub(r"\w@\w\.org", lambda m: want[m[0]], t)
    assert sorted(map(repr, ((r["text"], r["masked"]) for r in out.collect()))) == sorted(map(repr, ((t, put(t)) for _, t in TEXTS)))


def test_a_stream_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    """Stopped after the names of a batch were kept but before its rows were; what comes out equals batches that were never stopped."""
    for n in range(3):
        docs(spark, TEXTS[3 * n : 3 * n + 3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("names", "out", "offsets")]
    write = pseudonyms.write_batch

    def breaks(df, path, batch):
        if int(batch) == 1:
            raise OSError("stopped")
        write(df, path, batch)

    monkeypatch.setattr(pseudonyms, "write_batch", breaks)
    query = pseudonyms.mask_with_store(stream(), "text", *paths, EMAIL)
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination(120)
    assert len(committed(spark, paths[0])) == 2 and len(committed(spark, paths[1])) == 1
    monkeypatch.setattr(pseudonyms, "write_batch", write)
    pseudonyms.mask_with_store(stream(), "text", *paths, EMAIL).awaitTermination(120)
    pseudonyms.mask_with_store(stream(), "text", *paths, EMAIL).awaitTermination(120)
    got = read_batches(spark, paths[1], "doc_id long, text string, masked string, batch string").collect()

    store, want = str(tmp_path / "plain"), []
    for batch in sorted({r["batch"] for r in got}):
        rows = docs(spark, [(r["doc_id"], r["text"]) for r in got if r["batch"] == batch])
        want += [(r["doc_id"], r["text"], r["masked"]) for r in mapping.mask_stored(rows, "text", store, batch, EMAIL).collect()]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["masked"]) for r in got))) == sorted(map(repr, want)) and len(got) == len(TEXTS)


def test_own_columns_stay_or_are_refused(spark):
    rows = spark.createDataFrame([(1, "a@b.org", "t", "f", "p", 5)], "id int, text string, _text string, _found string, pieces string, digits int")
    out = mask.mask_text(rows, "text", EMAIL).first()
    assert tuple(out)[:6] == (1, "a@b.org", "t", "f", "p", 5) and out["masked"] == "{{EMAIL}}"
    with pytest.raises(ValueError, match="masked"):
        mask.mask_text(rows.withColumnRenamed("pieces", "Masked"), "text", EMAIL)
    keyed = mask.findings(rows.withColumn("masked", F.lit("own")), "text", ["masked", "text"], EMAIL).first()
    assert (keyed["masked"], keyed["text"], keyed["original"]) == ("own", "a@b.org", "a@b.org")


VALUES = [
    {"a@b.org": 1, "k": ["x c@d.org é \" \\ \n\t", {"q": None, "z": 1.5, "t": True, "deep": [[[["e@f.org"]]]]}], "e@f.org": {"a@b.org": "last"}},
    {"a@b.org": {"x": 1}, "c@d.org": {"y": ["g@h.org"]}},
    ["a@b.org", 5, [], {}, "", "plain", "\u0001 🙂 a@b.org"],
    "only a@b.org",
    12345678901234567890,
    None,
    {"no": "mail", "n": 0.1},
]


def walked(value):
    if isinstance(value, str):
        return re.sub(r"\b[a-z]@[a-z]\.org", "{{EMAIL}}", value)
    if isinstance(value, list):
        return [walked(x) for x in value]
    return {walked(k): walked(v) for k, v in value.items()} if isinstance(value, dict) else value


def test_json_of_any_form_equals_a_recursive_walk(spark):
    texts = [json.dumps(v) for v in VALUES] + [json.dumps(VALUES[0], ensure_ascii=False, indent=2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, j string").withColumns({"names": F.lit("own"), "mark": F.lit(1)})
    out = mask.mask_free_json(rows, "j", EMAIL)
    assert out.columns == rows.columns
    got = {r["id"]: r["j"] for r in out.collect()}
    assert [json.loads(got[i]) for i in range(len(texts))] == [walked(v) for v in [*VALUES, VALUES[0]]]
    assert all(got[i] == texts[i] for i in (4, 5, 6))


def test_json_that_is_none_and_all_rules(spark):
    rows = spark.createDataFrame([(1, "{broken a@b.org"), (2, None), (3, ""), (4, '{"s": "a@b.org ORDER-123456789"}'), (4, '{"s": "a@b.org ORDER-123456789"}')], "id int, j string")
    assert sorted((r["id"], r["j"]) for r in mask.mask_free_json(rows, "j").collect() if r["j"]) == [(1, "{broken {{EMAIL}}"), *[(4, '{"s": "{{EMAIL}} {{ORDER_NUMBER}}"}')] * 2]
    assert mask.mask_free_json(rows.limit(0), "j", EMAIL).count() == 0
