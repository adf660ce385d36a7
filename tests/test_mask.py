"""Masking by hand-made examples: what each rule takes, what it leaves, and how rules meet."""

from pyspark.sql import functions as F

from prismtext.operators import guard, mapping, mask, retrieval
from prismtext.operators.rules import RULES, catalogue
from prismtext.sources.files import read_texts

CASES = {
    "mail jan.k@ex.com or 10.0.0.1:8080": "mail {{EMAIL}} or {{IP}}:{{PORT}}",
    "300.1.1.1:80 x": "300.1.1.1 x",
    "PESEL: 44051401359 and 44051401359": "PESEL: {{PESEL_TAGGED}} and {{PESEL}}",
    "konto PL61109010140000071219812874 ok": "konto {{BANK_ACCOUNT}} ok",
    "PL 61 1090 1014 0000 0712 1981 2874": "{{BANK_ACCOUNT}}",
    "PL61109010140000071219812875": "PL61109010140000071219812875",
    "12.30 PLN and 1 200,50 zł": "{{TIME}} PLN and {{MONEY}}",
    "4111 1111 1111 1111": "{{CREDIT_CARD}}",
    "+48 600 123 456 and 600123456": "{{PHONE_INTERNATIONAL}} and {{PHONE}}",
    "3 maja 2023, May 3rd 2024, 2024-05-01": "{{DATE}}, {{DATE}}, {{DATE}}",
    "http://u@h.com": "http://{{EMAIL}}",
    "AB1234567 ABC123456 123-45-6789 fbid12345678": "{{PASSPORT}} {{ID_CARD}} {{SSN}} {{SOCIAL_ID}}",
    "ORDER-2023-001": "{{ORDER_NUMBER}}-001",
    "00-950 Warszawa": "{{POSTAL_CODE}} Warszawa",
    "000-000-00-13": "{{KRS}}",
    "{EMAIL_1_2}": "{EMAIL_1_2}",
    "": "",
    None: None,
}


def test_full_chain(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "id int, text string")
    got = {r["text"]: (r["masked"], r["findings"]) for r in mask.mask_text(rows, "text").collect()}
    assert {k: v[0] for k, v in got.items()} == CASES
    assert [f["original"] for f in got["000-000-00-13"][1]] == ["0000000013"]
    assert got[None][1] == []


def test_catalogue_has_all_rules():
    assert len(RULES) == 33 and len(catalogue(compat=False)) == 33


def test_payload_keys_values_and_other_types(spark):
    rows = spark.sql("select map('a@b.org', array('x c@d.org'), 'k', array(null)) as m, named_struct('n', 5, 's', 'e@f.org') as s, cast(null as struct<s:string>) as z")
    email = [r for r in RULES if r.tag == "EMAIL"]
    out = mask.mask_payload(mask.mask_payload(mask.mask_payload(rows, "m", email), "s", email), "z", email).first()
    assert out["m"] == {"{{EMAIL}}": ["x {{EMAIL}}"], "k": [None]}
    assert out["s"].asDict() == {"n": 5, "s": "{{EMAIL}}"} and out["z"] is None


def test_pseudonyms_agree_and_come_back(spark):
    rows = spark.createDataFrame([(1, "a@b.org and a@b.org"), (2, "none"), (3, None)], "doc_id int, text string")
    hidden = mask.mask_text(rows, "text", [RULES[0]], mask.pseudonym("s"))
    names = [f["replacement"] for f in hidden.where("doc_id = 1").first()["findings"]]
    assert len(set(names)) == 1 and "a@b.org" not in hidden.where("doc_id = 1").first()["masked"]
    table = hidden.select(F.explode("findings").alias("f")).select(F.expr("substring(f.replacement, 2, length(f.replacement) - 2)").alias("pseudonym"), "f.original").distinct()
    back = {r["doc_id"]: r["restored"] for r in mapping.restore(hidden.select("doc_id", "masked"), "masked", table).collect()}
    assert back == {1: "{a@b.org} and {a@b.org}", 2: "none", 3: None}


def test_remote_services_fail_closed(spark):
    def make():
        def post(url, payload):
            if payload["q"] == "down":
                raise OSError("no route")
            return {"results": {"safe": payload["q"] == "good"}, "anonymized": "***"}

        return post

    rows = spark.createDataFrame([('{"q": "good"}',), ('{"q": "bad"}',), ('{"q": "down"}',), (None,)], "p string")
    assert [r["safe"] for r in guard.remote_guard(rows, "p", "u", make).collect()] == [True, False, False, False]
    assert [r["anonymized"] for r in guard.remote_mask(rows, "p", "u", make).collect()] == ["***", "***", None, None]


def test_chunks_embedding_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(" ".join(map(str, range(10))))
    (tmp_path / "in" / "b.TXT").write_text("no")
    files = read_texts(spark, str(tmp_path), ["md"])
    cut = retrieval.chunks(files.withColumn("id", F.lit(1)), "id", "text", 4, 1)
    assert [r["chunk"] for r in cut.orderBy("chunk_no").collect()] == ["0 1 2 3", "3 4 5 6", "6 7 8 9", "9"]
    norm = retrieval.embed(cut, "chunk").select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-5 for r in norm)


def test_stream(spark, tmp_path):
    from prismtext.streaming.mask import mask_stream

    spark.createDataFrame([("a@b.org",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    mask_stream(stream, "text", str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["masked"].startswith("{EMAIL_")
