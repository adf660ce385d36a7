"""Terms in texts by a join, and judges that are asked in turn and once for each payload."""

import json
import random

import pytest
from pyspark.sql import functions as F

from prismtext.operators import guard, terms


def test_terms_equal_contains(spark):
    """A catalogue of words, phrases, single letters and repeats against texts with nulls, line breaks, repeats and other scripts."""
    rnd = random.Random(4)
    syllables = ["ka", "lo", "mi", "zü", "né", "t", " ", "\n", "🙂", "ab"]
    texts = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(0, 60))) for _ in range(120)] + [None, "", "x" * 3000 + "needle", "abc", "abc"]
    known = {"".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5))) for _ in range(400)} | {"", "needle", "never there", "a", "🙂", "xxxxxxxx"}
    rows = spark.createDataFrame([(i % 90 if i % 7 else None, t, "own", "m") for i, t in enumerate(texts)], "id int, text string, candidates string, mark string")
    catalogue = spark.createDataFrame([(t,) for t in [*known, *list(known)[:50], None]], "term string")
    out = terms.terms_in(rows, "text", catalogue)
    assert out.columns == [*rows.columns, "terms"]
    got = sorted((repr(r["text"]), tuple(sorted(r["terms"]))) for r in out.collect())
    assert got == sorted((repr(t), tuple(sorted(k for k in known if t is not None and k in t))) for t in texts)
    assert {tuple(r["terms"]) for r in terms.terms_in(rows, "text", catalogue.limit(0)).collect()} == {()}
    with pytest.raises(ValueError, match="terms"):
        terms.terms_in(out, "text", catalogue)


def test_scores_of_a_catalogue_of_the_shipped_size(spark):
    """Four intents with some forty keywords and phrases each: the join gives what the expression of literals gives."""
    from prismtext.operators import route

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 6)))
    intents = [route.Intent(n, sorted({word() for _ in range(40)}), sorted({f"{word()} {word()}:{rnd.randint(1, 5)}" for _ in range(48)}), [], {}) for n in ("code", "math", "creative", "general")]
    table = [(i.name, *t) for i in intents for t in [*((k, 1.0) for k in i.keywords), *map(route._weight, i.phrases)]]
    rows = spark.createDataFrame([(i, " ".join(word().capitalize() for _ in range(rnd.randint(0, 30)))) for i in range(80)], "id int, text string")
    got = {(r["id"], r["intent"]): r["score"] for r in terms.term_scores(rows, ["id"], "text", spark.createDataFrame(table, "intent string, term string, weight double")).collect()}
    plain = rows.select("id", *[route.score(F.lower("text"), i).alias(i.name) for i in intents]).collect()
    assert got == {(r["id"], i.name): r[i.name] for r in plain for i in intents if r[i.name]}


@pytest.fixture
def judge(tmp_path):
    """A service that writes down each call: unsafe if the text has its name, failing at first where it says so, or always."""
    calls = tmp_path / "calls"
    calls.touch()

    def make():
        def post(url, payload):
            said = f"{url} {payload['text']}"
            with calls.open("a") as file:
                file.write(said + "\n")
            if "down" in payload["text"] or "once" in payload["text"] and calls.read_text().count(said + "\n") < 3:
                raise OSError("no route")
            return {"results": {"safe": f"_{url}" not in payload["text"]}, "message": f"not {payload['text']}"}

        return post

    return make, lambda: sorted(calls.read_text().split("\n")[:-1])


def payloads(spark, *texts):
    return spark.createDataFrame([(i, None if t is None else json.dumps({"text": t}), 1, "o") for i, t in enumerate(texts)], "id int, p string, mark int, payload string")


def test_each_payload_is_asked_once(spark, judge):
    make, calls = judge
    rows = payloads(spark, *["same"] * 6, "down", "once", None, "other").repartition(4)
    out = guard.ask_once(rows, "p", "a", make, tries=3).orderBy("id").collect()
    assert calls() == sorted(["a same", "a other", *["a down"] * 3, *["a once"] * 3])
    assert [r["error"] for r in out] == [None] * 6 + ["OSError: no route", None, "no payload", None]
    assert all(json.loads(r["answer"])["results"]["safe"] for r in out if r["error"] is None) and rows.columns == list(out[0].asDict())[:4]


def test_later_judges_see_only_what_is_safe(spark, judge):
    make, calls = judge
    stages = [guard.Stage("first", "a"), guard.Stage("second", "b")]
    out = guard.remote_guards(payloads(spark, "x", "x", "has _a", "has _b", "has _a and _b", None, "down"), "p", stages, make, tries=2).orderBy("id").collect()
    assert [(r["safe"], r["blocked_by"]) for r in out] == [(True, None), (True, None), (False, "first"), (False, "second"), (False, "first"), (False, "first"), (False, "first")]
    assert [r["message"] for r in out] == [None, None, "not has _a", "not has _b", "not has _a and _b", "no payload", "OSError: no route"]
    assert calls() == sorted(["a x", "a has _a", "a has _b", "a has _a and _b", "a down", "a down", "b x", "b has _b"])
    assert guard.remote_guards(payloads(spark, "x"), "p", [], make).first()["safe"]
    assert guard.remote_guards(payloads(spark, "x").limit(0), "p", stages, make).count() == 0


def test_chunks_roll_up_to_texts(spark, judge):
    make, calls = judge
    texts = ["q w e r t z u", "q w e bad_a t z bad_a2", None, " ", "q w e r t z u"]
    rows = spark.createDataFrame([(7, t, "own") for t in texts], "id int, text string, hash string")
    out = guard.guard_chunks(rows, "text", [guard.Stage("first", "a")], make, 3, 1).select("text", "safe", "blocked_by", "message", "n_chunks").collect()
    want = [(texts[0], True, None, None, 4), (texts[1], False, "first", "not e bad_a t", 4), (None, True, None, None, 0), (" ", True, None, None, 0), (texts[0], True, None, None, 4)]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    assert calls() == sorted(f"a {x}" for x in {"q w e", "e r t", "t z u", "u", "e bad_a t", "t z bad_a2", "bad_a2"})
