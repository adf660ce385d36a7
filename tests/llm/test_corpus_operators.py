"""The corpus operators against plain versions in Python, on a small fixture of hard cases.

The fixture holds null and empty texts, repeated rows, exact and near copies,
a passage that documents share, ties, long texts, and columns whose names clash
with the operators' own.
"""

import hashlib
import random
import re
import zlib

import pytest

from prismtext.llm.fingerprints import op1_fingerprint
from prismtext.llm.jaccard import op7_jaccard
from prismtext.llm.langid import op9_language
from prismtext.llm.lm_score import op6_lm_score
from prismtext.llm.media import op2_media
from prismtext.llm.mixing import op10_mix
from prismtext.llm.pieces import op5_pieces
from prismtext.llm.suffix_dedup import op4_suffix_dedup
from prismtext.llm.token_files import op8_token_files
from prismtext.llm.toxicity import op3_toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, score double, doc int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture_rows():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = prose(120), prose(90)
    texts = [None, "", " \n ", "one", "one two three four five", "ONE two three four five", "x" * 3000, base, base]
    for k in range(6):
        edited = base.split()
        edited[10 * k + 3] = "changed"
        texts.append(" ".join(edited))
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(3)] + [prose(6000), "🙂 é" * 200, "12345 !!!"]
    texts += [prose(80) for _ in range(12)]
    rows = [(i, t, ["de", "en", None][i % 3], ["a", "a", "b", None][i % 4], 0, "n", 0.5, 1) for i, t in enumerate(texts)]
    return rows + [rows[7]]  # one row twice


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_jaccard_classes_equal_brute_force(docs):
    rows = fixture_rows()
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = op7_jaccard(docs)
    assert got.count() == len(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(got).items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_with_null_ids_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        for k in range(5):
            edited = list(base)
            edited[7 * k] = f"changed{k}"
            rows += [(10 * g + k, " ".join(edited), g), (None, " ".join(edited), g)]  # each text has a copy without an id
    rows += [(None, "alone " + " ".join(f"v{i}" for i in range(60)) + f" {k}", 9) for k in (1, 1, 2)]  # a class without ids
    table = spark.createDataFrame(rows, "doc_id long, text string, g int")
    got = op7_jaccard(table.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, 10 * g) for i, _, g in rows if i is not None}
    import corpus_pipeline

    kept = corpus_pipeline.near_duplicates(spark, table.unionByName(spark.createDataFrame([(None, " ", 7), (None, None, 7)], table.schema)), "").collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["g"]) for r in kept) == [(-1, 7), (-1, 7), (-1, 9), *[(10 * g, g) for g in range(6)]]


def test_suffix_dedup_equals_brute_force(docs):
    rows = fixture_rows()
    raw = [(r[1] or "").encode() for r in rows]
    places = {}
    for d, text in enumerate(raw):
        for i in range(len(text) - 399):
            places.setdefault(text[i : i + 400], []).append((d, i))
    gone = [bytearray(len(t)) for t in raw]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + 400] = b"\1" * 400
    got = by_id(op4_suffix_dedup(docs))
    for r, text, marks in zip(rows, raw, gone):
        kept = bytes(c for c, m in zip(text, marks) if not m)
        want = (len(text), sum(marks), len(re.findall(b"\1+", bytes(marks))), hashlib.sha256(kept).hexdigest())
        assert tuple(got[r[0]][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want, r[0]


def test_token_files_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    rows = sorted(op8_token_files(docs).collect(), key=lambda r: (r["doc_id"], r["start"]))
    texts = dict((r[0], r[1]) for r in fixture_rows())
    for r in rows:
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


def test_media_payload_comes_back(docs):
    got = by_id(op2_media(docs))
    for i, text, *_ in fixture_rows():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[7]["media_sha256"] == got[8]["media_sha256"] and got[7]["feature"] == got[8]["feature"]


def test_fingerprints(docs):
    got = by_id(op1_fingerprint(docs))
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[7]["near_next"] == 1.0
    assert got[0]["n_chars"] == 0 and got[1]["fingerprint"] == got[0]["fingerprint"]
    texts = {r[0]: r[1] or "" for r in fixture_rows()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order[:-1]):
        text, after = texts[i], texts[order[k + 1]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        if i not in (8, 7):  # the repeated row stands next to its copy
            assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1


def test_pieces_decode_to_the_text(docs):
    got = by_id(op5_pieces(docs))
    assert set(got) == {r[0] for r in fixture_rows()} and all(r["n_ids"] >= 0 for r in got.values())


def test_pieces_equal_sentencepiece(spark, docs):
    import public_tokenizers
    import sentencepiece

    from prismtext.llm.pieces import encode

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    hard = ["The government announced", "hello world", "  two   marks\n\n end ", "aaaaaaa aaa", "tab\there \u2581 mark", "日本語 ﬁ \U0001f642\u0301", "Übergrößenträger " * 3, "x" * 40000]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more).unionByName(spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("doc_id + 10000 AS doc_id", "text"))
    got = encode(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        assert r["ids"] == model.encode(r["text"] or ""), r["doc_id"]


def test_mix_meets_targets(docs):
    rows = op10_mix(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and len(rows) == len(fixture_rows())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op10_mix(docs).collect()))


def test_scores_base_by_hand(docs):
    import math
    from collections import Counter

    tokens = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t, *_ in fixture_rows()}
    counts = Counter()
    for i, *_ in fixture_rows():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens[i])
    total, kinds = sum(counts.values()), len(counts)
    for i, r in by_id(op6_lm_score(docs)).items():
        want = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens[i])
        assert r["train_tokens"] == total and r["n_tokens"] == len(tokens[i])
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and r["score"] <= 0


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = table.select("doc_id", "lang").collect()
    langs = {r["doc_id"]: r["lang"] for r in rows}
    got = [r for r in op9_language(table).collect() if r["held_out"] and langs[r["doc_id"]]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in got) >= 0.9 * len(got)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rated = op3_toxicity(table, labels).collect()
    assert len(rated) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rated)


def test_language_of_hard_rows(docs):
    got = by_id(op9_language(docs))
    assert got[0]["lang_pred"] == "und" and got[1]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("operator", [op1_fingerprint, op2_media, op4_suffix_dedup, op5_pieces, op6_lm_score, op7_jaccard, op8_token_files, op9_language, op10_mix])
def test_empty_table(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_toxicity_of_an_empty_table(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op3_toxicity(docs.limit(0), labels).count() == 0
    assert op3_toxicity(docs, labels).count() == len(fixture_rows())
