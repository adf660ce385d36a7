"""Pipeline stages on hard rows with clashing columns, and operators against plain versions of their methods."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prismtext.llm import pieces as P
from prismtext.llm.common import materialize
from prismtext.llm.jaccard import jaccard_classes, op7_jaccard
from prismtext.llm.lm_score import op6_lm_score

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, evidence int, hash int, doc int, kept string, n_bytes int, copies int, copy int, starts int, _text int, ids int"
OWN = (0.5, "mine", 1, 2, 3, "k", 4, 5, 6, 7, 8, 9)


def hard_rows(seed=5):
    rnd = random.Random(seed)
    known = ["der hund und die katze laufen im garten", "the dog and the cat run in the garden", "le chien et le chat courent dans le jardin"]
    vocabulary = [line.split() for line in known]
    rows = []
    for i in range(60):
        k = i % 3
        text = " ".join(rnd.choice(vocabulary[k]) + rnd.choice(["", "", "s", "en"]) for _ in range(rnd.randint(30, 90)))
        rows.append((i, text, ["de", "en", "fr"][k], [None, "a", "b"][i % 3], len(text)))
    copy = rows[0]
    rows += [(100, copy[1], None, "a", 0), (101, copy[1], "de", "a", 0), (None, copy[1], "de", "a", 0), (None, rows[4][1], "en", None, 0), copy]
    passage = " ".join(f"gemeinsam{j}" for j in range(60))
    rows += [(110 + j, rows[3 * j][1] + " " + passage + " " + rows[3 * j + 3][1], "de", "b", 0) for j in range(3)]
    rows += [(120, None, "de", "a", None), (121, "", None, "a", 0), (122, " \n ", None, None, 3), (123, "12345 !!!", None, "b", 9), (124, " ".join(rows[1][1] for _ in range(40)), "en", "a", 0)]
    return [(*r, *OWN) for r in rows]


def repeated_bytes(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    places = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in raw]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + length] = b"\1" * length
    return [bytes(c for c, m in zip(t, g) if not m).decode("utf-8", "ignore") for t, g in zip(raw, gone)]


def test_stages_keep_own_columns(spark):
    """Every stage on nulls, copies and columns called like its own: rows are kept as plain versions say, columns unchanged."""
    docs = materialize(spark.createDataFrame(hard_rows(), SCHEMA).repartition(3), "hard")
    columns, own = docs.columns, SCHEMA.split(", ")[5:]
    own = [c.split(" ")[0] for c in own]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = materialize(stage(spark, docs, DIR), name)
        after = out.collect()
        if name == corpus_pipeline.STAGES[-1][0]:
            import public_tokenizers
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = sorted((str(r["doc_id"]), model.encode(r["text"] or "")) for r in before)
            assert sorted((str(r["doc_id"]), r["ids"]) for r in after) == want
            break
        assert out.columns == columns and all(tuple(r[c] for c in own) == OWN for r in after)
        if name == "language_id":
            kept = {r["doc_id"] for r in after}
            assert not kept & {120, 121, 122, 123} and len(after) >= 0.9 * sum(bool(re.search("[a-z]", r["text"] or "")) for r in before)
        elif name == "near_duplicates":
            texts = [r["text"] for r in after]
            assert len(set(texts)) == len(texts) and not {r["doc_id"] for r in after} & {100, 101, None}
        elif name == "repeated_passages":
            plain = repeated_bytes([r["text"] for r in before])
            assert sorted(r["text"] for r in after) == sorted(plain)
        docs = out


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, DIR).count() == 0


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_large_group_of_near_copies_equals_brute_force(spark):
    """Copies whose edits take some below the threshold to the base but not to each other; classes and links are exact."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rnd.sample(range(8), rnd.randint(0, 4)):
            words[10 * at + rnd.randint(0, 1)] = f"x{rnd.randint(0, 3)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rnd.randrange(50)}" for _ in range(40)) for _ in range(30)]
    rows = list(enumerate(texts))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in op7_jaccard(docs).collect()} == {i: find(i) for i in range(len(sets))}
    classes, links = jaccard_classes(docs)
    of = {r["set_id"]: r["doc_id"] for r in classes.collect()}
    for r in links.collect():
        a, b = sets[of[r["a"]]], sets[of[r["b"]]]
        assert linked(a, b) and (r["na"], r["nb"], r["common"]) == (len(a), len(b), len(a & b))


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    one = {r["doc_id"]: r for r in op6_lm_score(docs.repartition(1)).collect()}
    many = {r["doc_id"]: r for r in op6_lm_score(docs.repartition(7)).collect()}
    assert len(one) == docs.count() and one.keys() == many.keys()
    for i, r in one.items():
        assert abs(r["score"] - many[i]["score"]) <= 1e-6 * abs(r["score"]) and r["score"] <= 0
    trained = [r for r in one.values() if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)


def test_mixing_equals_a_plain_sum(spark):
    """A batch's scores against probabilities summed decision by decision in Python floats, and words spelt by a tree that is complete."""
    import math

    import numpy as np
    import pyarrow as pa

    from prismtext.llm import lm_score as L

    counts = np.array([50, 20, 7, 5, 5, 2])
    start, nodes, bits = L.huffman(counts)
    assert abs(sum(2.0 ** -(z - a) for a, z in zip(start, start[1:])) - 1) < 1e-12  # Kraft: the tree is complete
    texts = ["a b a c unknown a b", "", "zz zz zz ünknown"]
    h = L.read(pa.array(texts))["h"]
    keys, n = np.unique(h, return_counts=True)
    top = np.argsort(-n, kind="stable")[:3]
    shape = L.Shape(keys[top], n[top], np.ones(256, np.int64), int(n.sum()))
    size = int(shape.offset[-1])
    rng = np.random.default_rng(3)
    logit, level = rng.integers(-40, 40, size).astype(np.int8), rng.integers(0, 8, size)
    table = ((level << 8) | logit.view(np.uint8)).astype(np.uint16)
    mixers = L.Mixer(0), L.Mixer(1)
    for m in mixers:
        m.w = rng.normal(0.02, 0.01, len(m.w)).astype(np.float32)
    got, _ = L.score_batch(pa.array(texts), shape, table, mixers)
    for i, text in enumerate(texts):
        t = L.read(pa.array([text]))
        L.understand(t, shape)
        total = [0.0, 0.0]
        for kind, d in enumerate((L.word_decisions(t, shape, 0, len(t["h"])), L.byte_decisions(t, shape, 0, len(t["h"])))):
            seen = {}
            for k in range(len(d["bit"])):
                bit, gate = int(d["bit"][k]), int(d["depth"][k]) * 8 + int(level[d["slots"][2][k]])
                values = [(int(logit[s[k]]), int(level[s[k]])) for s in d["slots"]]
                if kind == 0:
                    zero, one = seen.get(int(d["node"][k]), (0, 0))
                    values.append((round(12 * math.log((one + 0.4) / (zero + 0.4))), int(min(7, math.log2(1 + zero + one)))))
                    seen[int(d["node"][k])] = (zero + (bit == 0), one + (bit == 1))
                mixed = sum(float(mixers[kind].w[(gate * len(values) + j) * 8 + c]) * s for j, (s, c) in enumerate(values))
                fine = round(mixed * 64) / 64  # nothing was calibrated
                for e, x in enumerate((fine, 0.8 * fine)):
                    total[e] -= math.log1p(math.exp(-x if bit else x))
        want = math.log(sum(math.exp(x) for x in total) / 2) / math.log(10)
        assert abs(got[i] - want) < 3e-3 * max(1, abs(want)), text


def test_viterbi_equals_the_library_on_a_unigram_model(spark, tmp_path):
    """A hand-made unigram model (nothing is trained): the sum-of-scores fold gives the library's pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rnd = random.Random(2)
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    proto.trainer_spec.byte_fallback = True
    proto.trainer_spec.vocab_size = 0
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = True

    def add(piece, score, kind):
        p = proto.pieces.add()
        p.piece, p.score, p.type = piece, score, kind

    add("<unk>", 0, pb.ModelProto.SentencePiece.UNKNOWN)
    add("<s>", 0, pb.ModelProto.SentencePiece.CONTROL)
    add("</s>", 0, pb.ModelProto.SentencePiece.CONTROL)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, pb.ModelProto.SentencePiece.BYTE)
    parts = {"▁"} | {c for c in "abcde"} | {"".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 4))) for _ in range(60)}
    parts |= {"▁" + "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 4))) for _ in range(60)}
    for i, p in enumerate(sorted(parts)):
        add(p, -rnd.uniform(2, 12) - i * 1e-4, pb.ModelProto.SentencePiece.NORMAL)
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 9))) for _ in range(40)] + ["", None, "ab  cd", "abz é ac"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.encode(docs, path=str(path)).collect():
        assert r["ids"] == model.encode(r["text"] or ""), r["text"]
    back = P.decode(P.encode(docs, path=str(path)), path=str(path)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
