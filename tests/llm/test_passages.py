"""Passages of over 50 words that repeat, most of them shorter than 400 bytes: op4 tells them beside what it removes, its operator removes them if asked."""

import random
import re

from prismtext.llm import suffix_dedup
from prismtext.llm.suffix_dedup import BYTES, WORDS, op4_suffix_dedup, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(texts, length=51):
    """Brute force: the marked bytes of each text under runs of words that start more than once."""
    marks, places = [bytearray(len((t or "").encode())) for t in texts], {}
    for d, t in enumerate(texts):
        at = [(len(t[: m.start()].encode()), len(t[: m.end()].encode()), m.group()) for m in WORD.finditer(t or "")]
        for i in range(len(at) - length + 1):
            places.setdefault(tuple(w for _, _, w in at[i : i + length]), []).append((d, at[i][0], at[i + length - 1][1]))
    for found in places.values():
        for d, a, z in found if len(found) > 1 else ():
            marks[d][a:z] = b"\1" * (z - a)
    return marks


def repeated_bytes(texts, length=400):
    raw, places = [(t or "").encode() for t in texts], {}
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i : i + length], []).append((d, i))
    marks = [bytearray(len(t)) for t in raw]
    for found in places.values():
        for d, i in found if len(found) > 1 else ():
            marks[d][i : i + length] = b"\1" * length
    return marks


def rows():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6)))
    some = lambda n: [word() for _ in range(n)]
    texts = []
    for n in (49, 50, 51, 52, 60, 75, 130):  # each in two texts, with unlike words around
        passage = some(n)
        texts += [" ".join([*some(rnd.randint(0, 90)), *passage, *some(rnd.randint(0, 90))]) for _ in range(2)]
    passage = some(55)
    texts += [" ".join([*some(20), *passage]), "\n".join([*passage, *some(9)]), "  ".join([*some(3), *passage, *some(3)])]  # with other blanks
    passage = some(110)
    texts += [" ".join([*some(30), *passage[rnd.randrange(30) : 110 - rnd.randrange(30)], *some(30)]) for _ in range(25)]  # parts that overlap
    twice = some(53)
    texts += [" ".join([*some(5), *twice, *some(5), *twice]), "ab " * 70, "", None]  # within one text; a run that overlaps itself
    long = "".join(rnd.choice("xyz") for _ in range(450))
    texts += [f"{word()} {long} {word()}", f"{word()} {word()} {long}"]  # repeated bytes in one word
    texts += [texts[4], " ".join(some(51))]
    return list(enumerate(texts))


def test_passages_of_over_50_words(spark, monkeypatch):
    table = rows()
    texts = [t for _, t in table]
    by_words, by_bytes = repeated(texts), repeated_bytes(texts)
    # A passage of 50 words is none, one of 51 is, though it has fewer than 400 bytes.
    assert not any(by_words[2]) and any(by_words[4]) and any(by_words[6]) and not any(by_bytes[6]) and any(by_bytes[-4])
    runs = lambda m: (sum(m), len(re.findall(b"\1+", bytes(m))))
    told = [(*runs(b), *runs(w)) for b, w in zip(by_bytes, by_words)]
    left = [bytes(c for c, x, y in zip((t or "").encode(), b, w) if not x and not y).decode("utf-8", "ignore") for t, b, w in zip(texts, by_bytes, by_words)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)

    def check():
        got = sorted(op4_suffix_dedup(docs).select("doc_id", "n_removed", "n_spans", "n_passage_bytes", "n_passages").collect())
        assert [tuple(r)[1:] for r in got] == told
        cut = sorted(remove_repeats(docs, ["doc_id"], as_text=True, units=(BYTES, WORDS)).collect())
        assert [r["kept"] for r in cut] == left

    check()
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)  # windows of every long bucket are dealt
    monkeypatch.setattr(suffix_dedup, "FEW", 0)  # no broadcast
    check()
