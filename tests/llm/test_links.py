"""Numbers of links within classes against all pairs by brute force."""

import random

import pytest

from prismtext.llm import jaccard
from prismtext.llm.jaccard import jaccard_classes, link_counts

from test_corpus_operators import shingles


def chained_rows():
    """Variants that drift away from their first text, lone edits, copies, rows without ids, tiny and empty texts."""
    rnd = random.Random(11)
    rows, at = [], 0
    for _ in range(4):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for k in range(30):
            rows.append((at, " ".join(words)))
            if k % 5 == 0:
                rows.append((None, " ".join(words).upper()))
            if k % 7 == 0:
                rows.append((at, " ".join(words)))
            words = list(words)
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one two"), (at + 4, "ONE two"), (at + 5, "two one"), (at + 6, "alone " * 9)]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_link_counts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    rows = chained_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes, _ = jaccard_classes(table)
    counts = {r["set_id"]: r["n_links"] for r in link_counts(table, classes).collect()}
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n"], counts.get(r["set_id"], 0)) for r in classes.collect())
    sets = [shingles(t) for _, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = sorted((-1 if i is None else i, len(s), sum(linked(s, t) for k, t in enumerate(sets) if k != j)) for j, ((i, _), s) in enumerate(zip(rows, sets)))
    assert got == want
    assert max(w[2] for w in want) > 5


def test_link_counts_of_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    classes, _ = jaccard_classes(table)
    assert link_counts(table, classes).collect() == []
