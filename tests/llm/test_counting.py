"""Counts of equal words and bytes under equal contexts, taken at once, equal those of every decision on its own."""

import random

import numpy as np
import pyarrow as pa

from prismtext.llm import lm_score as L


def plain(texts, shape):
    """Every decision of every token adds one to its slots; the numbers of decisions of words and of bytes."""
    table, many = np.zeros(2 * int(shape.offset[-1]), np.uint32), [0, 0]
    for column in texts:
        t = L.read(column)
        L.understand(t, shape)
        for a, z in L.slices(t):
            for kind, d in enumerate((L.word_decisions(t, shape, a, z), L.byte_decisions(t, shape, a, z))):
                many[kind] += len(d["bit"])
                for s in d["slots"]:
                    np.add.at(table, 2 * s + d["bit"], np.uint32(1))
    return table, many


def test_counts_of_equal_pairs(monkeypatch):
    rnd = random.Random(4)
    common, rare = [f"w{i}" for i in range(40)], lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 9)))
    line = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.8 else rare() for _ in range(n))
    texts = [pa.array([line(rnd.randint(0, 300)) for _ in range(20)] + ["", None, "once"]) for _ in range(4)]
    texts.append(texts[0])
    keys, n = np.unique(np.concatenate([L.read(x)["h"] for x in texts]), return_counts=True)
    shape = L.Shape(keys[n > 9], n[n > 9], np.bincount(L.read(texts[0])["raw"], minlength=256), int(n.sum()))
    want, many = plain(texts, shape)
    assert min(many) > 1000
    walked, count = [], L.count_pairs
    monkeypatch.setattr(L, "count_pairs", lambda table, shape, k, pairs, n: (walked.append((k, len(pairs), int(n.sum()))), count(table, shape, k, pairs, n)))
    for held in (1, 1000, 1 << 19):
        walked.clear()
        monkeypatch.setattr(L, "HELD", held)
        assert np.array_equal(L.count_texts(iter(texts), shape), want)
    # Held together, equal pairs go down the tree once: far fewer than there are tokens or bytes.
    assert sorted(k for k, _, _ in walked) == list(range(9)) and sum(d for _, d, _ in walked) < 0.6 * sum(n for _, _, n in walked)
    assert L.count_texts(iter([]), shape) is None
