"""Marks of sets as packed bits."""

import numpy as np

from prismtext.llm import jaccard


def test_marks_are_read_from_packed_bits():
    rng = np.random.default_rng(1)
    plain = rng.random(1 << 12) < 0.3
    slot = rng.integers(0, 1 << 12, 5000)
    assert (jaccard._marked(np.packbits(plain), slot) == plain[slot]).all()
