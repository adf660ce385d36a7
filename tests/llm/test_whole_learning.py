"""The language model's weights and refinement learn from every training text."""

import numpy as np
import pyarrow as pa

from prismtext.llm import lm_score as L

DIR = "/root/testdata/sf0.001"


def test_every_training_text_is_learned_from(spark, monkeypatch):
    """Six shards' worth of texts, with copies; decisions that the refinement saw are those of all distinct texts."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    train = spark.createDataFrame([(t,) for t in texts + texts[:20]], "text string").repartition(5)
    size = sum(len(t.encode()) for t in texts)
    monkeypatch.setattr(L, "SHARD", size // 6)
    seen = []
    calibrate = L.Mixer.calibrate
    monkeypatch.setattr(L.Mixer, "calibrate", lambda self, n, ones: (seen.append((int(n.sum()), int(ones.sum()))), calibrate(self, n, ones))[1])
    shape, _, mixers, _ = L.fit(train)
    t = L.read(pa.array(sorted(set(texts))))
    L.understand(t, shape.value)
    for kind, of in enumerate((L.word_decisions, L.byte_decisions)):
        bit = np.concatenate([of(t, shape.value, a, z)["bit"] for a, z in L.slices(t)])
        assert seen[kind] == (len(bit), int(bit.sum()))
        assert np.isfinite(mixers[kind].w).all() and (mixers[kind].w != np.float32(0.4 / L.STEP)).sum() > 100
