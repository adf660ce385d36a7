"""Batches of wide rows are bounded in bytes while a table is materialized."""

import pyarrow as pa

from prismtext.llm.common import BATCH, materialize


def test_batches_are_bounded_in_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "size"])

    wide = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 10000) AS text").mapInArrow(sizes, "n long, size long")
    got = materialize(wide, "sizes").collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["size"] for r in got) < 2 * BATCH
    assert spark.conf.get(key, None) == before
