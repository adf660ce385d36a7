"""What finished work leaves behind: memory of Python workers, shuffle files."""

import glob
import os

import numpy as np
import pyarrow as pa

from prismtext.llm import common
from prismtext.llm.common import materialize, sweep


def test_a_worker_keeps_no_memory_in_reserve(spark):
    def held(batches):
        """The worker and the MB that it holds."""
        for _ in batches:
            pass
        mb = int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([mb])], names=["pid", "mb"])

    def scattered(batches):
        """300 MB in small blocks, of which the last stays in use, so that the allocator returns nothing by itself."""
        blocks = [np.ones(12_000) for _ in range(3_000)]
        np.kept_block = blocks[-1]
        del blocks
        yield from held(batches)

    one = spark.range(0, 1, 1, 1)
    lean = getattr(common, "lean", lambda run: run)
    (first,) = one.mapInArrow(lean(scattered), "pid long, mb long").collect()
    (then,) = one.mapInArrow(held, "pid long, mb long").collect()
    assert first["mb"] > 300
    assert then["pid"] != first["pid"] or then["mb"] < first["mb"] - 200


def test_sweep_drops_the_shuffle_files_of_what_was_written(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{root}/**/shuffle_*.data", recursive=True))
    sweep(spark)
    before = files()
    for _ in range(3):
        out = materialize(spark.range(200_000).repartition(5, "id").sortWithinPartitions("id"), "swept")
        sweep(spark)
        assert not files() - before
    assert out.count() == 200_000
