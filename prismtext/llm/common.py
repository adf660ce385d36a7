"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only where the session
    leaves it unset in a local run (tests) a folder below the warehouse is used.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return where.rstrip("/")


#: Bytes of rows, about, that go to a Python worker at once while a table is materialized.
BATCH = 4 << 20


@contextmanager
def lean_batches(spark: SparkSession):
    """Within it batches for Python workers are bounded in bytes, not only in rows: each is held on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor never forces the work before this
    point to be repeated, and a table used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/prismtext-{tag}-{uuid.uuid4().hex}"
    with lean_batches(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append((path, out))
    return out


#: Folders that ``materialize`` wrote in this process, and the tables that read them.
_written: list[tuple[str, DataFrame]] = []


def written() -> int:
    """A mark for ``discard``."""
    return len(_written)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete what was materialized since ``mark``, but for the tables to ``keep``: for intermediate tables whose reader has ended."""
    for path, table in _written[mark:]:
        if not any(table is k for k in keep):
            delete(spark, path)
    _written[mark:] = [x for x in _written[mark:] if any(x[1] is k for k in keep)]


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now. It does so when the driver collects its garbage, which may be long after.

    One round is not enough: what a job has just used is let go only after it.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)


def give_back() -> None:
    """Return memory that this process holds but does not use, to the system where it has such a call."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the Python worker, which waits for other tasks, holds no memory in reserve."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return ended


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column is called so (in whatever case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pack_counts(x: np.ndarray) -> bytes:
    """Counts (at most 32 bits) as compressed planes of bytes: most high bytes are zero."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_counts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def small_join(big: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "left", most: int = 20_000) -> DataFrame:
    """Join a per-key table of ``rows`` rows to a large table.

    Up to ``most`` rows the small side is broadcast. Beyond it the small side
    is repeated under eight salts, so that one hot key is dealt to eight tasks.
    """
    if rows <= most:
        return big.join(F.broadcast(small), on, how)
    salts = 8
    salted = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in on]), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``most`` bytes of text each.

    A longer text makes a run by itself; rows are neither dropped nor cut.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, n = 0, 0
        for i, s in enumerate(size):
            if n and n + s > most:
                yield batch.slice(start, i - start)
                start, n = i, 0
            n += int(s)
        if start < len(size):
            yield batch.slice(start)


#: Turns A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for the bytes that separate words.
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text and in all."""
    blank = IS_BLANK[raw]
    start = ~blank
    first = start.copy()
    first[1:] &= blank[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(raw))]
    first[inner] = start[inner]  # a word never crosses two texts
    last = start.copy()
    last[:-1] &= blank[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    ends = ends[ends < len(raw)]
    last[ends] = start[ends]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from sums of mixed bytes over 8-byte lanes.

    Words are hashed together by length rounded up to 8 bytes, so the work is
    vectorised and words of any length are read whole.
    """
    size = ends - begins
    out = np.full(len(begins), np.uint64(0x9E3779B97F4A7C15)) ^ size.astype(np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded.tobytes(), strides=(1,)) if len(raw) else np.zeros(1, np.uint64)
    todo = np.arange(len(begins))
    at = 0
    while len(todo):
        left = size[todo] - at
        lane = lanes[begins[todo] + at]
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        short = left < 8
        lane[short] &= (np.uint64(1) << keep[short]) - np.uint64(1)
        out[todo] = mix64(out[todo] ^ lane) + np.uint64(0x9E3779B97F4A7C15)
        todo = todo[left > 8]
        at += 8
    return mix64(out)
