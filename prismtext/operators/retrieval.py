"""Chunks of texts, their vectors, exact search by inner product, and context for a prompt."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prismtext.operators.mask import free
from prismtext.storage import committed, numbered, read_batches, stored, write_batch

#: Fixed value: the words that introduce the context.
CONTEXT_HEAD = "If the context below will help answer the above question, use it.\n    Context separated with double enter:"
#: Bytes of query vectors up to which they are sent to every task; more queries go in several rounds.
QUERY_BYTES = 64 << 20
#: Texts that are given to an embedder at once, whatever the size of a batch: their words are objects in the worker.
EMBED_ROWS = 1000


def windows(tokens: Column, size: int = 400, overlap: int = 100) -> Column:
    """array of struct(start, tokens): windows that begin every ``size - overlap`` tokens; the last ones may be short."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, size).alias("tokens")))


def chunks(df: DataFrame, key: str, text: str, size: int = 400, overlap: int = 100) -> DataFrame:
    """key, chunk_no (from 0 in each text), chunk: windows of white-space tokens of the cleaned text."""
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+"), lambda t: t != "")
    cut = df.select(key, tokens.alias("t")).select(key, F.posexplode(windows(F.col("t"), size, overlap)).alias("chunk_no", "w"))
    return cut.select(key, "chunk_no", F.array_join("w.tokens", " ").alias("chunk"))


def number_chunks(df: DataFrame, key: str, text: str, size: int = 400, overlap: int = 100) -> DataFrame:
    """key, first, chunks, text: each row with the number of its first chunk in one numbering over all rows, and how many it has.

    Rows are in order of the key (null first), then of the text's md5; rows of
    one key, and equal rows, each have chunks of their own. Chunks are counted
    from the words, before anything is cut.
    """
    words = F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))
    (count,) = free(df.columns, "chunks")
    rows = df.select(key, text).withColumn(count, F.ceil(words / (size - overlap)))
    order = [F.col(key).asc_nulls_first(), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))]
    return numbered(rows, order, "first", F.col(count)).select(key, "first", F.col(count).alias("chunks"), text)


def numbered_chunks(df: DataFrame, key: str, text: str, size: int = 400, overlap: int = 100) -> DataFrame:
    """key, chunk_no, chunk, chunk_id: the chunks of all rows in one numbering, see ``number_chunks``. Null and blank texts have none."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    rows = number_chunks(df, key, text, size, overlap).where("chunks > 0").select(key, "first", tokens.alias("t"))
    cut = rows.select(key, "first", F.posexplode(windows(F.col("t"), size, overlap)).alias("chunk_no", "w"))
    return cut.select(key, "chunk_no", F.array_join("w.tokens", " ").alias("chunk"), (F.col("first") + F.col("chunk_no")).alias("chunk_id"))


def hashed(texts: pd.Series, size: int) -> np.ndarray:
    """Unit vectors of hashed, signed word counts; only a text without words has the zero vector. Each distinct word is hashed once.

    Where the words of a text cancel each other wholly, their counts go without signs.
    """
    lists = [(t or "").lower().split() for t in texts]
    codes, words = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
    h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
    row = np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])
    at = row * size + (h % size)[codes]
    out = np.bincount(at, np.where(h >> 31, 1.0, -1.0)[codes], len(lists) * size).reshape(-1, size)
    lost = ~out.any(1)
    if lost.any():
        out[lost] = np.bincount(at, minlength=len(lists) * size).reshape(-1, size)[lost]
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(states: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> Callable[[pd.Series, int], np.ndarray]:
    """An embedder from a model of token states: ``states(texts)`` gives (texts, tokens, size) and a mask of real tokens.

    States are averaged under the mask and brought to unit length; a text without tokens has the zero vector.
    """

    def embedder(texts: pd.Series, size: int) -> np.ndarray:
        state, mask = states([t or "" for t in texts])
        weight = mask[:, :, None].astype(np.float64)
        mean = (state * weight).sum(1) / np.maximum(weight.sum(1), 1)
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        return (mean / np.where(norm > 0, norm, 1)).astype(np.float32)

    return embedder


def embed(df: DataFrame, text: str, embedder: Callable[[pd.Series, int], np.ndarray] = hashed, size: int = 64) -> DataFrame:
    """``df`` with embedding, by any function from texts to a matrix of unit rows; it is set up once per worker."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for at in range(0, len(texts), EMBED_ROWS):
                yield pd.Series(list(embedder(texts[at : at + EMBED_ROWS], size)))

    return df.withColumn("embedding", vectors(F.col(text)))


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: for each query the ``k`` rows of the largest inner product, ties by key.

    ``queries`` (query_id, vector) are a stated set, sent to the tasks in
    rounds of bounded size. Each batch of rows is reduced to its own best ``k``
    per query before anything is shuffled.
    """
    rounds: list[DataFrame] = []
    held: list[tuple] = []
    room = 0

    def one(part: list[tuple]) -> DataFrame:
        ids = np.array([q for q, _ in part], np.int64)
        matrix = np.array([v for _, v in part], np.float64).T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                rows = np.asarray(batch.column(1).values.to_numpy(zero_copy_only=False), np.float64)[batch.column(1).offsets[0].as_py() :].reshape(len(keys), -1)
                got = rows @ matrix
                best = np.lexsort((np.broadcast_to(keys[:, None], got.shape), -np.round(got, 12)), axis=0)[:k]
                column = np.broadcast_to(np.arange(len(ids)), best.shape)
                yield pa.RecordBatch.from_arrays([pa.array(ids[column].ravel()), pa.array(keys[best].ravel()), pa.array(got[best, column].ravel())], names=["query_id", key, "score"])

        return base.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, f"query_id long, {key} long, score double")

    for row in queries.select(F.col("query_id").cast("long"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").toLocalIterator():
        held.append((row[0], row[1]))
        room += 8 * len(row[1])
        if room > QUERY_BYTES:
            rounds.append(one(held))
            held, room = [], 0
    if held or not rounds:
        rounds.append(one(held) if held else base.sparkSession.createDataFrame([], f"query_id long, {key} long, score double"))
    found = rounds[0]
    for other in rounds[1:]:
        found = found.unionByName(other)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), key)))
    return ranked.where(F.col("rank") <= k)


def with_context(prompt: Column, parts: Column) -> Column:
    """The prompt with the found chunks below it; unchanged if there are none."""
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("\n\n"), F.regexp_replace(p, r"(?U)\A\s+|\s+\z", ""), F.lit("\n"))), "\n")
    block = F.concat(F.lit(CONTEXT_HEAD + "\n    \n"), F.regexp_replace(body, r"\A\s+|\s+\z", ""))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, F.concat(prompt, F.lit("\n\n"), block)).otherwise(prompt)


@dataclass(frozen=True)
class Settings:
    """How texts are cut and embedded, and where the store lies. Searching is off without a name and an embedder."""

    collection: str | None = None
    embedder: str | None = None
    folder: str | None = None
    size: int = 400
    overlap: int = 100

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "RAG_") -> Settings:
        """From environment variables: COLLECTION, EMBEDDER, PERSIST_DIR, CHUNK_SIZE, CHUNK_OVERLAP under a prefix."""
        get = lambda k: values.get(prefix + k) or None
        return cls(get("COLLECTION"), get("EMBEDDER"), get("PERSIST_DIR"), int(get("CHUNK_SIZE") or 400), int(get("CHUNK_OVERLAP") or 100))

    @property
    def enabled(self) -> bool:
        return bool(self.collection and self.embedder and self.size and self.overlap)


#: What a store keeps of each key in a batch: how many texts it has (0: it is gone), sums of their hashes, and the batch's place.
MARKS = "n long, high decimal(38,0), low decimal(38,0), place long, batch string"


def _marks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, high, low: a key's texts as sums of 60-bit parts of their hashes, which tell whether anything changed."""
    part = lambda at: F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("decimal(38,0)")
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)")
    return df.groupBy(key).agg(F.count(text).alias("n"), add(part(1)).alias("high"), add(part(16)).alias("low"))


def _kept_marks(spark: SparkSession, store: str, key: T.StructField) -> DataFrame:
    """The last word on each key."""
    kept = read_batches(spark, f"{store}/texts", T.StructType([key, *T._parse_datatype_string(MARKS).fields]))
    return kept.groupBy(key.name).agg(F.max_by(F.struct("n", "high", "low", "batch"), "place").alias("m")).select(key.name, "m.*")


def index_texts(df: DataFrame, key: str, text: str, embedder: Callable[[pd.Series, int], np.ndarray] = hashed, dims: int = 64, size: int = 400, overlap: int = 100) -> DataFrame:
    """Clear, cut, number and embed texts: (key, chunk_no, chunk, chunk_id, embedding). Null and blank texts have no chunks."""
    return embed(numbered_chunks(df, key, text, size, overlap), "chunk", embedder, dims)


def update_index(df: DataFrame, key: str, text: str, store: str, batch: str, **how) -> DataFrame:
    """Bring a store up to date with these rows, and give its chunks.

    A key's rows replace all that the store holds of it: where its texts are
    the same (however many rows they are) nothing is done, where they differ
    the old chunks no longer count and new ones are added, and where all are
    null the key goes. Other keys stay. Numbers go on after the largest ever
    given. Chunks are written before the batch's marks, and count only with
    them: a batch that was broken off is written anew, one that was ended adds
    nothing when it is run again. One batch is written at a time.
    """
    spark, field = df.sparkSession, df.schema[key]
    done = committed(spark, f"{store}/texts")
    if batch not in done:
        held = _kept_marks(spark, store, field).select(F.col(key).alias("_key"), F.struct("n", "high", "low").alias("_held"))
        now = _marks(df, key, text)
        both = now.join(held, now[key].eqNullSafe(held["_key"]), "left")
        same = F.coalesce(F.struct("n", "high", "low") == F.col("_held"), F.col("n") == 0)
        changed = stored(both.where(~same).select(key, "n", "high", "low"), "changed")
        rows = df.select(key, text).join(changed.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
        last = read_batches(spark, f"{store}/chunks", "chunk_id long", done).agg(F.max("chunk_id")).first()[0]
        fresh = index_texts(rows, key, text, **how).withColumn("chunk_id", F.col("chunk_id") + (0 if last is None else last + 1))
        write_batch(fresh, f"{store}/chunks", batch)
        write_batch(changed.withColumn("place", F.lit(len(done)).cast("long")), f"{store}/texts", batch)
    return load_store(spark, store)


def load_store(spark: SparkSession, store: str) -> DataFrame | None:
    """The chunks of a store that count, or None where there is none yet."""
    done = committed(spark, f"{store}/texts")
    if not done:
        return None
    schema = spark.read.parquet(f"{store}/chunks/{done[0]}").schema
    key = schema.fields[0]
    held = _kept_marks(spark, store, key).where("n > 0").select(F.col(key.name).alias("_key"), F.col("batch").alias("_batch"))
    rows = read_batches(spark, f"{store}/chunks", schema, done)
    return rows.join(held, rows[key.name].eqNullSafe(held["_key"]) & (rows["batch"] == held["_batch"]), "left_semi").drop("batch")


def search(store: DataFrame | None, queries: DataFrame, text: str, k: int = 10, embedder: Callable[[pd.Series, int], np.ndarray] = hashed, dims: int = 64) -> DataFrame:
    """query_id, chunk_id, score, rank, chunk: for each query text the ``k`` most similar chunks; none without a store."""
    if store is None:
        return queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int, chunk string")
    asked = embed(queries.select("query_id", text), text, embedder, dims).select("query_id", "embedding")
    return nearest(store, asked, k, "chunk_id").join(store.select("chunk_id", "chunk"), "chunk_id").select("query_id", "chunk_id", "score", "rank", "chunk")
