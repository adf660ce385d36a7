"""A clustered store of vectors, and exact search in it that skips clusters by a bound.

Centroids come from a bounded sample; every row goes to its nearest centroid,
and a cluster keeps the largest distance of its rows. A row of a cluster with
centre c and radius r has an inner product with q of at most qc + |q| r. The
clusters nearest to a query give its first k rows; only clusters whose bound
reaches the k-th of these are read after that. What is left out can't be among
the first k, so the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismtext.operators.retrieval import QUERY_BYTES

#: Rows of the sample that centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 10_000, 8
#: Rounding of scores, so that ties are ties; bounds are widened by more.
DIGITS, SLACK = 12, 1e-6


def fit_centroids(rows: np.ndarray, clusters: int) -> np.ndarray:
    """Lloyd's rounds from rows far apart: each next one is the row farthest from those chosen."""
    chosen = [0]
    far = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(clusters, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    centres = rows[chosen].copy()
    for _ in range(ROUNDS):
        own = _nearest(rows, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    square = (centres**2).sum(1) - 2 * rows @ centres.T
    own = square.argmin(1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def write_clusters(base: DataFrame, store: str, clusters: int = 64, key: str = "vec_id", vector: str = "embedding") -> None:
    """Write ``store``/rows (key, vector, cluster; a folder for each cluster) and ``store``/clusters (cluster, centre, radius, n). Null vectors are left out."""
    rows = base.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    sample = rows.orderBy(F.xxhash64("key", "vector")).limit(SAMPLE).select("vector").collect()
    centres = fit_centroids(np.array([r["vector"] for r in sample], np.float64), clusters) if sample else np.zeros((1, 1))
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own, distance = _nearest(_matrix(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance), pa.array(own.astype(np.int32))], names=["key", "vector", "distance", "cluster"])

    # The rows of a cluster come from all tasks; a large cluster is written by several.
    dealt = rows.mapInArrow(run, "key long, vector array<float>, distance double, cluster int").hint("rebalance", "cluster")
    dealt.write.partitionBy("cluster").parquet(f"{store}/rows")
    written = rows.sparkSession.read.schema("key long, vector array<float>, distance double, cluster int").parquet(f"{store}/rows")
    stats = written.groupBy("cluster").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    centre = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    stats.join(centre, "cluster").coalesce(1).write.parquet(f"{store}/clusters")


def _scored(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, needed: np.ndarray, k: int) -> DataFrame:
    """query_id, key, score of the pairs of a query and a row of a cluster that it needs; of each batch a query's best ``k`` only."""
    clusters = np.flatnonzero(needed.any(0)).tolist()
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix, needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, needed = shared.value
        for batch in batches:
            if not len(batch):
                continue
            keys, own, vectors = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1))
            for cluster in np.unique(own):
                of, who = np.flatnonzero(own == cluster), np.flatnonzero(needed[:, cluster])
                got = vectors[of] @ matrix[who].T
                names = keys[of]
                best = np.lexsort((np.broadcast_to(names[:, None], got.shape), -np.round(got, DIGITS)), axis=0)[:k]
                column = np.broadcast_to(np.arange(len(who)), best.shape)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who][column].ravel()), pa.array(names[best].ravel()), pa.array(got[best, column].ravel())], names=["query_id", "key", "score"])

    return rows.where(F.col("cluster").isin(clusters)).select("key", "vector", "cluster").mapInArrow(run, "query_id long, key long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_in_clusters(spark: SparkSession, store: str, queries: DataFrame, k: int = 10, vector: str = "embedding") -> tuple[DataFrame, float]:
    """query_id, key, score, rank as a full scan gives them, and the share of the pairs of a query and a row that were skipped.

    ``queries`` (query_id, vector) are a stated set, worked on in rounds of bounded size.
    """
    stats = spark.read.parquet(f"{store}/clusters").orderBy("cluster").collect()  # a row for each centroid
    rows = spark.read.schema("key long, vector array<float>, distance double, cluster int").parquet(f"{store}/rows")
    width = 1 + max((s["cluster"] for s in stats), default=0)
    centres, radius, n = np.zeros((width, len(stats[0]["centre"]) if stats else 1)), np.full(width, -1.0), np.zeros(width, np.int64)
    for s in stats:
        centres[s["cluster"]], radius[s["cluster"]], n[s["cluster"]] = s["centre"], s["radius"], s["n"]
    found: list[DataFrame] = []
    read = asked = 0

    def one(held: list[tuple]) -> None:
        nonlocal read, asked
        ids, matrix = np.array([q for q, _ in held], np.int64), np.array([v for _, v in held], np.float64)
        near = matrix @ centres.T
        bound = near + np.linalg.norm(matrix, axis=1)[:, None] * radius * (1 + SLACK) + SLACK
        bound[:, n == 0] = -np.inf
        order = np.argsort(-np.where(n > 0, near, -np.inf), axis=1)
        enough = np.cumsum(n[order], axis=1) - n[order] < k
        first = np.zeros_like(bound, bool)
        np.put_along_axis(first, order, enough, axis=1)
        first &= n > 0
        begun = _ranked(_scored(rows, ids, matrix, first, k), k)
        least = {r["query_id"]: r["s"] for r in begun.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= k).collect()}
        least = np.array([least.get(int(q), -np.inf) for q in ids])
        rest = (bound >= least[:, None]) & ~first & (n > 0)
        found.append(begun.drop("rank"))
        if rest.any():
            found.append(_scored(rows, ids, matrix, rest, k))
        read += int(((first | rest) * n).sum())
        asked += len(ids) * int(n.sum())

    held, room = [], 0
    for q, v in queries.select(F.col("query_id").cast("long"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").toLocalIterator():
        held.append((q, v))
        room += 8 * (len(v) + width)
        if room > QUERY_BYTES:
            one(held)
            held, room = [], 0
    if held and stats:
        one(held)
    if not found:
        return spark.createDataFrame([], "query_id long, key long, score double, rank int"), 0.0
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return _ranked(every, k), 1 - read / max(asked, 1)
