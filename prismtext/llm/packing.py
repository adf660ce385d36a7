"""Token ids packed into sequences: bounded-space online packing.

Each task tokenizes its documents and keeps ``OPEN`` windows of ``SIZE`` ids
open. Whole windows of a long document go out at once; the rest of a document
is placed where it fits best (in the window that it leaves the least room in).
Where it fits in none, the fullest window is filled up with its head and goes
out, and what is left of it is placed in turn; so windows only go out full.

At a task's end its open windows are strung together and cut anew, which leaves
less than one window of it. Those leftovers are strung together over all tasks:
sums of their lengths, a row for each task, tell every leftover its place, and
each is cut where a sequence ends. The last, incomplete sequence is cut by the
powers of two that make up its length. So nothing is padded at all, no text is
shuffled, and a task holds ``OPEN`` windows whatever its input.

Defined results: a null text counts as empty and has the end id alone; null and
repeated ids are packed row by row; rows come in the order in which they are
read; an empty table has no pieces; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pieces, small_join
from .token_files import default_path, encoder

SIZE, OPEN = 4096, 64


class Packer:
    """The windows of one task. ``full`` takes (window number, pieces) of each that goes out; a piece is (key, start, ids)."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size = size
        #: Room and number of each open window, in order, and what it holds.
        self.open: list[tuple[int, int]] = [(size, i) for i in range(most)]
        self.held: list[list[tuple]] = [[] for _ in range(most)]
        self.full: list[list[tuple]] = []

    def add(self, key: tuple, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.full.append([(key, at, ids[at : at + self.size])])
        at = whole
        while at < len(ids):
            place = bisect_left(self.open, (len(ids) - at, -1))
            at = self._put(place if place < len(self.open) else 0, key, at, ids)

    def _put(self, place: int, key: tuple, at: int, ids: np.ndarray) -> int:
        """As much as fits of the ids from ``at`` on goes to the window at this place; where they go on."""
        room, window = self.open.pop(place)
        end = min(len(ids), at + room)
        self.held[window].append((key, at, ids[at:end]))
        room -= end - at
        if not room:
            self.full.append(self.held[window])
            self.held[window], room = [], self.size
        insort(self.open, (room, window))
        return end

    def close(self) -> list[tuple]:
        """String the open windows together, fullest first; what is left after the last full one."""
        rest: list[tuple] = []
        room = self.size
        for _, window in sorted(self.open):
            for key, at, ids in self.held[window]:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    rest.append((key, at, part))
                    at, room = at + len(part), room - len(part)
                    if not room:
                        self.full.append(rest)
                        rest, room = [], self.size
        return rest


def _packed(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Pieces of each task: part (the task), window in it (null for its leftover), where the piece begins in the window, and its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, done, part = encoder(path), Packer(), 0, TaskContext.get().partitionId()

        def out(windows: list[list[tuple]], numbers: list[int | None]) -> pa.RecordBatch:
            rows = [(key, at, ids, number, begin) for window, number in zip(windows, numbers) for (key, at, ids), begin in zip(window, np.cumsum([0] + [len(x[2]) for x in window]).tolist())]
            keys, at, ids, number, begin = zip(*rows)
            columns = [pa.array([k[0] for k in keys], own), pa.array(at, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([k[1] for k in keys], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(number, pa.int64()), pa.array(begin, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids", "doc_tokens", "part", "window", "offset"])

        own = None
        for batch in pieces(batches, "text"):
            own = batch.column(0).type
            for name, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()])):
                packer.add((name, len(ids) + 1), np.append(ids, np.uint32(end)).astype("<u4"))
            if packer.full:
                yield out(packer.full, list(range(done, done + len(packer.full))))
                done += len(packer.full)
                packer.full = []
        rest = packer.close()
        windows = [*packer.full, *([rest] if rest else [])]
        if windows:
            yield out(windows, [*range(done, done + len(packer.full)), *([None] if rest else [])])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, ids binary, doc_tokens long, part int, window long, offset long")


def _cut(rest: DataFrame, size: int) -> DataFrame:
    """Leftover pieces with their place (at) among all leftovers, cut where a sequence ends; sequence counts from 0."""
    kind = rest.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, start, raw, doc_tokens, at, total in zip(*(c.to_pylist() for c in batch.columns)):
                whole = total // size * size
                powers = [1 << k for k in reversed(range(size.bit_length())) if (total - whole) >> k & 1]
                ends = np.concatenate([[whole], whole + np.cumsum(powers, dtype=np.int64)])
                while raw:
                    k = int(np.searchsorted(ends, at, side="right"))
                    sequence, begin, stop = (at // size, at // size * size, at // size * size + size) if not k else (whole // size + k - 1, int(ends[k - 1]), int(ends[k]))
                    n = min(len(raw) // 4, stop - at)
                    rows.append((name, start, raw[: 4 * n], doc_tokens, sequence, at - begin))
                    raw, start, at = raw[4 * n :], start + n, at + n
            if rows:
                names, start, ids, doc_tokens, sequence, offset = zip(*rows)
                columns = [pa.array(names, batch.column(0).type), pa.array(start, pa.int64()), pa.array(ids, pa.binary()), pa.array(doc_tokens, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids", "doc_tokens", "sequence", "offset"])

    return rest.select("doc_id", "start", "ids", "doc_tokens", "at", "total").mapInArrow(run, f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence long, offset long")


def packed(docs: DataFrame, path: str | None = None, end: int = 2) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id (from 0), offset: every piece of every document."""
    found = materialize(_packed(docs, path or default_path(), end), "packed", "zstd")
    length = (F.octet_length("ids") / 4).cast("long")
    sizes = found.groupBy("part").agg((F.coalesce(F.max("window"), F.lit(-1)) + 1).alias("windows"), F.sum(F.when(F.col("window").isNull(), length).otherwise(0)).alias("left"))
    # A row for each task of the pass above.
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    places = sizes.select(
        "part", F.coalesce(F.sum("windows").over(ahead), F.lit(0)).alias("first"), F.coalesce(F.sum("left").over(ahead), F.lit(0)).alias("ahead"), F.sum("windows").over(every).alias("all"), F.sum("left").over(every).alias("total")
    )
    places = materialize(places, "places")
    placed = small_join(found, places, ["part"], places.count(), "inner")
    full = placed.where(F.col("window").isNotNull()).select("doc_id", "start", "ids", "doc_tokens", (F.col("first") + F.col("window")).alias("sequence_id"), "offset")
    rest = placed.where(F.col("window").isNull()).withColumn("at", F.col("ahead") + F.col("offset"))
    base = places.agg(F.max("all")).first()[0] or 0
    cut = _cut(rest, SIZE).select("doc_id", "start", "ids", "doc_tokens", (F.lit(base) + F.col("sequence")).alias("sequence_id"), "offset")
    return full.unionByName(cut)


def op12_packing(docs: DataFrame) -> DataFrame:
    return packed(docs).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
