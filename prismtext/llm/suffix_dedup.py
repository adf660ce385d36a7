"""Exact substring deduplication: every byte under a repeated 400-byte string goes.

The suffixes are refined bucket by bucket, as in bucket-pointer refinement:

1. Each position's bucket is named by its q-gram; a bucket of twice the length
   is named from the bucket names at i and at i + q, and the names so made are
   used again for the next doubling (1, 2, 4 ... 256 bytes). Names are 64-bit
   content hashes, so equal strings have equal names in every task without any
   exchange.
2. Only one suffix for each run of windows is sorted: the position whose 128-byte
   name is least among the 273 that a 400-byte window holds. Equal windows
   have it at the same place, so nothing is missed and a hundredth of all
   suffixes remains.
3. These suffixes are sorted by name, then by the names at later (and earlier)
   offsets that span all their windows. A bucket of one is unique and done. If
   the whole span occurs twice, all its windows repeat: done as well. Bytes go only
   where two 64-bit names agree, the suffix's and its span's or window's.
4. What stays open (a repeat begins or ends nearby) is refined to single
   windows, by the names of the 400 bytes at each offset.

Passages of over 50 words are often shorter than 400 bytes. Where they are asked
for, to be removed or to be told beside, the same is done with a text's words in
place of its bytes (names of 16 words, windows of 51): a run of 51 words that
also starts elsewhere counts from its first word to its last, whatever blanks
stand between them.

Defined results: a null text counts as empty; texts under 400 bytes are kept
whole; repeated rows are documents of their own, so a repeated text of 400
bytes or more is removed in each of its rows; matches never cross documents; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_BLANK, fresh, lean, materialize, mix64, pieces, utf8, word_hashes, words


class Unit(NamedTuple):
    """What texts are rows of; the length of a string that must not occur twice, and of the grams that name suffixes (a power of two, at most half of it)."""

    by_words: bool
    length: int
    gram: int

    @property
    def span(self) -> int:
        return self.length - self.gram + 1


BYTES, WORDS = Unit(False, 400, 128), Unit(True, 51, 16)
#: Rows up to which a join's side is broadcast, and open suffixes of one name up to which they are refined in one task.
FEW, GROUP = 5_000, 2_000
ODD, ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "name long, span long, doc long, start int, stop int, mark int, twin long"
#: Marks of a suffix: its span was seen twice in one batch (SEEN); a merged range of such spans, to be removed as it is (DONE).
SEEN, DONE = 1, 2


def double(names: np.ndarray, size: int) -> np.ndarray:
    """Names of twice the length from names of ``size`` bytes."""
    m = max(0, len(names) - size)
    x = (names[:m] * ODDER) ^ names[size:]
    return (x ^ (x >> np.uint64(32))) * ODD


def symbols(raw: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The names of single bytes or words, how many are before each text and in all, and where each begins and ends."""
    if unit.by_words:
        begins, ends, before = words(raw, offsets)
        return word_hashes(raw, begins, ends), before, begins, ends
    at = np.arange(len(raw) + 1)
    return (raw.astype(np.uint64) + np.uint64(1)) * ODD, offsets, at[:-1], at[1:]


def gram_names(names: np.ndarray, size: int) -> np.ndarray:
    """The name of the ``size`` bytes or words (a power of two) at each position, from those of single ones."""
    m = 1
    while m < size:
        names, m = double(names, m), 2 * m
    return names


def sliding_least(x: np.ndarray, wide: int) -> np.ndarray:
    """The minimum of each run of ``wide`` values, by running minima within blocks."""
    n = len(x)
    rows = np.full((-(-n // wide), wide), np.uint64(2**64 - 1))
    rows.ravel()[:n] = x
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[: n - wide + 1], behind[wide - 1 : n])


def anchors(names: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one text's names of grams: the chosen positions, and the first and last window of each."""
    least = sliding_least(names, span)
    window = np.arange(len(least))
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    # The leftmost place of each window's least name: candidates are places that are least in some window.
    edge = np.full(span - 1, np.uint64(0))
    closing = ~sliding_least(~np.concatenate([edge, least, edge]), span)
    places = np.flatnonzero(closing == names)
    at = np.searchsorted(places, window)
    own = names[places]
    late = np.flatnonzero(own[at] != least)
    while len(late):
        at[late] += 1
        late = late[own[at[late]] != least[late]]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return places[at[first]], first, np.append(first[1:], len(least)) - 1


def _suffixes(docs: DataFrame, unit: Unit) -> DataFrame:
    """(name, span, doc, start, stop, mark, twin): each chosen suffix, and the bytes that all its windows span."""
    gram, length = unit.gram, unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw, offsets = utf8(batch.column(1))
            doc, twin = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            single, bounds, begin, end = symbols(raw, offsets, unit)
            names = gram_names(single, gram)
            twice = double(names, gram)
            out = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32)]
            for i in np.flatnonzero(np.diff(bounds) >= length):
                a, z = int(bounds[i]), int(bounds[i + 1])
                own, wide = names[a : z - gram + 1], twice[a : z - 2 * gram + 1]
                place, first, last = anchors(own, unit.span)
                stop = last + length
                x = mix64((wide[first] * ODD) ^ wide[np.minimum(first + 2 * gram, stop - 2 * gram)])
                x = mix64((x * ODD) ^ wide[stop - 2 * gram] ^ ((stop - first).astype(np.uint64) << np.uint64(20)) ^ (place - first).astype(np.uint64))
                at = (begin[a + first] - offsets[i]).astype(np.int32), (end[a + stop - 1] - offsets[i]).astype(np.int32)
                for o, v in zip(out, (own[place], x, np.full(len(place), i), *at)):
                    o.append(v)
            name, span, row, start, stop = (np.concatenate(o) for o in out)
            if not len(name):
                continue
            # Of a span that a batch holds twice, one suffix stands for all; the others' bytes are known to repeat.
            _, first, back, many = np.unique(mix64(name) ^ span, return_index=True, return_inverse=True, return_counts=True)
            mark = np.where(many[back] > 1, SEEN, 0).astype(np.int32)
            other = mark > 0
            other[first] = False
            k = np.flatnonzero(other)
            new = np.ones(len(k), bool)
            new[1:] = (row[k[1:]] != row[k[:-1]]) | (start[k[1:]] > stop[k[:-1]])
            head = k[new]
            tail = k[np.append(np.flatnonzero(new)[1:], len(k)) - 1] if len(k) else k
            own = np.flatnonzero(~other)
            label = mix64(doc[row[head]].view(np.uint64) ^ (start[head].astype(np.uint64) << np.uint64(20)))
            both = np.append(own, head)
            columns = [np.concatenate([name[own], label]).view(np.int64), np.concatenate([span[own], label]).view(np.int64), doc[row[both]], start[both], np.append(stop[own], stop[tail]), np.append(mark[own], np.full(len(head), DONE, np.int32)), twin[row[both]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "span", "doc", "start", "stop", "mark", "twin"])

    return docs.mapInArrow(lean(run), SCHEMA)


def _buckets(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose name repeats, with ``repeats`` (the whole span repeats) and ``open`` (to be refined).

    The sorted suffixes are read once; a row needs only its two neighbours, so
    no bucket is gathered. A bucket's repeated span takes part in refinement by
    its first or last suffix; what a batch knew to repeat is passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(t: pa.Table, lead: int, tail: int) -> pa.RecordBatch:
            """Rows from ``lead`` on, but for the last ``tail``; the others are neighbours only."""
            name, span = t.column(0).to_numpy(), t.column(1).to_numpy()
            n = len(name)
            same, twin = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            same[1:n] = name[1:] == name[:-1]
            twin[1:n] = same[1:n] & (span[1:] == span[:-1])
            marked = t["mark"].to_numpy() > 0
            repeats = twin[:-1] | twin[1:] | marked
            opened = (same[:-1] & ~twin[:-1]) | (same[1:] & ~twin[1:])
            keep = np.flatnonzero(same[:-1] | same[1:] | marked)
            keep = keep[(keep >= lead) & (keep < n - tail)]
            out = t.take(pa.array(keep)).combine_chunks()
            columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in out.columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(repeats[keep]), pa.array(opened[keep])], names=[*t.column_names, "repeats", "open"])

        held: pa.Table | None = None
        lead = 0
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            if t.num_rows > lead + 1:
                yield judge(t, lead, 1)
                held, lead = t.slice(max(0, t.num_rows - 2)), min(1, t.num_rows - 1)
            else:
                held = t
        if held is not None:
            yield judge(held, lead, 0)

    return suffixes.repartition("name").sortWithinPartitions("name", "span").mapInArrow(lean(run), f"{SCHEMA}, repeats boolean, open boolean")


def _window_names(column: pa.Array, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of all windows of each value: names, the value each is in, and the bytes there at which it begins and ends."""
    raw, offsets = utf8(column)
    single, bounds, begin, end = symbols(raw, offsets, unit)
    twice = double(gram_names(single, unit.gram), unit.gram)
    count = np.maximum(np.diff(bounds) - unit.length + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(owner)) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    names = mix64((twice[at] * ODD) ^ twice[at + unit.length - 2 * unit.gram]) if len(at) else np.zeros(0, np.uint64)
    return names, owner, begin[at] - offsets[owner], end[at + unit.length - 1] - offsets[owner]


def _runs(hit: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit windows as (value, first offset, end offset)."""
    rows = np.flatnonzero(hit)
    if not len(rows):
        return rows, rows, rows
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows) != 1) | (owner[rows[1:]] != owner[rows[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return owner[rows[first]], begin[rows[first]], end[rows[last]]


def _refine(opened: DataFrame, unit: Unit) -> DataFrame:
    """Open suffixes (name, doc, start, bytes, twin) to repeated ranges (doc, start, stop, twin)."""

    def found(t: pa.Table) -> pa.RecordBatch:
        names, owner, begin, end = _window_names(t.column(3).combine_chunks(), unit)
        order = np.argsort(names, kind="stable")
        sorted_ = names[order]
        twin = np.zeros(len(names) + 1, bool)
        twin[1:-1] = sorted_[1:] == sorted_[:-1]
        hit = np.zeros(len(names), bool)
        hit[order] = twin[:-1] | twin[1:]
        value, first, last = _runs(hit, owner, begin, end)
        doc, start, twins = (t.column(i).to_numpy() for i in (1, 2, 4))
        return pa.RecordBatch.from_arrays([pa.array(doc[value]), pa.array((start[value] + first).astype(np.int32)), pa.array((start[value] + last).astype(np.int32)), pa.array(twins[value])], names=["doc", "start", "stop", "twin"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in pieces(batches, "bytes"):
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            name = t.column(0).to_numpy()
            cut = int(np.searchsorted(name, name[-1]))  # the last name may go on in the next batch
            if cut:
                yield found(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield found(held)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes"):
            names, owner, begin, end = _window_names(batch.column(3), unit)
            name, doc, start, twin = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            yield pa.RecordBatch.from_arrays([pa.array(name[owner]), pa.array(names.view(np.int64)), pa.array(doc[owner]), pa.array((start[owner] + begin).astype(np.int32)), pa.array((start[owner] + end).astype(np.int32)), pa.array(twin[owner])], names=["name", "window", "doc", "start", "stop", "twin"])

    large = opened.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP).select("name")
    large = materialize(large, "large")
    few = large.count()
    side = F.broadcast(large) if few <= FEW else large
    near = opened.join(side, "name", "left_anti") if few else opened
    near = near.repartition("name").sortWithinPartitions("name").select("name", "doc", "start", "bytes", "twin").mapInArrow(lean(small), "doc long, start int, stop int, twin long")
    if not few:
        return near
    # The windows of a long bucket become rows of their own, dealt by their names.
    rows = materialize(opened.join(side, "name").select("name", "doc", "start", "bytes", "twin").mapInArrow(lean(windows), "name long, window long, doc long, start int, stop int, twin long"), "windows")
    twice = rows.groupBy("name", "window").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("name", "window")
    far = rows.join(twice, ["name", "window"]).select("doc", "start", "stop", "twin")
    return near.unionByName(far)


def _ranges(rows: DataFrame, unit: Unit) -> DataFrame:
    """(doc, start, stop, twin): the bytes of ``rows`` (doc, text, twin) under strings of one unit that repeat."""
    found = materialize(_buckets(_suffixes(rows, unit)), "buckets")
    opened = found.where("open")
    few = opened.count() <= FEW
    side = opened.groupBy("doc", "twin").agg(F.collect_list(F.struct("name", "start", "stop")).alias("at"))
    inner = rows.join(F.broadcast(side) if few else side, ["doc", "twin"])
    text = F.col("text").cast("binary")
    cut = inner.select("doc", "twin", text.alias("b"), F.explode("at").alias("at")).select("at.name", "doc", "at.start", F.expr("substring(b, at.start + 1, at.stop - at.start)").alias("bytes"), "twin")
    refined = _refine(materialize(cut, "open"), unit)
    return found.where("repeats").select("doc", "start", "stop", "twin").unionByName(refined)


def repeated_ranges(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """(doc, twin, ranges) for each document that shares strings; ``docs`` has doc and twin (together a key of the row) and text; a range has the place in ``units`` of its unit."""
    rows = docs.select("doc", F.coalesce(F.col("text"), F.lit("")).alias("text"), "twin")
    ranges = reduce(DataFrame.unionByName, [_ranges(rows, u).withColumn("unit", F.lit(k)) for k, u in enumerate(units)])
    return ranges.groupBy("doc", "twin").agg(F.collect_set(F.struct("start", "stop", "unit")).alias("ranges"))


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", as_text: bool = False, names: tuple[str, ...] = ("kept", "n_bytes", "n_removed", "n_spans"), units: tuple[Unit, ...] = (BYTES,), told: tuple[Unit, ...] = (), within: tuple[Unit, ...] = ()) -> DataFrame:
    """The columns ``keep`` and under ``names`` the remaining bytes, the text's bytes, those removed and their runs, of every row.

    With ``as_text`` what remains is a string; a character that lost a byte
    goes whole. Bytes go under repeated strings of any of ``units``, and under
    those of ``within`` where a word is left over in the text; else these stay. For each of
    ``told`` two more of ``names`` are the bytes under its repeated strings in the text as it
    was, and their runs; they do not go by that. Rows are told apart by 128 bits of id and text, so a null id needs no care.
    ``keep`` must not hold a column called like one of ``names``.
    """
    doc, twin, body, starts, stops, kinds = fresh(keep, "doc", "twin", "_text", "starts", "stops", "units")
    # Two hashes of the row, of different beginnings: 128 bits, so that unlike rows are not taken for one.
    keys = F.xxhash64("doc_id", text).alias(doc), F.xxhash64(F.lit("twin"), "doc_id", text).alias(twin)
    keyed = docs.select(*keep, *keys, F.coalesce(F.col(text), F.lit("")).alias(body))
    ranges = materialize(repeated_ranges(keyed.select(F.col(doc).alias("doc"), F.col(body).alias("text"), F.col(twin).alias("twin")), (*units, *within, *told)), "ranges")
    side = ranges.select(F.col("doc").alias(doc), F.col("twin").alias(twin), F.col("ranges.start").alias(starts), F.col("ranges.stop").alias(stops), F.col("ranges.unit").alias(kinds))
    side = F.broadcast(side) if ranges.count() <= FEW else side
    rows = keyed.join(side, [doc, twin], "left").select(*keep, body, starts, stops, kinds)
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    n, removing = len(keep), len(units) + len(within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, body):
            raw, offsets = utf8(batch.column(n))
            some = batch.column(n + 1).is_valid().to_numpy(zero_copy_only=False)
            kept, counts = [], [[] for _ in range(2 + 2 * len(told))]
            for i, (a, z) in enumerate(zip(offsets[:-1], offsets[1:])):
                own = raw[a:z]
                if not some[i]:
                    kept.append(own.tobytes())
                    for c in counts:
                        c.append(0)
                    continue
                start, stop, unit = (batch.column(n + k)[i].values.to_numpy() for k in (1, 2, 3))

                def covered(of: np.ndarray) -> np.ndarray:
                    at = np.flatnonzero(of)
                    depth = np.zeros(z - a + 1, np.int64)
                    np.add.at(depth, start[at], 1)
                    np.add.at(depth, stop[at], -1)
                    return depth.cumsum()[:-1] > 0

                for t in range(1 + len(told)):
                    under = covered(unit < len(units) if t == 0 else unit == removing + t - 1)
                    if t == 0 and within:
                        more = covered(unit < removing)
                        under = more if (~more & ~IS_BLANK[own]).any() else under
                    counts[2 * t].append(int(under.sum()))
                    counts[2 * t + 1].append(int((np.diff(under.astype(np.int8), prepend=0) == 1).sum()))
                    if t == 0:
                        kept.append(own[~under].tobytes())
            if as_text:
                kept = [x.decode("utf-8", "ignore") for x in kept]
            columns = [pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(np.diff(offsets), pa.int64()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*keep, *names])

    types = ["string" if as_text else "binary", *["long"] * (len(names) - 1)]
    return rows.mapInArrow(lean(run), fields + ", ".join(f"`{c}` {k}" for c, k in zip(names, types)))


def op4_suffix_dedup(docs: DataFrame) -> DataFrame:
    """What the 400-byte strings take, and beside it the bytes and the runs under passages of over 50 words that repeat, which are often shorter."""
    cut = remove_repeats(docs.select("doc_id", "text"), ["doc_id"], names=("kept", "n_bytes", "n_removed", "n_spans", "n_passage_bytes", "n_passages"), told=(WORDS,))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes", "n_passages")
