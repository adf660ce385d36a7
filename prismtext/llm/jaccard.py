"""Exact Jaccard join of shingle sets, and the classes that its links form.

Sets are word shingles hashed to 64 bits, ordered alike everywhere: by hash,
with frequent shingles last. Two sets with a Jaccard index of at least T share
``LEAST`` shingles among the first n - ceil(T * n) + LEAST of each (the
prefix), so only prefixes are indexed.

The work skips along set relations:

* equal sets are one set (``set_id``) from the start;
* in the index lists each set meets the leaders of the lists; the one that it
  meets most often is its own leader, and both are compared whole. What stays
  of that answer is a bit for each shingle of the leader and the shingles that
  the leader lacks;
* from these the answers of all sets of one leader follow exactly: what two
  have in common is the common bits and the common rest. No text is read again
  and no pair is given out but the links of a spanning forest;
* lists are then read in blocks. A block is skipped where all its sets are of
  one class or of one leader, and within it groups of a leader are skipped whose
  sizes and positions cannot reach the threshold. A set that may link with a
  member of another leader's group is compared with that leader, which answers
  for the whole group as before.

Every skipped pair is either in one class already or proved below T, so the
classes are exact. ``links`` holds links that connect the classes (a spanning
subset of the join, each verified), ``set_id`` tells equal sets; pairs within a
class that connect nothing new are not listed, but ``link_counts`` decides each
of them and counts every row's links.

Frequencies come from all documents: a count sketch of 2**22 slots, merged
over all tasks; its size does not grow, and it only guides the order.

Defined results: words are runs of non-blank characters, A-Z lower-cased; a
text of fewer than five words is one shingle; a null or wordless text has an
empty set, linked with nothing; repeated rows are equal sets; rows without an
id take part, but lend no class their id; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, lean, materialize, mix64, pack_counts, pieces, sweep, unpack_counts, utf8, word_hashes, words, written
from .components import components

SHINGLE = 5
#: The threshold as a fraction.
NUM, DEN = 3, 4
SLOTS, BLOCK = 1 << 22, 1 << 16
#: Sets in one block of a long index list or of a leader's group.
LIST_BLOCK = 1024
#: Bytes of answers in one block of a class when links are counted.
BLOCK_BYTES = 32 << 20
#: Prefix shingles that two linked sets share (of small sets fewer).
LEAST = 4
#: Bits of the filter that picks the texts to compare; it only spares work.
WANTED = 1 << 24


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, text after text; and where each text's begin."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    begins, ends, before = words(raw, offsets)
    h = word_hashes(raw, begins, ends)
    many = np.diff(before)
    count = np.where(many >= n, many - n + 1, (many > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(count)), count)
    first = before[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
    stop = before[1:][owner]
    s = h[first] if len(first) else np.zeros(0, np.uint64)
    for j in range(1, n):
        next_ = first + j
        more = np.flatnonzero(next_ < stop)
        x = (s[more] + np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15)
        s[more] = (x ^ (x >> np.uint64(29))) ^ h[next_[more]]
    s = mix64(s)
    for a, z in zip(at[:-1], at[1:]):
        if z - a > 1:
            s[a:z].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def set_ids(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, from sums over its mixed hashes; 0 for an empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s + np.uint64(0x51ED27)))])
    size = np.diff(at).astype(np.uint64)
    ids = mix64((total[at[1:]] - total[at[:-1]]) ^ (size * np.uint64(0x9E3779B97F4A7C15)))
    return np.where(size > 0, ids, np.uint64(0)).view(np.int64)


def _digest(docs: DataFrame, text: str) -> DataFrame:
    """kind 0: a row for each document (doc_id, set_id, n); kind 1: blocks of the task's shingle counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "doc_id", "text_hash", "set_id", "n", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(SLOTS, np.uint32), set()
        for batch in pieces(batches, text):
            s, at = shingle_sets(batch.column(1))
            ids, n = set_ids(s, at), np.diff(at)
            new = []
            for i, x in enumerate(ids.tolist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            fresh = np.zeros(len(ids), bool)
            fresh[new] = True
            np.add.at(counts, (s[np.repeat(fresh, n)] >> np.uint64(42)).astype(np.int64), np.uint32(1))
            zero = pa.array(np.zeros(len(batch)), pa.int32())
            yield pa.RecordBatch.from_arrays([zero, batch.column(0), batch.column(2), pa.array(ids), pa.array(n, pa.int64()), pa.nulls(len(batch), pa.binary())], names=names)
        if len(seen):
            blocks = [pack_counts(counts[i : i + BLOCK]) for i in range(0, SLOTS, BLOCK)]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, batch.column(0).type), pa.nulls(k, pa.int64()), pa.array(np.arange(k), pa.int64()), pa.nulls(k, pa.int64()), pa.array(blocks, pa.binary())], names=names)

    rows = docs.select("doc_id", text, F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(lean(run), f"kind int, doc_id {kind}, text_hash long, set_id long, n long, counts binary")


def _hot_slots(blocks: DataFrame, tasks: int) -> np.ndarray:
    """A bit for each slot whose count lies far over the mean, from all tasks' counts (summed in two levels)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[b] = sums.get(b, 0) + unpack_counts(raw.as_py()).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([pack_counts(np.minimum(x, 2**32 - 1)) for x in sums.values()], pa.binary())], names=["set_id", "counts"])

    schema = "set_id long, counts binary"
    rows = blocks.select("set_id", "counts")
    salts = max(1, int(tasks**0.5))
    if salts > 1:
        rows = rows.withColumn("_s", F.pmod(F.xxhash64("counts"), F.lit(salts))).repartition("set_id", "_s").drop("_s").mapInArrow(lean(merge), schema)
    rows = rows.repartition("set_id").mapInArrow(lean(merge), schema)
    counts = np.zeros(SLOTS, np.uint64)
    for r in rows.toLocalIterator():  # SLOTS numbers, whatever the input
        counts[r["set_id"] * BLOCK : (r["set_id"] + 1) * BLOCK] = unpack_counts(bytes(r["counts"]))
    mean = float(counts.mean())
    return np.packbits(counts > mean + 8 * mean**0.5 + 4)


def prefix_size(n: np.ndarray) -> np.ndarray:
    need = (n * NUM + DEN - 1) // DEN
    return n - need + np.minimum(LEAST, need)


def _postings(docs: DataFrame, hot: np.ndarray, text: str) -> DataFrame:
    """(token, set_id, np): the prefix of each distinct set of a task; np holds size and place."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in pieces(batches, text):
            s, at = shingle_sets(batch.column(0))
            ids, n = set_ids(s, at), np.diff(at)
            token = (s >> np.uint64(1)) | (_marked(bits, (s >> np.uint64(42)).astype(np.int64)).astype(np.uint64) << np.uint64(63))
            take = prefix_size(n)
            out_t, out_s, out_n = [], [], []
            for i, x in enumerate(ids.tolist()):
                if n[i] and x not in seen:
                    seen.add(x)
                    own = token[at[i] : at[i + 1]]
                    own.sort()
                    out_t.append(own[: take[i]])
                    out_s.append(np.full(take[i], x, np.int64))
                    out_n.append((n[i] << 32) | np.arange(take[i]))
            if out_t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_t).view(np.int64)), pa.array(np.concatenate(out_s)), pa.array(np.concatenate(out_n))], names=["token", "set_id", "np"])

    return docs.select(text).mapInArrow(lean(run), "token long, set_id long, np long")


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Rows of index lists with two sets or more, each set once.

    A list is read in sorted order, a few rows at a time; no list is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether it was given out
        for batch in batches:
            t, s, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                t, s, x = np.append(held[0], t), np.append(held[1], s), np.append(held[2], x)
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            t, s, x = t[keep], s[keep], x[keep]
            same = t[1:] == t[:-1]
            shared = np.zeros(len(t), bool)
            shared[1:] |= same
            shared[:-1] |= same
            if held is not None and held[3]:
                shared[0] = False
                inside = True
            else:
                inside = False
            last = len(t) - 1
            given = bool(shared[last]) or (last == 0 and inside)
            held = (t[last:], s[last:], x[last:], given)
            out = np.flatnonzero(shared)
            if len(out):
                # The run's length in this batch tells long lists from short ones; it only guides.
                head = np.flatnonzero(np.append(True, ~same))
                run = np.repeat(np.diff(np.append(head, len(t))), np.diff(np.append(head, len(t))))
                yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(s[out]), pa.array(x[out]), pa.array(run[out])], names=["token", "set_id", "np", "k"])

    # Equal rows of copies in several tasks adjoin.
    rows = postings.repartition("token").sortWithinPartitions("token", "set_id")
    return rows.mapInArrow(lean(run), "token long, set_id long, np long, k long")


def _first_tries(lists: DataFrame) -> DataFrame:
    """For each set the leader it meets in most lists: (a: leader, b: set).

    A list's leader, for each range of sizes, is the set whose shingles stand
    in the longest lists: of many variants of a text, the least edited one.
    This is a guess at what is alike, so sets that meet in few lists are left
    to the later, exact search.
    """
    popular = lists.groupBy("set_id").agg(F.sum("k").alias("pop"))
    led = lists.join(popular, "set_id").select("token", "set_id", F.shiftright("np", 32).alias("n"), "pop")
    led = led.withColumn("bucket", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int"))
    lead = led.groupBy("token", "bucket").agg(F.max(F.struct("pop", "set_id", "n")).alias("lead"))
    around = lead.select("token", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket"), "lead")
    met = led.join(around, ["token", "bucket"]).where(F.col("lead.set_id") != F.col("set_id"))
    met = met.where((F.col("lead.n") * DEN >= F.col("n") * NUM) & (F.col("n") * DEN >= F.col("lead.n") * NUM))
    # Of two that meet, the more popular leads.
    met = met.where(F.struct(F.col("lead.pop"), F.col("lead.set_id")) > F.struct("pop", "set_id"))
    votes = met.groupBy("set_id", F.col("lead.set_id").alias("leader")).agg(F.count(F.lit(1)).alias("votes"), F.first("lead.pop").alias("pop"), F.first("n").alias("n"))
    best = votes.where(F.col("votes") * 24 >= F.col("n")).groupBy("set_id").agg(F.max(F.struct("votes", "pop", "leader")).alias("best"))
    return best.select(F.col("best.leader").alias("a"), F.col("set_id").alias("b"))


def _slot(set_id: np.ndarray) -> np.ndarray:
    return (mix64(set_id.view(np.uint64)) & np.uint64(WANTED - 1)).astype(np.int64)


def _marked(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the bits at the slots are set, in bits that stay packed."""
    return ((bits[slot >> 3] << (slot & 7)) & 128) > 0


def _wanted_texts(docs: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """(set_id, text): a text of every set of ``pairs``, and of few others; each at most once for each task."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED // 8, np.uint8)
        for batch in batches:
            for c in (0, 1):
                slot = _slot(batch.column(c).to_numpy())
                np.bitwise_or.at(bits, slot >> 3, (128 >> (slot & 7)).astype(np.uint8))
        hit = np.flatnonzero(bits.view(np.uint64))
        words = bits.view(np.int64)[hit]
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(words)], names=["at", "bits"])

    # One row at most for each 64 bits comes back: 2 MB, whatever the input.
    bits = np.zeros(WANTED // 64, np.int64)
    for r in pairs.select("a", "b").mapInArrow(lean(marks), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        bits[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in pieces(batches, text):
            ids = set_ids(*shingle_sets(batch.column(0)))
            keep = []
            for i in np.flatnonzero(_marked(bits, _slot(ids)) & (ids != 0)).tolist():
                if ids[i] not in seen:
                    seen.add(ids[i])
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), batch.column(0).take(pa.array(keep))], names=["set_id", "text"])

    return docs.select(text).mapInArrow(lean(run), "set_id long, text string")


ANSWER = "a long, b long, na long, nb long, common long, bits binary, rest binary"


def _answers(pairs: DataFrame, docs: DataFrame, text: str, least: float) -> DataFrame:
    """Each set b of ``pairs`` (a, b) compared with its leader a, on their texts.

    ``bits`` has a bit for each shingle of a, in order: whether b has it too;
    ``rest`` the shingles (64 bits each) of b that a lacks. Both are null where
    the Jaccard index is below ``least``. A leader's sets are dealt over tasks;
    its own text goes to each of them once.
    """
    texts = _wanted_texts(docs, pairs, text)
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("m"))
    of = pairs.join(size, "a").select("a", F.col("b").alias("set_id"), F.pmod(F.xxhash64("b"), F.col("m")).cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = size.select("a", F.col("a").alias("set_id"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt"), F.lit(0).alias("role"))
    rows = of.unionByName(heads).join(texts, "set_id").select("a", "salt", "role", "set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, last, head = None, None, np.zeros(0, np.uint64)
        for batch in pieces(batches, "text", 1 << 20):
            s, at = shingle_sets(batch.column(4))
            out = []
            for i, (a, role, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                own = s[at[i] : at[i + 1]]
                if not role:
                    lead, last, head = a, None, own.copy()
                elif (a, b) != last and a == lead:  # a set's text may come from several tasks
                    last = (a, b)
                    place = np.minimum(np.searchsorted(head, own), len(head) - 1)
                    both = head[place] == own
                    n = int(both.sum())
                    bits = rest = None
                    if n >= least * (len(head) + len(own) - n):
                        bits = np.zeros(len(head), bool)
                        bits[place[both]] = True
                        bits, rest = np.packbits(bits).tobytes(), own[~both].tobytes()
                    out.append((a, b, len(head), len(own), n, bits, rest))
            if out:
                kinds = [pa.int64()] * 5 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["a", "b", "na", "nb", "common", "bits", "rest"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "set_id").mapInArrow(lean(run), ANSWER)


def _forest(links: Iterator[tuple[int, int, int]], cls: np.ndarray) -> list[tuple[int, int, int]]:
    """Of links (i, j, common) those that join what is apart so far; ``cls`` are the classes at the start."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i, j, n in links:
        a, b = find(int(cls[i])), find(int(cls[j]))
        if a != b:
            root[a] = b
            out.append((i, j, n))
    return out


def _linked(bits: np.ndarray, rest: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) that ``open_`` marks those that link, and what each has in common; from the answers of one leader's sets."""
    none = (np.zeros(0, np.int64),) * 3
    inside = np.zeros((len(i), len(j)), np.float32)
    for c in range(0, bits.shape[1], 512):  # columns in slices, so that what is unpacked stays small
        inside += np.unpackbits(bits[i, c : c + 512], axis=1).astype(np.float32) @ np.unpackbits(bits[j, c : c + 512], axis=1).astype(np.float32).T
    spare = lambda x: np.array([len(rest[k]) for k in x.tolist()], np.int64)
    need = -((-NUM * (n[i][:, None] + n[j][None])) // (NUM + DEN))
    open_ = open_ & (inside + np.minimum(spare(i)[:, None], spare(j)[None]) >= need)
    p, q = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(p):
        return none
    common = inside[np.ix_(p, q)].astype(np.int64)
    rows_p, rows_q = [rest[x] for x in i[p]], [rest[x] for x in j[q]]
    tokens, at = np.unique(np.concatenate(rows_p), return_inverse=True)
    if len(tokens):
        # The rests' common part: columns are the tokens of the left side, in slices.
        mine = np.repeat(np.arange(len(p)), [len(x) for x in rows_p])
        flat = np.concatenate([np.zeros(0, np.uint64), *rows_q])
        place = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        hit = tokens[place] == flat
        theirs, place = np.repeat(np.arange(len(q)), [len(x) for x in rows_q])[hit], place[hit]
        used, place = np.unique(place, return_inverse=True)
        slot = np.full(len(tokens), -1)
        slot[used] = np.arange(len(used))
        col = slot[at]
        for c in range(0, len(used), 4096):
            wide = min(4096, len(used) - c)
            x, y = np.zeros((len(p), wide), np.float32), np.zeros((len(q), wide), np.float32)
            own = (col >= c) & (col < c + wide)
            x[mine[own], col[own] - c] = 1
            own = (place >= c) & (place < c + wide)
            y[theirs[own], place[own] - c] = 1
            common += (x @ y.T).astype(np.int64)
    u, v = np.nonzero(open_[np.ix_(p, q)] & (common >= need[np.ix_(p, q)]))
    return i[p[u]], j[q[v]], common[u, v]


def _group_links(rows: DataFrame) -> DataFrame:
    """Links (a, b, na, nb, common) between sets of one leader, from their answers alone.

    ``rows`` has list (the leader), set_id, n, bits, rest, class and moves. A
    pair counts if one of it moves and the classes differ. Large groups are cut
    into blocks; only rows that move go to blocks other than their own.
    """
    size = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("m"), F.max("moves").alias("some"))
    rows = rows.join(size.where("some").drop("some"), "list").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("m")).cast("int"))
    blocks = F.when(F.col("moves"), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array("own"))
    rows = rows.withColumn("block", F.explode(blocks)).drop("m")

    def found(t: pa.Table) -> pa.RecordBatch:
        sid, cls, n = (t[c].to_numpy() for c in ("set_id", "class", "n"))
        moves = t["moves"].to_numpy(zero_copy_only=False)
        native = t["own"].to_numpy() == t["block"].to_numpy()
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint8).reshape(len(sid), -1)
        rest = [np.frombuffer(x, np.uint64) for x in t["rest"].to_pylist()]
        left, right = np.flatnonzero(moves), np.flatnonzero(native)
        links = []
        for start in range(0, len(left), 256):
            i = left[start : start + 256]
            got = _linked(bits, rest, n, i, right, cls[i][:, None] != cls[right][None])
            links += _forest(zip(*(x.tolist() for x in got)), cls)
        links = _forest(iter(links), cls)
        i, j, c = (np.array(x, np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (sid[i], sid[j], n[i], n[j], c)], names=["a", "b", "na", "nb", "common"])

    return _each_block(rows, ["list", "block"], found, "a long, b long, na long, nb long, common long")


def _each_block(rows: DataFrame, keys: list[str], found, schema: str, short: int = 0, many=None) -> DataFrame:
    """``found`` over the rows of each block; blocks are bounded in size. Blocks of at most ``short`` rows go to ``many`` together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t[c].to_numpy() for c in keys])
            cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [t.num_rows]])
            size = np.diff(cut)
            for k in np.flatnonzero(size > max(short, 1)).tolist():
                out = found(t.slice(cut[k], size[k]))
                if len(out):
                    yield out
            some = (size > 1) & (size <= short)
            if some.any():
                yield from many(t.filter(pa.array(np.repeat(some, size))).combine_chunks(), size[some])

        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            # The last block may go on in the next batch.
            key = np.stack([held[c].to_numpy() for c in keys])
            last = np.flatnonzero((key != key[:, -1:]).any(0))
            if len(last):
                yield from close(held.slice(0, last[-1] + 1).combine_chunks())
                held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows > 1:
            yield from close(held.combine_chunks())

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)


def _more_tries(lists: DataFrame, classes: DataFrame, led: DataFrame) -> DataFrame:
    """(a: leader, b: set) where b may link with a set of a's group, or with a itself.

    Of two sets of different leaders that share prefix shingles one is to be
    tried with the other's leader: that of a group rather than a set alone, of
    equals the smaller. A set that shares too few shingles with all of a group
    is not tried.
    """
    heads = led.select(F.col("b").alias("set_id"), F.col("a").alias("lead"))
    heads = heads.union(led.select(F.col("a").alias("set_id"), F.col("a").alias("lead")).distinct().join(heads.select("set_id"), "set_id", "left_anti"))
    rows = lists.select(F.col("token").alias("list"), "set_id", "np").join(classes, "set_id", "left").join(heads, "set_id", "left")
    rows = rows.select("list", "set_id", F.coalesce("class", "set_id").alias("class"), F.coalesce("lead", "set_id").alias("lead"), F.isnull("lead").alias("alone"),
                       F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(0xFFFFFFFF).alias("place"))
    kinds = rows.groupBy("list").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("lead").alias("first"), F.max("lead").alias("last"), F.count(F.lit(1)).alias("k"))
    kinds = kinds.where((F.col("lo") != F.col("hi")) & (F.col("first") != F.col("last"))).select("list", F.ceil(F.col("k") / LIST_BLOCK).cast("int").alias("m"))
    rows = rows.join(kinds, "list").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("m")).cast("int"))
    # A row goes to each pair of blocks that its own is part of.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("m", "other")

    def found(t: pa.Table) -> pa.RecordBatch:
        sid, cls, lead, n, place, own = (t[c].to_numpy() for c in ("set_id", "class", "lead", "n", "place", "own"))
        alone = t["alone"].to_numpy(zero_copy_only=False)
        b1, b2 = t["b1"][0].as_py(), t["b2"][0].as_py()
        out = []
        for xs, ys in [(b1, b2), (b2, b1)][: 1 + (b1 != b2)]:
            x, y = np.flatnonzero(own == xs), np.flatnonzero(own == ys)
            if not len(x) or not len(y):
                continue
            groups, back = np.unique(lead[y], return_inverse=True)
            least = lambda v, big: np.minimum.reduceat(v[np.argsort(back, kind="stable")], big)
            begin = np.searchsorted(np.sort(back), np.arange(len(groups)))
            lo_c, hi_c = least(cls[y], begin), ~least(~cls[y], begin)
            lo_n, hi_n, lo_p, hi_p = least(n[y], begin), ~least(~n[y], begin), least(place[y], begin), ~least(~place[y], begin)
            single = least(alone[y].astype(np.int8), begin) > 0
            for start in range(0, len(x), 256):
                i = x[start : start + 256][:, None]
                ok = (lead[i] != groups) & ((lo_c != hi_c) | (lo_c != cls[i]))
                ok &= (single < alone[i]) | ((single == alone[i]) & (groups < lead[i]))
                ok &= (n[i] * DEN >= lo_n * NUM) & (hi_n * DEN >= n[i] * NUM)
                # No member reaches the threshold if the best size and position in the group do not.
                at = np.clip(place[i], lo_p, hi_p)
                ok &= np.minimum(place[i], at) + np.minimum(n[i] - place[i], hi_n - at) >= -((-NUM * (n[i] + lo_n)) // (NUM + DEN))
                p, q = np.nonzero(ok)
                if len(p):
                    small = np.minimum(n[i[p, 0]], lo_n[q])
                    out.append((groups[q], sid[i[p, 0]], np.minimum(LEAST, (small * NUM + DEN - 1) // DEN)))
        a, b, need = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, need)], names=["a", "b", "need"])

    def many(t: pa.Table, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All pairs of short lists at once, each set against each."""
        sid, cls, lead, n, place = (t[c].to_numpy() for c in ("set_id", "class", "lead", "n", "place"))
        alone, start = t["alone"].to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        steps = np.cumsum(sizes * sizes) // (1 << 19)
        for step in np.unique(steps):
            size, first = sizes[steps == step], start[steps == step]
            lists = np.repeat(np.arange(len(size)), size * size)
            at = np.arange(len(lists)) - np.repeat(np.cumsum(size * size) - size * size, size * size)
            x, y = first[lists] + at // size[lists], first[lists] + at % size[lists]
            ok = (cls[x] != cls[y]) & (lead[x] != lead[y]) & ((alone[y] < alone[x]) | ((alone[y] == alone[x]) & (lead[y] < lead[x])))
            x, y, lists = x[ok], y[ok], lists[ok]
            ok = np.minimum(place[x], place[y]) + np.minimum(n[x] - place[x], n[y] - place[y]) >= -((-NUM * (n[x] + n[y])) // (NUM + DEN))
            x, y, lists = x[ok], y[ok], lists[ok]
            order = np.lexsort((lead[y], sid[x], lists))
            x, y, lists = x[order], y[order], lists[order]
            # A set counts a list once for each leader.
            new = np.ones(len(x), bool)
            new[1:] = (lists[1:] != lists[:-1]) | (sid[x[1:]] != sid[x[:-1]]) | (lead[y[1:]] != lead[y[:-1]])
            head = np.flatnonzero(new)
            if len(head):
                need = np.minimum(LEAST, (np.minimum.reduceat(np.minimum(n[x], n[y]), head) * NUM + DEN - 1) // DEN)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (lead[y[head]], sid[x[head]], need)], names=["a", "b", "need"])

    met = _each_block(rows, ["list", "b1", "b2"], found, "a long, b long, need long", 64, many)
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need")).where(F.col("c") >= F.col("need")).select("a", "b")


def _grouped(answers: DataFrame, classes: DataFrame, moves) -> DataFrame:
    """Rows for ``_group_links``: a set that moves is compared with all others of its leader."""
    of = classes.select(F.col("set_id").alias("a"), F.col("class").alias("lead_class"))
    rows = answers.where(F.col("bits").isNotNull()).withColumn("set_id", F.col("b")).join(classes, "set_id", "left").join(of, "a", "left")
    rows = rows.withColumn("class", F.coalesce("class", "set_id")).withColumn("lead_class", F.coalesce("lead_class", "a"))
    return rows.select(F.col("a").alias("list"), "set_id", F.col("nb").alias("n"), "bits", "rest", "class", moves.alias("moves"))


def _link_sums(rows: DataFrame) -> DataFrame:
    """(set_id, linked): for each set the copies of all sets that link with it, from the answers of one leader.

    ``rows`` has list, set_id, n, bits, rest and copies. A class is cut into
    blocks by rows and bytes; each pair of blocks is one piece of work, which
    gives a row for each of its sets, never one for each pair.
    """
    weight = F.sum(F.length("bits") + F.length("rest")) / F.lit(BLOCK_BYTES)
    size = rows.groupBy("list").agg(F.ceil(F.greatest(F.count(F.lit(1)) / LIST_BLOCK, weight)).cast("int").alias("m"))
    rows = rows.join(size, "list").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("m", "other")

    def found(t: pa.Table) -> pa.RecordBatch:
        sid, n, copies, own = (t[c].to_numpy() for c in ("set_id", "n", "copies", "own"))
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint8).reshape(len(sid), -1)
        rest = [np.frombuffer(x, np.uint64) for x in t["rest"].to_pylist()]
        b1, b2, total = t["b1"][0].as_py(), t["b2"][0].as_py(), np.zeros(len(sid), np.int64)
        left, right = np.flatnonzero(own == b1), np.flatnonzero(own == b2)
        for start in range(0, len(left), 256):
            i = left[start : start + 256]
            p, q, _ = _linked(bits, rest, n, i, right, i[:, None] != right[None])
            total += np.bincount(p, copies[q], len(sid)).astype(np.int64)
            if b1 != b2:
                total += np.bincount(q, copies[p], len(sid)).astype(np.int64)
        hit = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(sid[hit]), pa.array(total[hit])], names=["set_id", "linked"])

    parts = _each_block(rows, ["list", "b1", "b2"], found, "set_id long, linked long")
    return parts.groupBy("set_id").agg(F.sum("linked").alias("linked"))


def link_counts(docs: DataFrame, classes: DataFrame, text: str = "text") -> DataFrame:
    """(set_id, n_links) of every set that is not empty: how many other rows of ``docs`` each row with that set is linked with.

    ``classes`` is the first result of ``jaccard_classes`` for the same rows.
    Every pair of different sets of a class is decided exactly. Each set is compared with one
    set of its class on their texts; all other pairs follow from these answers. Equal
    rows are counted, not expanded.
    """
    sets = materialize(classes.where("n > 0").groupBy("component", "set_id").agg(F.count(F.lit(1)).alias("copies")), "sets")
    heads = sets.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("copies", "set_id")).alias("head")).where("k > 1")
    pairs = materialize(sets.join(heads, "component").select(F.col("head.set_id").alias("a"), F.col("set_id").alias("b"), "copies"), "inclass")
    answers = _answers(pairs.select("a", "b"), docs, text, 0.0).select(F.col("a").alias("list"), F.col("b").alias("set_id"), F.col("nb").alias("n"), "bits", "rest")
    many = pairs.where("copies > 1").select(F.col("b").alias("set_id"), "copies")
    rows = answers.join(many, "set_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    sums = _link_sums(materialize(rows, "inanswers"))
    return sets.join(sums, "set_id", "left").select("set_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))


def jaccard_classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, set_id, n, component, class_id) of every document and links (a, b, na, nb, common) between sets that span the classes.

    ``class_id`` is null where no row of the class has an id; ``component`` tells such classes apart.
    """
    spark, mark = docs.sparkSession, written()
    first = materialize(_digest(docs, text), "digest")
    members = first.where("kind = 0").select("doc_id", "text_hash", "set_id", "n")
    parts = first.where("kind = 1")
    hot = _hot_slots(parts, max(1, parts.count() // (SLOTS // BLOCK)))
    lists = materialize(_shared_lists(_postings(docs, hot, text)), "lists")
    sweep(spark)  # the index as it was shuffled is larger than the texts
    linked = F.col("common") * (NUM + DEN) >= (F.col("na") + F.col("nb")) * NUM
    plain = ["a", "b", "na", "nb", "common"]

    def classes_of(links: DataFrame) -> DataFrame:
        return materialize(components(links.select("a", "b")).select(F.col("node").alias("set_id"), F.col("component").alias("class")), "classes")

    leaders = materialize(_first_tries(lists), "leaders")
    sweep(spark)
    tried = materialize(_answers(leaders, docs, text, 0.5), "tried")
    sweep(spark)
    led = tried.where(F.col("bits").isNotNull())
    links = tried.where(linked).select(*plain)
    classes = classes_of(links)
    # What left its leader's class is compared with all of the leader's sets.
    links = materialize(links.unionByName(_group_links(_grouped(led, classes, F.col("class") != F.col("lead_class")))), "links")
    classes = classes_of(links)
    more = materialize(_more_tries(lists, classes, led), "more")
    sweep(spark)
    again = materialize(_answers(more, docs, text, 0.0), "again")
    sweep(spark)
    moved = again.withColumn("moved", F.lit(True)).unionByName(led.join(again.select("a").distinct(), "a", "left_semi").withColumn("moved", F.lit(False)).select(*again.columns, "moved"))
    links = materialize(links.unionByName(again.where(linked).select(*plain)).unionByName(_group_links(_grouped(moved, classes, F.col("moved")))), "alllinks")
    classes = classes_of(links)
    named = members.join(classes, "set_id", "left").select("doc_id", "text_hash", "set_id", "n", F.coalesce("class", "set_id").alias("component"))
    lowest = named.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    out = named.join(lowest, "component", "left").select("doc_id", "text_hash", "set_id", "n", "component", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    out = materialize(out, "named")
    discard(spark, mark, out, links)
    sweep(spark)
    return out, links


def op7_jaccard(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links: the number of other rows that a row is linked with (0 for an empty set)."""
    docs, mark = docs.select("doc_id", "text"), written()
    classes, _ = jaccard_classes(docs)
    counts = materialize(link_counts(docs, classes), "counts")
    discard(docs.sparkSession, mark, classes, counts)
    rows = classes.join(counts, "set_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
