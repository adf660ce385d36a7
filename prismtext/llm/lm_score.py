"""Language-model scoring by online logistic context mixing.

A text is a row of tokens: lower-cased words, then one end. Every token is a
row of binary decisions. A frequent word is a path through a Huffman tree over
the ``TOP`` most frequent words; any other takes the tree's escape and is then
spelt byte by byte, each byte as a path through a tree over all byte values.

Several predictors guess each decision from counts in their own hashed context:

* of words: all of the corpus; the topic (the most frequent of the 32 words
  before, which mostly tells the language); the word before; the two words before; and the document itself, by
  counts that grow while it is read and start anew after ``SEGMENT`` words;
* of bytes: the last one, two and three with the topic, the last five, and the
  whole word so far.

Their logits are mixed by weights that a gate selects: how often each
predictor has seen its context, and how far the decision lies within the word.
Weights learn online, decision after decision in small batches, on all training
texts (each distinct one once). These are dealt by hash into shards of about
``SHARD`` bytes; a shard learns from the counts of the other half of the
training texts, which leave its own out, and the shards' weights are averaged by
how much each learned. A table of what came true for each mixed logit, added up
over all shards, refines the result, and while a text is
scored the refined and a blunter prediction are weighed anew after each block of
words by how well they did so far. The sum of the logarithms is
the probability of the token row; total bits and bits per byte follow from it.
All state is a document's own, so scores do not depend on how rows are dealt.

Counts come from all training texts: each task adds up tables, packed and
merged in two levels, so what is gathered grows with the corpus. The merged
tables grow with the number of tokens up to 2 to the power ``MOST`` slots, a bound
on memory; beyond it contexts share slots.
Word counts for the unigram base stay a Spark table; those of the ``TOP`` words
are broadcast, the others are joined.

Defined results: a null or empty text is one end token; repeated rows score
alike; a word of any length is spelt whole; without training texts every
decision is even and base counts are zero; an empty table gives an empty
result; columns other than those to keep and text are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, fold, materialize, pieces, utf8, word_hashes, words, written

#: Most frequent words: leaves of the word tree, and counts that are broadcast.
TOP = 1 << 17
#: Bits of the largest count table.
MOST = 22
#: Slots in a row of a packed table.
BLOCK = 1 << 16
#: Words of a document after which its own counts start anew; words of a block; tokens that are worked on at a time.
SEGMENT, WORDS_IN_BLOCK, SLICE = 1 << 15, 64, 8_000
#: Words, and bytes of rare words, that are held with their contexts until equal ones are counted at once.
HELD = 1 << 19
#: Bytes of text that one set of weights is learned on, about; there are as many sets as the training texts need.
SHARD = 8 << 20
#: Levels of confidence: the binary logarithm of a context's count.
LEVELS = 8
#: Bits of a rank, of which there are ``TOP`` and one.
RANK_BITS = TOP.bit_length()
#: Ranks that contexts of words tell apart; all rarer words are one.
TOPICS, BEFORE, PAIRS = 256, 4096, 1024
#: The token that ends each text, as a hash.
END = 0x0A0A0A0A
#: Steps of the logit that stored predictions have, and their number on either side of zero.
STEP = 12.0


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each leaf's path begins, and the nodes and bits of all paths."""
    n = len(counts)
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
    for node in range(n, 2 * n - 1):
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = node
        side[b] = 1
        heapq.heappush(heap, (x + y, node))
    depth = [0] * (2 * n - 1)
    for node, up in zip(range(2 * n - 3, -1, -1), parent[2 * n - 3 :: -1].tolist() if n > 1 else []):
        depth[node] = depth[up] + 1
    start = np.concatenate([[0], np.cumsum(depth[:n])])
    nodes, bits = np.zeros(start[-1], np.int32), np.zeros(start[-1], np.int8)
    at, cur = start[1:] - 1, np.arange(n)
    while len(cur) and n > 1:
        nodes[at], bits[at] = parent[cur] - n, side[cur]
        cur, at = parent[cur], at - 1
        more = cur != 2 * n - 2
        cur, at = cur[more], at[more]
    return start, nodes, bits


class Shape:
    """What is fixed before contexts are counted: the vocabulary, both trees, the sizes of the tables."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bytes_: np.ndarray, tokens: int):
        order = np.argsort(keys)
        self.keys, self.rank, self.counts = keys[order], order.astype(np.int32), counts[order].astype(np.float64)
        self.leaves = len(keys)
        self.words = huffman(np.append(counts, max(1, tokens - int(counts.sum()))))
        self.bytes = huffman(bytes_)
        size = int(max(tokens, 1)).bit_length()
        # Order 0 of words is exact: a slot for each node.
        bits = [max(1, int(self.leaves).bit_length()), min(MOST - 1, size), min(MOST, size + 1), min(MOST, size + 1), min(16, size), min(18, size), min(MOST - 1, size), min(MOST - 1, size + 1), min(MOST, size + 1)]
        self.bits = bits
        self.offset = np.concatenate([[0], np.cumsum([1 << b for b in bits])]).astype(np.int64)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank by frequency of each token, ``leaves`` for one outside the vocabulary."""
        if not self.leaves:
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.keys, h), self.leaves - 1)
        return np.where(self.keys[at] == h, self.rank[at], np.int32(self.leaves))


def read(column: pa.Array) -> dict[str, np.ndarray]:
    """The tokens of a batch: hash, text, place in the text; words' bytes, where each token's word begins and ends."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    begins, ends, before = words(raw, offsets)
    n = np.diff(before)
    text = np.repeat(np.arange(len(n)), n + 1)
    first = before[:-1] + np.arange(len(n))
    place = np.arange(len(text)) - np.repeat(first, n + 1)
    stop = np.zeros(len(text), bool)
    stop[first + n] = True
    h = np.full(len(text), END, np.uint64)
    h[~stop] = word_hashes(raw, begins, ends)
    begin, end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    begin[~stop], end[~stop] = begins, ends
    blocks = n // WORDS_IN_BLOCK + 1
    head = np.concatenate([[0], np.cumsum(blocks)])
    return {"raw": raw, "h": h.view(np.int64), "text": text, "place": place, "stop": stop, "begin": begin, "end": end, "n": n, "head": head, "block": np.repeat(head[:-1], n + 1) + place // WORDS_IN_BLOCK}


def understand(t: dict[str, np.ndarray], shape: Shape) -> None:
    """Adds rank, and the contexts of words as hashes, to the tokens."""
    rank = shape.ranks(t["h"])
    place, none = t["place"], np.int32(shape.leaves)

    def back(k: int) -> np.ndarray:
        out = np.full(len(rank), none, np.int32)
        out[k:] = rank[:-k] if k else rank
        out[place < k] = none
        return out

    before, second = back(1), back(2)
    topic = before.copy()
    for k in (1, 2, 4, 8, 16):  # the least rank of twice as many words each time
        inside = place >= k
        inside[:k] = False
        topic[inside] = np.minimum(topic[inside], topic[np.flatnonzero(inside) - k])
    topic = np.minimum(topic, TOPICS).astype(np.uint32)
    one = np.minimum(before, BEFORE).astype(np.uint32) + (place == 0) * np.uint32(BEFORE + 1)
    two = np.minimum(before, PAIRS).astype(np.uint32) * np.uint32(PAIRS + 1) + np.minimum(second, PAIRS).astype(np.uint32)
    t["rank"], t["topic"] = rank, topic
    t["segment"] = (np.cumsum(place % SEGMENT == 0) - 1) * np.int64(shape.leaves + 1)
    t["contexts"] = [(topic + np.uint32(1)) * np.uint32(0x9E3779B1), (one + np.uint32(1)) * np.uint32(0x85EBCA6B), (two + np.uint32(1)) * np.uint32(0xC2B2AE35)]


def _slot(context: np.ndarray, node: np.ndarray, bits: int, offset: int) -> np.ndarray:
    s = context ^ node
    s = (s ^ (s >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    s = (s ^ (s >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (s >> np.uint32(32 - bits)).astype(np.int64) + offset


def slices(t: dict[str, np.ndarray]) -> Iterator[tuple[int, int]]:
    """Runs of tokens of about ``SLICE``; a segment of a document is never cut."""
    cut = np.append(np.flatnonzero(t["place"] % SEGMENT == 0), len(t["place"])).tolist()
    a = 0
    for z, after in zip(cut[1:], [*cut[2:], None]):
        if after is None or after - a > SLICE:
            yield a, z
            a = z


def paths(leaf: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The decisions in a tree that lead to each leaf: whose they are, bit, node, step."""
    start, nodes, bits = tree
    count = start[leaf + 1] - start[leaf]
    owner = np.repeat(np.arange(len(leaf), dtype=np.int32), count)
    before = np.cumsum(count) - count
    path = np.arange(len(owner)) + np.repeat(start[leaf] - before, count)
    step = np.arange(len(owner), dtype=np.int32) - np.repeat(before.astype(np.int32), count)
    return owner, bits.take(path), nodes.take(path), step


#: What a node of the tree of words, and of that of bytes, is multiplied by before it is mixed with a context.
NODES = np.uint32(0x27D4EB2F), np.uint32(0x9E3779B1)


def _mixed(node: np.ndarray, kind: int) -> np.ndarray:
    return (node.astype(np.uint32) + np.uint32(1)) * NODES[kind]


def word_decisions(t: dict[str, np.ndarray], shape: Shape, a: int, z: int) -> dict[str, np.ndarray]:
    """The decisions of the tokens a to z in the word tree: token, bit, node, slots, depth."""
    token, bit, node, step = paths(t["rank"][a:z], shape.words)
    token += np.int32(a)
    mixed = _mixed(node, 0)
    slots = [node.astype(np.int64), *(_slot(c.take(token, mode="clip"), mixed, shape.bits[k], int(shape.offset[k])) for k, c in enumerate(t["contexts"], 1))]
    return {"token": token, "bit": bit, "node": node, "slots": slots, "depth": np.minimum(step, 7)}


def byte_contexts(t: dict[str, np.ndarray], shape: Shape, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The bytes of words outside the vocabulary, each word closed by a blank: token, place in the word, byte, contexts."""
    rare = np.flatnonzero((t["rank"][a:z] == shape.leaves) & ~t["stop"][a:z]) + a
    size = t["end"][rare] - t["begin"][rare] + 1
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(rare)), size)
    place = np.arange(len(owner)) - first[owner]
    data = np.full(len(owner), 32, np.uint8)
    inner = place < size[owner] - 1
    data[inner] = t["raw"][(t["begin"][rare][owner] + place)[inner]]
    x = data.astype(np.uint32) + np.uint32(1)
    odd = [np.uint32(v) for v in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
    topic = (t["topic"][rare][owner] + np.uint32(1)) * np.uint32(0x7FEB352D)
    h, contexts = np.zeros(len(x), np.uint32), []
    for k in range(1, 6):
        part = np.zeros(len(x), np.uint32)
        part[k:] = x[:-k]
        part[place < k] = 0
        h = h + part * odd[k - 1]
        if k <= 3:
            contexts.append((h + topic) * np.uint32(2 * k + 1))
        elif k == 5:
            contexts.append(h * np.uint32(11))
    # The whole word so far: differences of a running sum of weighted bytes.
    power = np.cumprod(np.full(256, np.uint32(0x01000193)), dtype=np.uint32)
    run = np.concatenate([[0], np.cumsum((x * odd[0] ^ (x << np.uint32(9))) * power[place & 255], dtype=np.uint32)]).astype(np.uint32)
    contexts.append((run[:-1] - run[first][owner]) * odd[3] + place.astype(np.uint32) * odd[1])
    return rare[owner].astype(np.int32), place, data, contexts


def byte_decisions(t: dict[str, np.ndarray], shape: Shape, a: int, z: int) -> dict[str, np.ndarray]:
    """The decisions of the bytes of words outside the vocabulary."""
    token, place, data, contexts = byte_contexts(t, shape, a, z)
    byte, bit, node, _ = paths(data.astype(np.int64), shape.bytes)
    mixed = _mixed(node, 1)
    slots = [_slot(c.take(byte, mode="clip"), mixed, shape.bits[4 + k], int(shape.offset[4 + k])) for k, c in enumerate(contexts)]
    return {"token": token[byte], "bit": bit, "slots": slots, "depth": np.minimum(place[byte], 7)}


def own_counts(d: dict[str, np.ndarray], t: dict[str, np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """How often the document's segment chose one and zero at each decision's node before."""
    key = t["segment"][d["token"]]
    key += d["node"] - (key[0] if len(key) else 0)
    # Sorted with its place behind it, a key needs no stable sort.
    wide = max(1, int(len(key)).bit_length())
    both = np.sort((key << wide) | np.arange(len(key)))
    ordered, order = both >> wide, both & ((1 << wide) - 1)
    bit = d["bit"][order].astype(np.int32)
    begin = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(order)))
    ones = np.cumsum(bit, dtype=np.int32) - bit
    ones -= np.repeat(ones[begin], size)
    seen = np.arange(len(order), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    n1, n0 = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
    n1[order], n0[order] = ones, seen - ones
    return n0, n1


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The logit (in steps, low byte) and the confidence (high byte) of counts."""
    few = (n0 < SMALL) & (n1 < SMALL)
    out = TABLE.take(np.where(few, n0 * SMALL + n1, 0), mode="clip")
    many = np.flatnonzero(~few)
    if len(many):
        out[many] = _stretch(n0[many], n1[many])
    return out


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    logit = np.log((n1.astype(np.float32) + np.float32(0.4)) / (n0.astype(np.float32) + np.float32(0.4)))
    seen = n0.astype(np.float32) + n1.astype(np.float32)
    level = np.minimum(np.log2(1 + seen), LEVELS - 1).astype(np.uint16)
    return (level << 8) | np.clip(np.rint(logit * STEP), -127, 127).astype(np.int8).view(np.uint8)


#: Both for small counts.
SMALL = 64
TABLE = _stretch(np.repeat(np.arange(SMALL), SMALL), np.tile(np.arange(SMALL), SMALL))


def inputs(d: dict[str, np.ndarray], t: dict[str, np.ndarray], shape: Shape, table: np.ndarray, kind: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Each predictor's logit (in steps) and the place of its weight; and the gate of the refinement."""
    found = [table.take(s) for s in d["slots"]]
    if kind == 0:
        found.append(stretch(*own_counts(d, t, shape)))
    level = [x >> np.uint16(8) for x in found]
    # The gate: how far the decision lies within the word, and how often the third predictor saw its context.
    gate = d["depth"].astype(np.int32) * LEVELS + level[2]
    base = gate * (len(found) * LEVELS)
    return [x.astype(np.int8) for x in found], [base + (c + np.uint16(k * LEVELS)) for k, c in enumerate(level)], gate


PREDICTORS = (5, 5)
#: What each weight's sum of squared gradients starts from.
START = 1e-3
#: Buckets of the refinement for each gate.
BUCKETS = 33


class Mixer:
    """Gated weights and the refinement table of one kind of decisions."""

    def __init__(self, kind: int):
        k = PREDICTORS[kind]
        self.w = np.full(8 * LEVELS * k * LEVELS, 0.4 / STEP, np.float32)
        self.sum = np.full(len(self.w), START, np.float64)
        self.fix = np.tile(np.linspace(-8, 8, BUCKETS, dtype=np.float32), 8 * LEVELS)

    def mix(self, st: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(st[0]), np.float32)
        for s, p in zip(st, place):
            out += self.w.take(p, mode="clip") * s
        return np.clip(out, -12, 12)

    def learn(self, st: list[np.ndarray], place: list[np.ndarray], bit: np.ndarray, rate: float = 0.01) -> np.ndarray:
        """One pass, in steps of 4,096 decisions; each weight has a rate of its own that falls with its gradients. The logits before each step."""
        out, k = np.zeros(len(bit), np.float32), len(st)
        for a in range(0, len(bit), 4096):
            n = min(4096, len(bit) - a)
            # Predictors have weights of their own, so all gradients are added up at once.
            at = np.concatenate([p[a : a + n] for p in place])
            x = np.concatenate([s[a : a + n] for s in st]).astype(np.float32).reshape(k, n)
            mixed = np.clip((self.w.take(at).reshape(k, n) * x).sum(axis=0), -12, 12)
            out[a : a + n] = mixed
            x *= bit[a : a + n] - 1 / (1 + np.exp(-mixed))
            g = np.bincount(at, x.ravel(), len(self.w)) / STEP
            self.sum += g * g
            self.w += (rate * g / np.sqrt(self.sum)).astype(np.float32)
        return out

    def bucket(self, logit: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.rint(np.clip(logit, -8, 8) * 2)
        return gate * BUCKETS + b.astype(np.int32) + BUCKETS // 2, logit - b / 2

    def outcomes(self, logit: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """For each bucket how many decisions it had, and how many of them were one."""
        at, _ = self.bucket(logit, gate)
        return np.stack([np.bincount(at, minlength=len(self.fix)), np.bincount(at, bit, len(self.fix))])

    def calibrate(self, n: np.ndarray, ones: np.ndarray) -> None:
        p = 1 / (1 + np.exp(-np.tile(np.linspace(-8, 8, BUCKETS), 8 * LEVELS)))
        self.fix = np.log((ones + 200 * p) / (n - ones + 200 * (1 - p))).astype(np.float32)

    def fine(self) -> np.ndarray:
        """The refined logit in 64ths for each gate and mixed logit in 32nds, from -12 to 12."""
        grid = np.arange(-GRID, GRID + 1, dtype=np.float32) / 32
        at, rest = self.bucket(np.tile(grid, 8 * LEVELS), np.repeat(np.arange(8 * LEVELS), len(grid)))
        return np.rint(np.clip(self.fix[at] + rest, -12, 12) * 64).astype(np.int16)


#: Steps of the mixed logit on either side of zero, and the cost of a refined logit (in 64ths) against what came true: as it is, and blunter.
GRID = 12 * 32
COST = [np.log1p(np.exp(f * np.arange(-2 * GRID, 2 * GRID + 1) / 64)) for f in (1.0, 0.8)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def _word_counts(train: DataFrame) -> DataFrame:
    """kind 0: (key, n) of words by hash; kind 1: of byte values; kind 2: bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, seen, texts, size = np.zeros(256, np.int64), [], 0, 0

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        def word_rows() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
            n = np.bincount(back, np.concatenate([y for _, y in seen]), len(keys))
            seen.clear()
            return rows(0, keys, n)

        for batch in pieces(batches, "text"):
            t = read(batch.column(0))
            values += np.bincount(t["raw"], minlength=256)
            texts, size = texts + len(batch), size + len(t["raw"])
            seen.append(np.unique(t["h"], return_counts=True))
            if len(seen) >= 64:
                yield word_rows()
        if texts:
            values[32] += sum(int(y.sum()) for _, y in seen)
            if seen:
                yield word_rows()
            yield rows(1, np.arange(256), values)
            yield rows(2, np.zeros(1), np.array([size]))

    return _rows(train).mapInArrow(run, "kind int, key long, n long")


def count_pairs(table: np.ndarray, shape: Shape, k: int, keys: np.ndarray, n: np.ndarray) -> None:
    """Add ``n`` times each to the k-th table's counts of zeros and ones: the leaves (low bits of ``keys``) under their contexts."""
    kind, low = (0, RANK_BITS) if k < 4 else (1, 8)
    for a in range(0, len(keys), SLICE):
        key = keys[a : a + SLICE]
        owner, bit, node, _ = paths(key & ((1 << low) - 1), shape.bytes if kind else shape.words)
        context = (key >> low).astype(np.uint32)
        s = _slot(context.take(owner, mode="clip"), _mixed(node, kind), shape.bits[k], int(shape.offset[k])) if k else node.astype(np.int64)
        s *= 2
        s += bit
        np.add.at(table, s, n[a : a + SLICE].astype(np.uint32).take(owner, mode="clip"))


def count_texts(texts: Iterator[pa.Array], shape: Shape) -> np.ndarray | None:
    """The counts of zeros and ones by slot over all texts; None without any.

    The decisions of a word or byte under a context depend on both alone, so equal pairs are counted and go down the tree once.
    """
    table, some = np.zeros(2 * int(shape.offset[-1]), np.uint32), False
    seen, words_, bytes_ = np.zeros(shape.leaves + 1, np.int64), [], []

    def settle(held: list[list[np.ndarray]], at: int, least: int) -> None:
        if not held or sum(len(x[0]) for x in held) < least:
            return
        for k in range(len(held[0])):
            keys = np.sort(np.concatenate([x[k] for x in held]))
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            count_pairs(table, shape, at + k, keys[first], np.diff(np.append(first, len(keys))))
        held.clear()

    for column in texts:
        some, t = True, read(column)
        understand(t, shape)
        seen += np.bincount(t["rank"], minlength=len(seen))
        words_.append([(c.astype(np.int64) << RANK_BITS) | t["rank"] for c in t["contexts"]])
        settle(words_, 1, HELD)
        for a, z in slices(t):
            _, _, data, contexts = byte_contexts(t, shape, a, z)
            bytes_.append([(c.astype(np.int64) << 8) | data for c in contexts])
            settle(bytes_, 4, HELD)
    settle(words_, 1, 0)
    settle(bytes_, 4, 0)
    leaves = np.flatnonzero(seen)
    count_pairs(table, shape, 0, leaves, seen[leaves])
    return table if some else None


def _tables(train: DataFrame, shape) -> DataFrame:
    """(key, n, counts): packed blocks of each task's counts of zeros and ones by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = count_texts((b.column(0) for b in pieces(batches, "text")), shape.value)
        for i in range(0, len(table) if table is not None else 0, 2 * BLOCK):
            part = table[i : i + 2 * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // (2 * BLOCK)], pa.int64()), pa.array([_pack(part)], pa.binary())], names=["key", "counts"])

    return _rows(train).mapInArrow(run, "key long, counts binary")


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of 32-bit counts, compressed: most high bytes are zero."""
    raw = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(4, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _merged(blocks: DataFrame, salts: int) -> DataFrame:
    """(key, counts): the sums of all tasks' blocks, in two levels. Counts beyond 32 bits stay at the largest, which no logit tells apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(0, np.uint64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([_pack(np.minimum(total, 2**32 - 1))], pa.binary())], names=["key", "counts"])
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != key:
                    if key is not None:
                        yield out()
                    key, total = k, 0
                total = total + _unpack(raw.as_py()).astype(np.uint64)
        if key is not None:
            yield out()

    rows = blocks
    if salts > 1:
        rows = rows.withColumn("_s", F.pmod(F.xxhash64("counts"), F.lit(salts))).repartition("key", "_s").sortWithinPartitions("key").drop("_s").mapInArrow(add, "key long, counts binary")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(add, "key long, counts binary")


def _predictions(blocks: DataFrame, shape: Shape) -> np.ndarray:
    """Logit and confidence of every slot: two bytes, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x = _unpack(batch.column(1)[k].as_py()).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([stretch(x[:, 0], x[:, 1]).tobytes()], pa.binary())], names=["key", "slots"])

    out = np.zeros(int(shape.offset[-1]), np.uint16)
    for r in blocks.mapInArrow(run, "key long, slots binary").toLocalIterator():
        x = np.frombuffer(bytes(r["slots"]), np.uint16)
        out[r["key"] * BLOCK : r["key"] * BLOCK + len(x)] = x
    return out


def _learn(train: DataFrame, shards: int, shape, halves) -> tuple[Mixer, Mixer]:
    """The mixers, learned on all texts of ``train``: each shard on its own, text by text in order of their hash, by the counts of the other half."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = []
            for i, h in enumerate(batch.column(1).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, last, mixers, some = shape.value, None, None, None, False
        weighed = [np.zeros((2, len(Mixer(k).w))) for k in (0, 1)]
        outcomes = [np.zeros((2, len(Mixer(k).fix))) for k in (0, 1)]

        def close() -> None:
            for sums, m in zip(weighed, mixers or ()):
                mass = m.sum - START
                sums += mass, mass * m.w

        for batch in pieces(batches, "text"):
            of, h = (batch.column(c).to_numpy() for c in (1, 2))
            fresh = np.append(h[0] != last, h[1:] != h[:-1])  # equal texts of several tasks adjoin
            last = h[-1]
            cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()
            for a, z in zip(cuts, cuts[1:]):
                if of[a] != shard:
                    close()
                    shard, mixers, some = of[a], (Mixer(0), Mixer(1)), True
                text = batch.column(0).slice(a, z - a).filter(pa.array(fresh[a:z]))
                if not len(text):
                    continue
                t, counts = read(text), halves[1 - shard % 2].value
                understand(t, own)
                for x, y in slices(t):
                    for kind, d in enumerate((word_decisions(t, own, x, y), byte_decisions(t, own, x, y))):
                        if len(d["bit"]):
                            st, place, gate = inputs(d, t, own, counts, kind)
                            outcomes[kind] += mixers[kind].outcomes(mixers[kind].learn(st, place, d["bit"]), gate, d["bit"])
        close()
        for kind in (0, 1) if some else ():
            for what, (x, y) in enumerate((weighed[kind], outcomes[kind])):
                hit = np.flatnonzero(x)
                columns = [pa.array(np.full(len(hit), v), pa.int32()) for v in (kind, what)] + [pa.array(hit, pa.int32()), pa.array(x[hit]), pa.array(y[hit])]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "what", "slot", "x", "y"])

    rows = train.select("text", F.xxhash64("text").alias("h")).mapInArrow(distinct, "text string, h long")
    rows = rows.select("text", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h").repartition("shard").sortWithinPartitions("shard", "h", "text")
    learned = rows.mapInArrow(run, "kind int, what int, slot int, x double, y double")
    # As decimals the sums are exact, so they do not depend on how shards are dealt.
    exact = [F.sum(F.col(c).cast("decimal(28,8)")).cast("double").alias(c) for c in ("x", "y")]
    mixers = Mixer(0), Mixer(1)
    outcomes = [np.zeros((2, len(m.fix))) for m in mixers]
    for r in learned.groupBy("kind", "what", "slot").agg(*exact).collect():  # a row for each weight and bucket, whatever the input
        if r["what"]:
            outcomes[r["kind"]][:, r["slot"]] = r["x"], r["y"]
        elif r["x"] > 0:
            mixers[r["kind"]].w[r["slot"]] = r["y"] / r["x"]
    for m, (n, ones) in zip(mixers, outcomes):
        m.calibrate(n, ones)
    return mixers


def fit(train: DataFrame):
    """The shape, the predictions by slot and the mixers (all broadcast), and the word counts (key, n) as a table."""
    spark = train.sparkSession
    counted = materialize(_word_counts(train).groupBy("kind", "key").agg(F.sum("n").alias("n")), "lmcounts")
    values, size = np.zeros(256, np.int64), 0
    for r in counted.where("kind > 0").collect():  # 257 rows
        if r["kind"] == 1:
            values[r["key"]] = r["n"]
        else:
            size = r["n"]
    by_word = counted.where("kind = 0").select("key", "n")
    tokens = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = by_word.where((F.col("n") > 1) | (F.col("key") == END)).orderBy(F.desc("n"), "key").limit(TOP).collect()
    shape = Shape(np.array([r["key"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64), values, tokens)
    del top
    shared = spark.sparkContext.broadcast(shape)
    rows = _rows(train)
    # An even number of shards, so that each lies within one half.
    shards = 2 * max(1, -(-size // (2 * SHARD)))
    # Tasks' tables go to the merge by its shuffle alone; only what is merged is written.
    salts = int(max(1, rows.rdd.getNumPartitions()) ** 0.5)
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    halves = [materialize(_merged(_tables(rows.where(half == k), shared), salts), "lmhalf", "uncompressed") for k in (0, 1)]
    tables = [spark.sparkContext.broadcast(_predictions(x, shape)) for x in halves]
    mixers = _learn(rows, shards, shared, tables)
    for x in tables:
        x.unpersist()
    whole = _predictions(_merged(halves[0].unionByName(halves[1]), 1), shape)
    return shared, spark.sparkContext.broadcast(whole), mixers, by_word


def score_batch(column: pa.Array, shape: Shape, table: np.ndarray, mixers: tuple[Mixer, Mixer]) -> tuple[np.ndarray, dict]:
    """log10 probability of each text, and the tokens of the batch."""
    t = read(column)
    understand(t, shape)
    blocks = int(t["head"][-1])
    like, fine = np.zeros((2, blocks)), [m.fine() for m in mixers]
    for a, z in slices(t):
        for kind, d in enumerate((word_decisions(t, shape, a, z), byte_decisions(t, shape, a, z))):
            if not len(d["bit"]):
                continue
            st, place, gate = inputs(d, t, shape, table, kind)
            at = np.rint(mixers[kind].mix(st, place) * 32).astype(np.int32)
            at += gate * (2 * GRID + 1) + GRID
            # The decision is taken at steps of a 64th, so its two chances still add up to one.
            at = fine[kind].take(at, mode="clip") * (1 - 2 * d["bit"].astype(np.int16)) + np.int16(2 * GRID)
            block = t["block"][d["token"]]
            low = int(block[0])
            block -= low
            for e, cost in enumerate(COST):
                part = np.bincount(block, cost.take(at, mode="clip"))
                like[e, low : low + len(part)] -= part
    # Experts start alike in each text and are weighed by what they gave to its earlier blocks.
    sums = np.cumsum(like, axis=1) - like
    per = np.diff(t["head"])
    sums -= np.repeat(sums[:, t["head"][:-1]], per, axis=1)
    prior = sums - np.logaddexp.reduce(sums, axis=0)
    block = np.logaddexp.reduce(prior + like, axis=0)
    return np.bincount(np.repeat(np.arange(len(per)), per), block, len(per)) / np.log(10), t


def score(docs: DataFrame, train: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    shape, table, mixers, counted = fit(train)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    m = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shape.value
        counts = np.zeros(own.leaves + 1)
        counts[own.rank] = own.counts
        known = np.log10(counts + 0.5)
        for batch in pieces(batches, "text"):
            log, t = score_batch(batch.column(m), own, table.value, mixers)
            n, text = t["n"], t["text"]
            hit = t["rank"] < own.leaves
            base = np.bincount(text, np.where(hit, known[t["rank"]], 0.0), len(n))
            rare = np.flatnonzero(~hit)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[rare], minlength=len(n)))]), pa.int32()), pa.array(t["h"][rare]))
            size = np.bincount(text, t["end"] - t["begin"] + 1, len(n))
            columns = [pa.array(n + 1, pa.int64()), pa.array(np.bincount(text[hit], minlength=len(n)), pa.int64()), pa.array(base, pa.float64()), pa.array(log, pa.float64()), pa.array(-log / np.log10(2) / size, pa.float64()), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:m], *columns], names=[*keep, "n_tokens", "n_top", "base_top", "score", "bits_per_byte", "rare"])

    scored = rows.mapInArrow(run, f"{fields}n_tokens long, n_top long, base_top double, score double, bits_per_byte double, rare array<long>")
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "lmscored", "zstd")
    rare = scored.select("_row", F.explode("rare").alias("key")).join(counted, "key", "left")
    rest = rare.groupBy("_row").agg(F.count("n").alias("n_rest"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("base_rest"))
    whole = F.lit(float(np.log10(total["n"] + 0.5 * (total["v"] + 1))))
    return scored.drop("rare").join(rest, "_row", "left").select(
        *keep, "n_tokens", (F.col("n_top") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rest", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"), "score", "bits_per_byte")


def op6_lm_score(docs: DataFrame) -> DataFrame:
    mark = written()
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    out = materialize(score(rows, rows.where(~F.col("held_out")).select("text"), ["doc_id", "held_out"]), "lm")
    discard(docs.sparkSession, mark, out)
    return out
