"""Token ids in compressed files: canonical length-limited Huffman coding.

Code lengths come from the global counts of all ids (package-merge, at most
``LIMIT`` bits), so codes follow from the lengths alone and one code book
serves all files. A file is a row of a Parquet table, so any store that Spark
can write holds it: header, bit offsets of every ``BLOCK``-th id (the
checkpoints), then the bits. Blocks decode independently; the decoder steps
through all blocks of a file at once with one table look-up an id.

Documents are in ascending id order. Ranges of ids are cut at quantiles, each
range is sorted and coded by a task of its own; ``ranges`` holds the number of
ids before each range, so no global sort or running sum is needed.

Layout of ``payload`` (little-endian): 8-byte magic ``HUFFIDS1``; uint64 first
(ids before this file in its range); uint32 ids; uint32 blocks; uint32 bit offset of each
block; code bits, most significant first, in 32-bit words.

Defined results: a null text counts as empty and has the end id alone; null
ids come first; repeated ids are ordered by their token ids; columns other than
doc_id and text are not read; an empty table writes no
file and reads as no rows.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, shared_dir, tasks

MAGIC = b"HUFFIDS1"
LIMIT, BLOCK = 18, 256
#: Ids after which a file ends (at the next document's end).
FILE_IDS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    symbols = np.flatnonzero(counts)
    n = len(symbols)
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    limit = max(limit, (n - 1).bit_length())
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, merged, is_leaf = [], leaves, np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        merged, is_leaf = both[sort], sort < n
    levels.append(is_leaf)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        chosen = is_leaf[:take]
        own = int(chosen.sum())
        depth[:own] += 1
        take = 2 * (len(chosen) - own)
    lengths[order] = depth
    return lengths


class Book:
    """Canonical codes from lengths: shorter first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.top = int(max(1, lengths.max())) if len(lengths) else 1
        ids = np.flatnonzero(lengths)
        ids = ids[np.argsort(lengths[ids], kind="stable")]
        sizes = self.lengths[ids]
        span = np.int64(1) << (self.top - sizes)
        left = np.concatenate([[0], np.cumsum(span)])
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[ids] = left[:-1] >> (self.top - sizes)
        self.symbol = np.zeros(1 << self.top, np.uint32)
        self.used = np.zeros(1 << self.top, np.uint8)
        self.symbol[: left[-1]] = np.repeat(ids, span)
        self.used[: left[-1]] = np.repeat(sizes, span)

    def encode(self, ids: np.ndarray, first: int) -> bytes:
        size, code = self.lengths[ids], self.codes[ids]
        end = np.cumsum(size)
        pos = end - size
        total = int(end[-1]) if len(end) else 0
        checkpoints = pos[::BLOCK].astype("<u4")
        words = np.zeros(total // 32 + 2, np.uint64)
        if len(ids):
            value = code.astype(np.uint64) << (64 - (pos & 31) - size).astype(np.uint64)
            word = pos >> 5
            new = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[new]] = np.add.reduceat(value >> np.uint64(32), new)
            last = np.append(new[1:], len(ids)) - 1
            words[word[last] + 1] += value[last] & np.uint64(0xFFFFFFFF)
        head = MAGIC + int(first).to_bytes(8, "little") + len(ids).to_bytes(4, "little") + len(checkpoints).to_bytes(4, "little")
        return head + checkpoints.tobytes() + words[: (total + 31) // 32].astype(">u4").tobytes()

    def decode(self, payload: bytes) -> tuple[int, np.ndarray]:
        """The number of ids before this file in its range, and its ids."""
        if payload[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        first = int.from_bytes(payload[8:16], "little")
        n, blocks = int.from_bytes(payload[16:20], "little"), int.from_bytes(payload[20:24], "little")
        pos = np.frombuffer(payload, "<u4", blocks, 24).astype(np.int64)
        raw = np.concatenate([np.frombuffer(payload, np.uint8, offset=24 + 4 * blocks), np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        out = np.zeros((BLOCK, blocks), np.uint32)
        drop = np.uint32(32 - self.top)
        whole, rest = divmod(n, BLOCK)
        for step in range(BLOCK if blocks else 0):
            if step == rest and whole < blocks:
                pos = pos[:whole]  # the last block is shorter
            if not len(pos):
                break
            peek = (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> drop
            out[step, : len(pos)] = self.symbol[peek]
            pos = pos + self.used[peek]
        return first, out.T.reshape(-1)[:n]


class Encoder:
    """A tokenizer with a memory of words, one for each Python worker.

    Where the tokenizer lower-cases and then cuts a text by a pattern into words
    that are encoded alone, a word is encoded once and remembered: its texts
    are cut here by the same pattern, and new words go to the tokenizer's model
    together. Texts with characters outside printable ASCII and Latin letters
    (for which normal forms could differ) go through the tokenizer whole.
    """

    #: Words after which no more are remembered.
    MOST = 700_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.memory: dict[str, bytes] = {}
        spec = json.loads(self.whole.to_str())
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        suffix = spec["model"].get("end_of_word_suffix")
        self.cut = None
        if steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and suffix:
            # The pattern's classes as they are among plain characters, for the faster standard matcher.
            pattern = cuts[0]["pattern"]["Regex"]
            for kind in (r"\p{L}", r"\p{N}"):
                pattern = pattern.replace(kind, "".join(re.escape(c) for c in map(chr, range(0x250)) if regex.match(kind, c)))
            self.cut = re.compile(pattern).findall
            self.plain = re.compile("[\t\n\r -~\u00c0-\u012f\u0131-\u024f]*").fullmatch
            self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)").search
            self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
            vocabulary = self.words.get_vocab()
            self.ends = np.zeros(1 + max(vocabulary.values()), bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            # Bytes as the characters that byte-level vocabularies are written in: printable ones stand for themselves.
            own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            rest = [b for b in range(256) if b not in own]
            spelt = [(chr(b) if b in own or b == 32 else chr(256 + rest.index(b))).encode() for b in range(256)]
            self.spelt = np.frombuffer(b"".join(x.ljust(2, b"\0") for x in spelt), np.uint8).reshape(256, 2)
            self.wide = np.array([len(x) > 1 for x in spelt])

    def encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, which the pattern has cut, and where each word's ids end."""
        raw = np.frombuffer(" ".join(new).encode(), np.uint8)
        keep = np.ones((len(raw), 2), bool)
        keep[:, 1] = self.wide[raw]
        ids = np.array(self.words.encode(self.spelt[raw][keep].tobytes().decode(), add_special_tokens=False).ids, "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(new):
            raise ValueError("words and their ends differ")
        return ids, at

    def split(self, texts: list[str]) -> tuple[list[int], list[list[str]]]:
        """Which texts are plain, and the words of those."""
        plain = [i for i, t in enumerate(texts) if self.cut and self.plain(t) and not self.special(t)]
        return plain, [self.cut(texts[i].lower()) for i in plain]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, cut = self.split(texts)
        got = [list(map(self.memory.get, ws)) for ws in cut]
        new = list({w for ws, ids in zip(cut, got) if None in ids for w, x in zip(ws, ids) if x is None})
        if new:
            ids, at = self.encode_words(new)
            raw, ends = ids.tobytes(), (at * 4).tolist()
            fresh = {w: raw[a:z] for w, a, z in zip(new, [0, *ends], ends)}
            got = [[fresh[w] if x is None else x for w, x in zip(ws, ids)] if None in ids else ids for ws, ids in zip(cut, got)]
            # What is common is met early. A full memory stays as it is, until so many words are new that the texts must be of another kind.
            if 4 * len(new) > sum(map(len, cut)):
                self.memory = {} if len(self.memory) > self.MOST else self.memory
            if len(self.memory) <= self.MOST:
                self.memory.update(fresh)
        for i, ids in zip(plain, got):
            out[i] = np.frombuffer(b"".join(ids), "<u4")
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else []):
            out[i] = np.array(e.ids, "<u4")
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranged(docs: DataFrame) -> DataFrame:
    """doc_id, text and the id range (part) of each row; ranges ascend."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * tasks(docs.sparkSession)
    ids = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = sorted(set(rows.agg(F.percentile_approx(ids, [(i + 1) / n for i in range(n - 1)], 100 * n).alias("c")).first()["c"] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < ids)) if cuts else F.lit(0)
    return rows.withColumn("part", part)


def _encoded(rows: DataFrame, path: str, end: int) -> DataFrame:
    """One pass over the texts: (part, doc_id, ids) of each row, and behind them the task's (id, n) counts with part null.

    Ids are kept in the fewest whole bytes that hold the vocabulary, so what is
    sorted and written on the way is smaller than the texts.
    """
    kind = rows.schema["doc_id"].dataType
    wide = _width(path, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total, own, names = encoder(path), np.zeros(1, np.int64), None, ["part", "doc_id", "ids", "id", "n"]
        for batch in pieces(batches, "text", 1 << 20):
            own = batch.column(0).type
            lists = [np.append(x, np.uint32(end)) for x in encode(batch.column(1).to_pylist())]
            n = np.bincount(np.concatenate(lists))
            if len(n) > len(total):
                total, n = n, total
            total[: len(n)] += n
            k = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int32()), batch.column(0), pa.array([x.astype(wide).tobytes() for x in lists], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names=names)
        some = np.flatnonzero(total)
        if len(some):
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, own), pa.nulls(k, pa.binary()), pa.array(some, pa.int32()), pa.array(total[some])], names=names)

    return rows.select("doc_id", "text", "part").mapInArrow(run, f"part int, doc_id {kind.simpleString()}, ids binary, id int, n long")


def _width(path: str, end: int) -> str:
    return "<u2" if max(encoder(path).whole.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = 2) -> None:
    """Encode all texts and write ``folder``/codes and ``folder``/files. Texts are tokenized once; codes follow from the counts of that pass."""
    spark = docs.sparkSession
    path = path or default_path()
    encoded = materialize(_encoded(_ranged(docs), path, end), "encoded", "zstd")
    # At most one row for each id of the vocabulary comes back.
    totals = encoded.where(F.col("part").isNull()).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([r["id"] for r in totals], default=end), np.int64)
    for r in totals:
        counts[r["id"]] = r["n"]
    lengths, wide = code_lengths(counts), _width(path, end)
    coded = spark.createDataFrame([(int(i), int(counts[i]), int(lengths[i])) for i in np.flatnonzero(counts)], "id int, n long, bits int")
    coded.coalesce(1).write.parquet(f"{folder}/codes")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, at, held, n, part = Book(lengths), 0, [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal at, n
            ids = np.concatenate([x for _, x in held])
            payload = book.encode(ids, at)
            docs = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays([d for d, _ in held]))
            sizes = pa.array([[len(x) for _, x in held]], pa.list_(pa.int32()))
            at, n = at + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), docs, sizes, pa.array([payload], pa.binary())], names=["part", "doc_ids", "sizes", "payload"])

        for batch in pieces(batches, "ids", 1 << 20):
            for i, (p, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                if p != part:
                    if held:
                        yield close()
                    part, at = p, 0
                ids = np.frombuffer(x.as_buffer(), wide).astype(np.int64)
                held.append((batch.column(1).slice(i, 1), ids))
                n += len(ids)
                if n >= FILE_IDS:
                    yield close()
        if held:
            yield close()

    dealt = encoded.where(F.col("part").isNotNull()).select("part", "doc_id", "ids").repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(code, f"part int, doc_ids array<{kind}>, sizes array<int>, payload binary").write.parquet(f"{folder}/files")
    # Where each range begins: a row for each range, from the sizes alone.
    sums = spark.read.parquet(f"{folder}/files").groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    begin = np.cumsum([0, *(r["n"] for r in sums)]).tolist()
    spark.createDataFrame([(r["part"], b) for r, b in zip(sums, begin)], "part int, first long").coalesce(1).write.parquet(f"{folder}/ranges")


def read_book(spark, folder: str) -> Book:
    rows = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(1 + max((r["id"] for r in rows), default=0), np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return Book(lengths)


def read_ids(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked) ids of every document, decoded from the files."""
    files = spark.read.parquet(f"{folder}/files")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    book = spark.sparkContext.broadcast(read_book(spark, folder))
    begin = {r["part"]: r["first"] for r in spark.read.parquet(f"{folder}/ranges").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                first, ids = book.value.decode(batch.column(2)[i].as_py())
                first += begin[batch.column(3)[i].as_py()]
                size = batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                end = np.cumsum(size)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[z - n : z]) for z, n in zip(end, size)]
                columns = [batch.column(0)[i].values, pa.array(first + end - size, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(end - size, end[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    more = ", ids array<int>" if with_ids else ""
    return files.select("doc_ids", "sizes", "payload", "part").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long{more}")


def op8_token_files(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/prismtext-ids-{uuid.uuid4().hex}"
    write_ids(docs, folder)
    return read_ids(spark, folder, with_ids=False)
