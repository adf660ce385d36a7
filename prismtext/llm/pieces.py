"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut where no piece can cross: before a run of word marks and around
line breaks. For each distinct word so found

* its substrings of bounded length are exploded,
* joined to the piece table (a fixed vocabulary, so it may be broadcast),
* folded as the model's kind wants it:

  - BPE: a word's edges, which the explosion leaves together, are merged from
    single characters up. Of all neighbours whose union is an edge, those of
    the best score merge first, the leftmost of equals. A sum of scores would
    be wrong here, as they are negative merge ranks;
  - unigram: grouped by word and end and folded by ``aggregate``: for each end
    the best sum of scores of any way to reach it, kept for as many ends as the
    longest piece is wide. Ties go to the longer last piece, then the smaller
    id. An unknown character costs ten more than the worst piece.

A word is segmented once for the whole table, and no text is shuffled for it:

1. the rows of each task are packed into compressed chunks, a table bucketed by
   chunk that stays where it is;
2. each chunk asks for the codes of its distinct words: one compressed request
   for each part of the word space;
3. a part's requests meet in one task, its distinct words go through the
   lattice, and one compressed answer goes back to each chunk;
4. the answers are joined to the chunks by the bucketing, and the texts are
   spelt out by look-up.

A character that no piece holds becomes its UTF-8 bytes' pieces. Scores and
pieces are read from a model file whose path is a parameter. A model of another
kind, or a BPE model with unused or user-defined pieces, is refused.

Defined results: null and empty texts have no ids and decode to the empty
text; words of any length are segmented whole; repeated rows are encoded alike;
an empty table gives an empty result. An own column of the result's name gives
way to the result; all other columns pass unchanged, null ids included.

The chunk tables live until ``release`` drops them, since results are read from
them lazily.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, lean, lean_batches, materialize, shared_dir, tasks, utf8, word_hashes
from .common import pieces as runs

MARK = "▁"
UNITS = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Bytes of text in a chunk.
CHUNK = 8 << 20
#: Starts of substrings in one run of a word.
STEP = 64
#: Characters up to which words are merged together.
LONG = 200
#: Edges that are folded at a time.
EDGES = 200_000
#: Rank of what is no piece.
NEVER = 1 << 30
#: Code of a character that no piece holds: this bit and its code point.
UNKNOWN = 1 << 23


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table: texts, scores, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        kind, types = proto.trainer_spec.model_type, {p.type for p in proto.pieces}
        if kind not in (proto.trainer_spec.BPE, proto.trainer_spec.UNIGRAM):
            raise ValueError("neither a BPE nor a unigram model")
        self.merges = kind == proto.trainer_spec.BPE
        if self.merges and types & {proto.SentencePiece.UNUSED, proto.SentencePiece.USER_DEFINED}:
            raise ValueError("a BPE model with unused or user-defined pieces")
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.byte = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.plain = {self.text[i]: (i, float(model.get_score(i))) for i in plain}
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in self.plain):
            raise ValueError("a piece crosses the places at which texts are cut")
        self.longest = max(map(len, self.plain))
        self.unknown = min(s for _, s in self.plain.values()) - 10.0
        # Pieces by falling score; equal scores share a rank, so that the leftmost of them merges first.
        scores = np.full(len(self.text), -np.inf)
        scores[[i for i, _ in self.plain.values()]] = [s for _, s in self.plain.values()]
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.spelt: tuple[np.ndarray, np.ndarray] | None = None

    def merged(self, s: np.ndarray, e: np.ndarray, code: np.ndarray) -> pa.Array:
        """BPE codes of words from their edges (s, e, code), in order; a word's first edge is (0, 1).

        All words are merged together, each by its best pair in every step. A
        word over ``LONG`` characters takes the queue instead.
        """
        place = np.cumsum(e - s == 1) - 1  # the character, counted through all words, at which an edge starts
        first = place[(s == 0) & (e == 1)]
        n = int(place[-1]) + 1
        codes, rank = np.zeros((n, self.longest), np.int32), np.full((n, self.longest), NEVER, np.int32)
        codes[place, e - s - 1] = code
        rank[place, e - s - 1] = np.where(code < UNKNOWN, self.rank[np.minimum(code, len(self.rank) - 1)], NEVER)
        size = np.diff(np.append(first, n))
        heads = np.ones(n + 1, bool)
        word = np.repeat(np.arange(len(first)), size)
        start = np.flatnonzero(size[word] <= LONG)
        end, word = start + 1, word[start]
        while len(start):
            wide = end[1:] - start[:-1]
            ok = (word[1:] == word[:-1]) & (wide <= self.longest)
            cost = np.full(len(start), NEVER, np.int32)
            cost[:-1][ok] = rank[start[:-1][ok], wide[ok] - 1]
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            count = np.diff(np.append(begin, len(word)))
            best = np.minimum.reduceat(cost, begin)
            at = np.flatnonzero((cost == np.repeat(best, count)) & (cost < NEVER))
            if not len(at):
                break
            at = at[np.diff(word[at], prepend=-1) != 0]  # the leftmost of equals
            heads[start[at + 1]] = False
            end[at] = end[at + 1]
            keep = np.repeat(best < NEVER, count)
            keep[at + 1] = False
            start, end, word = start[keep], end[keep], word[keep]
        for k in np.flatnonzero(size > LONG).tolist():
            self._queue(rank, heads, int(first[k]), int(first[k] + size[k]))
        start = np.flatnonzero(heads)
        flat = codes[start[:-1], np.diff(start) - 1]
        raw = np.stack([flat >> 16, flat >> 8, flat], axis=1).astype(np.uint8)
        offsets = 3 * np.searchsorted(start, np.append(first, n))
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes())])

    def _queue(self, rank: np.ndarray, heads: np.ndarray, a: int, z: int) -> None:
        """Merges the one word of the characters a to z by a queue of its pairs."""
        after = {i: i + 1 for i in range(a, z)}
        before = {i: i - 1 for i in range(a + 1, z + 1)}

        def push(s: int, m: int, e: int) -> None:
            if e - s <= self.longest and rank[s, e - s - 1] < NEVER:
                heappush(todo, (int(rank[s, e - s - 1]), s, m, e))

        todo: list[tuple[int, int, int, int]] = []
        for i in range(a, z - 1):
            push(i, i + 1, i + 2)
        while todo:
            _, s, m, e = heappop(todo)
            if after.get(s) != m or after.get(m) != e:
                continue
            heads[m], after[s], before[e] = False, e, s
            del after[m]
            if s > a:
                push(before[s], s, e)
            if e < z:
                push(s, e, after[e])

    def ids_of(self, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the packed codes, three bytes for each piece or unknown character, and where each code's begin."""
        raw, offsets = utf8(codes)
        x = raw.reshape(-1, 3).astype(np.int32)
        x = (x[:, 0] << 16) | (x[:, 1] << 8) | x[:, 2]
        odd, size = np.flatnonzero(x >= UNKNOWN), np.ones(len(x), np.int64)
        spelt = [[self.byte[b] for b in chr(c - UNKNOWN).encode()] for c in x[odd].tolist()]
        size[odd] = [len(b) for b in spelt]
        start = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(x, size)
        for at, ids in zip(start[odd].tolist(), spelt):
            out[at : at + len(ids)] = ids
        return out, start[offsets // 3]

    def spell(self, words: list[str], answers: list[tuple[np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the keys, in their order, and where each key's begin."""
        size, got, at, place = np.zeros(len(words), np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)
        if answers:
            place = np.concatenate([p for p, _ in answers])
            order = np.argsort(place)
            got, at = self.ids_of(pa.concat_arrays([c for _, c in answers]).take(pa.array(order)))
            place = place[order]
            size[place] = np.diff(at)
        broken = np.fromiter((k[:1] == "\n" for k in words), bool, len(words))
        begin = np.concatenate([[0], np.cumsum(size + broken)])
        flat = np.full(begin[-1], self.byte.get(10, 0), np.int32)
        target = begin[:-1][place] + broken[place]
        flat[np.repeat(target - at[:-1], size[place]) + np.arange(len(got))] = got
        return flat, begin

    def bytes_of(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts, as UTF-8, that lists of ids stand for: ``ids`` one after the other, cut at ``at``."""
        if self.spelt is None:
            parts = [bytes([self.value[i]]) if i in self.value else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
            self.spelt = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        raw, begin = self.spelt
        size = begin[ids + 1] - begin[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = raw[np.repeat(begin[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[at].tolist()
        return [flat[a + (flat[a : a + 1] == b" ") : z] if z > a else b"" for a, z in zip(cut, cut[1:])]

    def decode(self, ids) -> str:
        return self.bytes_of(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def table(path: str) -> Pieces:
    return Pieces(path)


def units(text: str | None) -> list[str]:
    """The words of a text by the rule: a mark leads it, spaces become marks, a word is a run of marks and what follows, or a line break."""
    return UNITS.findall(MARK + text.replace(" ", MARK)) if text else []


def keys(text: str | None) -> list[str]:
    """The words of a text as keys: without their first mark; a line break together with an unmarked word after it.

    Most texts hold single spaces alone and are simply split at these.
    """
    if not text:
        return []
    if "  " not in text and text[0] != " " and MARK not in text:
        if "\n" not in text:
            return text.split(" ")
        first, *lines = text.split("\n")
        return [*first.split(" "), *(w for line in lines for w in ("\n" + line).split(" "))]
    out: list[str] = []
    for u in units(text):
        if u[0] == MARK or u == "\n":
            out.append(u[1:] if u[0] == MARK else u)
        else:
            out[-1] += u
    return out


def word_of(key: str) -> str:
    """The word to be segmented for a key; a line break is no part of it."""
    return key[1:] if key[:1] == "\n" else MARK + key


def distinct(texts: list[str | None]) -> dict[str, int]:
    """The distinct keys of texts, each with its place in sorted order."""
    found: set[str] = set()
    for t in texts:
        found.update(keys(t))
    return {w: i for i, w in enumerate(sorted(found))}


class _Numbers(dict):
    """A number for each key, in the order in which keys come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def numbered(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct keys of texts, sorted; the place among them of every key, text after text; where each text's begin."""
    found, used, n = _Numbers(), array("i"), []
    for t in texts:
        own = keys(t)
        used.extend(map(found.__getitem__, own))
        n.append(len(own))
    words = sorted(found)
    place = np.zeros(len(words), np.int64)
    place[np.fromiter(map(found.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    return words, place[np.frombuffer(used, np.int32)] if used else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    with pa.ipc.open_stream(raw) as stream:
        return stream.read_all()


def _lean(place: np.ndarray, values: pa.Array) -> bytes:
    """Ascending places and what stands there (bytes or text), packed: steps of places, lengths, then the bytes."""
    raw, offsets = utf8(values)
    parts = [np.diff(place, prepend=0).astype("<u4").tobytes(), np.diff(offsets).astype("<u4").tobytes(), raw.tobytes()]
    # Planes of bytes: the high bytes of steps and lengths are nearly all zero.
    parts[:2] = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, 4).T).tobytes() for x in parts[:2]]
    whole = b"".join(parts)
    return len(place).to_bytes(4, "little") + len(whole).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(whole, asbytes=True)


def _fat(packed: bytes) -> tuple[np.ndarray, pa.Array]:
    """Places and values (as bytes) again."""
    n, size = int.from_bytes(packed[:4], "little"), int.from_bytes(packed[4:12], "little")
    whole = pa.decompress(packed[12:], size, codec="zstd", asbytes=True)
    number = lambda k: np.ascontiguousarray(np.frombuffer(whole, np.uint8, 4 * n, 4 * n * k).reshape(4, n).T).view("<u4").ravel()
    offsets = np.concatenate([[0], np.cumsum(number(1), dtype=np.int64)]).astype(np.int32)
    return np.cumsum(number(0), dtype=np.int64), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(whole[8 * n :])])


#: Chunk tables of this process that have not been dropped.
_held: list[tuple[str, str]] = []


def _chunks(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, rows): packed rows of a task, in a table bucketed by chunk."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, size, nth = TaskContext.get(), [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal nth, size
            rows = _packed(pa.Table.from_batches(held).combine_chunks())
            row = [pa.array([(context.partitionId() << 24) + nth], pa.int64()), pa.array([rows], pa.binary())]
            held.clear()
            nth, size = nth + 1, 0
            return pa.RecordBatch.from_arrays(row, names=["chunk", "rows"])

        for batch in runs(batches, text):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(text)))).as_py() or 0
            if size >= CHUNK:
                yield close()
        if held:
            yield close()

    packed = docs.mapInArrow(lean(run), "chunk long, rows binary")
    name = f"prismtext_chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with lean_batches(spark):
        packed.write.bucketBy(max(8, tasks(spark)), "chunk").option("path", path).saveAsTable(name)
    _held.append((name, path))
    return spark.table(name)


def held() -> int:
    """A mark for ``release``."""
    return len(_held)


def release(spark: SparkSession, mark: int = 0) -> None:
    """Drop the chunk tables of results made since ``mark``, which have been read; earlier results can still be."""
    while len(_held) > mark:
        name, path = _held.pop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def _requests(chunks: DataFrame, text: str, parts: int) -> DataFrame:
    """(part, chunk, words): for each part of the word space the distinct words of a chunk with their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows = _unpacked(batch.column(1)[k].as_py())
                words = pa.array([word_of(k) for k in distinct(rows.column(text).to_pylist())], pa.string())
                raw, at = utf8(words)
                part = (word_hashes(raw, at[:-1], at[1:]) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")  # within a part in order of words: neighbours share letters, which packs well
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    own = order[cut[p] : cut[p + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), batch.column(0).slice(k, 1), pa.array([_lean(own, words.take(pa.array(own)))], pa.binary())], names=["part", "chunk", "words"])

    return chunks.select("chunk", "rows").mapInArrow(lean(run), "part int, chunk long, words binary")


def _asked_words(requests: DataFrame) -> DataFrame:
    """(word, chunk, place): each distinct word of a task's requests with the lists of where its code is to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for chunk, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                place, words = _fat(raw)
                held.append(pa.table({"word": words.cast(pa.string()), "place": place.astype(np.int32), "chunk": np.full(len(place), chunk)}))
        if held:
            words = pa.concat_tables(held).group_by("word").aggregate([("chunk", "list"), ("place", "list")])
            yield from words.select(["word", "chunk_list", "place_list"]).rename_columns(["word", "chunk", "place"]).combine_chunks().to_batches(4096)

    # A task holds the words of its parts; parts are as many as the session's shuffle partitions ask for.
    return requests.repartition("part").mapInArrow(lean(run), "word string, chunk array<long>, place array<int>")


def _answers(coded: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, codes): what a task's words came to, packed for each chunk that asked."""
    held = []
    for batch in coded:
        chunk, place, code = (batch.column(batch.schema.get_field_index(c)) for c in ("chunk", "place", "code"))
        back = pa.array(np.repeat(np.arange(len(batch)), pc.list_value_length(chunk).to_numpy()))
        held.append(pa.table({"chunk": chunk.flatten(), "place": place.flatten(), "code": code.take(back)}))
    if held:
        rows = pa.concat_tables(held).sort_by([("chunk", "ascending"), ("place", "ascending")]).combine_chunks()
        chunk, place = rows["chunk"].to_numpy(), rows["place"].to_numpy()
        cut = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk)).tolist()
        for a, z in zip(cut, cut[1:]):
            yield pa.RecordBatch.from_arrays([pa.array(chunk[a : a + 1]), pa.array([_lean(place[a:z], rows["code"].slice(a, z - a).combine_chunks())], pa.binary())], names=["chunk", "codes"])


def piece_frame(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.plain.items()], "piece string, id int, score double")


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once: a lambda's argument is not computed again for each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def segment(words: DataFrame, pieces: Pieces, carry: tuple[str, ...] = (), finish=None, schema: str = "") -> DataFrame:
    """(word, carry, code) for rows of distinct words with more columns; code packs three bytes a piece.

    ``finish`` turns a task's batches of this into others, by ``schema``.
    """
    longest, worst = pieces.longest, pieces.unknown

    # Runs of STEP starts with what a piece from the last of them may reach: a place is found without counting from the word's start.
    segments = F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{1,{STEP + longest - 1}}})).{{1,{STEP}}}"), F.lit(1))
    rows = words.where(F.col("word") != "").select("word", *carry, F.posexplode(segments).alias("j", "part"))
    # What rides along stands on a word's first edge alone; the sum of scores needs the word on each.
    once = lambda on: [F.when(on, F.col(c)).alias(c) if c in carry or pieces.merges else F.col(c) for c in ("word", *carry)]
    rows = rows.select(*once(F.col("j") == 0), "j", "part", F.char_length("part").alias("n"))
    starts = rows.select("word", *carry, "j", "part", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(STEP), F.col("n")))).alias("i"))
    # A start keeps what a piece from it may reach, so that a substring is found without counting from the run's start.
    starts = starts.select("word", *carry, "j", F.substr("part", F.col("i"), F.lit(longest)).alias("part"), "n", "i")
    ends = starts.select("word", *carry, "j", "part", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("i") + 1))).alias("k"))
    at = F.col("j") * STEP + F.col("i") - 1
    cut = ends.select(*once((at == 0) & (F.col("k") == 1)), at.alias("s"), (at + F.col("k")).alias("e"), F.substr("part", F.lit(1), F.col("k")).alias("piece"))
    edges = cut.join(F.broadcast(piece_frame(words.sparkSession, pieces)), "piece", "left")
    edges = edges.where(F.col("id").isNotNull() | (F.col("e") - F.col("s") == 1))
    code = F.coalesce(F.col("id"), F.ascii("piece") + F.lit(UNKNOWN))
    if pieces.merges:
        return _merge(edges.select("word", *carry, "s", "e", code.alias("id")), pieces, carry, finish, schema)
    edge = F.struct("s", code.alias("id"), F.coalesce("score", F.lit(worst)).alias("score"))
    by_end = edges.groupBy("word", "e").agg(F.collect_list(edge).alias("edges"), *[F.first(c, True).alias(c) for c in carry])
    by_word = by_end.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("e", "edges"))).alias("ends"), *[F.first(c, True).alias(c) for c in carry])
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("path")))

    def step(reached: Column, end: Column) -> Column:
        n = F.size(reached)
        ways = F.transform(end["edges"], lambda d: F.struct(
            (F.get(reached, n - (end["e"] - d["s"]))["score"] + d["score"]).alias("score"), (end["e"] - d["s"]).alias("wide"), (-d["id"]).alias("minus")))
        best = _bound(F.array_max(ways), lambda w: F.struct(w["score"].alias("score"), F.concat(F.get(reached, n - w["wide"])["path"], F.array(-w["minus"])).alias("path")))
        kept = F.when(n < longest, reached).otherwise(F.slice(reached, 2, longest - 1))
        return F.concat(kept, F.array(best))

    path = F.aggregate("ends", start, step, lambda r: F.get(r, F.size(r) - 1)["path"])
    packed = F.unhex(F.array_join(F.transform(path, lambda i: F.lpad(F.hex(i), 6, "0")), ""))
    coded = by_word.select("word", *carry, packed.alias("code"))
    return coded.mapInArrow(lean(finish), schema) if finish else coded


def _merge(edges: DataFrame, pieces: Pieces, carry: tuple[str, ...], finish, schema: str) -> DataFrame:
    """The BPE fold of ``segment``. Edges come in the order of the explosion; word and carry stand on the first of each word."""
    path, m = pieces.path, 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, size = table(path), [], 0

        def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            s, e, code = (rows.column(c).to_numpy() for c in ("s", "e", "id"))
            kept = rows.select(["word", *carry]).take(pa.array(np.flatnonzero((s == 0) & (e == 1))))
            return kept.append_column("code", pieces.merged(s, e, code)).combine_chunks().to_batches()[0]

        for batch in batches:
            # The last word of a batch may go on in the next one.
            first = np.flatnonzero((batch.column(m).to_numpy() == 0) & (batch.column(m + 1).to_numpy() == 1))
            if size + len(batch) > EDGES and len(first) and size + first[-1]:
                yield close([*held, batch.slice(0, first[-1])])
                held, size, batch = [], 0, batch.slice(first[-1])
            if len(batch):
                held.append(batch)
                size += len(batch)
        if held:
            yield close(held)

    more = "".join(f"{c} {edges.schema[c].dataType.simpleString()}, " for c in carry)
    if finish:  # in the same Python worker
        return edges.mapInArrow(lean(lambda batches: finish(run(batches))), schema)
    return edges.mapInArrow(lean(run), f"word string, {more}code binary")


def encode(docs: DataFrame, text: str = "text", path: str | None = None, function=None, schema: str = "ids array<int>") -> DataFrame:
    """``docs`` with the column ids added, or what ``function(pieces, texts, ids, at)`` makes of them by ``schema``.

    ``ids`` are those of the texts one after the other, cut at ``at``.
    """
    path = path or default_path()
    added = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)]
    docs = docs.select(*[c for c in docs.columns if c not in added or c == text])
    chunks = _chunks(docs, text)
    words = _asked_words(_requests(chunks, text, 4 * max(8, tasks(docs.sparkSession))))
    back = segment(words, table(path), ("chunk", "place"), _answers, "chunk long, codes binary")
    codes = back.groupBy("chunk").agg(F.collect_list("codes").alias("codes"))
    both = chunks.join(codes.hint("shuffle_hash"), "chunk", "left").select("rows", "codes")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table(path)
        for batch in batches:
            for k in range(len(batch)):
                rows = _unpacked(batch.column(0)[k].as_py())
                words, places, first = numbered(rows.column(text).to_pylist())
                flat, begin = pieces.spell(words, [_fat(x) for x in batch.column(1)[k].as_py() or []])
                done = 0
                for part in runs(iter(rows.to_batches()), text):
                    at = first[done : done + len(part) + 1]
                    used, at, done = places[at[0] : at[-1]], at - at[0], done + len(part)
                    size = begin[used + 1] - begin[used]
                    ends = np.concatenate([[0], np.cumsum(size)])
                    ids = flat[np.repeat(begin[used] - ends[:-1], size) + np.arange(ends[-1])]
                    cut = ends[at]
                    more = function(pieces, part.column(part.schema.get_field_index(text)).to_pylist(), ids, cut) if function else [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *added])

    return both.mapInArrow(lean(run), fields + schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list added. Null ids decode to the empty text."""
    path = path or default_path()
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
            texts = [x.decode("utf-8", "replace") for x in pieces.bytes_of(column.flatten().to_numpy().astype(np.int64), at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return df.mapInArrow(lean(run), f"{fields}`{into}` string")


def _digests(pieces: Pieces, texts: list[str | None], ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    back, raw, cut = pieces.bytes_of(ids, at), ids.astype("<u4"), at.tolist()
    return [
        pa.array(np.diff(at), pa.int64()),
        pa.array([zlib.crc32(raw[a:z]) for a, z in zip(cut, cut[1:])], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
        pa.array([t == (s or "").encode() for s, t in zip(texts, back)], pa.bool_()),
    ]


def op5_pieces(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (ids as little-endian 32-bit), decoded_sha256 and whether it is the text."""
    mark = held()
    coded = encode(docs.select("doc_id", "text"), function=_digests, schema="n_ids long, ids_crc32 long, decoded_sha256 string, whole boolean")
    out = materialize(coded.drop("text"), "pieces")
    release(docs.sparkSession, mark)
    return out
