"""How far the sources of a language differ in their words: a two-pass vocabulary automaton.

Pass 1 counts in how many documents of a language each term occurs; a language
keeps the terms in at least ``least`` of them. Pass 2 matches the kept terms,
padded with the delimiter, by an Aho-Corasick automaton over the texts and so
counts occurrences by language and source. An automaton holds at most ``ROOM``
bytes of terms; a larger vocabulary is dealt to several automata by hash, each
with a pass of its own over the documents of its languages, so no term is left
out and nothing of unknown size is broadcast.

Postings (language, source, term, count) hold counts above 0 only. With z for
the share of a term of count 0, the distance of two sources is

    V |zA - zB| + sum over A's terms (|pA - zB| - |zA - zB|) + the same for B
    + sum over common terms (|pA - pB| - |pA - zB| - |zA - pB| + |zA - zB|).

The first sums need only how often each count occurs in a source; the last
takes the terms' posting lists, one entry a source. All of it is in whole
numbers, exact while a group has fewer than 9e15 occurrences.

Defined results: null text, lang and source are empty strings; a group without
kept terms has shares of count 0, a language that keeps none (V = 0) has pairs
of value 0 and no terms; repeated rows count each time; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pieces

#: Bytes of terms that one automaton holds; counts that a task holds before it hands them on.
ROOM, HELD = 4 << 20, 500_000
#: Turns A-Z to a-z and all that is no part of a term to a space; bytes of other characters stay.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_second = itemgetter(1)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of each one's values."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    return key[order][first], np.add.reduceat(np.concatenate(values)[order], first) if len(key) else key


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, n: in how many documents of the language the term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, terms in seen.items():
                names = pa.array(list(terms), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), names, pa.array(list(terms.values()), pa.int64())], names=["lang", "term", "n"])
            seen.clear()

        for batch in pieces(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                seen.setdefault(lang, Counter()).update(set(text.translate(_TERM).split()))
            if sum(map(len, seen.values())) > HELD:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _automata(kept: DataFrame) -> list[tuple[list[str], Column]]:
    """Languages and the condition on kept terms of each automaton, so that none holds much over ``ROOM`` bytes."""
    sizes = kept.groupBy("lang").agg(F.sum(F.octet_length("term") + 2).alias("n")).orderBy("lang")
    out: list[tuple[list[str], Column]] = []
    few: list[str] = []
    room = 0
    for lang, n in sizes.toLocalIterator():
        if n > ROOM:
            parts = -(-n * 5 // (ROOM * 4))
            out += [([lang], (F.col("lang") == lang) & (F.pmod(F.xxhash64("term"), F.lit(parts)) == k)) for k in range(parts)]
            continue
        if room + n > ROOM:
            out.append((few, F.col("lang").isin(few)))
            few, room = [], 0
        few.append(lang)
        room += n
    return out + ([(few, F.col("lang").isin(few))] if few else [])


def _counted(docs: DataFrame, langs: list[str], kept: DataFrame) -> DataFrame:
    """lang, source, term, n of one automaton's terms."""
    vocabulary: dict[str, list[str]] = {}
    for lang, term in kept.toLocalIterator():
        vocabulary.setdefault(lang, []).append(term)
    shared = docs.sparkSession.sparkContext.broadcast({k: pa.array(v, pa.string()) for k, v in vocabulary.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {}
        groups: dict[tuple[str, str], int] = {}
        keys, sums, size = [], [], 0

        def automaton(lang: str):
            if lang not in automata:
                found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for i, term in enumerate(shared.value[lang].to_pylist()):
                    found.add_word(f" {term} ", i)
                found.make_automaton()
                automata[lang] = found
            return automata[lang]

        def merge() -> None:
            nonlocal size
            key, total = _summed(keys, sums)
            keys[:], sums[:], size = [key], [total], len(key)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            group, term = keys[0] >> 32, keys[0] & 0xFFFFFFFF
            for (lang, source), g in groups.items():
                of = slice(*np.searchsorted(group, [g, g + 1]))
                n = of.stop - of.start
                names = shared.value[lang].take(pa.array(term[of]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), names, pa.array(sums[0][of])], names=["lang", "source", "term", "n"])
            keys.clear()
            sums.clear()
            size = 0

        for batch in pieces(batches, "text"):
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                texts.setdefault((lang, source), []).append(text)
            for (lang, source), own in texts.items():
                line = (b" " + b" ".join(own) + b" ").translate(_TERM).decode()
                key, n = np.unique(np.fromiter(map(_second, automaton(lang).iter(line)), np.int64), return_counts=True)
                keys.append(key | groups.setdefault((lang, source), len(groups)) << 32)
                sums.append(n)
                size += len(key)
            if size > 4 * HELD:
                merge()
                if size > HELD:
                    yield from out()
        if keys:
            merge()
            yield from out()

    rows = docs.where(F.col("lang").isin(langs)).select("lang", "source", "text")
    return rows.mapInArrow(run, "lang string, source string, term string, n long")


def postings(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term, n: occurrences above 0 of the kept terms (lang, term)."""
    parts = [_counted(docs, langs, kept.where(some)) for langs, some in _automata(kept)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(1e9 (n + 5) / (total + 5 terms)) in whole numbers, three digits at a time."""
    x, y = f"({n} + 5)", f"({total} + 5 * {terms})"
    a, b = f"(1000 * {x}) div {y}", f"((1000 * {x}) % {y})"
    c, d = f"(1000 * {b}) div {y}", f"((1000 * {b}) % {y})"
    return F.expr(f"cast(1 + 1000000 * ({a}) + 1000 * ({c}) + (1000 * {d}) div {y} as bigint)")


def _common(lists: DataFrame) -> DataFrame:
    """lang, a, b, x (a < b): over the common terms of two groups |pA - pB| - |pA - zB| - |zA - pB| + |zA - zB|.

    ``lists`` has a row for each (lang, term): its groups in order, their shares and their shares of count 0.
    A batch's pairs are summed before they go on, a slice of the lists at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            size = 0

            def out(held=held) -> Iterator[pa.RecordBatch]:
                for lang, parts in held.items():
                    own, total = _summed([k for k, _ in parts], [v for _, v in parts])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own >> 32), pa.array(own & 0xFFFFFFFF), pa.array(total)], names=["lang", "a", "b", "x"])
                held.clear()

            lang = batch.column(0).to_pylist()
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values
            g, p, z = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for row, name in enumerate(lang):
                of = slice(ends[row], ends[row + 1])
                i, q, y = g[of], p[of], z[of]
                for k in range(len(i) - 1):
                    x = np.abs(q[k] - q[k + 1 :]) - np.abs(q[k] - y[k + 1 :]) - np.abs(y[k] - q[k + 1 :]) + np.abs(y[k] - y[k + 1 :])
                    held.setdefault(name, []).append((i[k] << 32 | i[k + 1 :], x))
                    size += len(x)
                    if size > 4 * HELD:
                        yield from out()
                        size = 0
            yield from out()

    return lists.mapInArrow(run, "lang string, a long, b long, x long").groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows (other sources, farthest first) and ``term`` rows (what a source uses more than its language)."""
    docs = _named(docs)
    kept = materialize(document_frequencies(docs).where(F.col("n") >= least).select("lang", "term"), "terms", "zstd")
    counts = materialize(postings(docs, kept), "postings", "zstd")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = docs.select("lang", "source").distinct().join(terms, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    numbered = groups.withColumn("g", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long"))
    zero = F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(0)).cast("long")
    groups = materialize(numbered.withColumn("z", zero), "groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))

    lists = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "p", "z"))).alias("l")).select("lang", "l")
    common = _common(lists)
    # How often each share occurs in a source, against each other source of the language.
    steps = shares.groupBy("lang", "g", "p", "z").agg(F.count(F.lit(1)).alias("m"))
    others = groups.select("lang", F.col("g").alias("h"), F.col("z").alias("y"))
    alone = steps.join(others, "lang").where(F.col("g") != F.col("h"))
    alone = alone.groupBy("lang", "g", "h").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("z") - F.col("y")))).alias("x"))
    a, b = F.least("g", "h"), F.greatest("g", "h")
    extra = common.unionByName(alone.select("lang", a.alias("a"), b.alias("b"), "x")).groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))
    both = groups.join(others.join(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"]), "lang").where(F.col("g") != F.col("h"))
    pairs = both.withColumns({"a": a, "b": b}).join(extra, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("terms") * F.abs(F.col("z") - F.col("y")) + F.coalesce("x", F.lit(0))).alias("value"))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(sums.groupBy("lang").agg(F.sum("total").alias("total")), "lang").join(terms, "lang")
    whole = whole.select("lang", "term", share("n", "total", "terms").alias("q"))
    own = shares.join(whole, ["lang", "term"]).where(F.col("p") > F.col("q"))
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op13_divergence(docs: DataFrame) -> DataFrame:
    return divergence(docs)


_P = "(1 + 1000000000::HUGEINT * ({n} + 5) // ({total} + 5 * {v}))"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.lang, source, term, n, {_P.format(n="n", total="sum(n) OVER (PARTITION BY f.lang, source)", v="v")} AS p FROM f JOIN v ON f.lang = v.lang),
l AS (SELECT s.lang, term, {_P.format(n="n", total="sum(n) OVER (PARTITION BY s.lang)", v="v")} AS q FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL) s JOIN v ON s.lang = v.lang),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - l.q FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
WHERE part = 'pair' OR rank <= 50
"""
