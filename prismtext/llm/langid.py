"""Language identification by hierarchical discrimination.

A text's vector is the share of each hashed byte n-gram (two to four bytes of
the lower-cased letters). A one-versus-rest linear support vector machine for
each language family chooses the family; within a family of several languages
one-versus-one linear support vector machines vote, ties by summed margin.

Training uses a bounded, documented sample: about ``per_language`` labelled
rows of each language, chosen by a hash of the text, each read whole. The
vectors are computed on the executors; the driver fits weight vectors of
``DIMS`` numbers from at most languages x ``per_language`` x 4 KB. Prediction
covers every row with a weight table of fixed size.

The score compares languages and says nothing of a text unlike all of them.
``evidence`` does: the margin of the winning family's machine, or, of a single
family, the cosine with the mean vector. ``fit(..., calibrate=True)`` fits once
more on every other sampled row and sets ``least`` to the ``MISSED`` quantile of
the evidence of the rest.

Defined results: ``und`` with score 0 for a null text or one without a
letter, and for every text if there is no labelled row; a language that no
family lists is a family of its own; labels that are null are not learned;
repeated rows are rated alike, and of equal texts with one label the sample
holds one; rows without an id are rated like others; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, lean, pieces, utf8

#: Families of closely related languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
}
DIMS = 4096
ORDERS = (2, 3, 4)
#: Share of held-out labelled texts whose evidence may lie below ``least``.
MISSED = 0.002


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with every run of other ASCII made a space, offsets, and which texts hold a letter."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    has = pc.match_substring_regex(lower, r"\pL").to_numpy(zero_copy_only=False)
    raw, offsets = utf8(lower)
    keep = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    return np.where(keep, raw, np.uint8(32)), offsets, has.astype(bool)


def _grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-gram ids at every position and whether they count.

    An n-gram counts if it lies in one text and no two spaces adjoin in it.
    """
    n = len(raw)
    x = raw.astype(np.uint32)
    double = np.zeros(n, bool)
    double[:-1] = (raw[:-1] == 32) & (raw[1:] == 32)
    bad = double.copy()  # at i: bytes i and i+1 may not stand in one n-gram
    inner = offsets[1:-1]
    bad[inner[inner > 0] - 1] = True
    acc = x * np.uint32(0x9E3779B1)
    broken = np.zeros(n, bool)
    for order in range(2, max(ORDERS) + 1):
        m = n - order + 1
        if m <= 0:
            return
        acc = (acc[:m] ^ x[order - 1 :]) * np.uint32(0x85EBCA6B)
        acc ^= acc >> np.uint32(15)
        broken = broken[:m] | bad[order - 2 : n - 1]
        if order in ORDERS:
            yield (acc >> np.uint32(20)).astype(np.int32), ~broken


def _vectors(column: pa.Array) -> np.ndarray:
    raw, offsets, _ = _letters(column)
    n = len(column)
    out = np.zeros((n, DIMS), np.float32)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for ids, good in _grams(raw, offsets):
        at = owner[: len(ids)][good] * DIMS + ids[good]
        out += np.bincount(at, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    out = np.sqrt(out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, c: float = 20.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient descent. y is +1 or -1."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(d + 1, np.float32)
    v, rate, t = w.copy(), 1.0 / (1.0 + 2 * c * 2.0), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        grad = v - 2 * c * np.concatenate([slack @ x, [slack.sum()]]).astype(np.float32)
        grad[-1] -= v[-1]
        new = v - rate * grad
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


class Discriminator:
    """Family and pair machines as one weight table of shape (DIMS, machines)."""

    def __init__(self, x: np.ndarray, labels: list[str], families: dict[str, list[str]]):
        of = {lang: family for family, langs in families.items() for lang in langs}
        y = np.array(labels, dtype=object)
        self.languages = sorted(set(labels))
        self.family_of = {lang: of.get(lang, f"={lang}") for lang in self.languages}
        self.families = sorted(set(self.family_of.values()))
        family = np.array([self.family_of[lang] for lang in labels], dtype=object)
        machines = []
        if len(self.families) > 1:
            machines += [_svm(x, np.where(family == f, 1.0, -1.0).astype(np.float32)) for f in self.families]
        self.pairs = [p for f in self.families for p in combinations([lang for lang in self.languages if self.family_of[lang] == f], 2)]
        for a, b in self.pairs:
            rows = (y == a) | (y == b)
            machines.append(_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0).astype(np.float32)))
        mean = x.mean(axis=0)
        machines.append((mean / max(float(np.linalg.norm(mean)), 1e-9), 0.0))  # the last column: closeness to the mean text
        self.weights = np.stack([w for w, _ in machines], axis=1).astype(np.float32)
        self.bias = np.array([b for _, b in machines], np.float32)
        self.least = -np.inf

    def evidence(self, margin: np.ndarray) -> np.ndarray:
        """How far each text is like any learned language, from its margins."""
        return margin[:, : len(self.families)].max(axis=1) if len(self.families) > 1 else margin[:, -1]

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets, has = _letters(column)
        n = len(column)
        counts = np.zeros((n, DIMS), np.float32)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        for ids, good in _grams(raw, offsets):
            counts += np.bincount((owner[: len(ids)] * DIMS + ids)[good], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
        x = np.sqrt(counts)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x @ self.weights + self.bias, has

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        margin, has = self.margins(column)
        n = len(column)
        nf = len(self.families) if len(self.families) > 1 else 0
        chosen = np.argmax(margin[:, :nf], axis=1) if nf else np.zeros(n, int)
        sure = np.full(n, 9.0)
        if nf:
            ordered = np.sort(margin[:, :nf], axis=1)
            sure = ordered[:, -1] - ordered[:, -2]
        votes = np.zeros((n, len(self.languages)))
        total = np.zeros((n, len(self.languages)))
        place = {lang: i for i, lang in enumerate(self.languages)}
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, nf + k]
            for lang, s in ((a, m), (b, -m)):
                votes[:, place[lang]] += s > 0
                total[:, place[lang]] += np.tanh(s) / 4
        member = np.array([[self.family_of[lang] == f for lang in self.languages] for f in self.families])
        points = np.where(member[chosen], votes + total, -np.inf)
        best = np.argmax(points, axis=1)
        close = np.full(n, 9.0)
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, nf + k]
            close = np.where(best == place[a], np.minimum(close, 2 * m), np.where(best == place[b], np.minimum(close, -2 * m), close))
        score = 1 / (1 + np.exp(-2 * np.minimum(sure, close)))
        return [self.languages[b] if h else "und" for b, h in zip(best, has)], np.where(has, score, 0.0), self.evidence(margin)


def fit(labelled: DataFrame, per_language: int = 1000, families: dict[str, list[str]] | None = None, calibrate: bool = False) -> Discriminator | None:
    """Fit on (text, lang) rows: about ``per_language`` of each language, chosen by a hash of the text."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    # Copies of a text count once, so no group of copies can swamp the sample.
    keys = rows.select(F.xxhash64("text").alias("h"), "lang").distinct()
    counts = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))]), F.col("lang"))
    sample = rows.where(place < share).dropDuplicates(["text", "lang"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                x = _vectors(part.column(0)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = sample.mapInArrow(lean(vectors), "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not got:
        return None
    labels, x = [r["lang"] for r in got], np.empty((len(got), DIMS), np.float32)
    for own, r in zip(x, got):
        own[:] = np.frombuffer(bytes(r["x"]), np.float16)
    del got, own, r  # the driver holds the sample once
    give_back()
    least = -np.inf
    if calibrate:
        # Equal vectors stand together; one of each, so that no copy of a learned row is held out.
        single = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
        half, rest = single[::2], single[1::2]
        if len(rest):
            trial = Discriminator(x[half], [labels[i] for i in half], families or FAMILIES)
            least = float(np.quantile(trial.evidence(x[rest] @ trial.weights + trial.bias), MISSED))
    model = Discriminator(x, labels, families or FAMILIES)
    model.least = least
    del x
    give_back()
    return model


def predict(docs: DataFrame, model: Discriminator | None, keep: list[str] | None = None, text: str = "text", evidence: str | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (default: all) with a language and a score added, for every row and whole texts; evidence under the name given, if any.

    ``names`` are the added columns'; an own column of such a name gives way, so choose others to keep it.
    """
    added = [*names, *([evidence] if evidence else [])]
    keep = [c for c in keep or docs.columns if c not in added]
    if model is None:
        return docs.select(*keep, F.lit("und").alias(added[0]), *[F.lit(0.0).alias(c) for c in added[1:]])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*dict.fromkeys([*keep, text]))
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, text, 1 << 19):
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                at = {c: k for k, c in enumerate(part.schema.names)}
                langs, *numbers = model.predict(part.column(at[text]))
                columns = [*(part.column(at[c]) for c in keep), pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(columns[: len(keep) + len(added)], names=[*keep, *added])

    return rows.mapInArrow(lean(run), f"{fields}`{added[0]}` string, " + ", ".join(f"`{c}` double" for c in added[1:]))


def op9_language(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")).select("text", "lang"))
    return predict(rows.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])
