"""Toxicity grades by cumulative-link ordinal regression on sparse character n-grams.

Features are the presence of 4- to 6-grams inside words, word ends marked. The model is one weight a feature,
shared by all thresholds, and one threshold a grade: P(grade > j) = s(w.x - t_j). It is fitted on a bounded
sample of labelled documents; scoring reads every whole text. A document is toxic if a grade above the first is
likelier than not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .sampling import sample_ids

LETTERS = re.compile(r"[^\W\d_]+")
#: Grades that can be learnt.
GRADES = 20
#: Labelled documents of each grade, and characters of all, that a model is fitted on; features it keeps.
SAMPLE, SAMPLE_CHARS, FEATURES = 1500, 16_000_000, 4000
SCORES = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])
#: Whether a word has a feature, for the words seen; emptied at this size. Runs of more letters than PIECE are not kept.
KEPT, PIECE = 100_000, 200
#: Texts that an n-gram has to be in to be a feature; bins that n-grams are counted in first.
LEAST_TEXTS, BINS = 3, 1 << 22
#: Texts of each grade held out, without which thresholds are fitted on the texts that the weights are fitted on.
LEAST_HELD = 20
#: Log odds from which a feature counts.
LEAST_ODDS = 1.5


def grams(word: str) -> Iterator[str]:
    """All n-grams of a word, with repeats."""
    w = f"^{word}$"
    return (w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1))


def word_set(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def binned(words: set[str]) -> tuple[str, list[tuple[int, np.ndarray]]]:
    """The words as one string, and for each n the bins of its n-grams by place."""
    joined = f"^{'$^'.join(words)}$"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = np.zeros(len(c), np.uint32), []
    for n in range(1, 7):
        h = h[: max(0, len(c) - n + 1)] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n > 3:
            out.append((n, (h * np.uint32(0x85EBCA6B)) >> np.uint32(10)))
    return joined, out


def feature_counts(texts: list[str], graded: np.ndarray) -> tuple[Counter, Counter]:
    """Graded texts of each n-gram that is in ``LEAST_TEXTS`` of them or more, and ungraded ones: bins are counted first, so that rare n-grams of long runs take no memory."""
    seen = np.zeros(BINS, np.int32)
    for i in np.flatnonzero(graded):
        for _, bins in binned(word_set(texts[i]))[1]:
            seen[np.unique(bins)] += 1
    top, rest = Counter(), Counter()
    for into, which in ((top, graded), (rest, ~graded)):
        for i in np.flatnonzero(which):
            joined, found = binned(word_set(texts[i]))
            got = {joined[p : p + n] for n, bins in found for p in np.flatnonzero(seen[bins] >= LEAST_TEXTS).tolist()}
            into.update(g for g in got if "$" not in g[:-1] and "^" not in g[1:] and (into is top or g in top))
        if into is top:
            top = Counter({g: c for g, c in top.items() if c >= LEAST_TEXTS})
    return top, rest


class Hits(dict):
    """The features of each word seen."""

    def __init__(self, index: dict[str, int]) -> None:
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        got = tuple({self.index[g] for g in grams(word) if g in self.index})
        if len(word) <= PIECE:
            self[word] = got
        return got

    def of(self, text: str | None) -> set[int]:
        return set().union(*filter(None, map(self.__getitem__, word_set(text)))) if text else set()


@dataclass
class Ordinal:
    """``grades`` in order, a weight for each feature, thresholds between grades."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    @property
    def cut(self) -> float:
        """z from which a grade above the first is likelier than not."""
        return float(self.thresholds[0]) if len(self.thresholds) else np.inf

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -500, 500)))

    def severity(self, z: np.ndarray) -> np.ndarray:
        """The expected grade."""
        g = np.array(self.grades, float)
        return g[0] + self.above(z) @ np.diff(g)

    def grade(self, z: np.ndarray) -> np.ndarray:
        return np.array(self.grades)[(self.above(z) >= 0.5).sum(1)]


def slopes(z: np.ndarray, y: np.ndarray, t: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log likelihood by each z and by each threshold."""
    n, k = len(z), len(t)
    rows = np.arange(n)
    p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -60, 60)))
    pad = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
    steep = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], 1)
    mass = np.maximum(pad[rows, y] - pad[rows, y + 1], 1e-9)
    low, high = steep[rows, y] / mass * weigh, steep[rows, y + 1] / mass * weigh
    gt = np.zeros(k)
    np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, low, 0) / n)
    np.add.at(gt, np.minimum(y, k - 1), np.where(y < k, -high, 0) / n)
    return (high - low) / n, gt


def fit(texts: list[str], labels: list[int], *, features: int = FEATURES, rounds: int = 600, ridge: float = 1e-4) -> Ordinal:
    """Fits by gradient steps with momentum on the mean negative log likelihood. One grade alone gives no thresholds.

    Every fifth text is held out of the weights, and thresholds are fitted again on those, where the weights haven't
    seen the texts. Without enough of each grade the first thresholds stay.
    """
    grades = sorted(set(labels))
    y = np.array([grades.index(v) for v in labels])
    held = np.zeros(len(y), bool)
    for v in range(len(grades)):
        mine = np.flatnonzero(y == v)
        held[mine[4::5]] = len(mine) >= 5 * LEAST_HELD
    k = len(grades) - 1
    use = np.flatnonzero(~held)
    top, rest = feature_counts([texts[i] for i in use], y[use] > 0)
    n1, n0 = max(1, int((y[use] > 0).sum())), max(1, int((y[use] == 0).sum()))
    odds = {g: np.log((c + 0.5) / (n1 + 1) / ((rest[g] + 0.5) / (n0 + 1))) for g, c in top.items()}
    # features that tell graded from ungraded documents apart, those in most graded ones first
    names = sorted(sorted(g for g in odds if odds[g] >= LEAST_ODDS), key=lambda g: -top[g] * odds[g])[:features]
    del top, rest, odds
    index = {g: i for i, g in enumerate(names)}
    w, t = np.zeros(len(names)), np.linspace(0.5, 0.5 + k - 1, k) if k else np.zeros(0)
    if not k or not len(names):
        return Ordinal(index, w, t, grades)
    lookup = Hits(index)
    x = np.zeros((len(texts), len(names)), np.float32)
    for i, text in enumerate(texts):
        x[i, list(lookup.of(text))] = 1
    # grades count alike, however many documents they have
    share = lambda rows: np.array([len(rows) / (len(grades) * max(1, (y[rows] == v).sum())) for v in range(len(grades))])[y[rows]]
    seen, weigh = x[use], share(use)
    vw, vt = np.zeros_like(w), np.zeros_like(t)
    step = 1.0 / max(1.0, float(np.median(seen.sum(1))) ** 0.5)
    for _ in range(rounds):
        gz, gt = slopes(seen @ w.astype(np.float32), y[use], t, weigh)
        vw, vt = 0.9 * vw - step * (seen.T @ gz.astype(np.float32) + ridge * w), 0.9 * vt - step * gt
        w, t = w + vw, np.sort(t + vt)
    if all((held & (y == v)).any() for v in range(len(grades))):
        rows = np.flatnonzero(held)
        z, weigh, vt = x[rows] @ w, share(rows), np.zeros_like(t)
        for _ in range(2 * rounds):
            vt = 0.9 * vt - slopes(z, y[rows], t, weigh)[1]
            t = np.sort(t + vt)
    return Ordinal(index, w, t, grades)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """At most ``sample`` labelled texts of each grade and ``chars`` characters of each, by a hash of doc_id."""
    picked = labels.where("grade is not null and doc_id is not null").select("doc_id", "grade").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    size = docs.where("text is not null").select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    ids = {doc: grade for grade, doc in sample_ids(picked.join(size, "doc_id"), "grade", sample, chars, 11, GRADES, GRADES * chars)}
    if not ids:
        return [], []
    picked = docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "__id long")  # as many as the sample's bounds allow
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [ids[r.doc_id] for r in rows]


def _scored(model: Ordinal, lookup: Hits, texts: list[str | None]) -> np.ndarray:
    return np.array([model.weights[sorted(lookup.of(t))].sum() for t in texts], float)


def _score(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Hits(model.features)
        for b in arrow.slices(batches):
            z = _scored(model, lookup, b.column(1).to_pylist())
            yield arrow.batch(SCORES, list(zip(b.column(0).to_pylist(), model.severity(z).tolist(), model.grade(z).tolist(), (z >= model.cut).tolist(), strict=True)))

    return run


def _clean(model: Ordinal, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Hits(model.features)
        for b in arrow.slices(batches):
            yield b.filter(pa.array(_scored(model, lookup, b.column(text).to_pylist()) < model.cut, pa.bool_()))

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Ordinal:
    texts, y = labelled(docs, labels)
    return fit(texts, y) if texts else Ordinal({}, np.zeros(0), np.zeros(0), [0])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Severity of each row of ``docs(doc_id, text)``, learnt from ``labels(doc_id, grade)``.

    Returns ``doc_id, severity, grade, toxic``: the expected grade, the likeliest side of each threshold, and
    whether that is above the first grade. Defined cases:
    a null or empty text has no features and gets the severity of z = 0; repeated rows get equal scores; with
    no usable labels every document has severity 0 and is not toxic; an empty table gives no rows; further
    columns are ignored; a label without a document and a null grade count for nothing.
    """
    model = learn(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrow.tidy(_score(model)), arrow.ddl(SCORES))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that :func:`toxicity` does not call toxic."""
    return docs.mapInArrow(arrow.tidy(_clean(learn(docs, labels), docs.columns.index("text"))), docs.schema)


def grades_from(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` of the table ``labels``: 0 clean, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", (F.col("toxic") * (2 - F.coalesce("quality", F.lit(1)))).cast("int").alias("grade"))
