"""Language identification by blended-spectrum string kernels.

The kernel of two texts is the number of n-grams (n = 1 to 4, in bins of a fixed hash) that both hold, over
the geometric mean of how many each holds. A bounded set of landmark texts gives Nystroem features; kernel
ridge regression, one language against the rest, is fitted on them. Whole texts are scored in batches: the
presence matrix of a batch times that of the landmarks, times the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .sampling import sample_ids

ORDERS, BINS = (1, 2, 3, 4), 1 << 14
#: Texts a language that a model is fitted on, of those the landmarks, and characters: a language's, and all together.
SAMPLE, LANDMARKS, SAMPLE_CHARS, ALL_CHARS = 400, 24, 6_000_000, 60_000_000
#: Languages that can be learnt, and landmarks of all; with many languages each has fewer.
LANGUAGES, ALL_LANDMARKS = 2000, 2000
RIDGE = 1e-2
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
#: Characters of the pieces that long texts are compared in, so that the bins of a long text don't fill up.
PIECE = 20_000
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
UND = "und"


def presence(clean: str, out: np.ndarray) -> None:
    """Marks the bins of the n-grams of a piece of text."""
    c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in ORDERS:
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        out[(h * np.uint32(0x85EBCA6B)) >> np.uint32(18)] = 1


def spectra(texts: list[str]) -> np.ndarray:
    """A row a text: letters in lower case, words apart by one blank; presences over their norm, the mean over pieces.

    The product of two rows is the kernel: that of two pieces, averaged over all pairs of pieces of two texts.
    """
    out = np.zeros((len(texts), BINS), np.float32)
    for row, text in zip(out, texts, strict=True):
        clean = " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "
        n = -(-len(clean) // PIECE)
        for i in range(n):
            one = row if n == 1 else np.zeros(BINS, np.float32)
            presence(clean[len(clean) * i // n : len(clean) * (i + 1) // n], one)
            one /= np.sqrt(max(one.sum(), 1)) * n
            if n > 1:
                row += one
    return out


@dataclass
class Kernel:
    languages: list[str]
    landmarks: np.ndarray
    whiten: np.ndarray
    coefficients: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One column a language: the regression's values as shares by a softmax."""
        k = spectra(texts) @ self.landmarks.T
        z = 8 * (k @ self.whiten @ self.coefficients)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    names = sorted(set(languages))
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(names)))
    y = np.array([names.index(v) for v in languages])
    picked = np.concatenate([np.flatnonzero(y == i)[:landmarks] for i in range(len(names))])
    marks = spectra([texts[i] for i in picked])
    k = np.concatenate([spectra(texts[i : i + 256]) @ marks.T for i in range(0, len(texts), 256)])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    use = value > 1e-6 * value[-1]
    whiten = vector[:, use] / np.sqrt(value[use])
    phi = k @ whiten
    target = np.where(y[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    weigh = np.array([len(y) / (len(names) * (y == i).sum()) for i in range(len(names))])[y][:, None]  # languages count alike
    phi1 = phi * weigh
    coefficients = np.linalg.solve(phi.T @ phi1 + ridge * len(y) / len(names) * np.eye(phi.shape[1]), phi1.T @ target)
    return Kernel(names, marks, whiten.astype(np.float32), coefficients.astype(np.float32))


def held_out(doc_id):
    """Rows that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> Kernel | None:
    """Fits on at most ``sample`` texts of each language, by a hash of doc_id, of those that aren't held out; over ``languages`` languages are a ValueError."""
    open_ = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = sample_ids(open_.select("lang", "doc_id", F.length("text").alias("n")), "lang", sample, chars, 5, languages, ALL_CHARS)
    if not ids:
        return None
    picked = docs.sparkSession.createDataFrame(sorted({(k[1],) for k in ids}), "__id long")  # as many as the sample's bounds allow
    rows = open_.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    rows = sorted((r for r in rows if (r.lang, r.doc_id) in ids and LETTER.search(r.text)), key=lambda r: (r.lang, r.doc_id))
    order = np.random.default_rng(9).permutation(len(rows))
    return fit([rows[i].text for i in order], [rows[i].lang for i in order]) if rows else None


def _score(model: Kernel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, 128):
            docs, held, texts = (c.to_pylist() for c in b.columns)
            live = [i for i, t in enumerate(texts) if t and model and LETTER.search(t)]
            said, share = [UND] * len(docs), [0.0] * len(docs)
            if live:
                p = model.scores([texts[i] for i in live])
                for i, best, row in zip(live, p.argmax(1).tolist(), p, strict=True):
                    said[i], share[i] = model.languages[best], float(row[best])
            yield arrow.batch(SCORES, list(zip(docs, held, said, share, strict=True)))

    return run


def identify(docs: DataFrame, *, languages: int = LANGUAGES) -> DataFrame:
    """The language of each row of ``docs(doc_id, text, lang)``.

    Learns from text and non-null lang of rows that aren't :func:`held_out`, all languages; more than ``languages``
    of them are a ValueError, since landmarks and time grow with them. Returns ``doc_id, held_out,
    lang_pred, score``. Defined cases: ``und`` with score 0 for a text that is null or has no letter, and for
    every text if nothing can be learnt; a null doc_id is not held out and not learnt from; repeated rows get
    equal results; an empty table gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(arrow.tidy(_score(learn(docs, languages=languages))), arrow.ddl(SCORES))
