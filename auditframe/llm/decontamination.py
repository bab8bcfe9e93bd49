"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed of ``k`` tokens are tiled: the longest matches of unmarked
tokens, found by Karp-Rabin fingerprints, are marked again and again until none of ``k`` tokens is left. An
item is leaked if its tiles cover enough of it, in whatever order they stand in the document.

The benchmark is sent to the tasks in blocks of at most ``SMALL`` tokens, and documents are tiled where they are
read: texts never move, and what is sent doesn't grow with either table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .scratch import Scratch

K, COVERAGE = 5, 0.8
#: Tokens of the blocks in which a benchmark is sent to every task.
SMALL = 1_000_000
#: ASCII letters in lower case; digits and bytes of other letters as they are; everything else a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Beyond ASCII: a letter of a script without blanks (Thai to Khmer, kana, Han) is a token, what is no letter, mark or number is a blank.
SINGLE = regex.compile(r"[\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}\p{Hiragana}\p{Katakana}\p{Han}]")
OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
#: An odd number and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FOUND = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.bool_()), ("n_items", pa.int64()), ("best_item", pa.int64()), ("coverage", pa.float64()), ("items", pa.string())])
PAIRS = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64())])


def tokens(text: str | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii():
        text = SINGLE.sub(r" \g<0> ", OTHER.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def fingerprints(codes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin values of all windows of ``k`` codes, modulo 2**64, from those of all beginnings."""
    if len(codes) < k:
        return np.empty(0, np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), BASE)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes) - k, INVERSE)]), dtype=np.uint64)
    upto = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * power[:-1], dtype=np.uint64)])
    return (upto[k:] - upto[:-k]) * back


def free_starts(used: np.ndarray, length: int) -> np.ndarray:
    """Where windows start that hold nothing marked."""
    marks = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(marks[length:] == marks[:-length]) if len(used) >= length else np.empty(0, np.int64)


def longest_run(used: np.ndarray) -> int:
    ends = np.flatnonzero(np.concatenate([[True], used, [True]]))
    return int(np.diff(ends).max()) - 1


def tile(doc: np.ndarray, item: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """Tiles ``(start in doc, start in item, length)`` of two code arrays, longest first, none overlapping another.

    How long the longest match of unmarked tokens is is found by halving: there is one of a length just if a window of
    the document has the fingerprint of one of the item. All matches of that length, by place, are then marked. Memory
    is that of the fingerprints, and lengths that occur are at most the root of twice the tokens, whatever repeats.
    """
    used_d, used_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p, q = free_starts(used_d, length), free_starts(used_i, length)
        fp, fq = fingerprints(doc, length)[p], fingerprints(item, length)[q]
        hit = np.isin(fp, fq)
        return p[hit], fp[hit], q, fq

    most = len(item)
    while True:
        low, high = k - 1, min(most, longest_run(used_d), longest_run(used_i))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < k:
            return tiles
        most = low
        p, fp, q, fq = common(low)
        order = np.argsort(fq, kind="stable")
        left, end = dict(zip(*np.unique(fq[order], return_index=True), strict=True)), len(order)
        marked = False
        for a, f in zip(p.tolist(), fp, strict=True):
            if used_d[a : a + low].any():
                continue
            at = left[f]  # places in the item that were taken stay taken
            while at < end and fq[order[at]] == f and used_i[q[order[at]] : q[order[at]] + low].any():
                at += 1
            left[f] = at
            if at < end and fq[order[at]] == f:
                b = int(q[order[at]])
                if (doc[a : a + low] == item[b : b + low]).all():
                    used_d[a : a + low] = used_i[b : b + low] = marked = True
                    tiles.append((a, b, low))
        if not marked:  # equal fingerprints of different windows
            most = low - 1


class Benchmark:
    """A benchmark as codes of its own vocabulary, and the items of each seed."""

    def __init__(self, rows: list[tuple[int, str]], k: int = K) -> None:
        self.k, self.vocabulary, self.items = k, {}, []
        seeds: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        for item_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
            found = tokens(text)
            if len(found) < k:
                continue
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64)
            seeds.append(fingerprints(codes, k))
            owner.append(np.full(len(codes) - k + 1, len(self.items)))
            self.items.append((item_id, codes))
        s, o = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((seeds, np.uint64), (owner, np.int64)))
        order = np.argsort(s, kind="stable")
        self.seeds, self.owner = s[order], o[order]

    def leaks(self, text: str | None) -> list[tuple[int, float]]:
        """``(item_id, coverage)`` of the items that share a seed with a text."""
        found = tokens(text)
        if len(found) < self.k or not len(self.seeds):
            return []
        codes = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))
        known = np.flatnonzero(codes)
        if len(known) < self.k:
            return []
        # windows whose tokens are all known: k known places in a row
        start = known[: len(known) - self.k + 1][known[self.k - 1 :] - known[: len(known) - self.k + 1] == self.k - 1]
        known_value = fingerprints(codes, self.k)[start]
        value = np.unique(known_value)
        lo, hi = np.searchsorted(self.seeds, value, "left"), np.searchsorted(self.seeds, value, "right")
        near = sorted({int(o) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True) for o in self.owner[a:b]})
        places = np.full(len(codes), -1, np.int64)
        out: dict[int, float] = {}
        for o in near:
            item_id, item = self.items[o]
            # only what windows shared with the item cover can be in a tile; the rest is as one token that no item has
            places[:] = -1
            for a in start[np.isin(known_value, fingerprints(item, self.k))]:
                places[a : a + self.k] = codes[a : a + self.k]
            gap = places < 0
            kept = places[~(gap & np.concatenate([[False], gap[:-1]]))]
            share = sum(t[2] for t in tile(kept, item, self.k)) / len(item)
            out[item_id] = max(share, out.get(item_id, 0.0))
        return sorted(out.items())


def verdict(doc_id: int | None, leaks: list[tuple[int, float]], coverage: float) -> tuple:
    hits = [i for i, c in leaks if c >= coverage]
    best = min(leaks, key=lambda x: (-x[1], x[0]), default=(None, 0.0))
    return doc_id, bool(hits), len(hits), best[0], float(best[1]), ",".join(map(str, hits))


def _tell(bench: Benchmark, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches):
            yield arrow.batch(FOUND, [verdict(d, bench.leaks(t), coverage) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    return run


def _clean(bench: Benchmark, coverage: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches):
            yield b.filter(pa.array([not any(c >= coverage for _, c in bench.leaks(t)) for t in b.column(text).to_pylist()], pa.bool_()))

    return run


def _pairs(bench: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches):
            yield arrow.batch(PAIRS, [(row, item, c) for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for item, c in bench.leaks(t)])

    return run


def blocks(benchmark: DataFrame, small: int, k: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about ``small`` tokens; one is on the driver at a time. An item is in one block, whole."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text") + 2), F.lit(0))).first()[0]
    n = max(1, -(-size // (2 * small)))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield Benchmark([tuple(r) for r in part.collect()], k)


def _leaks(docs: DataFrame, parts: list[Benchmark]) -> DataFrame:
    """``(row, item_id, coverage)`` of documents and items that share a seed: a pass over the documents for each block."""
    named = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "text").where("text is not null")
    scratch, found = Scratch(docs.sparkSession, "decontamination"), None
    for i, bench in enumerate(parts):
        part = scratch.save(named.mapInArrow(arrow.tidy(_pairs(bench)), arrow.ddl(PAIRS)), f"leaks-{i}")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("row", "item_id").agg(F.max("coverage").alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, k: int = K, small: int = SMALL) -> DataFrame:
    """Which rows of ``docs(doc_id, text)`` hold items of ``benchmark(item_id, text)``.

    Returns ``doc_id, contaminated, n_items, best_item, coverage, items``: the number of items of which tiles
    cover ``coverage`` or more, the item best covered (of equals the smallest id; null if none shares a seed),
    its coverage, and the ids of the leaked items, comma-joined. Defined cases: a null or empty text holds
    nothing; items of fewer than ``k`` tokens, null texts or null ids are no evidence; of items that share an
    id the best counts; repeated rows get equal results; an empty table gives no rows, an empty benchmark
    clean ones; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = list(blocks(benchmark, small, k))
    if len(parts) == 1:
        return docs.mapInArrow(arrow.tidy(_tell(parts[0], coverage)), arrow.ddl(FOUND))
    best = _leaks(docs, parts).groupBy("row").agg(
        F.min(F.struct((-F.col("coverage")).alias("less"), "item_id")).alias("best"), F.sort_array(F.collect_list(F.when(F.col("coverage") >= coverage, F.col("item_id")))).alias("hits")
    )
    out = docs.withColumn("row", F.xxhash64("doc_id", "text")).join(best, "row", "left")
    hits = F.coalesce("hits", F.array().cast("array<long>"))
    return out.select("doc_id", (F.size(hits) > 0).alias("contaminated"), F.size(hits).cast("long").alias("n_items"), F.col("best.item_id").alias("best_item"), F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("coverage"), F.concat_ws(",", hits.cast("array<string>")).alias("items"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, k: int = K, small: int = SMALL) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item of ``benchmark``; cases as in :func:`decontaminate`."""
    parts = list(blocks(benchmark, small, k))
    if len(parts) == 1:
        return docs.mapInArrow(arrow.tidy(_clean(parts[0], coverage, docs.columns.index("text"))), docs.schema)
    bad = _leaks(docs, parts).where(F.col("coverage") >= coverage).select(F.col("row").alias("__leak")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == F.col("__leak"), "left_anti")
