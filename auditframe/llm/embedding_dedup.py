"""Near-duplicate embeddings by an inverted multi-index.

Vectors of unit length are cut in halves; each half has a codebook of its own, and the pairs of codewords are
the cells of a product grid. Every vector is filed in one cell. As a query it visits cells in the order of
their distance, as many as find a neighbour at the threshold with the target recall, and is compared in double
precision with what is filed there. Codebooks and the number of visits are fitted on a bounded sample.

How fine the grid is follows
from the visits that each of several grids needs on the sample and from the size of the largest label. Equal vectors are one class. A cell is compared in blocks of at most ``BLOCK`` filed and ``BLOCK`` visiting
vectors; what leaves a block is a count for each vector and a forest of links, never the pairs. A pair that
both sides can find is counted by each for itself, a pair that one side finds is counted there for both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .minhash import forest
from .scratch import Scratch, components, tasks

#: Codewords a half of the grids tried; vectors a cell should hold at least; what a visit costs in comparisons.
GRIDS, LEAST_IN_CELL, VISIT = (6, 12, 24, 48, 96, 192, 384), 8, 100
#: Sampled vectors; made neighbours that the visits are fitted on; the recall they must have; rows of a block.
SAMPLE, TRIALS, RECALL, BLOCK = 20_000, 1500, 0.998, 1024
#: Sampled vectors of a length from which it gets codebooks.
FEW = 50
READ = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("vector", pa.binary())])
FILED = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("role", pa.int32()), ("id", pa.int64()), ("copies", pa.int64()), ("home", pa.int32()), ("vector", pa.binary())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)[None, :], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from distinct sampled rows; a word without rows stays where it is."""
    rng = np.random.default_rng(31)
    start = np.unique(x, axis=0)
    words = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds if x.shape[1] else 0):
        near = squares(x, words).argmin(1)
        for i in np.unique(near):
            words[i] = x[near == i].mean(0)
    return words


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """Cells in the order of their distance, the nearest ``visits``.

        Both halves' words are sorted by distance. The cell of the a-th and the b-th word has at least
        (a + 1)(b + 1) - 1 cells before it, so only that staircase of sums is looked at.
        """
        n = min(visits or self.visits, len(self.first) * len(self.second))
        half = x.shape[1] // 2
        d1, d2 = squares(x[:, :half], self.first), squares(x[:, half:], self.second)
        o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        stair = [(a, b) for a in range(len(self.first)) for b in range(len(self.second)) if (a + 1) * (b + 1) <= n]
        a, b = (np.array(v) for v in zip(*stair, strict=True))
        order = (s1[:, a] + s2[:, b]).argsort(1, kind="stable")[:, :n]
        return (o1[np.arange(len(x))[:, None], a[order]] * len(self.second) + o2[np.arange(len(x))[:, None], b[order]]).astype(np.int32)


    def rank(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of a cell among those that each row visits, ties last; rows a few at a time."""
        half, out = x.shape[1] // 2, np.empty(len(x), np.int64)
        for i in range(0, len(x), 64):
            d1, d2 = squares(x[i : i + 64, :half], self.first), squares(x[i : i + 64, half:], self.second)
            a, b = np.divmod(cells[i : i + 64], len(self.second))
            rows = np.arange(len(d1))
            out[i : i + 64] = (d1[:, :, None] + d2[:, None, :] <= (d1[rows, a] + d2[rows, b])[:, None, None]).sum((1, 2))
        return out


def fit(sample: np.ndarray, least: float, *, words: int, recall: float = RECALL) -> Index:
    """Codebooks, and visits enough that one of two vectors at the threshold reaches the other's cell with the target recall."""
    x, half = unit(sample), sample.shape[1] // 2
    index = Index(codebook(x[:, :half], words), codebook(x[:, half:], words), 1)
    rng = np.random.default_rng(32)
    q = x[rng.integers(0, len(x), TRIALS)]
    home = index.cells(q, 1)[:, 0]
    # neighbours lie to all sides alike, or where the sample's vectors differ: the harder case counts
    for side in (rng.normal(size=q.shape), x[rng.integers(0, len(x), TRIALS)] - x[rng.integers(0, len(x), TRIALS)]):
        side = side - (side * q).sum(1, keepdims=True) * q
        norm = np.linalg.norm(side, axis=1, keepdims=True)
        near = least * q + np.sqrt(1 - least**2) * np.divide(side, norm, out=np.zeros_like(side), where=norm > 1e-12)
        rank = np.minimum(index.rank(q, index.cells(near, 1)[:, 0]), index.rank(near, home))
        index.visits = max(index.visits, int(np.quantile(rank, recall, method="higher")))
    return index


def best_index(sample: np.ndarray, least: float, largest: int, *, words: int | None = None, recall: float = RECALL) -> Index:
    """The grid with the least work for a vector of the largest label: each visit is a row to move and a cell to compare."""
    tried = [words] if words else [k for k in GRIDS if k == GRIDS[0] or k * k * LEAST_IN_CELL <= largest and 16 * k <= len(sample)]
    fitted = [fit(sample, least, words=k, recall=recall) for k in tried]
    return min(fitted, key=lambda i: i.visits * (VISIT + largest / (len(i.first) * len(i.second))))


def one_cell(dim: int) -> Index:
    """The index of a length that the sample has none of: everything is in one cell."""
    return Index(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)), 1)


def _read(double: bool):
    kind = np.dtype("<f8" if double else "<f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for vec, label, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.array(e if e is not None and None not in e else [], kind)
                if label is None or vec is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    rows.append((vec, label, 0, 0, 0, None))
                    continue
                x = x + kind.type(0)  # -0.0 is 0.0
                d = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes() + str(label).encode()), np.int64).tolist()
                rows.append((vec, label, len(x), *d, x.tobytes()))
            yield arrow.batch(READ, rows)

    return run


def _file(indexes: dict[int, Index], kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2000):
                label, dims, ids, copies, vectors = (c.slice(at, 2000).to_pylist() for c in b.columns)
                rows = []
                for dim in sorted(set(dims)):
                    use = [i for i, d in enumerate(dims) if d == dim]
                    x = unit(np.frombuffer(b"".join(vectors[i] for i in use), kind).reshape(len(use), dim).astype(float))
                    index = indexes.get(dim) or one_cell(dim)
                    for i, v in zip(use, index.cells(x).tolist(), strict=True):
                        rows.append((label[i], dim, v[0], 0, ids[i], copies[i], v[0], vectors[i]))
                        rows.extend((label[i], dim, c, 1, ids[i], copies[i], v[0], vectors[i]) for c in v)
                yield arrow.batch(FILED, rows)

    return run


def _compare(indexes: dict[int, Index], least: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, dim, cell, _, _), rows in arrow.runs(batches, 5):
            filed, came = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
            if not filed or not came:
                continue
            x, q = (unit(np.frombuffer(b"".join(r[4] for r in part), kind).reshape(len(part), dim).astype(float)) for part in (filed, came))
            xi, qi = (np.array([r[1] for r in part]) for part in (filed, came))
            xn, qn = (np.array([r[2] for r in part]) for part in (filed, came))
            link = (q @ x.T >= least) & (qi[:, None] != xi[None, :])
            if not link.any():
                continue
            home = np.array([r[3] for r in came])
            some = np.flatnonzero(link.any(0))
            visits = (indexes.get(dim) or one_cell(dim)).cells(x[some])  # of those that a link needs
            both = np.zeros_like(link)  # x, on its own way, comes to q too
            for h in np.unique(home[link.any(1)]):
                both[np.ix_(home == h, some)] = (visits == h).any(1)[None, :] | (h == cell)
            for i, n in zip(qi.tolist(), (link @ xn).tolist(), strict=True):
                if n:
                    out.append((i, None, n))
            for i, n in zip(xi.tolist(), ((link & ~both).T @ qn).tolist(), strict=True):
                if n:
                    out.append((i, None, n))
            nodes, place = np.unique(np.concatenate([qi, xi]), return_inverse=True)
            m = np.zeros((len(nodes), len(nodes)), bool)
            m[place[: len(qi), None], place[None, len(qi) :]] = link
            # nodes that are in both parts have a row of each
            m |= m.T
            out.extend((int(nodes[a]), int(nodes[b]), 0) for a, b in enumerate(forest(m)) if a != b)
            if len(out) > 50_000:
                yield arrow.batch(FOUND, out)
                out = []
        yield arrow.batch(FOUND, out)

    return run


def near_embeddings(vectors: DataFrame, *, least: float = 0.93, recall: float = RECALL, sample: int = SAMPLE, words: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links of ``vectors(vec_id, embedding, label)`` with equal labels and a cosine of ``least`` or more.

    Returns ``vec_id, n_links, component_id, kept`` for every row: how many other vectors it is linked with
    directly, the smallest vec_id reachable, whether that is its own. Defined cases: a vector that is null, empty,
    zero or holds null or non-finite components, one without a label, and one without a vec_id (whose component
    is null, and which is kept) link with nothing; vectors of different lengths, of which there may
    be any number, link with nothing; equal
    vectors always link; rows that repeat a vec_id are one node of the components and each counts as a vector;
    an empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    double = dict(vectors.dtypes)["embedding"] == "array<double>"
    kind = "<f8" if double else "<f4"
    plain = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>" if double else "array<float>"))
    read = scratch.save(plain.mapInArrow(arrow.tidy(_read(double)), arrow.ddl(READ)), "read")

    live = read.where("vector is not null")
    reps = live.groupBy("hi", "lo").agg(F.min(F.struct("vec_id", "label", "dim", "vector")).alias("r"), F.count("*").alias("copies"))
    reps = scratch.save(reps.select("hi", "lo", "copies", F.col("r.vec_id").alias("id"), "r.label", "r.dim", "r.vector"), "reps")
    largest = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    some = reps.select("dim", F.xxhash64("hi", "lo").alias("h"), "vector").orderBy("h").limit(sample).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in some:
        by_dim.setdefault(r.dim, []).append(r.vector)
    # a length with few vectors in the sample is one cell, as is one with none
    indexes = {dim: best_index(np.frombuffer(b"".join(v), kind).reshape(-1, dim).astype(float), least, largest, words=words, recall=recall) for dim, v in by_dim.items() if dim > 1 and len(v) >= FEW}

    filed = reps.select("label", "dim", "id", "copies", "vector").mapInArrow(arrow.tidy(_file(indexes, kind)), arrow.ddl(FILED))
    filed = scratch.save(filed, "filed")
    sizes = filed.groupBy("label", "dim", "cell").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == 1).alias("n1"))
    sizes = sizes.where("n0 > 0 and n1 > 1").select("label", "dim", "cell", F.ceil(F.col("n0") / block).cast("int").alias("p0"), F.ceil(F.col("n1") / block).cast("int").alias("p1"))
    dealt = filed.join(sizes, ["label", "dim", "cell"])
    mine = F.when(F.col("role") == 0, F.pmod(F.xxhash64("id"), F.col("p0"))).otherwise(F.pmod(F.xxhash64("id"), F.col("p1"))).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("p1")).otherwise(F.col("p0")) - 1)))
    keys = ["label", "dim", "cell", "i", "j"]
    dealt = dealt.select("label", "dim", "cell", F.when(F.col("role") == 0, F.col("mine")).otherwise(F.col("other")).alias("i"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("mine")).alias("j"), "role", "id", "copies", "home", "vector")
    dealt = dealt.repartition(tasks(spark), *keys).sortWithinPartitions(*keys)
    found = scratch.save(dealt.mapInArrow(arrow.tidy(_compare(indexes, least, kind)), arrow.ddl(FOUND)), "found")

    groups = components(scratch, found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    named = reps.join(counts, "id", "left").join(groups, "id", "left")
    named = named.select("hi", "lo", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("named"))
    out = read.join(named.where("n_links > 0"), ["hi", "lo"], "left")
    ok = F.col("vector").isNotNull()
    out = out.select("vec_id", F.when(ok, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(ok, F.coalesce("named", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
