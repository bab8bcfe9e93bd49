"""Near-duplicate documents by min-max hashing, verified on full shingle sets.

1. One pass over the texts keeps, under each permutation, the smallest and the largest value: two signature
   entries for one hash evaluation. Entries are banded; equal sets are one class from here on.
2. Classes that share a band are compared by one byte of each signature entry, inside blocks of bounded size.
   Pairs that may reach the threshold, with five standard deviations to spare, make candidate clusters.
3. The full sets of a cluster meet in blocks of bounded size and are intersected exactly. Links of a block
   leave it as a forest, and connected components of the forests are the groups.

No pair of documents is ever a row. The number of bands follows from the threshold so that a pair at the
threshold is missed with a probability of ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .scratch import Scratch, components, tasks
from .shingles import WordHashes, shingle_set, stir

ROWS, MISS = 5, 1e-6
#: Classes in a block of a band, classes and shingles in a block of a cluster.
BAND_BLOCK, SET_BLOCK, SET_SHINGLES = 256, 512, 3_000_000
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
SETS = pa.schema([("cluster", pa.int64()), ("parts", pa.int32()), ("id", pa.int64()), ("shingles", pa.binary())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def min_max(shingles: np.ndarray, permutations: np.ndarray) -> np.ndarray:
    """The smallest and the largest value under each permutation, in blocks of bounded memory."""
    low, high = np.full(len(permutations), 2**64 - 1, np.uint64), np.zeros(len(permutations), np.uint64)
    for i in range(0, len(shingles), 2048):
        x = shingles[None, i : i + 2048] * permutations[:, None]
        x ^= x >> np.uint64(32)
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.concatenate([low, high])


def _sign(bands: int, k: int):
    half = -(-bands * ROWS // 2)
    permutations = np.random.default_rng(77).integers(0, 2**63, half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place = stir(np.arange(1, bands * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    order = np.random.default_rng(78).permutation(2 * half)[: bands * ROWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in arrow.slices(batches):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingle_set(text, seen, k)
                if not len(s):
                    rows.append((doc, 0, 0, 0, None, None))
                    continue
                d = xxhash.xxh3_128_digest(s.tobytes())
                entries = stir(min_max(s, permutations))[order]
                keys = stir((stir(entries + place) * place).reshape(bands, ROWS).sum(1, dtype=np.uint64))
                rows.append((doc, len(s), *np.frombuffer(d, np.int64).tolist(), keys.view(np.int64).tolist(), entries.astype(np.uint8).tobytes()))
            yield arrow.batch(SIGNED, rows)

    return run


def forest(link: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row of a symmetric boolean matrix."""
    n = len(link)
    label, none = np.arange(n), n
    while True:
        found = np.minimum(label, np.where(link, label[None, :], none).min(1, initial=none))
        found = found[found]
        if (found == label).all():
            return label
        label = found


def _alike(least: float):
    """Blocks of ``(bucket, i, j)`` with rows ``(part, id, signature)`` to edges that join what may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for (_, i, j), rows in arrow.runs(batches, 3):
            rows.sort(key=lambda r: r[1])
            ids, part = [r[1] for r in rows], np.array([r[0] for r in rows])
            m = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
            link = np.zeros((len(rows), len(rows)), bool)
            for a in range(len(rows) - 1):
                same = (m[a + 1 :] == m[a]).mean(1)
                link[a, a + 1 :] = (same - 1 / 256) * (256 / 255) >= least
            if i != j:
                link &= part[:, None] != part[None, :]
            edges.update((ids[a], ids[b]) for a, b in enumerate(forest(link | link.T)) if a != b)
            if len(edges) > 50_000:
                yield arrow.batch(EDGES, list(edges))
                edges.clear()
        yield arrow.batch(EDGES, list(edges))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in arrow.slices(batches):
            cluster, parts, ids, texts = (c.to_pylist() for c in b.columns)
            yield arrow.batch(SETS, [(c, p, i, shingle_set(t, seen, k).tobytes()) for c, p, i, t in zip(cluster, parts, ids, texts, strict=True)])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of blocks of the incidence matrix."""
    n = len(sets)
    if n == 2:
        x = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), x], [x, len(sets[1])]], float)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    rank = np.cumsum(count > 1) - 1
    column = rank[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, width = np.zeros((n, n)), 2048
    for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        m = np.zeros((n, width), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        total += m @ m.T
    return total


def _verify(percent: int):
    """Blocks of ``(cluster, i, j)`` with rows ``(part, id, shingles)`` to a forest of exact links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for (_, i, j), rows in arrow.runs(batches, 3):
            rows.sort(key=lambda r: r[1])
            ids, part = [r[1] for r in rows], np.array([r[0] for r in rows])
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            size = np.array([len(s) for s in sets], float)
            both = intersections(sets)
            link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            if i != j:
                link &= part[:, None] != part[None, :]
            edges.extend((ids[a], ids[b]) for a, b in enumerate(forest(link)) if a != b)
            if len(edges) > 50_000:
                yield arrow.batch(EDGES, edges)
                edges = []
        yield arrow.batch(EDGES, edges)

    return run


def blocks(frame: DataFrame, key: str, *payload: str) -> DataFrame:
    """Rows of ``frame(key, parts, id, payload)`` once for each pair of parts they belong to, runs together."""
    at = frame.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = at.select(key, F.least("part", "other").cast("int").alias("i"), F.greatest("part", "other").cast("int").alias("j"), "part", "id", *payload)
    return at.repartition(tasks(frame.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def perhaps(rows: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """``rows`` and ``__hit``, false only for rows whose key is none of the wanted, so that a join needn't move them.

    A bit for each of 2**26 hashes, set where a wanted key falls: 2,048 rows of 4 KB, 8 MB, however many keys there are.
    With more keys more rows hit; what a join then finds among them is the same.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 26))
    bits = wanted.select(place(of).alias("__p")).groupBy(F.bitmap_bucket_number("__p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__bits"))
    bit = F.bitmap_bit_position(place(rows[key]))
    byte = F.conv(F.hex(F.substring(bits["__bits"], (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(rows[key])) == bits["__bucket"], "left")
    return met.select(rows["*"], F.coalesce(hit, F.lit(False)).alias("__hit"))


def near_duplicates(docs: DataFrame, *, percent: int = 80, k: int = 5) -> DataFrame:
    """Groups of ``docs(doc_id, text)`` whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id, kept`` for every row: component_id is the smallest doc_id
    reachable by links, kept says that it is the row's own. Defined cases: a null, empty or blank text has no
    shingles and links with nothing; fewer than ``k`` words are one shingle; rows that repeat a doc_id are one
    node, so their links are shared; a row with a null doc_id links with nothing, has a null component_id and
    is kept; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch, threshold, bands = Scratch(spark, "minhash"), percent / 100, bands_for(percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(docs.mapInArrow(arrow.tidy(_sign(bands, k)), arrow.ddl(SIGNED)), "signed")

    live = signed.where("n_shingles > 0 and doc_id is not null")
    first = live.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("r"), F.count("*").alias("copies"))
    reps = scratch.save(first.select("hi", "lo", "copies", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.bands", "r.signature"), "reps")

    banded = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("n", "members").agg(F.min("bucket").alias("bucket"))  # those with the same members are one
    buckets = buckets.select("bucket", F.ceil(F.col("n") / BAND_BLOCK).cast("int").alias("parts"))
    near = banded.join(buckets, "bucket").join(reps.select("id", "signature"), "id")
    slack = 5.2 * math.sqrt(threshold * (1 - threshold) / (bands * ROWS))
    maybe = blocks(near, "bucket", "signature").mapInArrow(arrow.tidy(_alike(threshold - slack)), arrow.ddl(EDGES))
    maybe = scratch.save(maybe.distinct(), "maybe")

    clusters = components(scratch, maybe, "clusters")
    clusters = scratch.save(clusters.join(reps.select("id", "n_shingles"), "id"), "members")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    parts = F.greatest(F.ceil(F.col("n") / SET_BLOCK), F.ceil(F.col("weight") / SET_SHINGLES)).cast("int")
    members = clusters.join(sizes.select("component", parts.alias("parts")), "component").select(F.col("component").alias("cluster"), "parts", "id")
    near = perhaps(docs.where("text is not null"), "doc_id", members, "id").where("__hit")
    texts = near.join(members, F.col("doc_id") == F.col("id")).select("cluster", "parts", "id", "text")
    sets = texts.mapInArrow(arrow.tidy(_sets(k)), arrow.ddl(SETS)).where("length(shingles) > 0")
    sure = blocks(sets, "cluster", "shingles").mapInArrow(arrow.tidy(_verify(percent)), arrow.ddl(EDGES))
    sure = scratch.save(sure.distinct(), "sure")

    groups = components(scratch, sure, "groups")
    named = reps.join(groups, "id", "left").where("copies > 1 or component is not null").select("hi", "lo", F.coalesce("component", "id").alias("named"))
    out = signed.join(named, ["hi", "lo"], "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("named", "doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, *, percent: int = 80, k: int = 5) -> DataFrame:
    """Rows of ``docs``, all columns, without those that :func:`near_duplicates` doesn't keep.

    Rows that repeat a kept doc_id stay; a row with a null doc_id stays.
    """
    gone = near_duplicates(docs, percent=percent, k=k).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = Scratch(docs.sparkSession, "minhash-gone").save(gone, "gone")
    told = perhaps(docs, "doc_id", gone, "__gone")
    stay = told.where("__hit").join(gone, told["doc_id"] == gone["__gone"], "left_anti")
    return told.where("not __hit").unionByName(stay).select(*(F.col(f"`{c}`") for c in docs.columns))
