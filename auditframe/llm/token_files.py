"""Token ids in Arrow files of equal-length sequences.

A shard is two Arrow IPC files: ``*.tokens.arrow`` with record batches of ``BATCH`` sequences, each a
fixed-size list of ids and one of mask bytes (0 where the last sequence is padded; a dictionary, since there are two), and ``*.docs.arrow``
with where each document starts in the shard and how many ids it has. Both are uncompressed, so sequence i is
found by arithmetic and read without a copy from a memory map. Documents run on across sequences; each ends
with the end id.

Shards follow doc_id: they are ranges of it, sorted inside. An attempt of a task writes under a name of its
own and its row reaches the manifest only if the task succeeds, so a lost executor leaves no half shard.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import new_path
from . import arrow
from .scratch import Scratch, tasks

LENGTH, BATCH, END = 2048, 64, 2
#: Pieces of text with their ids that a worker remembers, and as many of those it used before that.
KEPT = 150_000
SHARDS = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
DIGESTS = pa.schema([*DOCS, ("ids_crc32", pa.int64())])
#: How byte-level BPE files without a normaliser split a text, and the same for ASCII alone.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
ASCII_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: Characters beside ASCII that most texts in Latin letters keep to, by what they are to ``SPLIT``; it reads a text with any other.
LATIN = [*range(0x80, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]


def latin_split() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """``SPLIT`` for texts in ``LATIN`` characters, which the plain library reads in half the time, and what finds any other."""
    among = lambda kind: "".join(chr(c) for c in LATIN if regex.fullmatch(kind, chr(c)))
    letter, number, space = "A-Za-z" + among(r"\p{L}"), "0-9" + among(r"\p{N}"), r" \t-\r" + among(r"\p{White_Space}")
    split = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    return split, re.compile(rf"[^\x00-\x7f{''.join(map(chr, LATIN))}]")


LATIN_SPLIT, BEYOND_LATIN = latin_split()


def byte_characters() -> str:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else one of those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class Encoder(dict):
    """Ids of texts as bytes. The model of a file that splits texts as ``SPLIT`` is asked for each piece once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        own = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.before: dict[str, bytes] = {}
        self.model, self.place = self.tokenizer.model, byte_characters()
        self.bytes_of = [np.array([i], self.kind).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        #: Strings that the file has ids of their own for; a text that holds one is left to the library.
        self.own = [t["content"] for t in said.get("added_tokens", [])]
        self.by_piece = said["model"].get("type") == "BPE" and not said.get("normalizer") and own.items() <= ({"use_regex": True} | (said.get("pre_tokenizer") or {})).items()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, piece: str) -> bytes:
        got = self.before.get(piece)
        if got is None:
            said, _ = codecs.charmap_decode(piece.encode("utf-8"), "strict", self.place)
            got = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(said)])
        if len(self) >= KEPT:
            self.before = dict(self)
            self.clear()
        self[piece] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or any(t in text for t in self.own):
            return self.whole(text)
        split = ASCII_SPLIT if text.isascii() else SPLIT if BEYOND_LATIN.search(text) else LATIN_SPLIT
        return b"".join(map(self.__getitem__, split.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pa.fs.LocalFileSystem(), path)


class Writer:
    """Appends ids and writes full batches; holds less than one batch."""

    def __init__(self, path: str, kind: np.dtype, length: int) -> None:
        fs, at = _place(path)
        fs.create_dir(os.path.dirname(at), recursive=True)
        self.length, self.kind, self.held, self.size, self.total = length, kind, [], 0, 0
        self.masks = [np.ones(length, np.uint8)]
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])
        self.sink = fs.open_output_stream(f"{at}.tokens.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.docs_sink = fs.open_output_stream(f"{at}.docs.arrow")
        self.docs = pa.ipc.new_file(self.docs_sink, DOCS)

    def _emit(self, ids: np.ndarray) -> None:
        real = len(ids)
        rows = -(-real // self.length)
        ids = np.concatenate([ids, np.zeros(rows * self.length - real, self.kind)])
        last = real - (rows - 1) * self.length
        which = np.zeros(rows, np.int8)
        if last < self.length:  # only a shard's last sequence
            which[-1] = len(self.masks)
            self.masks.append((np.arange(self.length) < last).astype(np.uint8))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.concatenate(self.masks))]
        self.out.write_batch(pa.RecordBatch.from_arrays([lists[0], pa.DictionaryArray.from_arrays(pa.array(which), lists[1])], schema=self.schema))

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        full = self.length * BATCH * self.kind.itemsize
        if self.size >= full:
            joined = b"".join(self.held)
            for i in range(0, self.size - full + 1, full):
                self._emit(np.frombuffer(joined, self.kind, self.length * BATCH, i))
            self.held = [joined[self.size - self.size % full :]]
            self.size %= full
        self.total += len(data) // self.kind.itemsize

    def close(self) -> None:
        if self.size:
            self._emit(np.frombuffer(b"".join(self.held), self.kind))
        for x in (self.out, self.sink, self.docs, self.docs_sink):
            x.close()


class TokenFile:
    """Random access to a shard's sequences and documents."""

    def __init__(self, path: str) -> None:
        fs, at = _place(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(f"{at}.tokens.arrow") if local else fs.open_input_file(f"{at}.tokens.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.docs = pa.ipc.open_file(pa.memory_map(f"{at}.docs.arrow") if local else fs.open_input_file(f"{at}.docs.arrow"))
        self.at, self.held = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.at, self.held = i, self.file.get_batch(i)
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a sequence, neither copied: a view of the file, and one of the file's masks."""
        row = self._batch(i // BATCH)
        n = i % BATCH
        ids = row.column(0).flatten().to_numpy()[n * self.length : (n + 1) * self.length]
        mask = row.column(1)
        at = mask.indices[n].as_py() * self.length
        return ids, mask.dictionary.flatten().to_numpy()[at : at + self.length].view(bool)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard."""
        step, parts = self.length * BATCH, []
        for i in range(start // step, (start + n - 1) // step + 1 if n else 0):
            ids = self._batch(i).column(0).flatten().to_numpy()
            parts.append(ids[max(0, start - i * step) : start + n - i * step])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def _write(tokenizer: str, root: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, n_docs, shard = None, 0, TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        enc = encoder(tokenizer)
        last = np.array([end], enc.kind).tobytes()
        for b in arrow.slices(batches):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    writer = Writer(path, enc.kind, length)
                data = enc.encode(text) + last
                rows.append((doc, writer.total, len(data) // enc.kind.itemsize))
                writer.add(data)
            if rows:
                writer.docs.write_batch(arrow.batch(DOCS, rows))
                n_docs += len(rows)
        if writer is not None:
            writer.close()
            yield arrow.batch(SHARDS, [(shard, path, n_docs, writer.total)])

    return run


def write(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, end: int = END, root: str | None = None) -> DataFrame:
    """Writes ``docs(doc_id, text)`` in ascending doc_id order and returns the manifest ``(shard, path, n_docs, n_ids)``.

    ``root`` is a folder that driver and executors share; by default one below ``spark.checkpoint.dir`` that goes when the process ends.
    Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows that repeat a doc_id
    follow each other by the hash of their texts; strings of special tokens in a text get the ids that the library gives them; an
    empty table gives an empty manifest and no file; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    root = root or new_path(spark, "token-files")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ranged = ranged.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return scratch.save(ranged.mapInArrow(arrow.tidy(_write(tokenizer, root, length, end)), arrow.ddl(SHARDS)), "manifest")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
            shard = TokenFile(path)
            for i in range(shard.docs.num_record_batches):
                rows = []
                for doc, start, n in zip(*(c.to_pylist() for c in shard.docs.get_batch(i).columns), strict=True):
                    rows.append((doc, offset + start, n, zlib.crc32(shard.tokens(start, n).astype("<u4").tobytes())))
                yield arrow.batch(DIGESTS, rows)


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files of a manifest.

    The manifest has one row a shard; their sizes, added up in order, are where shards start.
    """
    rows, at, placed = manifest.orderBy("shard").collect(), 0, []
    for r in rows:
        placed.append((r.path, at))
        at += r.n_ids
    shards = spark.createDataFrame(placed, "path string, offset long").repartition(max(1, len(placed)))
    return shards.mapInArrow(arrow.tidy(_digest), arrow.ddl(DIGESTS))
