"""Token ids in files of bit planes, one after another in ascending doc_id order.

Ids are cut into blocks of a fixed size. A block is transposed, so that bit k (or byte k) of all its ids lies
together in plane k; planes without a bit are left out and each other one is compressed with zstandard. A file is

    magic, compressed planes of block 0, of block 1, ..., footer, length of the footer (8 bytes), magic

and its footer (JSON behind zstandard) holds the format, the chunk index (a block's place, number of ids, checksum,
and its planes' numbers and sizes) and the documents (doc_id and number of ids each), so any document's
ids are found without reading the blocks before. `_manifest.json` lists the files in order.

Files are written and read by Spark as the data source `idplanes`: rows sorted by range go to one file a task; tasks
stream, holding a block and 16 bytes a document. A task that is repeated writes another file; the manifest,
written when all are done, has one file a task. Reading splits files by blocks, so one large file is read by many tasks.

Rows of equal doc_id, repeated rows and those with a null doc_id (which come first) included, follow each other in the
input's order and may share several files. Null or empty text: the end id alone. A long text may span many
blocks; only a document's own ids are held at once. Extra columns, whatever their names, are ignored. An
empty table gives a manifest with no ids and no rows.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import free_name, id_and_text, shared_dir, slices, texts_of
from .token_counts import PATTERN, byte_symbols

MAGIC, MANIFEST = b"IDPLANE1", "_manifest.json"
#: Ids of a block. Of 49,408 ids byte planes take 10.9 bits an id, bit planes 12.6; both are offered.
BLOCK = 1 << 16
#: Words that a worker remembers the ids of.
REMEMBERED = 400_000
#: Ids that one reading task takes, about.
SHARE = 16 << 20
READ = "doc_id long, start long, n_tokens long, ids binary"


class IdEncoder(dict):
    """Ids of texts (little-endian, four bytes each) as the library's default encoding gives them.

    White space always ends a pre-token, so texts are cut at it and each different word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)))
        self.rare = re.compile("[\x1c-\x1f]").search  # white space to Python only
        self.find = regex.compile(PATTERN).findall
        self.stands = dict(enumerate(byte_symbols()))
        self.bytes_of = {c: b for b, c in self.stands.items()}
        self.raw = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.tokenize = self.library.model.tokenize

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        if plain or max(word) < "ɐ":
            cut = self.find(word)
        else:  # characters on whose class Unicode versions may differ
            cut = self.library.pre_tokenizer.pre_tokenize_str(word)
            cut = [bytes(self.bytes_of[c] for c in w).decode() for w, _ in cut]
        if len(cut) > 1:
            found = b"".join(map(self.__getitem__, cut))
        else:
            found = b"".join([self.raw[t.id] for t in self.tokenize(word if plain else word.encode().decode("latin-1").translate(self.stands))])
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if "<|" in text and self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii() and not self.rare(text) or text and max(text) < "ɐ" and not self.rare(text):
            words = text.lower().split()
        else:
            words = [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> IdEncoder:
    """A worker's encoder, which its later tasks find with the words that it remembers."""
    return IdEncoder(path)


def planes_of(ids: np.ndarray, by: str) -> dict[int, bytes]:
    """The planes of a block that have a bit set: bits of eight ids share a byte, the first id in the lowest."""
    used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    out: dict[int, bytes] = {}
    for k in range(4):
        if not used >> 8 * k & 255:
            continue
        column = np.ascontiguousarray(octets[:, k])
        if by == "byte":
            out[k] = column.tobytes()
            continue
        for j in range(8):
            if used >> 8 * k + j & 1:
                out[8 * k + j] = np.packbits(column & (1 << j), bitorder="little").tobytes()
    return out


def ids_of(planes: dict[int, bytes], n: int, by: str) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    for k, raw in planes.items():
        if by == "byte":
            octets[:, k] = np.frombuffer(raw, np.uint8)
        else:
            octets[:, k // 8] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little") << (k % 8)
    return octets.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; ids may come in any pieces."""

    def __init__(self, out, by: str = "byte", block: int = BLOCK, level: int = 3):
        if by not in ("bit", "byte"):
            raise ValueError(f"planes are by bit or byte, not {by}")
        self.out, self.by, self.block, self.at = out, by, block, len(MAGIC)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.index: list[tuple] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u4")
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            held = np.concatenate(self.pending)
            whole = len(held) - len(held) % self.block
            for a in range(0, whole, self.block):
                self._put(held[a : a + self.block])
            self.pending, self.waiting = [held[whole:].copy()], len(held) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = {k: self.zstd.compress(p) for k, p in planes_of(ids, self.by).items()}
        self.index.append((self.at, len(ids), zlib.crc32(ids.tobytes()), list(planes), [len(p) for p in planes.values()]))
        for p in planes.values():
            self.at += self.out.write(p)

    def close(self) -> int:
        """Writes what is left and the footer; the file's size."""
        if self.waiting:
            self._put(np.concatenate(self.pending))
        foot = json.dumps({"by": self.by, "block": self.block, "chunks": self.index, "doc_ids": self.docs, "sizes": self.sizes}).encode()
        foot = self.zstd.compress(foot)
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        return self.at + len(foot) + 8 + len(MAGIC)


class PlaneFile:
    """A file's footer, and the ids of its blocks."""

    def __init__(self, source, size: int):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(size - 8 - len(MAGIC))
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes, or one cut short")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 8 - len(MAGIC) - n)
        foot = json.loads(self.zstd.decompress(source.read(n)))
        self.by, self.block, self.chunks = foot["by"], foot["block"], foot["chunks"]
        self.doc_ids, self.sizes = foot["doc_ids"], np.array(foot["sizes"], np.int64)

    def ids(self, chunk: int) -> np.ndarray:
        at, n, crc, numbers, sizes = self.chunks[chunk]
        self.source.seek(at)
        planes = {k: self.zstd.decompress(self.source.read(size)) for k, size in zip(numbers, sizes, strict=True)}
        ids = ids_of(planes, n, self.by)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {chunk} has another checksum than its index")
        return ids

    def documents(self, first: int, stop: int) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, start in the file and ids of the documents that start in blocks first to stop - 1 (those at its end with the last)."""
        starts = np.cumsum(self.sizes) - self.sizes
        a = int(np.searchsorted(starts, first * self.block)) if first else 0
        b = int(np.searchsorted(starts, stop * self.block)) if stop < len(self.chunks) else len(starts)
        held, low = np.zeros(0, np.uint32), first * self.block  # ids from place low on
        chunk = first
        for d in range(a, b):
            start, n = int(starts[d]), int(self.sizes[d])
            parts = [held[start - low :]] if start - low < len(held) else []
            have = low + len(held)
            while have < start + n:
                more = self.ids(chunk)
                parts.append(more[max(0, start - have) :])
                have, chunk = have + len(more), chunk + 1
            held, low = (np.concatenate(parts) if parts else held[:0]), start
            yield self.doc_ids[d], start, held[:n].tobytes()


@dataclass
class Part(WriterCommitMessage):
    part: int
    name: str
    size: int
    n_ids: int
    n_docs: int
    n_chunks: int


@dataclass
class Blocks(InputPartition):
    name: str
    size: int
    before: int
    first: int
    stop: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class IdPlanes(DataSource):
    """Format `idplanes`. Options: path; to write tokenizer and end_id (where rows hold texts), planes ("bit" or "byte") and block; to read share (ids of a task, about)."""

    @classmethod
    def name(cls) -> str:
        return "idplanes"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("share", SHARE)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], self.options.get("planes", "byte"), int(self.options.get("block", BLOCK)), self.options.get("tokenizer"), int(self.options.get("end_id", 1)))


class Writer(DataSourceArrowWriter):
    """Takes rows (doc_id, ids) or, with a tokenizer, (doc_id, text), sorted over all tasks; a file a task."""

    def __init__(self, path: str, by: str, block: int, tokenizer: str | None, end_id: int):
        self.path, self.by, self.block, self.tokenizer, self.end = path, by, block, tokenizer, end_id.to_bytes(4, "little")

    def rows(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        if self.tokenizer is None:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            return
        encode = encoder_of(self.tokenizer).encode
        for batch in slices(batches, limit=2 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                yield doc_id, encode(text) + self.end

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.idp"
        with store.open_output_stream(f"{root}/{name}") as out:
            writer = PlaneWriter(out, self.by, self.block)
            for doc_id, raw in self.rows(iterator):
                writer.add(doc_id, raw)
            size = writer.close()
        return Part(part, name, size, writer.n_ids, len(writer.docs), len(writer.index))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"planes": self.by, "block": self.block, "files": [vars(m) for m in parts]}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class Reader(DataSourceReader):
    def __init__(self, path: str, share: int):
        self.path, self.share = path, share

    def partitions(self) -> list[Blocks]:
        store, root = opened(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            spec = json.loads(f.read())
        out, before, step = [], 0, max(1, self.share // spec["block"])
        for p in spec["files"]:
            for a in range(0, p["n_chunks"] or min(1, p["n_docs"]), step):
                out.append(Blocks(p["name"], p["size"], before, a, min(a + step, p["n_chunks"])))
            before += p["n_ids"]
        return out or [Blocks("", 0, 0, 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = opened(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as source:
            rows, held = [], 0
            for doc_id, start, raw in PlaneFile(source, partition.size).documents(partition.first, partition.stop):
                rows.append((doc_id, partition.before + start, len(raw) // 4, raw))
                held += len(raw)
                if held > 4 << 20 or len(rows) == 10_000:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def write_ids(docs: DataFrame, out: str, path: str, end_id: int = 1, planes: str = "byte", block: int = BLOCK) -> None:
    """Encodes the documents with the library's file at path, an end id after each, and writes them to the folder out."""
    docs.sparkSession.dataSource.register(IdPlanes)
    rows = id_and_text(docs)
    place = free_name(rows, "place")
    rows = rows.withColumn(place, F.monotonically_increasing_id())  # lets rows of one doc_id share several tasks
    rows = rows.repartitionByRange("doc_id", place).sortWithinPartitions("doc_id", place).drop(place)
    rows.write.format("idplanes").mode("append").options(tokenizer=path, end_id=end_id, planes=planes, block=block).save(out)


def read_ids(spark: SparkSession, out: str, share: int = SHARE) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens and ids (little-endian, four bytes each)."""
    spark.dataSource.register(IdPlanes)
    return spark.read.format("idplanes").option("share", share).load(out)


def id_files(docs: DataFrame, path: str, end_id: int = 1, planes: str = "byte", block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from files written to the shared folder and read back."""
    out = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, out, path, end_id, planes, block)
    return read_ids(docs.sparkSession, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
