"""Token ids in plane files.

Documents are sorted by id over all files.  A file holds the ids of its
documents one after the other, cut into blocks of ``BLOCK`` ids.  The bytes (or
bits) of a block's ids are transposed: plane 0 has the lowest byte of every id,
plane 1 the next, so that the seldom used high planes vanish under zstandard.

    magic | planes of block 0 | planes of block 1 | ... | footer | its length | magic

Each plane is one zstandard frame.  The footer is a frame of: plane mode, block
size, numbers of blocks, planes, documents and ids; the chunk index (length of
every plane of every block); and per document its id, whether it has one, and
its number of ids.  With the chunk index any block is read by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.encode import ID_TYPE, Encoder, encoder
from larder.llm.files import create, give_back, open_read
from larder.llm.tables import texts
from larder.llm.words import slices
from larder.session import materialise, work_path

MAGIC = b"LARDPLN1"
BLOCK = 1 << 16
END_ID = 0
ENCODED_BYTES = 1 << 20  # of text, encoded in one go; more takes less time and more memory
HEAD = np.dtype([(k, "<i8") for k in ("bits", "block", "blocks", "planes", "docs", "ids")])
LEVEL = 1


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of little-endian 32-bit ids."""
    rows = ids.view(np.uint8).reshape(len(ids), 4)
    if bits:
        return [p.tobytes() for p in np.packbits(
            np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [p.tobytes() for p in rows.T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T,
                           axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(rows.T)
    return rows.reshape(-1).view(ID_TYPE)


class PlaneWriter:
    """Writes one file, a block at a time."""

    def __init__(self, stream, bits: bool = False, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.lengths: list[list[int]] = []
        self.ids = 0
        self.waiting = bytearray()
        stream.write(MAGIC)

    def add(self, ids: bytes) -> None:
        self.waiting += ids
        self.ids += len(ids) // 4
        size = 4 * self.block
        if len(self.waiting) >= size:
            full = len(self.waiting) // size * size
            for low in range(0, full, size):
                self.put(bytes(self.waiting[low:low + size]))
            del self.waiting[:full]

    def put(self, ids: bytes) -> None:
        frames = [self.zstd.compress(p) for p in to_planes(np.frombuffer(ids, ID_TYPE), self.bits)]
        self.lengths.append(list(map(len, frames)))
        self.stream.write(b"".join(frames))

    def close(self, doc_ids: pa.Array, counts: np.ndarray) -> None:
        if self.waiting:
            self.put(bytes(self.waiting))
        planes = 32 if self.bits else 4
        head = np.array([(self.bits, self.block, len(self.lengths), planes, len(counts), self.ids)],
                        HEAD)
        footer = self.zstd.compress(b"".join((
            head.tobytes(), np.array(self.lengths, "<i8").tobytes(),
            doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
            doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
            counts.astype("<i8").tobytes())))
        self.stream.write(footer + np.int64(len(footer)).tobytes() + MAGIC)
        self.stream.close()


class PlaneReader:
    """Reads one file; blocks are read one at a time, in any order."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 16)
        tail = stream.read(16)
        length = int(np.frombuffer(tail[:8], "<i8")[0])
        stream.seek(0)
        if stream.read(8) != MAGIC or tail[8:] != MAGIC:
            raise ValueError("not a plane file, or not whole")
        stream.seek(size - 16 - length)
        self.zstd = zstandard.ZstdDecompressor()
        raw = self.zstd.decompress(stream.read(length))
        head = np.frombuffer(raw[:HEAD.itemsize], HEAD)[0]
        self.block, self.ids = int(head["block"]), int(head["ids"])
        blocks, planes, docs = int(head["blocks"]), int(head["planes"]), int(head["docs"])
        at = HEAD.itemsize
        self.lengths = np.frombuffer(raw, "<i8", blocks * planes, at).reshape(blocks, planes)
        at += self.lengths.nbytes
        doc_ids = np.frombuffer(raw, "<i8", docs, at)
        valid = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        self.counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
        self.doc_ids = pa.array(doc_ids, mask=valid == 0)
        self.offsets = len(MAGIC) + np.concatenate(
            [[0], np.cumsum(self.lengths.reshape(-1))]).astype(np.int64)

    def read(self, i: int) -> np.ndarray:
        """The ids of block ``i``."""
        planes = self.lengths.shape[1]
        low = int(self.offsets[i * planes])
        self.stream.seek(low)
        raw = self.stream.read(int(self.offsets[(i + 1) * planes]) - low)
        edges = (self.offsets[i * planes:(i + 1) * planes + 1] - low).tolist()
        frames = [self.zstd.decompress(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return from_planes(frames, min(self.block, self.ids - i * self.block))

    def documents(self) -> Iterator[tuple[int, bytes, bool]]:
        """Number of a document, some of its ids, and whether they are its last.

        A document longer than a block comes in parts.
        """
        doc, missing = 0, int(self.counts[0]) if len(self.counts) else 0
        for i in range(len(self.lengths)):
            ids, at = self.read(i).tobytes(), 0
            while at < len(ids):
                part = ids[at:at + 4 * missing]
                at += len(part)
                missing -= len(part) // 4
                yield doc, part, not missing
                if not missing:
                    doc += 1
                    missing = int(self.counts[doc]) if doc < len(self.counts) else 0


def encoded(columns: Iterator[pa.Array], encode: Encoder, size: int = ENCODED_BYTES
            ) -> Iterator[tuple[bytes, np.ndarray]]:
    """The ids of runs of texts, each text with its end id, and how many each has.

    A run has some ``size`` bytes.  A worker lives on after its task, so what a run took
    goes back to the system before the next one.
    """
    waiting, held = [], 0

    def run() -> Iterator[tuple[bytes, np.ndarray]]:
        texts = pa.concat_arrays(waiting)
        waiting.clear()
        for low, high, _, _ in slices(texts, size):
            ids, n = encode.encode_column(texts.slice(low, high - low))
            yield np.insert(ids, np.cumsum(n), END_ID).tobytes(), n + 1
            del ids
            give_back()

    for column in columns:
        waiting.append(column.fill_null("").cast(pa.large_string()))
        held += waiting[-1].nbytes
        if held >= size:
            yield from run()
            held = 0
    if waiting:
        yield from run()


def write_planes(docs: DataFrame, folder: str, tokenizer: str, bits: bool = False,
                 block: int = BLOCK, encoded_bytes: int = ENCODED_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into plane files below ``folder``.

    Returns the list of files: shard, path, n_docs, n_ids and before (ids in all
    shards before).  Shards are ranges of doc_id, in order, null first; rows of
    one id lie in the order of a hash of their text, so that a frequent id can
    be split.  Every document ends with the id ``END_ID``; null and empty texts
    have only that.  An empty table makes no file with documents.
    """
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        path, stream = create(folder, f"shard-{shard:06d}", ".planes")
        writer, ids, counts = PlaneWriter(stream, bits, block), [], [np.zeros(0, np.int64)]

        def text_columns() -> Iterator[pa.Array]:
            for batch in batches:
                # a column keeps its whole batch, texts and all
                ids.append(pa.array(batch.column("doc_id").to_pylist(), pa.int64()))
                yield batch.column("text")

        for own, n in encoded(text_columns(), encode, encoded_bytes):
            writer.add(own)
            counts.append(n)
        ids = pa.chunked_array(ids, pa.int64()).combine_chunks()
        counts = np.concatenate(counts)
        writer.close(ids, counts)
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "path": [path],
            "n_docs": pa.array([len(counts)], pa.int64()),
            "n_ids": pa.array([writer.ids], pa.int64())})

    files = materialise(rows.drop("tie").mapInArrow(
        write, "shard int, path string, n_docs long, n_ids long"), "plane-list")
    # One row per file; the files are as many as shuffle partitions.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.where("n_docs > 0").withColumn(
        "before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read_planes(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of plane files, as ``write_planes`` lists them.

    Returns one row per document: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers) and, if
    asked for, ids.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(),
                                    batch.column("before").to_pylist()):
                with open_read(path) as stream:
                    reader = PlaneReader(stream)
                    crc, ids, parts = [], [], []
                    running = 0
                    for _, part, last in reader.documents():
                        running = zlib.crc32(part, running)
                        if with_ids:
                            parts.append(part)
                        if last:
                            crc.append(running)
                            running = 0
                            if with_ids:
                                ids.append(np.frombuffer(b"".join(parts), ID_TYPE))
                                parts = []
                    ends = np.cumsum(reader.counts)
                    columns = {
                        "doc_id": reader.doc_ids,
                        "start": pa.array(before + ends - reader.counts),
                        "n_tokens": pa.array(reader.counts),
                        "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.array([i.astype(np.int64) for i in ids],
                                                  pa.list_(pa.int64()))
                    yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=10_000)

    n = max(1, files.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return files.repartitionByRange(n, "shard").select("path", "before").mapInArrow(
        read, schema + ", ids array<long>" if with_ids else schema)


def write_and_read(docs: DataFrame, tokenizer: str, folder: str | None = None,
                   bits: bool = False, encoded_bytes: int = ENCODED_BYTES) -> DataFrame:
    folder = folder or work_path(docs.sparkSession, "planes")
    return read_planes(write_planes(docs, folder, tokenizer, bits, encoded_bytes=encoded_bytes))
