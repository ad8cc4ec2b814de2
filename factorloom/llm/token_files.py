"""Token files of independent zstandard frames with a trailing seek table.

Layout (little endian), after the public Zstandard seekable format:

    frame ... frame      uint32 ids of one document; a document over FRAME_IDS ids takes several frames
    skippable 184D2A50   document index: zstandard frame of (id, id is known, ids, frames) records
    skippable 184D2A5E   seek table: (compressed size, plain size, low half of XXH64) per frame,
                         then number of frames, descriptor byte, 8F92EAB1

A reader takes the table from the file's end and decompresses only the frames of the documents it
was asked for, checking each.  Documents are written in ascending id order, null ids first, ties in
text order; a null or empty text holds the end id alone; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import filesystem, frozen, shared_folder, text_batches
from .tokenizer import encoder

FRAME_IDS = 1 << 20
CHECKSUMS = 0x80
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
DOCUMENT = np.dtype([("id", "<i8"), ("known", "u1"), ("ids", "<u8"), ("frames", "<u4")])
READ_BYTES = 8 << 20

MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class CorruptFrame(ValueError):
    """A frame does not match its checksum or size."""


class FileWriter:
    def __init__(self, sink, level: int = 3):
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        pieces = max(1, -(-len(ids) // FRAME_IDS))
        for k in range(pieces):
            plain = ids[k * FRAME_IDS : (k + 1) * FRAME_IDS].astype("<u4").tobytes()
            packed = self.packer.compress(plain)
            self.sink.write(packed)
            self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.documents.append((doc_id or 0, doc_id is not None, len(ids), pieces))

    def close(self) -> None:
        index = self.packer.compress(np.array(self.documents, DOCUMENT).tobytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((len(index) + 8, 0, 0))
        table = np.array(self.entries, ENTRY).tobytes()
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table)
        self.sink.write(struct.pack("<IBI", len(self.entries), CHECKSUMS, FOOTER_MAGIC))


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file, self.unpacker = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC:
            raise CorruptFrame(f"{uri} has no seek table")
        self.entries = np.frombuffer(self.file.read_at(frames * ENTRY.itemsize, size - 9 - frames * ENTRY.itemsize), ENTRY)
        self.at = np.concatenate(([0], np.cumsum(self.entries["packed"], dtype=np.int64)))
        index = self.file.read_at(int(self.entries["packed"][-1]) - 8, int(self.at[-2]) + 8)
        self.documents = np.frombuffer(self.unpacker.decompress(index), DOCUMENT)
        self.first = np.concatenate(([0], np.cumsum(self.documents["frames"], dtype=np.int64)))

    def close(self) -> None:
        self.file.close()

    def _plain(self, frame: int, packed: bytes) -> bytes:
        _, size, check = self.entries[frame].tolist()
        plain = self.unpacker.decompress(packed, max_output_size=size) if size else b""
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise CorruptFrame(f"frame {frame}")
        return plain

    def ids(self, document: int) -> np.ndarray:
        """Ids of one document by its number in the file; reads its frames alone."""
        frames = range(int(self.first[document]), int(self.first[document + 1]))
        begin, end = int(self.at[frames[0]]), int(self.at[frames[-1] + 1])
        raw = self.file.read_at(end - begin, begin)
        plain = [self._plain(f, raw[self.at[f] - begin : self.at[f + 1] - begin]) for f in frames]
        return np.frombuffer(b"".join(plain), "<u4")

    def by_id(self, wanted: Iterable[int]) -> dict[int, list[np.ndarray]]:
        """Ids of the documents with the wanted ids, one array for each row of an id."""
        rows = np.flatnonzero(np.isin(self.documents["id"], list(wanted)) & (self.documents["known"] > 0))
        found: dict[int, list[np.ndarray]] = {}
        for row in rows.tolist():
            found.setdefault(int(self.documents["id"][row]), []).append(self.ids(row))
        return found

    def all(self) -> Iterator[np.ndarray]:
        """Ids of every document in order; the file is read in stretches of about READ_BYTES."""
        document, count = 0, len(self.documents)
        while document < count:
            begin = int(self.at[self.first[document]])
            last = int(np.searchsorted(self.at[self.first[1:]], begin + READ_BYTES))
            last = min(max(last, document), count - 1)
            raw = self.file.read_at(int(self.at[self.first[last + 1]]) - begin, begin)
            for d in range(document, last + 1):
                frames = range(int(self.first[d]), int(self.first[d + 1]))
                plain = [self._plain(f, raw[self.at[f] - begin : self.at[f + 1] - begin]) for f in frames]
                yield np.frombuffer(b"".join(plain), "<u4")
            document = last + 1


def write_token_files(
    docs: DataFrame, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encode and write the documents; returns the manifest, one row per file in id order.

    A task writes one file under a name of its own, and the manifest names the files of the tasks
    that ended well, so a repeated task leaves no double rows.
    """
    folder = shared_folder(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n_docs, n_tokens, writer, sink, uri = TaskContext.get().partitionId(), 0, 0, None, None, ""
        for batch, texts in text_batches(batches, "text"):
            if writer is None:
                uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tokens"
                fs, path = filesystem(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(path)
                writer = FileWriter(sink)
            ids, borders = encoder(vocabulary).encode(texts, end_id)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), borders[:-1].tolist(), borders[1:].tolist()):
                writer.add(doc_id, ids[a:b])
            n_docs, n_tokens = n_docs + len(texts), n_tokens + len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            )

    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return frozen(ordered.mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                reader = FileReader(path)
                lengths = reader.documents["ids"].astype(np.int64)
                check = np.fromiter((zlib.crc32(ids) for ids in reader.all()), np.int64, len(lengths))
                reader.close()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.documents["id"], mask=reader.documents["known"] == 0),
                        pa.array(start + np.cumsum(lengths) - lengths),
                        pa.array(lengths),
                        pa.array(check),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = max(1, manifest.count())
    return placed.repartition(files, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
