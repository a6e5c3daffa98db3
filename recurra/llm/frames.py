"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame per document (its ids as little-endian unsigned 32-bit numbers, with zstandard's own checksum),
then a skippable frame with the ids of the documents, then the seek table of the public seekable format: for each frame
its compressed and decompressed size and the low 32 bits of the XXH64 of its content. The seek table alone tells where
each document lies and how many tokens it has; a reader decompresses only the frames asked for and any zstandard tool
can decompress the whole file.

Files are reached through ``pyarrow.fs``, so the folder may be any URI it knows; all executors must reach it.
"""

from __future__ import annotations

import struct
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import Batches, fixed, map_arrow
from recurra.llm.encode import encoder

# Fixed values of the zstandard seekable format and of skippable frames.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
INDEX_MAGIC = 0x184D2A50
CHECKSUM_FLAG = 0x80
LEVEL = 3

MANIFEST = "file_no int, path string, n_docs long, n_tokens long"
INDEX = "path string, doc_id long, frame long, position long, size long, checksum long, start long, n_tokens long"
_PART_BYTES = 8 << 20


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file, frame by frame."""

    def __init__(self, stream):
        self._stream = stream
        self._compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True).compress
        self._table: list[bytes] = []
        self._ids: list[int | None] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self._compress(ids)
        self._stream.write(frame)
        self._table.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self._ids.append(doc_id)
        self.n_tokens += len(ids) // 4

    def close(self) -> None:
        known = b"".join(struct.pack("<?q", i is not None, i or 0) for i in self._ids)
        self._stream.write(struct.pack("<II", INDEX_MAGIC, len(known)) + known)
        entries = b"".join(self._table) + struct.pack("<III", len(known) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        foot = struct.pack("<IBI", len(self._ids) + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._stream.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(entries) + len(foot)) + entries + foot)
        self._stream.close()


class FrameFile:
    """Reads one file: the table first, then only the frames that are asked for."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self._file = system.open_input_file(path)
        size = self._file.size()
        frames, flags, magic = struct.unpack("<IBI", self._file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = np.frombuffer(self._file.read_at(12 * frames, size - 9 - 12 * frames), "<u4").reshape(-1, 3)
        ends = np.cumsum(table[:, 0].astype(np.int64))
        index = self._file.read_at(int(table[-1, 0]) - 8, int(ends[-2] if frames > 1 else 0) + 8)
        self.doc_ids = [i if known else None for known, i in struct.iter_unpack("<?q", index)]
        self.sizes = table[:-1, 0].astype(np.int64)
        self.positions = ends[:-1] - self.sizes
        self.n_tokens = table[:-1, 1].astype(np.int64) // 4
        self.checksums = table[:-1, 2].astype(np.int64)
        self._decompress = zstandard.ZstdDecompressor().decompress

    def read(self, position: int, size: int, checksum: int) -> bytes:
        """The content of one frame, checked against the table."""
        ids = self._decompress(self._file.read_at(size, position))
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != checksum:
            raise ValueError(f"checksum of the frame at {position} differs")
        return ids

    def close(self) -> None:
        self._file.close()


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every text, write files in ascending order of the id, return their manifest (``MANIFEST``).

    Null and empty texts have the end id alone. Null ids come first; rows with equal ids follow each other in the order of
    their texts' hashes, equal texts in any order. Ids that many rows share are dealt to several files like others.
    Other columns are ignored; an empty table gives no file. A task that runs again writes a file of another name; only
    files of tasks that succeeded are in the manifest, which is written as a table.
    """
    location = folder.rstrip("/")

    def run(batches: Batches) -> Batches:
        encode = encoder(tokenizer, end_id).encode
        number = TaskContext.get().partitionId()
        uri = f"{location}/part-{number:06d}-{uuid4().hex}.zst"
        system, path = _open(uri)
        writer = None
        n = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, edges, ids in encode(batch.column(1)):
                if writer is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = FrameWriter(system.open_output_stream(path, compression=None))
                raw = ids.tobytes()
                spans = (4 * edges).tolist()
                for doc, a, b in zip(own[first:], spans, spans[1:]):
                    writer.add(doc, raw[a:b])
                n += len(spans) - 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "file_no": pa.array([number], pa.int32()),
                    "path": [uri],
                    "n_docs": [n],
                    "n_tokens": [writer.n_tokens],
                }
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("doc_id", "hash", "spread").sortWithinPartitions("doc_id", "hash")
    return fixed(map_arrow(dealt.select("doc_id", "text"), run, MANIFEST))


def token_index(manifest: DataFrame) -> DataFrame:
    """Where every document lies (``INDEX``), from the seek tables; ``start`` counts the ids of all documents before."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for uri, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                file = FrameFile(uri)
                n = len(file.doc_ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [uri] * n,
                        "doc_id": pa.array(file.doc_ids, pa.int64()),
                        "frame": np.arange(n),
                        "position": file.positions,
                        "size": file.sizes,
                        "checksum": file.checksums,
                        "start": first + np.cumsum(file.n_tokens) - file.n_tokens,
                        "n_tokens": file.n_tokens,
                    }
                )
                file.close()

    before = F.sum("n_tokens").over(Window.orderBy("file_no")) - F.col("n_tokens")
    files = manifest.withColumn("first", before).select("path", "first")
    return map_arrow(files.repartition(max(1, manifest.count())), run, INDEX)


def read_tokens(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) for the rows of ``token_index``, or for those that are left of it.

    ``ids`` is binary: little-endian unsigned 32-bit numbers. Only the frames of the given rows are decompressed; each is
    checked. Rows of one file should follow each other, as they do in ``token_index``.
    """

    def run(batches: Batches) -> Batches:
        file, opened = None, None
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()))
            arrays = [pa.array([h[i] for h in held], kind) for i, (_, kind) in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in kinds])

        names = ("path", "doc_id", "position", "size", "checksum", "start", "n_tokens")
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in names]
            for uri, doc, position, length, checksum, start, n in zip(*columns):
                if uri != opened:
                    if file is not None:
                        file.close()
                    file, opened = FrameFile(uri), uri
                held.append((doc, start, n, file.read(position, length, checksum)))
                size += 4 * n
                if size >= _PART_BYTES:
                    yield out()
                    held, size = [], 0
        if file is not None:
            file.close()
        if held:
            yield out()

    return map_arrow(index, run, "doc_id long, start long, n_tokens long, ids binary")


def requested(index: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of the index for the ids asked for, file by file."""
    wanted = ids.select(F.col(id_column).cast("long").alias("doc_id")).distinct()
    return index.join(wanted, "doc_id", "left_semi").repartition("path").sortWithinPartitions("path", "frame")
