"""Token-id files in bit planes.

Documents are put in ascending doc_id order by range partitions. Each partition
becomes one file: its ids, each document ended by id 0, are cut into blocks of
``BLOCK_IDS``; a block is transposed into bit (or byte) planes, each plane is
compressed with zstandard, and the chunk index at the file's end stores every
block's id count and plane sizes. The next section lists the documents' lengths.

File layout, all integers little-endian::

    planes of block 0, planes of block 1, ...      zstandard frames
    document lengths                               zstandard frame of unsigned 32-bit integers
    chunk index: per block  ids, plane count, plane sizes      unsigned 32-bit integers
    footer: index bytes, length-frame bytes, blocks, documents  unsigned 64-bit, plane kind (1: bits, 8: bytes), magic

A task writes under a name of its own and reports the file in its output row, so
a file of a lost or repeated attempt is never listed and never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import id_text, scratch_path, written
from .token_ids import default_vocabulary, encoded, encoder

MAGIC = b"TSBPLN01"
BLOCK_IDS = 1 << 16
FOOTER = struct.Struct("<5Q8s")
PLANE_BITS = {"bit": 1, "byte": 8}


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """Transpose unsigned 32-bit ids into as many low bit or byte planes as the largest needs."""
    planes = -(-max(int(ids.max()).bit_length(), 1) // plane_bits) if len(ids) else 0
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        return [octets[:, k].tobytes() for k in range(planes)]
    out = []
    for byte in range(-(-planes // 8)):
        # eight ids as a 64-bit number hold an 8 x 8 bit matrix; its transpose has one byte for each plane
        part = np.zeros(-(-len(ids) // 8) * 8, np.uint8)
        part[:len(ids)] = octets[:, byte]
        turned = _transposed(part.view("<u8")).view(np.uint8).reshape(-1, 8)
        out += [turned[:, k].tobytes() for k in range(min(8, planes - 8 * byte))]
    return out


def _transposed(x: np.ndarray) -> np.ndarray:
    """8 x 8 bit matrices in 64-bit numbers, row r in byte r, transposed by swapping ever larger blocks."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    return x


def from_planes(planes: list[bytes], count: int, plane_bits: int) -> np.ndarray:
    octets = np.zeros((count, 4), np.uint8)
    if plane_bits == 8:
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
        return octets.view("<u4")[:, 0]
    for byte in range(-(-len(planes) // 8)):
        turned = np.zeros((-(-count // 8), 8), np.uint8)
        for k, plane in enumerate(planes[byte * 8:byte * 8 + 8]):
            turned[:, k] = np.frombuffer(plane, np.uint8)
        octets[:, byte] = _transposed(turned.view("<u8")[:, 0]).view(np.uint8)[:count]
    return octets.view("<u4")[:, 0]


def write_file(sink, documents: Iterator[bytes], plane_bits: int) -> tuple[int, int, list[int]]:
    """Write one file from documents' id bytes; returns ids, blocks and the documents' lengths."""
    press = zstandard.ZstdCompressor(level=3)
    index, lengths, held, have, total = [], [], [], 0, 0

    def block(ids: np.ndarray) -> None:
        frames = [press.compress(p) for p in to_planes(ids, plane_bits)]
        for frame in frames:
            sink.write(frame)
        index.append(struct.pack(f"<{2 + len(frames)}I", len(ids), len(frames), *map(len, frames)))

    for data in documents:
        lengths.append(len(data) // 4)
        total += lengths[-1]
        held.append(data)
        have += lengths[-1]
        if have >= BLOCK_IDS:
            ids = np.frombuffer(b"".join(held), "<u4")
            full = have // BLOCK_IDS * BLOCK_IDS
            for at in range(0, full, BLOCK_IDS):
                block(ids[at:at + BLOCK_IDS])
            held, have = [ids[full:].tobytes()], have - full
    if have:
        block(np.frombuffer(b"".join(held), "<u4"))
    table = press.compress(np.array(lengths, "<u4").tobytes())
    entries = b"".join(index)
    sink.write(table + entries)
    sink.write(FOOTER.pack(len(entries), len(table), len(index), len(lengths), plane_bits, MAGIC))
    return total, len(index), lengths


def read_index(source) -> tuple[list[tuple[int, int, list[int]]], np.ndarray, int]:
    """Blocks as (offset, ids, plane sizes), the documents' lengths and the plane kind."""
    size = source.size()
    source.seek(size - FOOTER.size)
    entries, table, blocks, documents, plane_bits, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a bit-plane token file")
    source.seek(size - FOOTER.size - entries - table)
    lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(
        source.read(table), max_output_size=4 * documents), "<u4")
    words = np.frombuffer(source.read(entries), "<u4").tolist()
    index, at, offset = [], 0, 0
    for _ in range(blocks):
        ids, planes = words[at], words[at + 1]
        sizes = words[at + 2:at + 2 + planes]
        index.append((offset, ids, sizes))
        at += 2 + planes
        offset += sum(sizes)
    return index, lengths, plane_bits


def read_documents(source) -> Iterator[np.ndarray]:
    """The documents' ids in file order; holds one block and the document it is in."""
    index, lengths, plane_bits = read_index(source)
    expand = zstandard.ZstdDecompressor()
    blocks = iter(index)
    held = np.empty(0, "<u4")
    for length in lengths.tolist():
        parts, need = [], length
        while need > len(held):
            parts.append(held)
            need -= len(held)
            offset, ids, sizes = next(blocks)
            source.seek(offset)
            raw, planes, at = source.read(sum(sizes)), [], 0
            for size in sizes:
                planes.append(expand.decompress(raw[at:at + size]))
                at += size
            held = from_planes(planes, ids, plane_bits)
        parts.append(held[:need])
        held = held[need:]
        yield np.concatenate(parts) if len(parts) > 1 else parts[0]


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_blocks", pa.int64()),
                       ("doc_ids", pa.list_(pa.int64()))])


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, plane_bits: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    ids: list[int | None] = []

    def texts() -> Iterator[str]:
        for batch in batches:
            ids.extend(batch.column("doc_id").to_pylist())
            for text in batch.column("text"):
                yield text.as_py()

    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tok"
    with store.open_output_stream(path) as sink:
        total, blocks, lengths = write_file(sink, encoded(texts(), encoder(vocabulary)), plane_bits)
    if not lengths:
        store.delete_file(path)
        return
    yield pa.RecordBatch.from_pylist([{"part": part, "file": path.rsplit("/", 1)[1], "n_ids": total,
                                       "n_blocks": blocks, "doc_ids": ids}], schema=_MANIFEST)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with store.open_input_file(f"{base}/{row['file']}") as source:
                at, out = row["start"], []
                for doc_id, ids in zip(row["doc_ids"], read_documents(source), strict=True):
                    out.append((doc_id, at, ids.tobytes()))
                    at += len(ids)
                    if len(out) == 512:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "start", "ids"])


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, planes: str = "bit") -> DataFrame:
    """Encode ``docs`` and write them as bit-plane files in ascending doc_id order.

    Returns the manifest, one row per file: ``part`` (files in order), ``file``,
    ``n_ids``, ``n_blocks``, ``doc_ids`` and ``start`` (ids in all files before).
    ``folder`` must be shared storage. A null text counts as empty and gives the
    end id alone. Rows without doc_id come first; repeated ids follow one another
    in the order of their texts, and each row is written. Other columns are not
    read. An empty table writes no file.
    """
    spark, bits = docs.sparkSession, PLANE_BITS[planes]
    vocabulary = vocabulary or default_vocabulary()
    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(
        lambda it: _write(it, folder, vocabulary, bits),
        "part int, file string, n_ids long, n_blocks long, doc_ids array<long>"), "manifest")
    # one row per file: as many as partitions, and only its counts cross the window
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return files.join(starts, "part")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before the document) and ``ids`` (little-endian unsigned 32-bit) from the files."""
    tasks = manifest.repartitionByRange(max(1, manifest.count()), "part").select("file", "doc_ids", "start")
    return tasks.mapInArrow(lambda it: _read(it, folder), "doc_id long, start long, ids binary")


def token_digests(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Write the files, read them back and describe each document's ids."""
    folder = scratch_path(spark, "token-files")
    read = read_token_files(write_token_files(docs, folder), folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
