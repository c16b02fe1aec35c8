"""Media columns: archives of images behind a Spark data source (operator 5).

``store`` writes payloads as lossless 8-bit grey PNG images into archives, one or more for each task. An
archive is a run of members (id, length, CRC-32, image) and ends with the list of their offsets. The data
source ``media_archive`` lists a directory's archives on the driver, cuts them into byte ranges (of 4 MiB, or
larger ones so that there are at most ``MOST_RANGES``) and leaves each range to a task. A task reads the offsets in
its range and the members in large blocks, tries by its offset each one again that can't be read or whose checksum
is wrong, and hands the images on in Arrow batches.

A text is taken as UTF-8 (null: empty) and padded with bytes 255, which no UTF-8 holds, to a positive multiple
of 576. Repeated rows have members of their own; a null doc_id stays null. An empty table gives no archive
and no row. Files have names of their own for every attempt; only those that finished tasks report are in the
manifest, and the source reads no others. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import materialize, read_table, run_folder, text_or_empty
from .storage import Reader, Writer, new_file, open_fs

WIDTH = 576
RANGE_BYTES = 4 << 20
MOST_FILE = 256 << 20
BATCH_BYTES = 4 << 20
MOST_RANGES = 100_000
TRIES = 3

_PNG = b"\x89PNG\r\n\x1a\n"
_MEMBER = "<?qII"
_MEMBER_SIZE = struct.calcsize(_MEMBER)


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image of ``WIDTH`` columns whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """Samples of an image as ``encode_png`` makes it: rows by columns."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, data, size = 8, b"", (0, 0)
    while at < len(image):
        (length,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, a 16-bin histogram and a hash of which of 64 areas are brighter than the mean."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    levels = np.arange(256)
    mean = float(counts @ levels) / len(flat)
    deviation = float(np.sqrt(max(0.0, float(counts @ levels**2) / len(flat) - mean**2)))
    areas = flat.reshape(64, -1).sum(axis=1, dtype=np.int64) / (len(flat) // 64)
    bright = np.packbits(areas > mean).tobytes().hex()
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.3f} sd={deviation:.3f} bright={bright} hist={','.join(map(str, counts.reshape(16, 16).sum(axis=1)))}"


def _store_batches(folder: str, most_file: int):
    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offsets = None, []

        def closed() -> pa.RecordBatch:
            foot = out.at
            out.write(np.array(offsets, "<i8").tobytes() + struct.pack("<q", foot))
            out.close()
            return pa.record_batch([pa.array([out.uri]), pa.array([len(offsets)], pa.int64()), pa.array([foot], pa.int64())], names=["path", "members", "bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    out, offsets = Writer(new_file(folder, ".media")), []
                image = encode_png(padded(text.as_buffer().to_pybytes()))
                offsets.append(out.at)
                out.write(struct.pack(_MEMBER, doc_id is not None, doc_id or 0, len(image), zlib.crc32(image)) + image)
                if out.at >= most_file:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored


def store(docs: DataFrame, folder: str, most_file: int = MOST_FILE) -> DataFrame:
    """Write the archives and a manifest of them; (path, members, bytes) of each archive."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    files = materialize(rows.mapInArrow(_store_batches(folder, most_file), "path string, members long, bytes long"), "media-files")
    own, base = open_fs(folder)
    own.create_dir(base, recursive=True)
    with own.open_output_stream(f"{base}/manifest") as out:
        for r in files.toLocalIterator():  # one row for each archive
            out.write(f"{r.path.rpartition('/')[2]}\t{r.bytes}\n".encode())
    return files


@dataclass
class ByteRange(InputPartition):
    path: str
    lo: int
    hi: int


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, tries: int):
        self.folder, self.range_bytes, self.tries = folder, range_bytes, tries

    def partitions(self):
        own, base = open_fs(self.folder)
        with own.open_input_stream(f"{base}/manifest") as f:
            listed = dict(line.split("\t") for line in f.read().decode().splitlines())
        there = {x.base_name for x in own.get_file_info(pafs.FileSelector(base)) if x.is_file}
        if missing := listed.keys() - there:
            raise FileNotFoundError(f"archives of the manifest are missing: {sorted(missing)[:3]}")
        step = max(self.range_bytes, -(-sum(map(int, listed.values())) // MOST_RANGES))
        return [ByteRange(f"{self.folder}/{name}", lo, min(lo + step, int(size))) for name, size in sorted(listed.items()) for lo in range(0, int(size), step)] or [ByteRange("", 0, 0)]

    @staticmethod
    def _unpacked(data: bytes, at: int) -> tuple[int | None, bytes]:
        known, doc_id, size, crc = struct.unpack_from(_MEMBER, data)
        image = data[_MEMBER_SIZE : _MEMBER_SIZE + size]
        if len(image) < size or zlib.crc32(image) != crc:
            raise OSError(f"checksum of the member at {at} is wrong")
        return (doc_id if known else None), image

    def _member(self, source: Reader, at: int, end: int) -> tuple[int | None, bytes]:
        """One member by its offset, tried again if that fails."""
        for left in reversed(range(self.tries)):
            try:
                return self._unpacked(source.read_at(at, end - at), at)
            except (OSError, struct.error):
                if not left:
                    raise
                time.sleep(0.2)
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        source = Reader(partition.path)
        (foot,) = struct.unpack("<q", source.read_at(source.size - 8, 8))
        offsets = np.frombuffer(source.read_at(foot, source.size - 8 - foot), "<i8")
        first, last = np.searchsorted(offsets, [partition.lo, partition.hi])
        own = np.append(offsets, foot)[first : last + 1].tolist()
        while len(own) > 1:
            n = 1  # a block of members, or one larger member
            while n + 1 < len(own) and own[n + 1] - own[0] <= BATCH_BYTES:
                n += 1
            try:
                block = source.read_at(own[0], own[n] - own[0])
            except OSError:
                block = b""
            found = []
            for at, end in zip(own[:n], own[1 : n + 1], strict=True):
                try:
                    found.append(self._unpacked(block[at - own[0] : end - own[0]], at))
                except (OSError, struct.error):
                    found.append(self._member(source, at, end))
            ids, images = zip(*found, strict=True)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "media"])
            own = own[n:]
        source.close()


class MediaArchives(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options rangeBytes and tries."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "doc_id long, media binary"

    def reader(self, schema):
        return MediaReader(self.options["path"].rstrip("/"), int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("tries", TRIES)))


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, media) of every member under ``folder``."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(folder)


FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            image = media.as_buffer().to_pybytes()
            samples = decode_png(image)
            payload = samples.tobytes()
            rows.append((doc_id, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of images, from the bytes as stored."""
    return media.select("doc_id", "media").mapInArrow(_described, FIELDS)


def op5_media_archives(spark, sf_dir):
    folder = run_folder(spark, "media")
    store(read_table(spark, sf_dir, "documents"), folder)
    return describe(read(spark, folder))
