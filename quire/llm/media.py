"""Operator 6, media columns: texts as lossless images in archives, read back by a custom data source.

Method: a Spark data source ("media_archive") plans byte ranges over the files of an archive directory (of ZIP files with
stored members); a range has the members whose header starts in it. Each range streams its members through Arrow in
batches bounded by bytes, and each member is read by its own offset and checked by its CRC; one that fails is tried again
alone, from a newly opened file, without touching the others.

A payload is the text in UTF-8 with bytes 32 up to a positive multiple of 192, stored as the 8-bit RGB samples of a PNG 64
pixels wide; the unpadded length is in a text chunk. Equal texts give equal files. A null text is empty (one row of
spaces); a null doc_id comes out null; repeated rows are members of their own; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, written
from .files import Rolling, at

ROW = 192
WIDTH = ROW // 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FILES = "file string, bytes long, members long"
MEMBERS = "name string, file string, offset long, media binary"
#: Bytes of a range, bytes of a batch, tries for a member.
RANGE = 32 << 20
BATCH = 4 << 20
TRIES = 3


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW if text else ROW)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # a filter byte of 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode()) + chunk(b"IDAT", zlib.compress(rows, 4)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples by row, and the unpadded length, of what encode_png() gives; checks each chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    pos, data, n_bytes, height = 8, [], -1, 0
    while pos < len(media):
        size, kind = struct.unpack_from(">I4s", media, pos)
        body = media[pos + 8 : pos + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, pos + 8 + size)[0]:
            raise ValueError(f"bad chunk {kind!r}")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        pos += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)[:, 1:], n_bytes


def feature(samples: np.ndarray) -> str:
    """An average hash: of 8 bands of rows and 8 of columns, which cells are brighter than the mean; 16 hex digits."""
    bands = np.array_split(samples.reshape(len(samples), 8, -1).mean(2), 8)
    cells = np.array([b.mean(0) if len(b) else np.zeros(8) for b in bands])
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


class Archives(Rolling):
    """ZIP files with stored members."""

    def opened(self) -> None:
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)

    def closing(self) -> None:
        self.zip.close()

    def add(self, name: str, media: bytes) -> None:
        if self.out is None:
            self._open()
        self.zip.writestr(zipfile.ZipInfo(name), media)
        self.member_over()


def write_media(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = Archives(folder, ".zip"), 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                out.add(f"{'' if (i := doc_id.as_py()) is None else i}_{n}.png", encode_png(padded(raw), len(raw)))
                n += 1
        done = out.finished()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "members"])

    return run


def archive(docs: DataFrame) -> str:
    """Writes docs (doc_id, text) as archives; gives the folder of the table of their files."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = written(rows.mapInArrow(write_media(new_path(spark, "media")), FILES), "media-files")
    return table.inputFiles()[0].rpartition("/")[0] if table.inputFiles() else ""


class ByteRange(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class MediaReader(DataSourceReader):
    def __init__(self, index: str, size: int):
        self.index, self.size = index, size

    def partitions(self) -> list[ByteRange]:
        """From names and sizes of files alone; no file is opened here."""
        import pyarrow.dataset as ds

        files, path = at(self.index)
        table = ds.dataset(path, filesystem=files, format="parquet").to_table(columns=["file", "bytes"])
        out = [ByteRange(f, a, a + self.size) for f, n in zip(*(table.column(i).to_pylist() for i in range(2)), strict=True) for a in range(0, n, self.size)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        held, total = [], 0
        for entry, media in in_range(partition.file, partition.start, partition.end):
            held.append((entry.filename, partition.file, entry.header_offset, media))
            total += len(media)
            if total >= BATCH:
                yield as_batch(held)
                held, total = [], 0
        if held:
            yield as_batch(held)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "file", "offset", "media"])


def read_member(f, entry: zipfile.ZipInfo) -> bytes:
    """A stored member by the offset of its header, checked."""
    f.seek(entry.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {entry.header_offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    f.seek(entry.header_offset + 30 + name + extra)
    media = f.read(entry.compress_size)
    if len(media) != entry.file_size or zlib.crc32(media) != entry.CRC:
        raise OSError(f"damaged member {entry.filename} at {entry.header_offset}")
    return media


def in_range(uri: str, start: int, end: int, opened=None, tries: int = TRIES, wait: float = 0.2) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
    """The members whose header starts in start..end - 1. Opening, the directory and each member are tried again by themselves. opened: opens a file, for tests."""
    if opened is None:
        files, path = at(uri)
        opened = lambda: files.open_input_file(path)
    f = None

    def again(use):
        """use(f), with a file opened anew after each failure."""
        nonlocal f
        for left in range(tries - 1, -1, -1):
            try:
                if f is None:
                    f = opened()
                return use(f)
            except (OSError, struct.error, zipfile.BadZipFile):
                if f is not None:
                    f.close()
                    f = None
                if not left:
                    raise
                time.sleep(wait)

    try:
        for entry in again(lambda g: [e for e in zipfile.ZipFile(g).infolist() if start <= e.header_offset < end]):
            yield entry, again(lambda g, e=entry: read_member(g, e))
    finally:
        if f is not None:
            f.close()


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder of a table of files); option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)))


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members -> what op6 returns, from the stored bytes."""
    for b in batches:
        out: list[tuple] = []
        for name, media in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            samples, n_bytes = decode_png(media)
            payload = samples.tobytes()
            doc_id = name.partition("_")[0]
            out.append((int(doc_id) if doc_id else None, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in DESCRIBED.split(", ")])


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(spark: SparkSession, index: str) -> DataFrame:
    """name, file, offset, media of all members of the archives that the table at index names."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(index)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media(spark, index).mapInArrow(described, DESCRIBED)
