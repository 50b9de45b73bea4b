"""Media columns over archive directories, by a Spark data source.

`write_archives` stores the media of each row as a member of ZIP archives (deflated,
a few per task, of bounded size) below the shared folder, and returns a table of the
archives that finished tasks wrote: what a lost or repeated task left behind is in no
table and is never read.

`ArchiveSource` (format "millrace_archive") reads them. The driver only looks at the
archives' names and sizes and plans byte ranges of them, larger ones where there would be
more than MOST_RANGES; a task reads the directory at
the end of its archive, takes the members whose offset lies in its range, and streams
their payloads in Arrow batches of bounded bytes. Each member is read by its own
offset, checked by CRC and length, and read again by itself, after opening the file
anew, if that fails; after `retries` attempts the task fails, or with on_error "row"
the member is returned with null bytes and the error's text.

Here a text is stored as sound: its UTF-8 bytes, padded with spaces to a positive
multiple of 192, are the 8-bit samples of a mono WAV file, which depends on nothing
but the text.

Definitions for odd input: a null text counts as empty (192 padding bytes); equal texts
have equal media and features; a null id stays null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.llm.common import Scratch, session_of

PAD, RATE = 192, 8000
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, MEMBERS, MOST_RANGES = 64 << 20, 8 << 20, 8 << 20, 20_000, 100_000


# -- one media file -----------------------------------------------------------
def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(PAD, -(-len(data) // PAD) * PAD)
    return data.ljust(size, b"\x20"), len(data)


def to_wav(samples: bytes) -> bytes:
    """8-bit unsigned mono PCM; samples of even length."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(data: bytes) -> bytes:
    riff, _, wave, fmt, size, kind, channels, _, _, _, bits, tag, length = struct.unpack_from("<4sI4s4sIHHIIHH4sI", data)
    if (riff, wave, fmt, size, kind, channels, bits, tag) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data") or len(data) != 44 + length:
        raise ValueError("not an 8-bit mono WAV file")
    return data[44:]


def sound_features(samples: bytes) -> str:
    """Whole numbers only, so that equal samples give equal text: peak, mean, energy, zero crossings, 8 shares of levels (in 1/1000)."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = len(x)
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    levels = np.bincount((x + 128) >> 5, minlength=8) * 1000 // n
    return f"peak={int(np.abs(x).max())} mean={int(x.sum()) * 1000 // n} energy={int((x * x).sum()) * 1000 // n} crossings={crossings * 1000 // n} levels={'/'.join(map(str, levels))}"


# -- archives -----------------------------------------------------------------
def open_fs(url: str) -> tuple[pafs.FileSystem, str]:
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if url.startswith(hadoop):
            url = arrow + url[len(hadoop) :]
    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


class _ArchiveWriter:
    def __init__(self, folder: str):
        self.fs, self.folder = open_fs(folder)
        self.url = folder
        self.done: list[tuple[str, int, int]] = []
        self.zip = None

    def add(self, name: str, data: bytes) -> None:
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.zip"
            self.fs.create_dir(self.folder, recursive=True)
            self.stream = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.zip, self.members, self.bytes = zipfile.ZipFile(io.BufferedWriter(_Forward(self.stream), 1 << 20), "w", zipfile.ZIP_DEFLATED, compresslevel=1), 0, 0
        self.zip.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED, 1)
        self.members += 1
        self.bytes += self.zip.filelist[-1].compress_size
        if self.bytes >= ARCHIVE_BYTES or self.members >= MEMBERS:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            out = self.zip.fp
            self.zip.close()
            out.flush()
            self.stream.close()
            self.done.append((f"{self.url}/{self.name}", self.fs.get_file_info(f"{self.folder}/{self.name}").size, self.members))
            self.zip = None


class _Forward(io.RawIOBase):
    """A forward-only raw stream over one of pyarrow's."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        return self.stream.write(bytes(data))


def write_archives(df: DataFrame, folder: str, *, id_col: str, text_col: str) -> DataFrame:
    """Writes the media of all rows; returns path, bytes, members of each archive when it is executed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _ArchiveWriter(folder)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload, n = padded(text.as_py())
                writer.add(f"{'null' if i is None else i}.{n}.wav", to_wav(payload))
        writer.close()
        path, size, members = ([d[k] for d in writer.done] for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(members, pa.int64())], names=["path", "bytes", "members"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "path string, bytes long, members long")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArchiveSource(DataSource):
    """Options: archives (a Parquet table with path and bytes) or path (a folder of .zip files); range_bytes, retries, on_error."""

    @classmethod
    def name(cls) -> str:
        return "millrace_archive"

    def schema(self) -> str:
        return "member string, offset long, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.retries = int(self.options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        archives = self._archives()
        step = max(int(self.options.get("range_bytes", RANGE_BYTES)), sum(size for _, size in archives) // MOST_RANGES)
        return [ByteRange(path, start, start + step) for path, size in archives for start in range(0, max(size, 1), step)] or [ByteRange("", 0, 0)]

    def _archives(self) -> list[tuple[str, int]]:
        if "archives" in self.options:
            import pyarrow.parquet as pq

            fs, path = open_fs(self.options["archives"])
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet")]
            return sorted((r["path"], r["bytes"]) for f in files for r in pq.read_table(fs.open_input_file(f), columns=["path", "bytes"]).to_pylist())
        url = self.options["path"].rstrip("/")
        fs, path = open_fs(url)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return sorted((f"{url}{f.path[len(path):]}", f.size) for f in found if f.path.endswith(".zip"))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = open_fs(partition.path)
        file = fs.open_input_file(path)
        with zipfile.ZipFile(file) as directory:
            members = [m for m in directory.infolist() if partition.start <= m.header_offset < partition.end and not m.is_dir()]
        rows: list[tuple[str, int, bytes | None, str | None]] = []
        held = 0
        for m in sorted(members, key=lambda m: m.header_offset):
            data, error = None, None
            for _ in range(self.retries):
                try:
                    file = file if not file.closed else fs.open_input_file(path)
                    data, error = read_member(file, m), None
                    break
                except (OSError, ValueError, zlib.error, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"[:300]
                    file.close()
            if error and self.options.get("on_error", "fail") != "row":
                raise OSError(f"{partition.path}, member {m.filename} at {m.header_offset}: {error}")
            rows.append((m.filename, m.header_offset, data, error))
            held += len(data or b"")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def read_member(file, m: zipfile.ZipInfo) -> bytes:
    """The member at its offset, by itself: header, payload, length and CRC."""
    file.seek(m.header_offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member starts at this offset")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.seek(m.header_offset + 30 + name + extra)
    raw = file.read(m.compress_size)
    data = zlib.decompress(raw, -15) if m.compress_type == zipfile.ZIP_DEFLATED else raw
    if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
        raise ValueError("length or CRC differs")
    return data


def _batch(rows: list[tuple[str, int, bytes | None, str | None]]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["member", "offset", "media", "error"])


def media_columns(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Per row of df, from what is stored and read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with_media the stored bytes."""
    spark = session_of(df)
    scratch = Scratch(spark, "media")
    folder = f"{scratch.root}/archives"
    listed = scratch.path("listed")
    write_archives(df, folder, id_col=id_col, text_col=text_col).write.parquet(listed)
    spark.dataSource.register(ArchiveSource)
    stored = spark.read.format("millrace_archive").option("archives", listed).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for member, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_py()
                i, n, _ = member.rsplit(".", 2)
                payload = from_wav(media)
                row = (None if i == "null" else int(i), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), sound_features(payload))
                out.append((*row, media) if with_media else row)
            arrays = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(KINDS[: None if with_media else -1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *NAMES[1 : len(arrays)]])

    schema = f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if with_media else "")
    return stored.select("member", "media").mapInArrow(run, schema)


NAMES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
