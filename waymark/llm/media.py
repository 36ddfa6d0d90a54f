"""Media columns: payloads kept as images in archives, read by a Spark data source of our own.

``write_media`` streams payloads into zip archives of bounded size in a folder that all
executors share. Each payload is a grey 8-bit PNG, 576 samples wide, and carries its
unpadded length as a text chunk. A task that is run again writes new files; the manifest
names only the archives of the attempts that counted.

``ArchiveSource`` (format ``member_archive``) plans byte ranges over the archives in a
folder: the driver knows names and sizes only, a task reads the directory of its one
archive and takes the members that start in its range. Members are read by their offset,
checked and decoded one by one, and each is tried again on its own, from its offset on a
new handle; batches of payloads go to Spark as Arrow. A member that stays unreadable
fails the task, or with ``onError=report`` gives a row with its error and no payload.

Nulls: a null payload is empty, which is stored as one row of padding. Empty tables make
empty folders, read as no rows. Repeated rows are members of their own. Other columns are
ignored.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.llm.common import slices

WIDTH = 576
PAD = b"\xff"
MANIFEST = "_manifest.json"
SCHEMA = "archive string, offset bigint, member string, n_bytes bigint, payload binary, media binary, feature string, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(payload: bytes) -> bytes:
    """The payload, filled up to a positive multiple of the width."""
    return payload + PAD * (-len(payload) % WIDTH if payload else WIDTH)


def to_png(payload: bytes) -> bytes:
    """The padded payload as a grey PNG; lossless."""
    rows = np.frombuffer(pad(payload), np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1)  # filter 0: samples as they are
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    size = b"bytes\0" + str(len(payload)).encode()
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", size) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The padded payload and its unpadded length; raises ValueError on anything damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size, shape = 8, [], None, None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(media) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            size = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or size is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not one of our images")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not ours")
    return lines[:, 1:].tobytes(), size


def feature(payload: bytes) -> str:
    """Sum of samples, of squares, of steps to the next sample, and a histogram of 16 bins."""
    x = np.frombuffer(payload, np.uint8)
    y = x.astype(np.int64)
    steps = int(np.abs(np.diff(y)).sum())
    return ",".join(map(str, [int(y.sum()), int((y * y).sum()), steps, *np.bincount(x >> 4, minlength=16).tolist()]))


def write_media(rows: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> None:
    """Write (member, payload) rows to archives in ``folder``, a URI that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        made: list[tuple[str, int]] = []
        out = archive = None

        def close() -> None:
            archive.close()
            out.close()
            made.append((name, system.get_file_info(f"{root}/{name}").size))

        for b in slices(batches):
            for member, payload in zip(b["member"].to_pylist(), b["payload"].to_pylist()):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = system.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                archive.writestr(member, to_png(payload))
                if out.tell() >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["name", "size"])

    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    named = rows.select("member", F.coalesce("payload", F.lit(b"")).alias("payload"))
    made = [[r["name"], r["size"]] for r in named.mapInArrow(run, "name string, size bigint").collect()]
    with system.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps(made).encode())


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int) -> None:
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.split = int(options.get("splitbytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 3))
        self.report = options.get("onerror", "fail") == "report"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.folder)
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                archives = [tuple(x) for x in json.loads(f.read())]
        else:
            archives = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".zip")]
        ranges = [Range(name, at, at + self.split) for name, size in sorted(archives) for at in range(0, size, self.split)]
        return ranges or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        system, root = _filesystem(self.folder)
        path = f"{root}/{part.archive}"
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            members = sorted((m for m in archive.infolist() if part.start <= m.header_offset < part.end), key=lambda m: m.header_offset)
        handle = system.open_input_file(path)

        def stored(m: zipfile.ZipInfo) -> bytes:
            handle.seek(m.header_offset)
            head = handle.read(30)
            if head[:4] != b"PK\x03\x04" or m.compress_type != zipfile.ZIP_STORED:
                raise ValueError("no stored member begins here")
            name, extra = struct.unpack_from("<HH", head, 26)
            handle.seek(m.header_offset + 30 + name + extra)
            data = handle.read(m.compress_size)
            if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
                raise ValueError("the member's checksum is wrong")
            return data

        rows: list[tuple] = []
        held = 0
        for m in members:
            for attempt in range(self.retries + 1):
                try:
                    media = stored(m)
                    payload, size = from_png(media)
                    rows.append((part.archive, m.header_offset, m.filename, size, payload, media, feature(payload), None))
                    held += len(payload) + len(media)
                    break
                except (OSError, ValueError, struct.error, zlib.error) as e:
                    if attempt == self.retries:
                        if not self.report:
                            raise OSError(f"{path}, member {m.filename} at {m.header_offset}: {e}") from e
                        rows.append((part.archive, m.header_offset, m.filename, None, None, None, None, str(e)))
                        break
                    time.sleep(min(5, 0.2 * 2**attempt))
                    handle.close()
                    handle = system.open_input_file(path)
            if held >= self.batch:
                yield _batch(rows)
                rows, held = [], 0
        handle.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


class ArchiveSource(DataSource):
    """Options: path (a folder's URI), splitBytes, batchBytes, retries, onError (fail or report)."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_media(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("member_archive").options(**options).load(folder)
