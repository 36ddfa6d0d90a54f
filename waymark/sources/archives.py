"""Archives of code as a data source: members of tar files, planned by offset and read range by range.

A ``.tar`` is planned on the driver by its headers, one short read for each member; what is
kept of it is where ranges of about ``rangeBytes`` begin. A ``.tar.gz`` can't be entered in
the middle, so it is streamed once, by one task for each archive, into tar files of about
that size in the shared folder, which are then read like any other. No more than one
member, or one range being written, is held at a time.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.functions.shared import shared_path

#: Bytes of a range, unpacked.
RANGE = 16 << 20
SCHEMA = "archive string, offset bigint, name string, length bigint, content binary"
ENDINGS = (".tar", ".tar.gz", ".tgz")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"/{uri}")


def _archives(uri: str) -> tuple[object, list[str]]:
    """The file system, and the archives that a path names: itself, or those in a folder."""
    from pyarrow import fs

    system, root = _filesystem(uri)
    info = system.get_file_info(root)
    if info.type == fs.FileType.Directory:
        return system, sorted(i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.path.endswith(ENDINGS))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    return system, [root]


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int) -> None:
        self.archive, self.start, self.end = archive, start, end


class TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("rangeBytes", RANGE))
        self.most = int(options.get("mostBytes", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        system, archives = _archives(self.path)
        found: list[InputPartition] = []
        for path in archives:
            with system.open_input_file(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                start = 0
                for m in tar:
                    if m.offset - start >= self.size:
                        found.append(Range(path, start, m.offset))
                        start = m.offset
                    tar.members = []  # what was walked isn't kept
                found.append(Range(path, start, f.size()))
        return found

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        with system.open_input_file(part.archive) as f:
            f.seek(part.start)
            with tarfile.open(fileobj=f, mode="r:") as tar:
                for m in tar:
                    if m.offset >= part.end:
                        break
                    if m.isfile():
                        data = tar.extractfile(m).read() if m.size <= self.most else b""
                        columns = [pa.array([part.archive]), pa.array([m.offset], pa.int64()), pa.array([m.name]), pa.array([m.size], pa.int64()), pa.array([data], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["archive", "offset", "name", "length", "content"])
                    tar.members = []


class TarSource(DataSource):
    """``spark.read.format("tar_members").load(path)``; options rangeBytes, mostBytes (longer members come without content)."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options)


def _unpacked(raw: object, into: object, stem: str, size: int) -> Iterator[tuple[str, int, int]]:
    """Streams a compressed tar into tars of about ``size`` bytes; (path, members, bytes) of each once it is whole."""
    held, count, number = None, 0, 0

    def close() -> tuple[str, int, int]:
        nonlocal held, number
        tar, buffer = held
        tar.close()
        path, data = f"{stem}-{number:06d}.tar", buffer.getbuffer()
        with into.open_output_stream(path + ".part", compression=None) as f:
            f.write(data)
        into.move(path + ".part", path)  # a task that is tried again writes the same names
        held, number = None, number + 1
        return path, count, len(data)

    with tarfile.open(fileobj=raw, mode="r|gz") as tar:
        for m in tar:
            tar.members = []
            if held is None:
                buffer = io.BytesIO()
                held, count = (tarfile.open(fileobj=buffer, mode="w:", format=tarfile.PAX_FORMAT), buffer), 0
            held[0].addfile(m, tar.extractfile(m) if m.isfile() else None)
            held[0].members = []
            count += 1
            if held[1].tell() >= size:
                yield close()
    if held is not None:
        yield close()


def members(spark: SparkSession, path: str, most: int = 1 << 62, size: int = RANGE) -> DataFrame:
    """(archive, offset, name, length, content) of all files in an archive, or in all archives of a folder."""
    _, archives = _archives(path)
    spark.dataSource.register(TarSource)

    def load(where: str) -> DataFrame:
        return spark.read.format("tar_members").option("rangeBytes", size).option("mostBytes", most).load(where)

    packed = [a for a in archives if not a.endswith(".tar")]
    if not packed:
        return load(path)
    folder = shared_path(spark, "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, root = _filesystem(folder)
        into.create_dir(root, recursive=True)
        for b in batches:
            for number, archive in zip(b["number"].to_pylist(), b["archive"].to_pylist()):
                with _filesystem(path)[0].open_input_file(archive) as raw:
                    for row in _unpacked(raw, into, f"{root}/{number:06d}", size):
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.int64()))], ["range", "members", "bytes"])

    listed = spark.createDataFrame(list(enumerate(packed)), "number bigint, archive string").repartition(len(packed), "number")
    listed.mapInArrow(run, "range string, members bigint, bytes bigint").write.format("noop").mode("overwrite").save()
    found = load(folder)
    plain = [a for a in archives if a.endswith(".tar")]
    for a in plain:
        found = found.unionByName(load(a))
    return found
