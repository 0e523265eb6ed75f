"""ZIP archives of text as a Spark data source: a partition per archive member, and a streaming writer.

Paths are URIs of any store that Arrow can open (local or shared folders, HDFS, object stores); drivers and tasks
open them alike.  Planning reads only the archives' directories.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = 20_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


@dataclass
class Member(InputPartition):
    file: str
    member: str

    def __init__(self, file: str, member: str):
        super().__init__((file, member))
        self.file, self.member = file, member


class MemberReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.encoding = options["path"], options.get("encoding", "ISO-8859-1")

    def partitions(self) -> list[Member]:
        store, root = _open(self.root)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and info.extension == "zip":
                with store.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                    found += [Member(info.path, m) for m in sorted(z.namelist()) if not m.endswith("/")]
        return sorted(found, key=lambda m: (m.file, m.member)) or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _open(self.root)
        with store.open_input_file(partition.file) as f, zipfile.ZipFile(f) as z, io.TextIOWrapper(z.open(partition.member), encoding=self.encoding, newline="\n") as lines:
            batch, start = [], 0
            for line in lines:
                batch.append(line.rstrip("\r\n"))
                if len(batch) == LINES:
                    yield self._rows(partition, start, batch)
                    start, batch = start + LINES, []
            if batch:
                yield self._rows(partition, start, batch)

    @staticmethod
    def _rows(p: Member, start: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        cols = [pa.array([p.file] * n), pa.array([p.member] * n), pa.array(range(start, start + n), pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["file", "member", "line_no", "line"])


class ArchiveSource(DataSource):
    """``spark.read.format("zip_lines").option("path", ...)``: (file, member, line_no, line)."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "file string, member string, line_no long, line string"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def zip_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines of every member of every ZIP below ``path``; members are read side by side, in batches of lines."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("zip_lines").option("path", path).option("encoding", encoding).load()


def write_zips(lines: DataFrame, path: str, *, archive: str, member: str, header: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Writes ``lines`` (archive, member, line) as ZIPs below ``path``; each member begins with the ``header`` lines.

    An archive is written by one task as a stream, so it is as large as a disk allows and never in memory; its name is
    its own, so a retried task writes the same file again.  Returns (file, n_members, n_lines) of what was written, which is run once
    and stored."""
    from tidemark.session import cut_lineage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        store.create_dir(root, recursive=True)
        done, sink, z, out, at, counts = [], None, None, None, (None, None), [0, 0]

        def close_member():
            if out is not None:
                out.close()

        def close_archive():
            if z is not None:
                close_member()
                z.close()
                sink.close()
                done.append((f"{at[0]}.zip", *counts))

        for batch in batches:
            for a, m, line in zip(*(c.to_pylist() for c in batch.columns)):
                if a != at[0]:
                    close_archive()
                    sink = store.open_output_stream(f"{root}/{a}.zip")
                    z, out, counts = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED), None, [0, 0]
                if (a, m) != at:
                    close_member()
                    out = z.open(m, "w")
                    at = (a, m)
                    counts[0] += 1
                    for h in header:
                        out.write(f"{h}\n".encode(encoding, "replace"))
                out.write(f"{line}\n".encode(encoding, "replace"))
                counts[1] += 1
        close_archive()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["file", "n_members", "n_lines"])

    rows = lines.select(F.col(archive).cast("string"), F.col(member).cast("string"), F.col("line").cast("string")).repartition(archive).sortWithinPartitions(archive, member)
    return cut_lineage(rows.mapInArrow(run, "file string, n_members long, n_lines long"), "archives")
