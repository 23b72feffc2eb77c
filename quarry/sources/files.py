"""Contents from files, and a Python data source that lists archives' members as rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarry.operators import members


def contents(spark: SparkSession, path: str, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """``path, length, modificationTime, content`` of files; larger ones are pruned before they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= max_bytes) if max_bytes is not None else files


def content_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same for files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)


def of_table(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A text column as contents."""
    return rows.select(key, F.encode(text, "UTF-8").alias("content"))


def sub_views(rows: DataFrame, offset: str = "offset", size: str = "size", data: str = "content") -> DataFrame:
    """Contents cut to their checked ranges; a size of -1 reads to the end."""
    from quarry.functions.bytes import part

    return rows.withColumn(data, part(F.col(data), F.col(offset), F.col(size)))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder)``: one row for each member of each local archive.

    For files that every executor can open by path; contents in other stores go
    through ``contents`` and ``members.extract``.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "path string, index int, name string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _ArchiveWriter(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.files = options["path"], int(options.get("filesPerPartition", 16))

    def partitions(self) -> list[InputPartition]:
        import os

        found = sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names) if os.path.isdir(self.path) else [self.path]
        return [_Files(found[k : k + self.files]) for k in range(0, len(found), self.files)]

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                data = f.read()
            for kind, (magic, offset, _) in members.READERS.items():
                if data[offset : offset + len(magic) // 2] == bytes.fromhex(magic):
                    for k, m in enumerate(members._listed(data, kind)):
                        yield path, k, m.name, m.size, members.member_bytes(data, m)
                    break


@dataclass
class _Written(WriterCommitMessage):
    staged: str
    part: str


class _ArchiveWriter(DataSourceWriter):
    """Writes (name, content) rows as one archive for each partition; ``kind`` is one of ``members.PACKERS``.

    The folder must be one that driver and executors share; parts get their names when all of them are written.
    """

    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "tar")

    def write(self, iterator) -> WriterCommitMessage:
        import os

        from pyspark import TaskContext

        rows = [(r["name"], bytes(r["content"])) for r in iterator]
        if not rows:
            return _Written("", "")
        os.makedirs(self.path, exist_ok=True)
        part = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}.{self.kind}")
        staged = f"{part}.{TaskContext.get().taskAttemptId()}.tmp"
        with open(staged, "wb") as f:
            f.write(members.PACKERS[self.kind](rows))
        return _Written(staged, part)

    def commit(self, messages) -> None:
        """All parts are there: they get their names."""
        import os

        for m in messages:
            if m is not None and m.staged:
                os.replace(m.staged, m.part)

    def abort(self, messages) -> None:
        """The job failed: what was staged goes."""
        import contextlib
        import os

        for m in messages:
            if m is not None and m.staged:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(m.staged)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
