"""`spark.read.format("registry")` and `spark.readStream.format("registry")` over a folder of entities.

The folder is what stores.write leaves: entity_type=<type>/source=<source>/*.parquet. Filters on type and source that Spark pushes down
(spark.sql.python.filterPushdown.enabled) choose folders before any file is opened; files are grouped into partitions by their size, and only the
columns of the schema that is asked for are read, a batch at a time. The stream hands on the files that have come since the last batch, by the time
they were written. Paths may be of any file system that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from .documents import ENTITY

NAME, PARTITION_BYTES = "registry", 64 << 20
FOLDERS = ("entity_type", "source")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python sources there, which this one asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistrySource)


@dataclass
class Files(InputPartition):
    """Files of one partition: (path, entity_type, source)."""

    files: tuple[tuple[str, str, str], ...]


@dataclass(frozen=True)
class Found:
    path: str
    entity_type: str
    source: str
    size: int
    written: int


class RegistrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in ENTITY.items())

    def reader(self, schema: StructType) -> DataSourceReader:
        return RegistryReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RegistryStream(self.options["path"], schema)


def files_of(path: str, wanted: dict[str, set]) -> list[Found]:
    """The folder's files under types and sources that are wanted; other folders are not listed."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def inside(folder: str, name: str) -> Iterator[tuple[str, str]]:
        for f in system.get_file_info(fs.FileSelector(folder)):
            key, _, value = f.base_name.partition("=")
            if f.type == fs.FileType.Directory and key == name and (name not in wanted or unquote(value) in wanted[name]):
                yield f.path, unquote(value)

    found = []
    for kind_path, kind in inside(root, FOLDERS[0]):
        for source_path, source in inside(kind_path, FOLDERS[1]):
            for f in system.get_file_info(fs.FileSelector(source_path, recursive=True)):
                if f.is_file and f.extension == "parquet" and not f.base_name.startswith(("_", ".")):
                    found.append(Found(f.path, kind, source, f.size, f.mtime_ns))
    return sorted(found, key=lambda f: (f.written, f.path))


def partitions_of(found: list[Found]) -> list[Files]:
    out, held, size = [], [], 0
    for f in found:
        if held and size + f.size > PARTITION_BYTES:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append((f.path, f.entity_type, f.source))
        size += f.size
    return [*out, Files(tuple(held))] if held else out


def batches_of(path: str, schema: StructType, files: Files) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import to_arrow_schema

    system = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    target = to_arrow_schema(schema)
    for name, kind, source in files.files:
        with system.open_input_file(name) as opened:
            file = pq.ParquetFile(opened)
            there = set(file.schema_arrow.names)
            for batch in file.iter_batches(batch_size=8192, columns=[c for c in target.names if c in there]):
                folder = dict(zip(FOLDERS, (kind, source)))
                columns = [
                    pa.array([folder[f.name]] * batch.num_rows, f.type) if f.name in folder else batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type)
                    for f in target
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


class RegistryReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.wanted = path, schema, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what types and sources have to be; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in FOLDERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.wanted[column] = self.wanted.get(column, values) & values
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in FOLDERS:
                continue  # folders have a name
            else:
                yield f

    def partitions(self) -> list[Files]:
        return partitions_of(files_of(self.path, self.wanted)) or [Files(())]

    def read(self, partition: Files) -> Iterator:
        yield from batches_of(self.path, self.schema, partition)


class RegistryStream(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"written": 0}

    def latestOffset(self) -> dict:
        found = files_of(self.path, {})
        return {"written": found[-1].written if found else 0}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return partitions_of([f for f in files_of(self.path, {}) if start["written"] < f.written <= end["written"]])

    def read(self, partition: Files) -> Iterator:
        yield from batches_of(self.path, self.schema, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""
