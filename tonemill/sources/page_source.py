"""Stored pages as a Spark data source: ``spark.read.format("pages")`` and ``spark.readStream.format("pages")``.

A folder holds a file for each page, named by its cache key; a file whose name ends with ``.404`` marks a page that is known as missing
and gives a row with a null html. Files without a byte and hidden ones are no pages, as for Spark's own file readers.

A batch read lists the folder once, on the driver, and deals the files into partitions of about ``partitionBytes`` bytes. Filters on
the key (equality, IN) are taken over where Spark offers them (``spark.sql.python.filterPushdown.enabled``): then nothing is listed, and
only the asked pages and their marks are looked for. A stream's offset is the last (time of change, name) that was read; pages are
stored under another name before they get theirs, so that a file that is listed is whole.

Any store works that pyarrow's file systems know (local folders, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..functions.urls import CP1252_HIGH
from .pages import MISSING

SCHEMA = "key string, html string"
#: Bytes of files dealt to one partition, and handed to Spark at once.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 1 << 20

_HIGH = dict(zip(range(0x80, 0xA0), CP1252_HIGH, strict=True))


def decoded(body: bytes) -> str:
    """A page body as text, by the rule of ``decode_body``: UTF-8 if it is valid, else Windows-1252."""
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("latin-1").translate(_HIGH)


class Files(InputPartition):
    """The files of one partition: names within the folder."""

    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class Folder:
    """A folder in any store."""

    def __init__(self, path: str):
        self.path = path

    def open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def list(self, names: list[str] | None = None) -> list[pafs.FileInfo]:
        """The files of the folder that hold pages or marks; of ``names`` alone if given."""
        fs, root = self.open()
        infos = fs.get_file_info(pafs.FileSelector(root)) if names is None else fs.get_file_info([f"{root}/{n}" for n in names])
        return [i for i in infos if i.type == pafs.FileType.File and (i.base_name.endswith(MISSING) or (i.size and not i.base_name.startswith(("_", "."))))]

    def rows(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """(key, html) of some files, in batches of about BATCH_BYTES bytes."""
        fs, root = self.open()
        keys, pages, held = [], [], 0
        for name in names:
            if name.endswith(MISSING):
                keys.append(name.removesuffix(MISSING))
                pages.append(None)
                continue
            with fs.open_input_stream(f"{root}/{name}") as file:
                body = file.read()
            keys.append(name)
            pages.append(decoded(body))
            held += len(body)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pages, pa.string())], names=["key", "html"])
                keys, pages, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pages, pa.string())], names=["key", "html"])


def dealt(infos: list[pafs.FileInfo], limit: int) -> list[Files]:
    """Files in partitions of about ``limit`` bytes; a mark counts as a kilobyte."""
    out, names, held = [], [], 0
    for info in infos:
        names.append(info.base_name)
        held += max(info.size or 0, 1024)
        if held >= limit:
            out.append(Files(names))
            names, held = [], 0
    return [*out, Files(names)] if names else out


class PageReader(DataSourceReader):
    """A batch read."""

    def __init__(self, options: dict):
        self.folder, self.limit = Folder(options["path"]), int(options.get("partitionBytes", PARTITION_BYTES))
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                asked = {f.value}
            elif isinstance(f, In) and f.attribute == ("key",):
                asked = set(f.value)
            else:
                yield f  # Spark applies it
                continue
            asked.discard(None)
            self.keys = asked if self.keys is None else self.keys & asked

    def partitions(self) -> Sequence[InputPartition]:
        names = None if self.keys is None else [f"{k}{end}" for k in sorted(self.keys) if k and "/" not in k for end in ("", MISSING)]
        infos = sorted(self.folder.list(names), key=lambda i: i.base_name)
        if self.keys is not None:  # a key that ends like a mark is no mark's key
            infos = [i for i in infos if i.base_name.removesuffix(MISSING) in self.keys]
        return dealt(infos, self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(partition.names)


class PageStream(DataSourceStreamReader):
    """A stream of pages, in order of (time of change, name)."""

    def __init__(self, options: dict):
        self.folder, self.limit = Folder(options["path"]), int(options.get("partitionBytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"at": -1, "name": ""}

    def latestOffset(self) -> dict:
        return max(({"at": i.mtime_ns or 0, "name": i.base_name} for i in self.folder.list()), key=lambda o: (o["at"], o["name"]), default=self.initialOffset())

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = (start["at"], start["name"]), (end["at"], end["name"])
        own = sorted((i for i in self.folder.list() if after < (i.mtime_ns or 0, i.base_name) <= upto), key=lambda i: (i.mtime_ns or 0, i.base_name))
        return dealt(own, self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(partition.names)

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches but Spark's own offsets."""


class PageSource(DataSource):
    """The format ``pages``: option ``path`` (or ``load(path)``), and ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``pages`` known to a session, with filters handed over to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
