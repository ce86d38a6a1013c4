"""Folders of HTML files as a data source: read in partitions of files by bytes, written under names of their own.

``spark.read.format("html_folder").option("path", p).load()`` gives (file, html),
``file`` relative to the folder.  ``df.write.format("html_folder")`` takes the
same two columns: a task writes each file beside its place and renames it, so a
file is whole or absent, and a task that runs again writes the same names.
``_SUCCESS`` is written when all tasks are done; a failed job takes back the
files that it has created.

The folder is one that driver and executors share, or any store that
``pyarrow.fs`` reaches by its address.  ``files.read_crawl`` can also read
through Spark's own text reader, which reaches every store that the session does.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, html string"
#: Bytes of a partition of files, and what opening one more file counts as.
PART_BYTES = 128 << 20
OPEN_BYTES = 1 << 20
#: Bytes that a batch of rows holds at most, but for one file alone.
BATCH_BYTES = 16 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of an address."""
    plain = path[len("file:") :] if path.startswith("file:") else path
    if plain.startswith("/"):
        return pafs.LocalFileSystem(), "/" + plain.strip("/")
    system, at = pafs.FileSystem.from_uri(path)
    return system, at.rstrip("/")


def unsafe(name: str | None) -> bool:
    return not name or name.startswith("/") or ".." in name.split("/") or not name.endswith(".html")


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    created: list[str]
    n: int


class HtmlFolder(DataSource):
    """The source ``html_folder``; options: ``path``, ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "html_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HtmlReader:
        return HtmlReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> HtmlWriter:
        if [f.name for f in schema.fields] != ["file", "html"]:
            raise ValueError(f"html_folder takes the columns file and html, not {', '.join(f.name for f in schema.fields)}")
        return HtmlWriter(self.options["path"], overwrite)


class HtmlReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Files]:
        system, at = located(self.path)
        found = system.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        out, held = [], 0
        for f in sorted((f for f in found if f.is_file and f.path.endswith(".html")), key=lambda f: f.path):
            size = f.size + OPEN_BYTES
            if not out or held + size > self.part_bytes:
                out.append(Files([]))
                held = 0
            out[-1].names.append(posixpath.relpath(f.path, at))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, at = located(self.path)
        names, texts, held = [], [], 0
        for name in partition.names:
            with system.open_input_stream(f"{at}/{name}") as f:
                raw = f.read()
            if held + len(raw) > BATCH_BYTES and names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["file", "html"])
                names, texts, held = [], [], 0
            names.append(name)
            texts.append(raw.decode("utf-8", "replace"))
            held += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["file", "html"])


class HtmlWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        if overwrite:  # on the driver, before any task
            system, at = located(path)
            if system.get_file_info(at).type == pafs.FileType.Directory:
                system.delete_dir_contents(at)

    def write(self, rows: Iterator) -> Written:
        system, at = located(self.path)
        created, made = [], set()
        n = 0
        for row in rows:
            if unsafe(row.file):
                raise ValueError(f"{row.file} is not the name of an HTML file below the folder")
            folder = posixpath.dirname(f"{at}/{row.file}")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            to = f"{at}/{row.file}"
            if system.get_file_info(to).type == pafs.FileType.NotFound:
                created.append(row.file)
            beside = f"{folder}/.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(beside) as f:
                f.write((row.html or "").encode())
            system.move(beside, to)
            n += 1
        return Written(created, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = located(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/_SUCCESS") as f:
            f.write(str(sum(m.n for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, at = located(self.path)
        for m in messages:
            for name in m.created if m else []:
                if system.get_file_info(f"{at}/{name}").is_file:
                    system.delete_file(f"{at}/{name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HtmlFolder)
