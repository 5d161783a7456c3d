"""Data sources: decks as tables (batch and stream), and text files written a file a deck.

    spark.dataSource.register(DeckSource)
    shapes = spark.read.format("conforma_deck").option("kind", "shape").load("decks/")
    fresh = spark.readStream.format("conforma_deck").option("kind", "deck").load("drop/")

    spark.dataSource.register(TextFiles)
    lines.write.format("conforma_files").mode("overwrite").save("reports/")

Files are listed and opened with Arrow's file systems (local or mounted folders, HDFS, S3, GCS); for folders that only
Spark reaches, pptx.read_decks goes through Spark's own reader.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .pptx import SCHEMAS, parse

TABLES = SCHEMAS | {"error": "deck_id string, error string"}
PARTITION_BYTES = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what stands before paths in Spark's names of files."""
    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    if isinstance(system, fs.LocalFileSystem):
        return system, inner, "file:"
    return system, inner, path[: path.index(inner)] if inner in path else ""


def deck_files(path: str) -> list[fs.FileInfo]:
    """Decks below path, or path itself if it is one; what begins with _ or . is left out."""
    system, inner, _ = opened(path)
    info = system.get_file_info(inner)
    files = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    files = [f for f in files if f.is_file and f.path.endswith(".pptx") and f.base_name[0] not in "_."]
    return sorted(files, key=lambda f: (f.mtime_ns or 0, f.path))


@dataclass
class Decks(InputPartition):
    """Files that one task reads."""

    paths: list[str] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(tuple(self.paths))


def planned(files: list[fs.FileInfo], most: int) -> list[Decks]:
    """Files dealt to partitions of about most bytes: the largest first, each to the first one with room."""
    held: list[tuple[int, list[str]]] = []
    for f in sorted(files, key=lambda f: (-(f.size or 0), f.path)):
        at = next((i for i, (size, _) in enumerate(held[-64:], max(0, len(held) - 64)) if size + f.size <= most), None)
        if at is None:
            held.append((f.size, [f.path]))
        else:
            held[at] = (held[at][0] + f.size, [*held[at][1], f.path])
    return [Decks(sorted(paths)) for _, paths in held]


class _Reads:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "deck")
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.schema = schema

    def rows(self, partition: Decks):
        """One Arrow batch a deck, of the table that is asked for."""
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _, prefix = opened(self.path)
        kinds = to_arrow_schema(self.schema)
        for path in partition.paths:
            name = f"{prefix}{path}"
            try:
                rows = [row for kind, row in parse(name, system.open_input_stream(path).read()) if kind == self.kind]
            except Exception as e:  # noqa: BLE001 - one malformed file is a row of the error table
                rows = [dict(deck_id=name, error=repr(e))] if self.kind == "error" else []
            if rows:
                full = [{f.name: row.get(f.name) for f in kinds} for row in rows]
                yield pa.RecordBatch.from_pylist(full, schema=kinds)


class DeckReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Decks]:
        return planned(deck_files(self.path), self.most)

    def read(self, partition: Decks):
        yield from self.rows(partition)


class DeckStreamReader(_Reads, DataSourceStreamReader):
    """Offsets are places in the order of files by modification time and name; a file is read once, unless it is
    written again. A file that appears later with an older time than the last one read is not seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = deck_files(self.path)
        return {"time": files[-1].mtime_ns, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Decks]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return planned([f for f in deck_files(self.path) if low < (f.mtime_ns, f.path) <= high], self.most)

    def read(self, partition: Decks):
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class DeckSource(DataSource):
    """One table of decks (option kind: a name of TABLES); partitionBytes bounds what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "conforma_deck"

    def schema(self) -> str:
        kind = self.options.get("kind", "deck")
        if kind not in TABLES:
            raise ValueError(f"kind must be one of {', '.join(TABLES)}")
        return TABLES[kind]

    def reader(self, schema: StructType) -> DeckReader:
        return DeckReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DeckStreamReader:
        return DeckStreamReader(schema, self.options)


@dataclass
class Written(WriterCommitMessage):
    """A task's files: where they lie until the job commits."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    """Rows (file, line) that come file by file and in order (see by_file). A task appends lines to one open file at a
    time, in a folder of its attempt; only the files of attempts that Spark counts are moved to their
    places when the job commits, so that a repeated task leaves one file."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, root, _ = opened(self.path)
        attempt, files, name, out = f"{root}/{self.job}/{uuid.uuid4().hex}", [], None, None
        system.create_dir(attempt)
        for row in iterator:
            if row["file"] != name:
                if out:
                    out.close()
                name = row["file"]
                files.append((f"{attempt}/{len(files)}", f"{root}/{name}"))
                out = system.open_output_stream(files[-1][0])
            out.write(row["line"].encode() + b"\n")
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        system, root, _ = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [final for _, final in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("lines of one file came in several runs: deal and sort them with by_file")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root, recursive=True)):
                if old.is_file and self.job not in old.path and old.path not in names:
                    system.delete_file(old.path)
        for made, final in files:
            system.create_dir(final.rpartition("/")[0])
            system.move(made, final)
        system.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Written]) -> None:
        system, root, _ = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


class TextFiles(DataSource):
    """Text files of rows (file, line): file is a name below the folder that is written to."""

    @classmethod
    def name(cls) -> str:
        return "conforma_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def by_file(lines, *order: str):
    """Rows (file, line) of lines as the files' writer needs them: a file's in one task, in order."""
    return lines.repartition("file").sortWithinPartitions("file", *order).select("file", "line")
