"""Rows as files of a vault: a data source to write to, and the files as rows again.

    write_files(rows, "s3a://bucket/vault", existing="skip")
    read_files(spark, "s3a://bucket/vault")

Each row (``path`` below the vault, ``body``) becomes a file. A task writes all of its rows
under names of its own in a staging folder and moves them to their places when the last
one is written, so a task that fails or is killed before shows nothing. A move puts a whole file in
place; rows must have distinct paths. A job that is repeated writes the same files again, or
leaves them. The staging folder goes with the commit of the job, or when it is given up.

The work is one of files, not of bytes: rows and paths are spread over as many tasks as a shuffle
has, both ways. Folders are listed by tasks too, so no list of files is held by the driver.
"""

from __future__ import annotations

import fcntl
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import cut

NAME = "vault_files"
KEEP, REPLACE = "skip", "overwrite"
STAGING = ".staging-"

# Names, and bytes, that a task hands on at a time.
NAMES_AT_ONCE, BYTES_AT_ONCE = 4096, 8 << 20


@dataclass
class Written(WriterCommitMessage):
    """What a task has put in place."""

    written: int
    kept: int
    no_body: int


class VaultFiles(DataSource):
    """``path``: the vault's folder; ``existing``: whether a file that is there is kept or replaced."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path STRING, body BINARY"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VaultWriter(self.options["path"], self.options.get("existing", KEEP))


def _within(path: str) -> bool:
    """Whether a path stays inside of the vault."""
    parts = path.split("/")
    return path != "" and not path.startswith("/") and ".." not in parts and "\0" not in path


def _parts(rows: Iterator[Row]) -> Iterator[list[Row]]:
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row["body"] or b"")
        if len(part) >= NAMES_AT_ONCE or held >= BYTES_AT_ONCE:
            yield part
            part, held = [], 0
    yield part


@contextmanager
def _turn(system: fs.FileSystem, staging: str, kind: int) -> Iterator[None]:
    """Tasks of a job move their files one after the other if the folder is local, and none looks for
    files meanwhile: each move between folders locks the whole file system and its target there, and
    many that wait for it slow each other down. Files are right without it, so storage that has no
    such lock goes on."""
    if not isinstance(system, fs.LocalFileSystem):
        yield
        return
    folder = os.open(staging, os.O_RDONLY)
    try:
        with suppress(OSError):
            fcntl.flock(folder, kind)
        yield
    finally:
        os.close(folder)


class VaultWriter(DataSourceWriter):
    def __init__(self, root: str, existing: str):
        if existing not in (KEEP, REPLACE):
            raise ValueError(f"existing is {KEEP} or {REPLACE}, not {existing}")
        self.root, self.existing = root.rstrip("/"), existing
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def _storage(self) -> tuple[fs.FileSystem, str]:
        """The file system of the vault and its folder there."""
        return fs.FileSystem.from_uri(self.root)

    def _kept(self, system: fs.FileSystem, target: str) -> bool:
        return self.existing == KEEP and system.get_file_info(target).type != fs.FileType.NotFound

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = self._storage()
        context = TaskContext.get()
        own = f"{root}/{self.staging}/{context.taskAttemptId() if context else uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        staged, no_body, kept = [], 0, 0
        for part in _parts(iterator):
            rows = [row for row in part if row["path"] is not None and row["body"] is not None]
            no_body += len(part) - len(rows)
            for row in rows:
                if not _within(row["path"]):
                    raise ValueError(f"not a path in the vault: {row['path']!r}")
            new = rows
            if self.existing == KEEP:
                with _turn(system, f"{root}/{self.staging}", fcntl.LOCK_SH):
                    new = [row for row in rows if not self._kept(system, f"{root}/{row['path']}")]
            kept += len(rows) - len(new)
            for row in new:
                with system.open_output_stream(f"{own}/{len(staged)}") as out:
                    out.write(bytes(row["body"]))
                staged.append(row["path"])
        written, folders = 0, set()
        with _turn(system, f"{root}/{self.staging}", fcntl.LOCK_EX):
            for number, path in enumerate(staged):
                target = f"{root}/{path}"
                # another task may have written it in the meantime
                if self._kept(system, target):
                    kept += 1
                    continue
                folder = target.rpartition("/")[0]
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                system.move(f"{own}/{number}", target)
                written += 1
        return Written(written, kept, no_body)

    def _clear(self) -> None:
        system, root = self._storage()
        where = f"{root}/{self.staging}"
        if system.get_file_info(where).type != fs.FileType.NotFound:
            system.delete_dir(where)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


def _spread(rows: DataFrame) -> DataFrame:
    """A stated number of partitions, as small rows would be put together by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def write_files(rows: DataFrame, root: str, existing: str = KEEP) -> None:
    """Write ``path, body`` rows below ``root`` (a folder or URI that all executors reach)."""
    rows.sparkSession.dataSource.register(VaultFiles)
    chosen = _spread(rows.select("path", rows["body"].cast("binary").alias("body")))
    chosen.write.format(NAME).option("path", root).option("existing", existing).mode("append").save()


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder and whether they are folders; none if it is not there. A local folder is
    listed as a stream, as it may hold very many."""
    if isinstance(system, fs.LocalFileSystem):
        if os.path.isdir(folder):
            with os.scandir(folder) as found:
                yield from ((entry.name, entry.is_dir()) for entry in found)
        return
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        yield info.base_name, info.type == fs.FileType.Directory


def _listing(root: str) -> Callable:
    """Entries of folders (their paths below ``root``); staging folders are none."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                entries = _entries(system, f"{base}/{folder}".rstrip("/"))
                while part := list(islice(entries, NAMES_AT_ONCE)):
                    part = [(f"{folder}/{name}".lstrip("/"), is_folder) for name, is_folder in part if not name.startswith(STAGING)]
                    yield pa.record_batch({"path": [p for p, _ in part], "folder": [f for _, f in part]}, _LISTED)

    return listed


def _reading(root: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths, contents, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{path}") as file:
                    content = file.read()
                paths.append(path)
                contents.append(content)
                held += len(content)
                if held >= BYTES_AT_ONCE:
                    yield pa.record_batch({"path": paths, "content": contents}, _READ)
                    paths, contents, held = [], [], 0
            yield pa.record_batch({"path": paths, "content": contents}, _READ)

    return read


_LISTED = pa.schema({"path": pa.string(), "folder": pa.bool_()})
_READ = pa.schema({"path": pa.string(), "content": pa.binary()})


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` below ``root`` and ``content`` of the files there and in all folders below. The folders
    of a level are listed by tasks, one level after the other; a folder is listed by one."""
    root = root.rstrip("/")
    folders, levels = spark.range(1, numPartitions=1).select(F.lit("").alias("path")), []
    while not levels or not folders.isEmpty():
        listed = cut(folders.mapInArrow(_listing(root), "path STRING, folder BOOLEAN"))
        levels.append(listed.where("NOT folder").select("path"))
        folders = _spread(listed.where("folder").select("path"))
    return _spread(reduce(DataFrame.unionByName, levels)).mapInArrow(_reading(root), "path STRING, content BINARY")
