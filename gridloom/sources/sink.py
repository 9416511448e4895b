"""Files as a Spark sink: tasks stage what they write, and the driver's commit moves it into place, all or nothing.

Rows (name, data) are files of a folder. A task writes its rows beside their places, under names of its attempt; only
attempts that Spark commits are moved, and a job that fails leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """Where each of a task's files is, and its name."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.job = options["path"], uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, at = fs.FileSystem.from_uri(self.folder)
        return store, at, f"{at}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, _, staging = self._staging()
        store.create_dir(staging, recursive=True)
        files, attempt = [], TaskContext.get().taskAttemptId()
        for batch in iterator:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data"), strict=True):
                part = f"{staging}/{attempt}-{len(files)}"
                with store.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                files.append((part, name))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, at, staging = self._staging()
        store.create_dir(at, recursive=True)
        for message in messages:
            for part, name in message.files if message else []:
                store.move(part, f"{at}/{name}")
        self._clear(store, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, staging = self._staging()
        self._clear(store, staging)

    @staticmethod
    def _clear(store: fs.FileSystem, staging: str) -> None:
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: object, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def write_files(files: DataFrame, folder: str) -> None:
    """The files (name, data) into folder, all or none of them; one that is there by that name is replaced."""
    files.sparkSession.dataSource.register(Files)
    files.select("name", "data").write.format("files").mode("append").save(folder)
