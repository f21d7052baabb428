"""A Spark sink that writes one file a row, as they are: pictures and other bytes.

``spark.dataSource.register(FileFolder)``, then ``rows.write.format("filefolder").mode("append").save(folder)`` with rows (name, content).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import opened


@dataclass
class _Done(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.subfolder = f".{self.job}.staged"
        store, folder = opened.at(self.folder)
        # Made here alone: what a task still writes after the job was given up has no place to go.
        store.create_dir(f"{folder}/{self.subfolder}", recursive=True)

    def write(self, rows: Iterator[Row]) -> _Done:
        store, folder = opened.at(self.folder)
        done = _Done()
        for row in rows:
            name = posixpath.normpath(row.name or "")
            if not row.name or name.startswith(("/", "..", ".")):
                raise ValueError(f"not a file's name: {row.name!r}")
            if row.content is None:
                continue
            part = f"{folder}/{self.subfolder}/{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(bytes(row.content))
            done.files.append((name, part))
        return done

    def commit(self, messages: list) -> None:
        store, folder = opened.at(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = {name for name, _ in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("two rows have one name")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder, recursive=True)):
                inside = f.path[len(folder) + 1 :]
                if f.type == fs.FileType.File and inside not in names and not inside.startswith(self.subfolder):
                    store.delete_file(f.path)
        for name, part in files:
            store.create_dir(posixpath.dirname(f"{folder}/{name}"), recursive=True)
            store.move(part, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, folder = opened.at(self.folder)
        if store.get_file_info(f"{folder}/{self.subfolder}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.subfolder}")


class FileFolder(DataSource):
    """One file per row of (name, content): names may have folders, but stay inside; a row without content has no file; two rows of one name fail the job.

    Files are put in place when all tasks have ended; a job that fails leaves the folder as it was. Mode ``overwrite`` removes other files then.
    """

    @classmethod
    def name(cls) -> str:
        return "filefolder"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)
