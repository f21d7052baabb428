"""A Spark sink for folders of label files.

``spark.dataSource.register(LabelFolder)``, then
``files.write.format("labelfolder").mode("append").option("empty", "write").save(folder)`` with rows (stem, raw).

A job writes beside the folder's files and puts them in place when all tasks have ended, so a job that fails leaves the folder as it was.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import opened

#: What becomes of a row without text: a file without content, or none.
EMPTY = ("write", "omit")
#: What becomes of a file that is there: it is replaced, or keeps its lines and gets the new ones after them.
PRESENT = ("replace", "extend")


@dataclass
class _Done(WriterCommitMessage):
    #: Pairs of a file's name and the one under which a task has written it.
    files: list[tuple[str, str]] = field(default_factory=list)


def _read(store: fs.FileSystem, path: str) -> str | None:
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as f:
        return f.read().decode()


def _write(store: fs.FileSystem, path: str, text: str) -> None:
    with store.open_output_stream(path) as out:
        out.write(text.encode())


def extended(before: str | None, more: str) -> str:
    """The lines of a file, without blank ones and outer blanks, then those of ``more``; each ends with a line end."""
    lines = [x.strip() for x in (before or "").splitlines() if x.strip()] + [x.strip() for x in more.splitlines() if x.strip()]
    return "".join(f"{x}\n" for x in lines)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.empty, self.present = options.get("empty", "write"), options.get("present", "replace")
        for name, value, known in (("empty", self.empty, EMPTY), ("present", self.present, PRESENT)):
            if value not in known:
                raise ValueError(f"unknown {name} {value!r}; known: {', '.join(known)}")
        if overwrite and self.present == "extend":
            raise ValueError("mode overwrite has no files to extend")
        self.overwrite, self.folder, self.ending = overwrite, options["path"].rstrip("/"), options.get("ending", "txt")
        job = options.get("job")
        self.job = hashlib.sha256(job.encode()).hexdigest()[:24] if job else uuid.uuid4().hex[:24]
        self.named = bool(job)
        store, folder = opened.at(self.folder)
        self.finished = self.named and _read(store, f"{folder}/.{self.job}.done") is not None
        if not self.finished and (ready := _read(store, f"{folder}/.{self.job}.staged/.ready")) is not None:
            # An earlier run of this job was cut off while its files were put in place.
            self._place(json.loads(ready))
            self.finished = True
        if not self.finished:
            # Made here alone: what a task still writes after the job was given up has no place to go.
            store.create_dir(f"{folder}/.{self.job}.staged", recursive=True)

    def write(self, rows: Iterator[Row]) -> _Done:
        store, folder = opened.at(self.folder)
        staged, done = f"{folder}/.{self.job}.staged", _Done()
        for row in rows:
            if not row.stem or "/" in row.stem or row.stem in (".", ".."):
                raise ValueError(f"not a file's name: {row.stem!r}")
            if self.finished or (not row.raw and self.empty == "omit"):
                continue
            name = f"{row.stem}.{self.ending}"
            text = extended(_read(store, f"{folder}/{name}"), row.raw or "") if self.present == "extend" else row.raw or ""
            part = f"{uuid.uuid4().hex}.part"
            _write(store, f"{staged}/{part}", text)
            done.files.append((name, part))
        return done

    def commit(self, messages: list) -> None:
        """Note what is to be put in place, then do it; cut off in between, a run of the same ``job`` goes on."""
        if self.finished:
            return
        store, folder = opened.at(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _ in files]
        if self.present == "extend" and len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows extend one file")
        plan = {"files": files, "overwrite": self.overwrite}
        _write(store, f"{folder}/.{self.job}.staged/.ready~", json.dumps(plan))
        store.move(f"{folder}/.{self.job}.staged/.ready~", f"{folder}/.{self.job}.staged/.ready")
        self._place(plan)

    def _place(self, plan: dict) -> None:
        store, folder = opened.at(self.folder)
        staged, names = f"{folder}/.{self.job}.staged", {name for name, _ in plan["files"]}
        if plan["overwrite"]:
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File and f.base_name not in names and not re.fullmatch(r"\.[0-9a-f]{24}\.done", f.base_name):
                    store.delete_file(f.path)
                elif f.type == fs.FileType.Directory and not f.base_name.endswith(".staged"):
                    store.delete_dir(f.path)
        for name, part in plan["files"]:
            if store.get_file_info(f"{staged}/{part}").type == fs.FileType.File:
                store.move(f"{staged}/{part}", f"{folder}/{name}")
        if self.named:
            _write(store, f"{folder}/.{self.job}.done", "")
        store.delete_dir(staged)

    def abort(self, messages: list) -> None:
        """What tasks have written goes; the folder's files are as they were."""
        store, folder = opened.at(self.folder)
        if store.get_file_info(f"{folder}/.{self.job}.staged").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/.{self.job}.staged")


class LabelFolder(DataSource):
    """One file per row of (stem, raw).

    Options: ``empty``: ``write`` a file without content for null or empty text, or ``omit`` it; ``ending``: txt; ``present``: a file that is there is
    ``replace``d, or ``extend``ed: its lines, then the new ones; ``job``: a name for this write: run again after it has ended, it does nothing, and after it
    was cut off, it ends what it began, so lines are added once. A stem that is null, empty or a path fails the job. Stems should differ: of rows with one stem one
    stays, and a job that extends fails. Mode ``overwrite`` removes the folder's other files when the new ones are whole, ``append`` doesn't. The driver
    moves the files, one by one: names are all it holds.
    """

    @classmethod
    def name(cls) -> str:
        return "labelfolder"

    def schema(self) -> str:
        return "stem string, raw string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)
