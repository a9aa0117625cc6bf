"""A sink for named files of any bytes, written in parts: any task may write any piece of a file at its offset.

Rows are (path, at, content, size): the bytes ``content`` belong at offset ``at`` of the file ``path``, which has ``size`` bytes in
all. A file needs neither to be one row nor to be one task's. Tasks write into a file aside; the commit, which sees the
bytes of the attempts that counted, checks that no file lacks any, and renames. A task that runs again writes the same
bytes to the same places, so a retry leaves one whole file, and a job that fails leaves the files as they were.

The folder must be mounted on all executors and the driver, as offsets are not to be had in object stores.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "cuesheet_parts"
SCHEMA = "path string, at bigint, content binary, size bigint"


@dataclass
class Written(WriterCommitMessage):
    """Bytes by file that one task wrote, and the files' sizes."""

    files: dict[str, tuple[int, int]]


class PartFiles(DataSource):
    """``df.write.format("cuesheet_parts")``; see ``write_parts``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PartWriter(self.options["folder"], self.options["job"])


class PartWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def _places(self, path: str) -> tuple[str, str]:
        """Where a file comes to stand, and where it is written."""
        target = os.path.normpath(os.path.join(self.folder, path.lstrip("/")))
        if not target.startswith(os.path.normpath(self.folder) + os.sep):
            raise ValueError(f"{path} leaves the folder {self.folder}")
        return target, f"{target}.{self.job}.part"

    def write(self, rows: Iterator) -> Written:
        files: dict[str, tuple[int, int]] = {}
        handle, current = -1, None
        try:
            for row in rows:
                if row["path"] != current:
                    if handle >= 0:
                        os.close(handle)
                        handle = -1
                    current = row["path"]
                    _, aside = self._places(current)
                    os.makedirs(os.path.dirname(aside), exist_ok=True)
                    handle = os.open(aside, os.O_RDWR | os.O_CREAT, 0o644)
                content, at = memoryview(row["content"] or b""), row["at"]
                while len(content):
                    done = os.pwrite(handle, content, at)
                    content, at = content[done:], at + done
                bytes_, _ = files.get(current, (0, 0))
                files[current] = (bytes_ + at - row["at"], row["size"])
        finally:
            if handle >= 0:
                os.close(handle)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        total: dict[str, list[int]] = {}
        for message in messages:
            for path, (bytes_, size) in message.files.items() if message is not None else ():
                total.setdefault(path, [0, size])[0] += bytes_
        lacking = [path for path, (bytes_, size) in total.items() if bytes_ != size]
        if lacking:
            raise ValueError(f"{len(lacking)} files lack parts or have some twice, such as {lacking[0]}")
        for path in total:
            target, aside = self._places(path)
            os.replace(aside, target)

    def abort(self, messages: list[Written | None]) -> None:
        for path in {path for message in messages if message is not None for path in message.files}:
            try:
                os.remove(self._places(path)[1])
            except FileNotFoundError:
                pass


def write_parts(parts: DataFrame, folder: str) -> None:
    """Write all files of parts(path, at, content, size) below a folder; paths are relative to it."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", folder)
    if scheme and scheme[1] != "file":
        raise ValueError(f"{folder} is in an object store, which has no offsets; name a mounted folder")
    local = re.sub(r"^file:(//(?=/))?", "", folder)
    parts.sparkSession.dataSource.register(PartFiles)
    rows = parts.select("path", parts["at"].cast("bigint"), "content", parts["size"].cast("bigint"))
    rows.write.format(FORMAT).mode("append").option("folder", local).option("job", uuid.uuid4().hex).save()
