"""A sink for files of sections: all of a write appear, or none of them does."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def folder_name(section: str) -> str:
    """A name for a section's folder: no two sections have the same one, and none leads elsewhere."""
    name = quote(section, safe=" ")
    return name if name.strip(".") else name.replace(".", "%2E") or "%"


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has put its files; None if it had none."""

    folder: str | None


class SectionFiles(DataSource):
    """``format("section_files")``: rows (section_id, content) become ``<folder>/<section_id>/<file>``, ids as in URLs.

    Options: ``folder``, one that all machines see as files, and ``file``. Appends only: sections that are not among the
    rows keep their files. Rows without a section_id or content make no file; of several rows of a section the last one of the last task counts.
    """

    @classmethod
    def name(cls) -> str:
        return "section_files"

    def writer(self, schema: StructType, overwrite: bool) -> SectionWriter:
        if overwrite:
            raise ValueError("files of sections are replaced one by one: write in append mode")
        missing = {"section_id", "content"} - set(schema.names)
        if missing or not self.options.get("folder") or not self.options.get("file"):
            raise ValueError("section_files wants columns section_id and content, and options folder and file")
        return SectionWriter(self.options["folder"], self.options["file"])


class SectionWriter(DataSourceArrowWriter):
    """Each attempt of a task fills a folder of its own; only those that Spark has taken are moved into place."""

    def __init__(self, folder: str, file: str):
        self.folder, self.file = folder, file
        self.staging = os.path.join(folder, f".staged-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        own = None
        for batch in iterator:
            for section, content in zip(batch.column("section_id").to_pylist(), batch.column("content"), strict=True):
                if section is None or not content.is_valid:
                    continue
                own = own or os.path.join(self.staging, uuid.uuid4().hex)
                at = os.path.join(own, folder_name(str(section)))
                os.makedirs(at, exist_ok=True)
                with open(os.path.join(at, self.file), "wb") as f:
                    f.write(content.as_py())
        return Staged(own)

    def commit(self, messages: list[Staged | None]) -> None:
        for message in messages:
            if message is None or message.folder is None:
                continue
            for entry in os.scandir(message.folder):
                to = os.path.join(self.folder, entry.name)
                os.makedirs(to, exist_ok=True)
                os.replace(os.path.join(entry.path, self.file), os.path.join(to, self.file))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
