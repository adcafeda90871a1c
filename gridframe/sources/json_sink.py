"""A sink for documents: JSON lines, each row once however often its task ran.

``df.write.format(FORMAT)`` (``register`` it first) takes a table with a string column ``value`` of JSON objects.  A
task writes a file of its own under ``_temporary``; only files of the attempts that Spark commits are moved beside the
others when the whole job has ended, and with ``overwrite`` what was there goes then, not before.  A job that fails
leaves the folder's files as they were; what tasks wrote that were still running then stays under ``_temporary``, which
readers pass over.  No folder is made for a document, and no file for a task without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "gridframe_json"


@dataclass
class Written(WriterCommitMessage):
    """The file of one task, and its rows."""

    name: str | None
    rows: int


class JsonWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path.removeprefix("file:") if self.path.startswith("file:/") else self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, base = self.place()
        name, rows, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.json", 0, None
        for batch in iterator:
            for value in batch.column("value").to_pylist():
                if value is None:
                    continue
                if out is None:
                    files.create_dir(f"{base}/_temporary/{self.job}", recursive=True)
                    out = files.open_output_stream(f"{base}/_temporary/{self.job}/{name}")
                out.write(value.encode() + b"\n")
                rows += 1
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, base = self.place()
        files.create_dir(base, recursive=True)
        before = [f.path for f in files.get_file_info(fs.FileSelector(base)) if f.is_file] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                files.move(f"{base}/_temporary/{self.job}/{m.name}", f"{base}/{m.name}")
        for path in before:
            files.delete_file(path)
        self.clear(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*self.place())

    def clear(self, files, base: str) -> None:
        """What this job's other attempts left, and the folder of such if no other job has one."""
        from pyarrow import fs

        for path in (f"{base}/_temporary/{self.job}", f"{base}/_temporary"):
            found = files.get_file_info(path)
            if found.type == fs.FileType.Directory and (path.endswith(self.job) or not files.get_file_info(fs.FileSelector(path))):
                files.delete_dir(path)


class JsonSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> JsonWriter:
        if "value" not in schema.names:
            raise ValueError("rows need a column value of JSON objects")
        return JsonWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonSink)
