"""Rows of several tables that are published together or not at all.

A DataFrame has a column for each table: a struct, or null where a row adds nothing to that table. Tasks write files of
their own and tell the driver which; the driver publishes all of them, whatever their table, by one manifest that is put
in place by one rename. What no manifest names isn't there: files of a task that failed, of one that was run twice, or of
a job that was given up. A manifest bears the name of its transaction, so that a batch that comes again adds nothing.

    write_together(rows, path, txn)        # rows: courses struct<...>, memberships struct<...>
    read_together(spark, path, "courses")

Paths are what pyarrow's file systems open and Spark reads. Transactions only add rows, so that none depends on another.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from folioscan.sources.event_source import _file_system

_NAME = re.compile(r"[A-Za-z0-9][\w.-]*")


@dataclass
class Written(WriterCommitMessage):
    """A task's files: table, path below the root, rows."""

    files: list[tuple[str, str, int]]


class TogetherWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.txn, self.tables = options["path"], options["txn"], schema.fieldNames()
        self.job = options["job"]

    def write(self, iterator: Iterator) -> Written:
        """A file for each table that this task has rows of; batches are written as they come."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, folder = _file_system(self.root)
        task = TaskContext.get()
        part = f"{task.partitionId()}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
        writers: dict[str, pq.ParquetWriter] = {}
        counts: dict[str, int] = {}
        for batch in iterator:
            for name in self.tables:
                column = batch.column(name)
                column = column.filter(column.is_valid())
                if not len(column):
                    continue
                rows = pa.RecordBatch.from_arrays(column.flatten(), names=[f.name for f in column.type])
                if name not in writers:
                    files.create_dir(f"{folder}/{name}", recursive=True)
                    writers[name] = pq.ParquetWriter(f"{folder}/{name}/{self.job}-{part}.parquet", rows.schema, filesystem=files)
                writers[name].write_batch(rows)
                counts[name] = counts.get(name, 0) + len(rows)
        for w in writers.values():
            w.close()
        return Written([(name, f"{name}/{self.job}-{part}.parquet", n) for name, n in counts.items()])

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _file_system(self.root)
        from pyarrow.fs import FileType

        if files.get_file_info(f"{folder}/_log/{self.txn}.json").type != FileType.NotFound:
            return self.abort(messages)  # this transaction has been published
        files.create_dir(f"{folder}/_log", recursive=True)
        held = [{"table": t, "file": f, "rows": n} for m in messages if m for t, f, n in m.files]
        with files.open_output_stream(f"{folder}/_log/.{self.job}") as out:
            out.write("".join(f"{json.dumps(f)}\n" for f in held).encode())
        files.move(f"{folder}/_log/.{self.job}", f"{folder}/_log/{self.txn}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Takes away what tasks said that they wrote. Files of tasks that died before stay unnamed; `sweep` takes them away."""
        files, folder = _file_system(self.root)
        for m in messages:
            for _, file, _ in m.files if m else []:
                files.delete_file(f"{folder}/{file}")


class Together(DataSource):
    @classmethod
    def name(cls) -> str:
        return "together"

    def writer(self, schema: StructType, overwrite: bool) -> TogetherWriter:
        if overwrite:
            raise ValueError("transactions add rows; nothing is overwritten")
        return TogetherWriter(dict(self.options), schema)


def write_together(rows: DataFrame, path: str, txn: str) -> None:
    """Adds each column's structs to the table of its name, all or none; the same `txn` (letters, digits, . _ -) adds nothing twice."""
    if not _NAME.fullmatch(txn):
        raise ValueError(f"no name of a transaction: {txn}")
    rows.sparkSession.dataSource.register(Together)
    rows.write.format("together").mode("append").option("path", path).option("txn", txn).option("job", uuid.uuid4().hex).save()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(table, file, rows) of all that has been published."""
    return spark.read.schema("table string, file string, rows long").json(f"{path}/_log")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_together(spark: SparkSession, path: str, table: str, schema: StructType | str) -> DataFrame:
    """A table as its transactions left it. The driver lists files, as it does for any table of files; it reads none."""
    held = [r["file"] for r in manifests(spark, path).where(F.col("table") == table).select("file").collect()] if _exists(spark, f"{path}/_log") else []
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in held]) if held else spark.createDataFrame([], schema)


def sweep(spark: SparkSession, path: str, tables: list[str]) -> int:
    """Takes away files that no manifest names, and says how many; only while nothing is being written."""
    files, folder = _file_system(path)
    from pyarrow import fs

    named = {r["file"] for r in manifests(spark, path).select("file").collect()} if _exists(spark, f"{path}/_log") else set()
    gone = [f"{t}/{i.base_name}" for t in tables for i in files.get_file_info(fs.FileSelector(f"{folder}/{t}", allow_not_found=True)) if f"{t}/{i.base_name}" not in named]
    for f in gone:
        files.delete_file(f"{folder}/{f}")
    return len(gone)
