"""Ordered lines to one text file, written by all tasks.

``spark.write.format("lines")`` takes frames with a column ``line`` whose partitions stand in the order of the file. Each task
writes a file of its own beside the target; the commit strings these together and puts the result in the target's place, so
a run that fails leaves what was there. All machines must see the target's folder at the same path.
"""

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.parts = path, f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        os.makedirs(self.parts, exist_ok=True)
        task = TaskContext.get()
        where = os.path.join(self.parts, f"{task.partitionId()}-{task.taskAttemptId()}")
        with open(where, "w", encoding="utf-8", newline="") as out:
            for batch in iterator:
                out.writelines(f"{line}\n" for line in batch.column("line").to_pylist() if line is not None)
        return _Part(task.partitionId(), where)

    def commit(self, messages: list[_Part]) -> None:
        os.makedirs(self.parts, exist_ok=True)
        whole = os.path.join(self.parts, "whole")
        with open(whole, "wb") as out:
            for part in sorted((m for m in messages if m), key=lambda m: m.number):
                with open(part.path, "rb") as piece:
                    shutil.copyfileobj(piece, out)
        os.replace(whole, self.path)
        shutil.rmtree(self.parts)

    def abort(self, messages: list[_Part]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class Lines(DataSource):
    @classmethod
    def name(cls):
        return "lines"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """lines(line, ...) to the file, in the given order of columns."""
    spark = lines.sparkSession
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    spark.dataSource.register(Lines)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) for c in order]
    sorted_ = lines.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).select("line")
    sorted_.write.format("lines").mode("append").save(os.path.abspath(path))
