"""A message topic in a shared folder, written by a stream.

``TopicSource`` is a Python data source with a stream writer.  Each task writes
its messages as one Parquet part; the driver then commits the micro-batch by one
file, named by the batch, that lists the parts.  A reader takes listed parts
only.  So a batch counts once however often it runs: a rerun writes new parts
and replaces the batch's list, and parts of a failed try are never listed.

It needs no connector and no server.  Where a Kafka connector is on the class
path, ``keyed.drain(messages, checkpoint, "kafka", ...)`` sends the same frame.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

NAME = "trustfold_topic"
_MESSAGE = "key string, value string"


def _place(path: str):
    """(file system, folder) of a path or URI, as tasks and the driver reach it without Spark."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int


class TopicWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator) -> Part:
        system, top = _place(self.path)
        system.create_dir(f"{top}/parts", recursive=True)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    out = pq.ParquetWriter(f"{top}/parts/{name}", batch.schema, filesystem=system)
                out.write_table(pa.Table.from_batches([batch]))
                rows += batch.num_rows
        if out is None:
            return Part(None, 0)
        out.close()
        return Part(name, rows)

    def commit(self, messages, batchId: int) -> None:
        system, top = _place(self.path)
        system.create_dir(f"{top}/commits", recursive=True)
        parts = [{"batch": batchId, "name": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
        draft = f"{top}/commits/_{uuid.uuid4().hex}"  # Spark's readers pass over names with an underscore
        with system.open_output_stream(draft) as f:
            f.write("".join(json.dumps(p) + "\n" for p in parts).encode())
        system.move(draft, f"{top}/commits/{batchId}.json")

    def abort(self, messages, batchId: int) -> None:
        system, top = _place(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{top}/parts/{m.name}")


class TopicSource(DataSource):
    """``writeStream.format("trustfold_topic").option("path", folder)`` for frames of (key, value)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _MESSAGE

    def streamWriter(self, schema, overwrite: bool) -> TopicWriter:
        if [f.name for f in schema.fields] != ["key", "value"]:
            raise ValueError(f"a message has a key and a value, not {[f.name for f in schema.fields]}")
        return TopicWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicSource)


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """(batch, key, value): the messages of all committed batches."""
    top = path.rstrip("/")
    listed = spark.read.schema("batch long, name string, rows long").json(f"{top}/commits").select("batch", "name")
    parts = spark.read.schema(_MESSAGE).parquet(f"{top}/parts").select("key", "value", F.col("_metadata.file_name").alias("name"))
    return parts.join(listed, "name").select("batch", "key", "value")
