"""Sinks: one file per row, event appends, ordered Markdown."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text


def write_files(rows: DataFrame, folder: str, name: str = "name", body: str = "text") -> None:
    """One UTF-8 file per row in a shared folder; each is written beside its place and renamed."""

    def put(partition) -> None:
        for row in partition:
            path = os.path.join(folder, row[name])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "w", encoding="utf-8") as file:
                file.write(row[body])
            os.replace(path + ".part", path)

    rows.select(name, body).foreachPartition(put)


def append_events(events: DataFrame, path: str) -> None:
    """Append rows to a JSONL log, credentials redacted."""
    events.select(text.redact(F.to_json(F.struct("*"))).alias("value")).write.mode("append").text(path)


def delete_files(names: DataFrame, folder: str, name: str = "name") -> int:
    """Delete the named files of a folder one by one, as their names arrive; how many there were."""
    spark = names.sparkSession
    jvm, deleted = spark.sparkContext._jvm, 0
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in names.select(name).toLocalIterator():  # a partition at a time
        deleted += bool(fs.delete(jvm.org.apache.hadoop.fs.Path(folder, row[0]), False))
    return deleted
