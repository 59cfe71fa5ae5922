"""Scans: document folders, cards with front matter, JSON lists and event logs.

All readers take explicit schemas and are tolerant: what can't be read becomes a row
with an ``error`` or no row, never an exception.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_TYPES = ("pdf", "md", "txt", "markdown", "tex")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_document(name: Column) -> Column:
    """Not hidden, private, a readme or an index."""
    return ~name.rlike(r"^[._]") & ~name.rlike(r"(?i)^(readme|index)\.[a-z]+$")


def extension_filter(value: str | list[str] | None) -> list[str]:
    """"pdf", ".pdf", "pdf, md" or a list, as lower-case extensions without dots; nothing gives all."""
    parts = value.split(",") if isinstance(value, str) else list(value or [])
    return [p.strip().lower().lstrip(".") for p in parts if p.strip(" .")] or list(DOCUMENT_TYPES)


def documents(spark: SparkSession, folder: str, only: str | list[str] | None = None) -> DataFrame:
    """(path, name, changed, content) of the documents directly in ``folder``; the filter reaches the file listing."""
    kinds = extension_filter(only)
    glob = "*.{" + ",".join(sorted({k for x in kinds for k in (x, x.upper())})) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    rows = files.select("path", file_name(F.col("path")).alias("name"), F.col("modificationTime").alias("changed"), "content")
    return rows.where(is_document(F.col("name")))


def texts(spark: SparkSession, folder: str, glob: str = "*.md", recursive: bool = False) -> DataFrame:
    """(path, name, changed, text) of whole text files."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("changed"), F.col("value").alias("text"))
    return rows.where(~F.col("name").rlike(r"^[._]"))


_FRONT = T.StructType().add("fields", "string").add("error", "string")


@F.pandas_udf(_FRONT)
def front_matter(bodies: pd.Series) -> pd.DataFrame:
    """Leading YAML block as a JSON object {key: text or JSON}; none gives {}, a malformed one an error."""
    import json
    import re

    import yaml

    def read(body):
        found = re.match(r"\A﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", body or "", re.S)
        if not found:
            return "{}", None
        try:
            loaded = yaml.safe_load(found[1]) or {}
        except yaml.YAMLError as broken:
            return None, str(broken).splitlines()[0]
        if not isinstance(loaded, dict):
            return None, "front matter is no mapping"
        return json.dumps({str(k): v.strip() if isinstance(v, str) else json.dumps(v, default=str) for k, v in loaded.items() if v is not None}), None

    return pd.DataFrame([read(b) for b in bodies], columns=["fields", "error"])


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, fields, error): the front matter of every Markdown card."""
    return texts(spark, folder).withColumn("_f", front_matter("text")).select("path", "name", F.from_json("_f.fields", "map<string,string>").alias("fields"), "_f.error")


def listed(field: Column) -> Column:
    """A list given as JSON array or comma-separated text, trimmed, blanks dropped."""
    from_json = F.from_json(field, "array<string>")
    items = F.coalesce(F.when(field.startswith("["), from_json), F.split(field, ","))
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def json_items(spark: SparkSession, path: str, dotted: str, item: str) -> DataFrame:
    """(item_index, item): the array at a dotted path of whole JSON files, read with schema ``item``."""
    nested = f"array<{item}>"
    for key in reversed(dotted.split(".")):
        nested = f"struct<`{key}`: {nested}>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", nested).alias("v"))
    return whole.select(F.posexplode(F.col("v." + dotted)).alias("item_index", "item"))


EVENT_SCHEMA = "at timestamp, type string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """(at, type, payload): a JSONL event log; unreadable lines are skipped, other keys stay in payload."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    read = lines.select(F.from_json("value", EVENT_SCHEMA).alias("e"), F.expr("try_parse_json(value)").alias("payload"))
    return read.where("e.type IS NOT NULL").select("e.at", "e.type", "payload")
