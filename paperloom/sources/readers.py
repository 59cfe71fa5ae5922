"""Readers of what a run leaves behind: query lists, results, manifests, checkpoints, decisions, items, agents.

Lists that grow are read as DataFrames with explicit schemas; single small control files
are read on the driver through the session's file system.  Missing and broken files are
what each reader says, never an unexplained exception.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import fetching, ranking
from paperloom.sources import scan

STATE_VERSION = 1


class ReadError(ValueError):
    """A file that is missing, broken or of another version; the message says which."""


def read_small(spark: SparkSession, path: str) -> str | None:
    """Whole text of one small file, or None if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, body: str) -> None:
    """Write one small file beside its place and rename it, so no reader sees half of it."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(body, "utf-8"))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"can't rename {part} to {target}")


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it doesn't exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


# item sources of a fan-out


def distinct_ids(items: DataFrame) -> DataFrame:
    """``items`` if no id occurs twice; else ReadError with the first ids that do."""
    twice = ranking.colliding(items, "id").orderBy("id").limit(5).collect()
    if twice:
        raise ReadError("items collide on id " + ", ".join(repr(r["id"]) for r in twice))
    return items


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    from paperloom.operators.reports import ordered

    return ordered(rows, [F.asc(c) for c in order], "item_index")


def glob_items(spark: SparkSession, pattern: str) -> DataFrame:
    """(id, item_index, path, stem) of the files a pattern matches, in path order."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    rows = files.withColumn("stem", F.regexp_replace(scan.file_name(F.col("path")), r"(?<=.)\.[^.]*$", ""))
    return distinct_ids(_numbered(rows, ["path"]).select(text.slug("stem").alias("id"), "item_index", "path", "stem"))


def json_items(spark: SparkSession, path: str, dotted: str | None = None) -> DataFrame:
    """(id, item_index, stem, item) of the array at a dotted path of a JSON file, ``item`` a VARIANT.

    Objects give their id's file-name form or ``item-N``; strings and numbers give their
    own.  ReadError if there is no array.
    """
    at = "$" + "".join(f"['{k}']" for k in (dotted or "").split(".") if k)
    whole = spark.read.text(path, wholetext=True).select(F.expr(f"try_variant_get(try_parse_json(value), \"{at}\", 'array<variant>')").alias("a"))
    if not whole.where("a IS NOT NULL").limit(1).count():
        raise ReadError(f"{path}: no JSON array at {dotted or 'the top'}")
    rows = whole.select(F.posexplode("a").alias("item_index", "item"))
    kind = F.schema_of_variant("item")
    own = F.when(F.schema_of_variant(F.try_variant_get("item", "$.id", "variant")) == "STRING", F.nullif(F.try_variant_get("item", "$.id", "string"), F.lit("")))
    stem = F.when(~kind.startswith("OBJECT"), F.try_variant_get("item", "$", "string"))
    number = F.concat(F.lit("item-"), (F.col("item_index") + 1).cast("string"))
    return distinct_ids(rows.select(F.coalesce(text.slug(F.coalesce(stem, own)), number).alias("id"), "item_index", stem.alias("stem"), "item"))


def literal_items(spark: SparkSession, values: Iterable[str | int | float]) -> DataFrame:
    """(id, item_index, stem) of values written into a plan."""
    rows = [(text.slug_of(str(v)), i, str(v)) for i, v in enumerate(values)]
    return distinct_ids(spark.createDataFrame(rows, "id string, item_index int, stem string"))


# lists


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_no, kind, point, query, doi, arxivid, title, limit) of a query list; entries without a point are dropped."""
    fields = "struct<kind: string, point: string, query: string, doi: string, arxivId: string, title: string, limit: int>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<queries: array<{fields}>>")["queries"].alias("q"))
    if not whole.where("q IS NOT NULL").limit(1).count():
        raise ReadError(f"{path} must hold a list of queries")
    rows = whole.select(F.posexplode("q").alias("query_no", "q")).select("query_no", "q.*").where("point IS NOT NULL AND point <> ''")
    kind = F.when(F.col("kind") == "id", "id").otherwise("query")
    return rows.select("query_no", kind.alias("kind"), "point", *[text.or_null(F.col(c)).alias(c.lower()) for c in ("query", "doi", "arxivId", "title")], "limit")


PAPER = "struct<id: string, title: string, authors: array<string>, year: int, venue: string, abstract: string, doi: string, arxivId: string, s2Id: string, openAlexId: string, citationCount: bigint, pdfUrl: string, backends: array<string>, queries: array<string>, points: array<string>>"


def results(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a results file; a missing or broken file is an empty one."""
    body = read_small(spark, path)
    names = {"arxivId": "arxivid", "s2Id": "s2_id", "openAlexId": "openalex_id", "citationCount": "citations", "pdfUrl": "pdf_url"}
    if body is None:
        return spark.createDataFrame([], f"p {PAPER}").select("p.*").withColumnsRenamed(names)
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<papers: array<{PAPER}>>")["papers"]).alias("p"))
    return whole.select("p.*").withColumnsRenamed(names)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a fetch manifest; a missing or broken file is an empty one."""
    if read_small(spark, path) is None:
        return spark.createDataFrame([], fetching.MANIFEST)
    row = "struct<" + ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in fetching.MANIFEST.split(", "))) + ">"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"struct<papers: array<{row}>>")["papers"]).alias("p")).select("p.*")


def write_manifest(rows: DataFrame, path: str) -> None:
    """Write manifest rows as JSON lines in order of id, so that two runs can be compared line by line."""
    rows.orderBy("id").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


# control files


def checkpoint(spark: SparkSession, path: str) -> dict:
    """A run's state; ReadError tells a missing, an unreadable and an incompatible one apart."""
    body = read_small(spark, path)
    if body is None:
        raise ReadError(f"no run state at {path}")
    try:
        state = json.loads(body)
    except ValueError as cause:
        raise ReadError(f"run state at {path} is not valid JSON: {cause}") from None
    if not isinstance(state, dict) or state.get("version") != STATE_VERSION:
        raise ReadError(f"run state at {path} has version {state.get('version') if isinstance(state, dict) else None}, not {STATE_VERSION}")
    return state


@dataclass(frozen=True)
class Decision:
    """What a reviewer decided at a gate."""

    action: str
    feedback: str | None = None
    target: str | None = None
    keep: tuple[str, ...] | None = None


def decision(body: str | None) -> Decision | None:
    """A decision file; nothing, or anything unreadable, is no decision, a malformed keep list none of its own."""
    try:
        raw = json.loads(body or "")
    except ValueError:
        return None
    action = {"reject": "revise"}.get(raw.get("action"), raw.get("action")) if isinstance(raw, dict) else None
    if action not in ("approve", "revise", "skip", "abort"):
        return None
    keep = raw.get("keep")
    keep = tuple(keep) if isinstance(keep, list) and all(isinstance(k, str) for k in keep) else None
    clean = lambda v: v.strip() if isinstance(v, str) and v.strip() else None
    return Decision(action, clean(raw.get("feedback")), clean(raw.get("target")), keep)


@dataclass(frozen=True)
class Agent:
    """A per-item function described in Markdown: what it may use and what it must write."""

    name: str
    description: str
    body: str
    tools: tuple[str, ...] | None = None
    model: str | None = None
    max_turns: int | None = None
    timeout_minutes: float | None = None
    outputs: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


#: Tools an agent may be allowed.
TOOLS = ("read", "write", "edit", "bash", "grep", "find", "ls", "search_papers")


def tool_list(value) -> tuple[str, ...] | None:
    """Allowed tools from a list or a comma-separated text: None for all, none of them for "none"; an unknown one raises."""
    if value is None or value == "all":
        return None
    names = [str(v).strip() for v in (value if isinstance(value, list) else str(value).split(","))]
    names = [n for n in names if n and n != "none"]
    if unknown := [n for n in names if n not in TOOLS]:
        raise ReadError(f"unknown tools {unknown}; known are {', '.join(TOOLS)}")
    return tuple(dict.fromkeys(names))


def agent(body: str, source: str) -> Agent:
    """An agent's definition; ReadError names the file and what is wrong with it."""
    import yaml

    found = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)(.*)", body, re.S)
    try:
        fields = yaml.safe_load(found[1]) if found else None
    except yaml.YAMLError as cause:
        raise ReadError(f"{source}: {str(cause).splitlines()[0]}") from None
    if not isinstance(fields, dict):
        raise ReadError(f"{source}: no front matter")
    problems = [f"{k} must be text" for k in ("name", "description") if not isinstance(fields.get(k), str) or not fields[k].strip()]
    whole, real = fields.get("max_turns"), fields.get("timeout_minutes")
    if whole is not None and (isinstance(whole, bool) or not isinstance(whole, int) or whole < 1):
        problems.append("max_turns must be a whole number from 1")
    if real is not None and (isinstance(real, bool) or not isinstance(real, (int, float)) or real <= 0):
        problems.append("timeout_minutes must be a positive number")
    outputs = fields.get("outputs") or []
    outputs = [outputs] if isinstance(outputs, str) else outputs
    if not isinstance(outputs, list) or not all(isinstance(o, str) and o.strip() for o in outputs):
        problems.append("outputs must be a list of paths")
    if problems:
        raise ReadError(f"{source}: " + "; ".join(problems))
    known = {"name", "description", "tools", "model", "max_turns", "timeout_minutes", "outputs"}
    return Agent(fields["name"].strip(), fields["description"].strip(), found[2].strip(), tool_list(fields.get("tools")), fields.get("model"), whole, real, tuple(o.strip() for o in outputs), {k: v for k, v in fields.items() if k not in known})


def discover_agents(spark: SparkSession, folders: Iterable[str]) -> tuple[list[Agent], list[str]]:
    """(agents by name, problems) of the Markdown files in ``folders``; a later folder's agent wins, a bad file is a problem."""
    found: dict[str, Agent] = {}
    problems: list[str] = []
    for folder in folders:
        for name in list_folder(spark, folder):
            if name.endswith(".md") and name[0] not in "._":
                try:
                    one = agent(read_small(spark, f"{folder.rstrip('/')}/{name}") or "", name)
                    found[one.name] = one
                except ReadError as cause:
                    problems.append(str(cause))
    return [found[k] for k in sorted(found)], problems


def option(options: dict, key: str, fallback):
    """An option of a step: text trimmed and not blank, numbers also written as text; else ``fallback``."""
    value = options.get(key)
    if isinstance(fallback, bool):
        return value is True or isinstance(value, str) and value.strip().lower() in ("true", "1", "yes", "on")
    if isinstance(fallback, (int, float)):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return value
        digits = re.match(r"\s*([+-]?\d+)", value) if isinstance(value, str) else None
        return int(digits[1]) if digits else fallback
    return value.strip() if isinstance(value, str) and value.strip() else fallback


def run_defaults(spark: SparkSession, path: str) -> dict[str, str]:
    """Provider, model and thinking level that hold where nothing else is said; a missing or broken file says nothing."""
    try:
        raw = json.loads(read_small(spark, path) or "{}")
    except ValueError:
        raw = {}
    return {k: v.strip() for k in ("provider", "model", "thinking") if isinstance(v := raw.get(k) if isinstance(raw, dict) else None, str) and v.strip()}


def latest_run(spark: SparkSession, folder: str) -> str | None:
    """The latest run's id among the names in a folder."""
    ids = [n for n in list_folder(spark, folder) if re.match(text.RUN_ID, n)]
    return max(ids) if ids else None


def inside(base: str, path: str) -> str:
    """``path`` below ``base``, both plain paths; ReadError if it leads out."""
    import posixpath

    whole = posixpath.normpath(posixpath.join(base, path))
    root = posixpath.normpath(base)
    if whole != root and not whole.startswith(root.rstrip("/") + "/"):
        raise ReadError(f"{path} leads out of {base}")
    return whole


def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every file below a folder in lower case, without guidance files."""
    rows = scan.texts(spark, folder, "*", recursive=True)
    return rows.where(~F.col("name").rlike(r"(?i)^readme\.")).select("path", F.lower("text").alias("text"))


def collected(spark: SparkSession, paths: Iterable[str], only: str | list[str] | None = None) -> DataFrame:
    """(path, name, changed, content) of documents in folders and of files named themselves, in path order.

    Folders and files that aren't there are skipped; a file named itself needn't look
    like a document, only fit the filter if one is given.
    """
    jvm = spark.sparkContext._jvm
    folders, files = [], []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(target):
            (folders if fs.getFileStatus(target).isDirectory() else files).append(path)
    parts = [scan.documents(spark, f, only) for f in folders]
    if only is not None:
        kinds = scan.extension_filter(only)
        files = [f for f in files if f.lower().rsplit(".", 1)[-1] in kinds]
    if files:
        named = spark.read.format("binaryFile").load(files)
        parts.append(named.select("path", scan.file_name(F.col("path")).alias("name"), F.col("modificationTime").alias("changed"), "content"))
    if not parts:
        return spark.createDataFrame([], "path string, name string, changed timestamp, content binary")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.orderBy("path")
