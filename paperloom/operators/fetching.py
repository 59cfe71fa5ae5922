"""The manifest of fetched papers: status from what is there, stubs, sidecars, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import ingest, ranking
from paperloom.operators.reports import ordered

MANIFEST = "id string, title string, status string, points array<string>, file string, bytes bigint, error string"


def present(files: DataFrame) -> DataFrame:
    """(id, file, bytes) of the files (name, bytes) in a paper folder: a PDF wins over the stub of its paper."""
    named = files.select(F.regexp_extract("name", r"^(.*)\.(?:pdf|md)$", 1).alias("id"), F.col("name").alias("file"), "bytes").where("id <> ''")
    return ranking.latest_by_precedence(named, "id", [F.desc(F.col("file").endswith(".pdf")), F.asc("file")])


def superseded_stubs(files: DataFrame) -> DataFrame:
    """Names of stubs to delete, their papers having a PDF."""
    pdfs = files.where("name LIKE '%.pdf'").select(F.regexp_replace("name", r"\.pdf$", ".md").alias("name"))
    return files.select("name").join(pdfs, "name", "left_semi")


def stub(papers: DataFrame) -> Column:
    """A Markdown stub from a paper's own metadata; null where there is no abstract."""
    people = F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise(F.lit("unknown authors"))
    facts = F.concat_ws(". ", people, F.col("year").cast("string"), text.or_null(F.col("venue")))
    known = F.concat_ws(" — ", F.concat(F.lit("DOI: "), "doi"), F.concat(F.lit("arXiv: "), "arxivid"))
    body = F.concat(
        F.lit("---\nsource: "), "id", F.lit(".md\ntitle: "), text.yaml_scalar(F.col("title")), F.lit("\nabstract_only: true\n---\n\n> **ABSTRACT ONLY**: written from search metadata; the paper itself was not read.\n\n# "),
        "title", F.lit("\n\n"), facts, F.when(known != "", F.concat(F.lit("\n\n"), known)).otherwise(F.lit("")), F.lit("\n\n## Abstract\n\n"), text.strip(F.col("abstract")), F.lit("\n"),
    )
    return F.when(text.or_null(F.col("abstract")).isNotNull(), body)


def sidecars(papers: DataFrame) -> DataFrame:
    """(name, text): the metadata of each paper as one JSON file, for readers that must not guess it."""
    return papers.select(F.concat(F.lit("meta/"), "id", F.lit(".json")).alias("name"), F.concat(F.to_json(F.struct(*papers.columns), {"pretty": "true"}), F.lit("\n")).alias("text"))


def with_metadata(documents: DataFrame, papers: DataFrame, name: str = "name") -> DataFrame:
    """``documents`` with the metadata of the paper whose id is the document's file name."""
    return documents.withColumn("id", F.regexp_replace(name, r"\.[^.]*$", "")).join(papers, "id", "left")


def fetch_results(papers: DataFrame, downloads: DataFrame) -> DataFrame:
    """Manifest rows of papers nothing is present of.

    ``downloads`` (id, content, error): what a transport brought for the papers with a
    ``pdf_url``.  downloaded: a PDF of sufficient size; abstract-only: no PDF but an
    abstract, the reason kept; failed: neither.
    """
    rows = papers.join(downloads, "id", "left")
    whole = F.coalesce(ingest.is_pdf(F.col("content")), F.lit(False))
    magic = F.substring("content", 1, len(ingest.PDF_MAGIC)) == F.encode(F.lit(ingest.PDF_MAGIC), "ISO-8859-1")
    tried = text.or_null(F.col("pdf_url")).isNotNull()
    cause = F.coalesce("error", F.when(F.col("content").isNull(), "no answer"), F.when(~magic, "response was not a PDF (probably a login or consent page)"), F.concat(F.lit("PDF was only "), F.length("content").cast("string"), F.lit(" bytes")))
    readable = stub(rows).isNotNull()
    status = F.when(tried & whole, "downloaded").when(readable, "abstract-only").otherwise("failed")
    error = F.when(status == "downloaded", None).when(tried, cause).when(~readable, "no open-access PDF and no abstract")
    file = F.when(status == "downloaded", F.concat("id", F.lit(".pdf"))).when(status == "abstract-only", F.concat("id", F.lit(".md")))
    return rows.select("id", "title", status.alias("status"), "points", file.alias("file"), F.when(status == "downloaded", F.length("content").cast("bigint")).alias("bytes"), error.alias("error"))


def manifest(papers: DataFrame, files: DataFrame, old: DataFrame, downloads: DataFrame) -> DataFrame:
    """The new manifest, a row per id of ``papers`` or ``old``.

    What is present decides the status, never what the old manifest said; papers of
    which nothing is present get what ``downloads`` brought; rows of other papers stay.
    """
    there = present(files)
    before = old.select("id", F.col("points").alias("_old"))
    none = F.array().cast("array<string>")
    kept = papers.join(there, "id").join(before, "id", "left").select(
        "id", "title", F.when(F.col("file").endswith(".pdf"), "downloaded").otherwise("abstract-only").alias("status"),
        F.array_distinct(F.concat(F.coalesce("_old", none), F.coalesce("points", none))).alias("points"), "file", F.when(F.col("file").endswith(".pdf"), F.col("bytes")).alias("bytes"), F.lit(None).cast("string").alias("error"),
    )
    fresh = fetch_results(papers.join(there.select("id"), "id", "left_anti"), downloads)
    others = old.join(papers.select("id"), "id", "left_anti").select(*kept.columns)
    return kept.unionByName(fresh).unionByName(others)


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


def missing(papers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Papers of this run without their full text, with the manifest's status and error."""
    lacking = manifest.where("status <> 'downloaded'").select("id", "status", "error")
    return papers.join(lacking, "id")


def missing_list(papers: DataFrame, manifest: DataFrame, order: list[str], folder: str = "papers") -> DataFrame:
    """(place, line): a numbered entry for each paper without full text, in ``order``; no row if none is missing."""
    placed = ordered(missing(papers, manifest), [F.asc(c) for c in order])
    facts = F.concat_ws(" · ", F.col("year").cast("string"), text.or_null(F.col("venue")), F.when(F.col("status") == "failed", "no abstract either").otherwise("abstract only"))
    entry = F.concat(F.lit("## "), (F.col("place") + 1).cast("string"), F.lit(". "), "title")
    lines = F.concat_ws(
        "\n", entry, F.lit(""), F.concat(F.lit("- "), facts), F.concat(F.lit("- why: "), "error"), F.concat(F.lit("- https://doi.org/"), "doi"), F.concat(F.lit("- https://arxiv.org/abs/"), "arxivid"),
        F.concat(F.lit(f"- by hand: `{folder}/"), "id", F.lit(".pdf`")), F.lit(""),
    )
    return placed.select("place", lines.alias("line"))
