"""Ingesting a folder of documents: one status table from scan, freshness, extraction and page statistics.

PDF extraction is a parameter, a function from bytes to page texts that runs in Arrow
batches on the executors; everything else is a projection over the status table, and
only extracted and copied rows carry a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text
from paperloom.operators import ingest, ranking

TEXT_TYPES = ("md", "txt", "markdown", "tex")
_PAGES = T.StructType().add("pages", T.ArrayType(T.StringType())).add("error", T.StringType())


def extracted(content: Column, extractor: Callable[[bytes], list[str]] | None) -> Column:
    """struct(pages, error) of each PDF; a failing extractor gives an error, never an exception."""

    @F.pandas_udf(_PAGES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            rows = []
            for content in contents:
                try:
                    if content is None:
                        rows.append((None, None))
                    elif extractor is None:
                        rows.append((None, "no PDF extractor was given"))
                    else:
                        rows.append(([str(p) for p in extractor(bytes(content))], None))
                except Exception as cause:  # whatever a damaged file makes it raise
                    rows.append((None, f"{type(cause).__name__}: {cause}"))
            yield pd.DataFrame(rows, columns=["pages", "error"])

    return run(content)


def ingest_status(files: DataFrame, outputs: DataFrame, extractor: Callable[[bytes], list[str]] | None = None, force: bool = False) -> DataFrame:
    """(path, output, status, n_pages, characters, textless, error, document) for ``files`` (path, changed, content).

    skipped: an output (``outputs``: name, written) at least as new is there; copied: a
    text document; extracted: a PDF with text; failed: anything else, with the reason.
    Output names are file-name forms of the paths, made unique in path order.
    """
    named = ranking.unique_names(files.select("path", text.path_slug("path").alias("_slug")), "_slug", ["path"], "_name").select("path", F.concat("_name", F.lit(".md")).alias("output"))
    rows = files.join(named, "path").join(outputs.select(F.col("name").alias("output"), "written"), "output", "left")
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    fresh = F.coalesce(F.col("written") >= F.col("changed"), F.lit(False)) & F.lit(not force)
    rows = rows.withColumn("_kind", kind).withColumn("_fresh", fresh)
    pdf = (F.col("_kind") == "pdf") & ~F.col("_fresh")
    rows = rows.withColumn("_x", extracted(F.when(pdf, F.col("content")), extractor))
    stats = ingest.page_stats(rows.withColumn("pages", F.coalesce("_x.pages", F.array().cast("array<string>"))), "pages")
    body = F.when(F.col("_kind").isin(*TEXT_TYPES) & ~F.col("_fresh"), F.make_valid_utf8(F.col("content").cast("string")))
    reason = (
        F.when(F.col("_fresh") | body.isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_kind") != "pdf", F.concat(F.lit('unsupported extension ".'), "_kind", F.lit('"')))
        .when(F.col("_x.error").isNotNull(), F.col("_x.error"))
        .when(F.col("status") == "scanned", F.concat(F.lit("no text layer on any of "), F.col("n_pages").cast("string"), F.lit(" page(s)")))
        .when(F.col("status") == "mostly_scanned", F.concat(F.lit("no text layer on "), F.size("textless").cast("string"), F.lit(" of "), F.col("n_pages").cast("string"), F.lit(" page(s) ("), text.page_ranges(F.col("textless")), F.lit(")")))
    )
    status = F.when(F.col("_fresh"), "skipped").when(body.isNotNull(), "copied").when(reason.isNotNull(), "failed").otherwise("extracted")
    document = F.when(status == "copied", ingest.passed_through(F.col("path"), body)).when(status == "extracted", ingest.rendered(F.col("path"), F.col("pages"), F.col("textless")))
    is_pdf = F.col("_kind") == "pdf"
    return stats.select(
        "path", "output", status.alias("status"), F.when(is_pdf & ~F.col("_fresh"), F.col("n_pages")).alias("n_pages"),
        F.when(F.col("_fresh"), None).otherwise(F.coalesce(F.length(body), "characters")).alias("characters"), F.when(is_pdf & ~F.col("_fresh"), F.col("textless")).alias("textless"), reason.alias("error"), document.alias("document"),
    )


def pruned(outputs: DataFrame, status: DataFrame) -> DataFrame:
    """Names of Markdown outputs no input claims; a failed input still claims its output."""
    return ingest.orphans(outputs.where("name LIKE '%.md'").select("name"), status.select(F.col("output").alias("name")), "name")


def ingest_outcome(status: DataFrame, optional: bool = False) -> tuple[bool, str, DataFrame]:
    """(ok, summary, failures): any failed file fails the step, unless it is optional and one file succeeded.

    No input at all is a failure, too, unless the step is optional.
    """
    counts = status.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed")).first()
    n, failed = counts["n"], counts["failed"]
    failures = status.where("status = 'failed'").select("path", "error")
    if n == 0:
        return optional, "no source documents found", failures
    if not failed:
        return True, f"{n} document(s) ready", failures
    if optional and failed < n:
        return True, f"{n - failed} document(s) ready, {failed} skipped", failures
    return False, f"{failed} of {n} document(s) failed to extract", failures
