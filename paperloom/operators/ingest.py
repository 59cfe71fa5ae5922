"""Documents to pages and back: scan detection, freshness, orphans, assembly, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.storage import Scratch

#: A page under so many characters has no text; a document with a larger share of such pages is a scan.
TEXTLESS_CHARS = 100
MOSTLY_SCANNED = 0.5
#: Smallest PDF taken for a file, and how PDFs begin.
MIN_PDF_BYTES = 1024
PDF_MAGIC = "%PDF-"


def pages_of(body: Column, size: int) -> Column:
    """A text cut into pages of ``size`` characters; an empty text has no page."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(body) / size) - 1).cast("int")), lambda i: F.substring(body, i * size + 1, F.lit(size)))


def page_stats(documents: DataFrame, pages: str) -> DataFrame:
    """``documents`` with n_pages, characters, textless (page numbers) and status.

    scanned: no page or every page textless; mostly_scanned: more than half of them;
    both fail.  Higher-order functions over the row's own array: no shuffle.
    """
    p = F.col(pages)
    numbered = F.transform(p, lambda x, i: F.when(F.length(text.strip(x)) < TEXTLESS_CHARS, i + 1))
    out = documents.withColumn("n_pages", F.size(p)).withColumn("characters", F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x))).withColumn("textless", F.array_compact(numbered))
    bare = F.size("textless")
    status = F.when((F.col("n_pages") == 0) | (bare == F.col("n_pages")), "scanned").when(bare > MOSTLY_SCANNED * F.col("n_pages"), "mostly_scanned").otherwise("extracted")
    return out.withColumn("status", status)


def rendered(source: Column, pages: Column, textless: Column) -> Column:
    """A document with front matter and numbered pages as one text."""
    listed = F.when(F.size(textless) > 0, F.concat(F.lit("textless_pages: ["), F.array_join(textless.cast("array<string>"), ", "), F.lit("]\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("---\nsource: "), text.json_string(source), F.lit("\npages: "), F.size(pages).cast("string"), F.lit("\n"), listed, F.lit("---\n"))
    body = F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("<!-- page "), (i + 1).cast("string"), F.lit(" -->\n\n"), text.strip(p))), "\n\n")
    return F.concat(head, body, F.lit("\n"))


def passed_through(source: Column, body: Column) -> Column:
    """A text document verbatim behind the front matter of a single page."""
    return F.concat(F.lit("---\nsource: "), text.json_string(source), F.lit("\npages: 1\n---\n"), body, F.lit("\n"))


def fresh(sources: DataFrame, outputs: DataFrame, key: str, changed: str, written: str) -> DataFrame:
    """(key, n_outputs, fresh): whether there are outputs and none is older than its source."""
    joined = sources.select(key, changed).join(outputs.select(key, written), key, "left")
    return joined.groupBy(key).agg(F.count(written).alias("n_outputs"), F.coalesce(F.bool_and(F.col(written) >= F.col(changed)), F.lit(False)).alias("fresh"))


def orphans(outputs: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Outputs no source claims."""
    return outputs.join(expected.select(key), key, "left_anti")


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items a resumed run still has to do."""
    return items.join(done.select(key), key, "left_anti")


def assembled(sections: DataFrame, drafts: DataFrame, group: str, position: str, key: str, body: str = "text") -> DataFrame:
    """(group, n_sections, n_missing, document): drafts in section order, a marker where one is missing."""
    gap = F.concat(F.lit("## "), F.col("title"), F.lit("\n\nSECTION MISSING: "), F.col(key).cast("string"), F.lit(" was not drafted."))
    parts = sections.join(drafts.select(key, text.strip(F.col(body)).alias("_draft")), key, "left")
    ordered = F.array_sort(F.collect_list(F.struct(position, F.coalesce("_draft", gap).alias("part"))))
    return parts.groupBy(group).agg(F.count("*").alias("n_sections"), F.count_if(F.col("_draft").isNull()).alias("n_missing"), F.array_join(F.transform(ordered, lambda s: s["part"]), "\n\n").alias("document"))


def is_pdf(content: Column) -> Column:
    return (F.length(content) >= MIN_PDF_BYTES) & (F.substring(content, 1, len(PDF_MAGIC)) == F.encode(F.lit(PDF_MAGIC), "ISO-8859-1"))


def fetch_status(pdf_bytes: Column, abstract: Column, tried: Column) -> Column:
    """downloaded, abstract-only, failed, or null where nothing was tried yet."""
    return F.when(pdf_bytes >= MIN_PDF_BYTES, "downloaded").when(text.or_null(abstract).isNotNull(), "abstract-only").when(tried, "failed")


def manifest_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two manifests (key, status, points): the new status wins, points are united in order."""
    points = F.array_distinct(F.concat(F.coalesce("o.points", F.array().cast("array<string>")), F.coalesce("n.points", F.array().cast("array<string>"))))
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), F.coalesce("n.status", "o.status").alias("status"), points.alias("points"))


def distinctive(doi: Column, arxiv: Column) -> Column:
    """Identifiers long enough that finding one on a page identifies the paper, squashed."""
    bare = F.regexp_replace(doi, r"(?i)^https?://(dx\.)?doi\.org/", "")
    squashed = [F.lower(F.regexp_replace(x, rf"{text.SPACE}+", "")) for x in (bare, F.concat(F.lit("arXiv:"), text.or_null(arxiv)))]
    return F.filter(F.array(*squashed), lambda x: F.length(x) >= HEAD)


#: Characters of an identifier by which files and papers meet; a shorter identifier tells nothing.
HEAD = 10


def adopted(files: DataFrame, papers: DataFrame, first_page: str = "first_page", identifier: str = "identifier") -> DataFrame:
    """(file, paper) of files whose first page names exactly one paper nobody claimed yet.

    Files claim in order of their names; a claimed paper leaves the pool, so a later file
    that names it and one other paper gets the other.  Pages are squashed and met by the
    first characters of each possible identifier; only files that share papers wait for
    one another, and each round decides every file that comes first for all its papers.
    """
    scratch = Scratch(files.sparkSession, "adopted")
    told = papers.where(F.length(identifier) >= HEAD).select("paper", F.lower(identifier).alias("_id")).withColumn("_head", F.substring("_id", 1, HEAD))
    pages = files.select("file", F.lower(F.regexp_replace(first_page, rf"{text.SPACE}+", "")).alias("_page"))
    heads = F.array_distinct(F.regexp_extract_all("_page", F.lit(r"(?=(10\..{7}|arxiv:.{4}))"), F.lit(1)))
    met = pages.withColumn("_head", F.explode(heads)).join(told, "_head").where(F.contains("_page", F.col("_id")))
    open_pairs = scratch.save(met.select("file", "paper").distinct())
    claimed: list[DataFrame] = []
    while open_pairs.limit(1).count():
        first = open_pairs.groupBy("paper").agg(F.min("file").alias("first"))
        due = open_pairs.join(first, "paper").groupBy("file").agg(F.bool_and(F.col("first") == F.col("file")).alias("due"), F.count("*").alias("n"), F.min("paper").alias("paper")).where("due")
        due = scratch.save(due)
        taken = due.where("n = 1").select("file", "paper")
        claimed.append(taken)
        rest = open_pairs.join(due.select("file"), "file", "left_anti").join(taken.select("paper"), "paper", "left_anti")
        done, open_pairs = open_pairs, scratch.save(rest.select("file", "paper"))
        scratch.drop(done)
    empty = files.sparkSession.createDataFrame([], met.select("file", "paper").schema)
    return reduce(DataFrame.unionByName, claimed, empty)
