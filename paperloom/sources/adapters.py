"""Answers of bibliographic services as paper records: pure projections over a payload column.

Output columns: title, authors, year, venue, abstract, doi, arxivid, source_id,
citations, pdf_url, backend.  A paper without a title is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids, text

#: Papers a request may ask of each service at most; answers are read whole.
CAPS = {"arxiv": 100, "semanticscholar": 100, "openalex": 200}
S2_SCHEMA = (
    "struct<data: array<struct<paperId: string, title: string, abstract: string, year: int, venue: string, citationCount: bigint, "
    "openAccessPdf: struct<url: string, status: string>, externalIds: map<string, string>, authors: array<struct<authorId: string, name: string>>>>>"
)
OPENALEX_SCHEMA = (
    "struct<results: array<struct<id: string, doi: string, title: string, display_name: string, publication_year: int, cited_by_count: bigint, "
    "authorships: array<struct<author: struct<id: string, display_name: string>>>, primary_location: struct<source: struct<display_name: string>>, "
    "best_oa_location: struct<pdf_url: string>, abstract_inverted_index: map<string, array<int>>>>>"
)


def _names(names: Column) -> Column:
    return F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), text.strip), lambda n: F.length(n) > 0)


def s2_fields(p) -> list[Column]:
    """Record columns of a Semantic Scholar paper; ``p`` gives a column by its lower-case name."""
    arxiv = text.or_null(F.regexp_replace(p("externalids")["ArXiv"], r"(?i)v\d+$", ""))
    open_pdf = text.or_null(p("openaccesspdf")["url"])
    return [
        text.or_null(p("title")).alias("title"), _names(F.transform(p("authors"), lambda a: a["name"])).alias("authors"), p("year").alias("year"), text.or_null(p("venue")).alias("venue"),
        text.or_null(p("abstract")).alias("abstract"), ids.doi_text(p("externalids")["DOI"]).alias("doi"), arxiv.alias("arxivid"), text.or_null(p("paperid")).alias("source_id"),
        p("citationcount").alias("citations"), F.coalesce(open_pdf, F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)).alias("pdf_url"), F.lit("semanticscholar").alias("backend"),
    ]


def openalex_fields(w) -> list[Column]:
    """Record columns of an OpenAlex work; ``w`` gives a column by its name."""
    return [
        F.coalesce(text.or_null(w("display_name")), text.or_null(w("title"))).alias("title"), _names(F.transform(w("authorships"), lambda a: a["author"]["display_name"])).alias("authors"),
        w("publication_year").alias("year"), text.or_null(w("primary_location")["source"]["display_name"]).alias("venue"), text.rebuilt_text(w("abstract_inverted_index")).alias("abstract"),
        ids.doi_text(w("doi")).alias("doi"), F.lit(None).cast("string").alias("arxivid"), text.or_null(w("id")).alias("source_id"), w("cited_by_count").alias("citations"),
        text.or_null(w("best_oa_location")["pdf_url"]).alias("pdf_url"), F.lit("openalex").alias("backend"),
    ]


def semantic_scholar(payloads: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    """Papers of search answers ``{data: [...]}``."""
    papers = payloads.select(*keep, F.posexplode(F.from_json(body, S2_SCHEMA)["data"]).alias("rank", "p"))
    names = {"externalids": "externalIds", "openaccesspdf": "openAccessPdf", "paperid": "paperId", "citationcount": "citationCount"}
    return papers.select(*keep, "rank", *s2_fields(lambda n: F.col("p")[names.get(n, n)])).where("title IS NOT NULL")


def openalex(payloads: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    """Papers of answers ``{results: [...]}``; a single work is taken as a list of one."""
    many = F.from_json(body, OPENALEX_SCHEMA)["results"]
    one = F.array(F.from_json(body, OPENALEX_SCHEMA[len("struct<results: array<") : -2]))
    papers = payloads.select(*keep, F.posexplode(F.coalesce(many, one)).alias("rank", "w"))
    return papers.select(*keep, "rank", *openalex_fields(lambda n: F.col("w")[n])).where("title IS NOT NULL")


def arxiv(payloads: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    """Papers of an Atom feed; the entry titled "Error" is none, versions are dropped."""
    entries = F.regexp_extract_all(body, F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))
    rows = payloads.select(*keep, F.posexplode(entries).alias("rank", "e"))

    def field(name: str) -> Column:
        return text.or_null(text.collapse(text.decode_entities(text.tag_text(F.col("e"), name))))

    people = F.regexp_extract_all("e", F.lit(r"(?s)<author\b[^>]*>.*?<name\b[^>]*>(.*?)</name>.*?</author>"), F.lit(1))
    joined = text.decode_entities(F.array_join(people, "\u0001"))
    arxiv_id = F.regexp_extract(field("id"), r"(?i)arxiv\.org/abs/(.+?)(?:v\d+)?$", 1)
    out = rows.select(
        *keep, "rank", field("title").alias("title"), _names(F.transform(F.split(joined, "\u0001"), text.collapse)).alias("authors"), text.year_of(field("published")).alias("year"),
        F.coalesce(field("arxiv:journal_ref"), F.lit("arXiv")).alias("venue"), field("summary").alias("abstract"), ids.doi_text(field("arxiv:doi")).alias("doi"), F.nullif(arxiv_id, F.lit("")).alias("arxivid"),
        F.nullif(arxiv_id, F.lit("")).alias("source_id"), F.lit(None).cast("bigint").alias("citations"), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id).alias("pdf_url"), F.lit("arxiv").alias("backend"),
    )
    return out.where("title IS NOT NULL AND arxivid IS NOT NULL AND lower(title) <> 'error'")
