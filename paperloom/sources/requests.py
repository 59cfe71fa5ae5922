"""Request addresses of the bibliographic services, built from a query row; nothing is sent.

A column per service, null where a service can't answer the query.  Limits are clamped
to what the service allows; ids beat titles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.sources.adapters import CAPS

#: Addresses and the fields asked of a service.
BASES = {"arxiv": "http://export.arxiv.org/api/query", "semanticscholar": "https://api.semanticscholar.org/graph/v1", "openalex": "https://api.openalex.org"}
S2_FIELDS = "title,abstract,year,venue,authors,externalIds,citationCount,openAccessPdf,paperId"


def component(value: Column) -> Column:
    """Percent-encoding of one part of an address; a blank becomes %20, not a plus."""
    coded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return coded


def _limit(limit: Column, service: str) -> Column:
    return F.least(F.greatest(F.coalesce(limit, F.lit(1)), F.lit(1)), F.lit(CAPS[service])).cast("string")


def arxiv_url(kind: Column, query: Column, arxiv: Column, title: Column, limit: Column, base: str = BASES["arxiv"]) -> Column:
    arxiv, title, words = text.or_null(arxiv), text.or_null(title), text.or_null(F.replace(query, F.lit('"'), F.lit(" ")))
    n = _limit(limit, "arxiv")
    by_id = F.concat(F.lit(f"{base}?id_list="), component(arxiv), F.lit("&max_results=1"))
    by_title = F.concat(F.lit(f"{base}?search_query="), component(F.concat(F.lit('ti:"'), title, F.lit('"'))), F.lit("&max_results="), n)
    by_words = F.concat(F.lit(f"{base}?search_query="), component(F.concat(F.lit("all:"), words)), F.lit("&start=0&max_results="), n, F.lit("&sortBy=relevance"))
    return F.when(kind == "id", F.coalesce(by_id, by_title)).otherwise(by_words)


def semantic_scholar_url(kind: Column, query: Column, doi: Column, arxiv: Column, limit: Column, base: str = BASES["semanticscholar"]) -> Column:
    key = F.coalesce(F.concat(F.lit("DOI:"), component(text.or_null(doi))), F.concat(F.lit("arXiv:"), component(text.or_null(arxiv))))
    by_id = F.concat(F.lit(f"{base}/paper/"), key, F.lit(f"?fields={S2_FIELDS}"))
    by_words = F.concat(F.lit(f"{base}/paper/search?query="), component(text.or_null(query)), F.lit("&limit="), _limit(limit, "semanticscholar"), F.lit(f"&fields={S2_FIELDS}"))
    return F.when(kind == "id", by_id).otherwise(by_words)


def openalex_url(kind: Column, query: Column, doi: Column, title: Column, limit: Column, contact: str = "", base: str = BASES["openalex"]) -> Column:
    mail = F.concat(F.lit("mailto="), component(F.lit(contact))) if contact else F.lit("")
    more = F.concat(F.lit("&"), mail) if contact else F.lit("")
    by_doi = F.concat(F.lit(f"{base}/works/doi:"), component(text.or_null(doi)), F.lit("?"), mail)
    by_title = F.concat(F.lit(f"{base}/works?filter="), component(F.concat(F.lit("title.search:"), text.or_null(title))), F.lit("&per-page=5"), more)
    by_words = F.concat(F.lit(f"{base}/works?search="), component(text.or_null(query)), F.lit("&per-page="), _limit(limit, "openalex"), more)
    return F.when(kind == "id", F.coalesce(by_doi, by_title)).otherwise(by_words)
