"""Identifier normalisation as column expressions (no Python workers).

A citation's identifiers arrive as people type them.  ``work_ids`` reads the DOI
and the arXiv id of a row out of any number of free-text fields, whichever field
holds which, so that two rows naming the same identifier get equal strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace and invisible characters that no identifier contains.
_INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}]+"
#: The resolver prefixes of the two kinds of identifier.
_DOI_PREFIX = r"^(?:https?://)?(?:[\w-]+\.)*doi\.[a-z]+/|^doi[:.]*"
_ARXIV_PREFIX = r"^(?:https?://)?(?:[\w-]+\.)*arxiv\.[a-z]+/(?:abs|pdf)/|^arxiv[:.]*"
#: Registrant and prefix of DOIs that only wrap an arXiv id.
_ARXIV_DOI = r"^10\.48550/arxiv\.(.+)$"
_ARXIV_ID = r"^((?:\d{4}\.\d{4,5})|(?:[a-z-]+(?:\.[a-z]{2})?/\d{7}))(?:v\d+)?(?:\.pdf)?$"


def compact(raw: Column) -> Column:
    """Lower case, without whitespace, invisible characters and closing punctuation."""
    bare = F.regexp_replace(F.lower(raw), _INVISIBLE, "")
    bare = F.regexp_replace(bare, r"%2f", "/")
    return F.regexp_replace(bare, r"^[\"'<(\[]+|[\"'>)\].,;]+$", "")


def _strip(value: Column, pattern: str) -> Column:
    # twice: "doi:https://doi.org/10..." carries two prefixes
    return F.regexp_replace(F.regexp_replace(value, pattern, ""), pattern, "")


def doi_text(raw: Column) -> Column:
    """The DOI in ``raw`` (arXiv-wrapping ones included), or null."""
    bare = _strip(compact(raw), _DOI_PREFIX)
    return F.when(bare.rlike(r"^10\.\d{3,9}(?:\.\d+)*/.+"), bare)


def arxiv_id(raw: Column) -> Column:
    """The arXiv id in ``raw`` without its version, also from a wrapping DOI, or null.

    An id that is all zeros is a placeholder and yields null.
    """
    wrapped = F.regexp_extract(doi_text(raw), _ARXIV_DOI, 1)
    bare = F.when(F.length(wrapped) > 0, wrapped).otherwise(_strip(compact(raw), _ARXIV_PREFIX))
    found = F.regexp_extract(bare, _ARXIV_ID, 1)
    return F.when((F.length(found) > 0) & ~found.rlike(r"^[0./]+$"), found)


def doi(raw: Column) -> Column:
    """The DOI in ``raw`` unless it only wraps an arXiv id, or null."""
    text = doi_text(raw)
    return F.when(~text.rlike(_ARXIV_DOI), text)


def work_ids(*fields: Column) -> tuple[Column, Column]:
    """(doi, arxiv id) of a row, each taken from the first field that holds one."""
    return F.coalesce(*[doi(f) for f in fields]), F.coalesce(*[arxiv_id(f) for f in fields])


def card_name(raw: Column) -> Column:
    """Card name without path, extension, case and surrounding whitespace; blank gives null."""
    bare = F.regexp_replace(F.lower(raw), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^.*[/\\]", ""), r"\.(md|markdown|txt|tex|pdf)$", "")
    return F.when((F.length(bare) > 0) & ~bare.isin("unknown", "none", "n/a", "-", "tbd", "pending", "null"), bare)
