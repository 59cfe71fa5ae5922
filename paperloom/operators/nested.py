"""Nested JSON responses as related flat tables (problem 4).

A body is parsed once into a VARIANT; nested ``transform`` calls carry the
ancestor's keys and indices down to each child, ``flatten`` joins the arrays and
one ``inline`` emits the rows.  Everything is a projection: no shuffle, no Python.
The method is higher-order SQL projection.

Defined results: a null, empty or unparseable body yields no row; a null, missing
or wrongly typed part yields no child; a lone object stands for an array of one;
word positions are whole numbers from 0 to the largest BIGINT, anything else among them
(also a nested array) is passed over; repeated responses yield their rows once per response row; extra columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _array(value: str, path: str) -> str:
    """SQL for the array at ``path``; a lone object is an array of one, all else null."""
    part = f"variant_get({value}, '{path}', 'variant')"
    return (
        f"CASE WHEN schema_of_variant({part}) LIKE 'ARRAY%' THEN try_cast({part} AS ARRAY<VARIANT>) "
        f"WHEN schema_of_variant({part}) LIKE 'OBJECT%' THEN array({part}) END"
    )


def _string(value: str, path: str) -> str:
    """SQL for the JSON string at ``path``, null where it is blank or no string."""
    part = f"variant_get({value}, '{path}', 'variant')"
    text = f"try_variant_get({value}, '{path}', 'string')"
    return f"CASE WHEN schema_of_variant({part}) = 'STRING' AND {text} RLIKE '[^\\\\s\\\\p{{Z}}]' THEN {text} END"


def _long(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'bigint')"


def _author_rows() -> str:
    key = _string("a", "$.author.id")
    return (
        f"transform({_array('w', '$.authorships')}, (a, j) -> named_struct("
        f"'child', 'author', 'child_no', CAST(j AS BIGINT), 'child_key', {key}, "
        f"'child_name', {_string('a', '$.author.display_name')}))"
    )


def _source_rows() -> str:
    # primary_location may itself come as an array of one
    place = "coalesce(variant_get(w, '$.primary_location[0]', 'variant'), variant_get(w, '$.primary_location', 'variant'))"
    key = _string(place, "$.source.display_name")
    return f"array(named_struct('child', 'source', 'child_no', CAST(0 AS BIGINT), 'child_key', {key}, 'child_name', {key}))"


def _term_rows() -> str:
    index = "variant_get(w, '$.abstract_inverted_index', 'variant')"
    entries = f"map_entries(CASE WHEN schema_of_variant({index}) LIKE 'OBJECT%' THEN try_cast({index} AS MAP<STRING, VARIANT>) END)"
    # whole numbers only; one beyond BIGINT reads as null
    number = "CASE WHEN schema_of_variant(p) RLIKE '^(BIGINT|DECIMAL[(][0-9]+,0[)])$' THEN try_variant_get(p, '$', 'bigint') END"
    spots = f"array_distinct(filter(transform(try_cast(e.value AS ARRAY<VARIANT>), p -> {number}), p -> p >= 0))"
    return (
        f"flatten(transform(filter({entries}, e -> schema_of_variant(e.value) LIKE 'ARRAY%' AND e.key RLIKE '[^\\\\s\\\\p{{Z}}]'), e -> "
        f"transform({spots}, p -> named_struct("
        "'child', 'term', 'child_no', p, 'child_key', e.key, 'child_name', e.key))))"
    )


def _per_work(rows: str) -> str:
    """SQL for the flattened rows of all works of a body; ``rows`` sees work ``w`` at place ``i``.

    The parsed body is bound by a lambda, so it is parsed once however often it is used.
    """
    return f"flatten(transform(filter(array(try_parse_json(body)), v -> v IS NOT NULL), v -> flatten(transform({_array('v', '$.results')}, (w, i) -> {rows}))))"


def _emit(responses: DataFrame, rows: str) -> DataFrame:
    # inline_outer: plain inline lets the optimizer evaluate the whole expression once more in an inferred filter
    return responses.selectExpr("response_id", f"inline_outer({_per_work(rows)})").where("result_no IS NOT NULL")


_EMPTY = "CAST(array() AS ARRAY<STRUCT<child: STRING, child_no: BIGINT, child_key: STRING, child_name: STRING>>)"
_KINDS = {"author": _author_rows, "source": _source_rows, "term": _term_rows}


def child_rows(responses: DataFrame, kinds: tuple[str, ...] = ("author", "source", "term")) -> DataFrame:
    """(response_id, result_no, child, child_no, child_key, child_name) of the chosen kinds."""
    joined = ", ".join(f"coalesce({_KINDS[k]()}, {_EMPTY})" for k in kinds)
    rows = (
        f"transform(filter(concat({joined}), c -> c.child_key IS NOT NULL), "
        "c -> named_struct('result_no', CAST(i AS BIGINT), 'child', c.child, 'child_no', c.child_no, "
        "'child_key', c.child_key, 'child_name', c.child_name))"
    )
    return _emit(responses, rows)


def works(responses: DataFrame) -> DataFrame:
    """One row per work: parent key and its own scalar fields."""
    fields = {
        "work_id": _string("w", "$.id"), "doi": _string("w", "$.doi"), "display_name": _string("w", "$.display_name"),
        "publication_year": _long("w", "$.publication_year"), "cited_by_count": _long("w", "$.cited_by_count"),
        "pdf_url": _string("w", "$.best_oa_location.pdf_url"),
    }
    listed = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    row = f"named_struct('result_no', CAST(i AS BIGINT), 'is_object', schema_of_variant(w) LIKE 'OBJECT%', {listed})"
    return _emit(responses, f"filter(array({row}), r -> r.is_object)").drop("is_object")


def flat_tables(responses: DataFrame) -> dict[str, DataFrame]:
    """The related tables: ``works`` and its children ``authors``, ``sources``, ``terms``.

    Each child row keeps (response_id, result_no), the key of its parent work.
    """
    parent = ["response_id", "result_no"]
    authors = child_rows(responses, ("author",)).select(*parent, F.col("child_no").alias("author_no"), F.col("child_key").alias("author_id"), F.col("child_name").alias("author_name"))
    sources = child_rows(responses, ("source",)).select(*parent, F.col("child_key").alias("source_name"))
    terms = child_rows(responses, ("term",)).select(*parent, F.col("child_no").alias("position"), F.col("child_key").alias("word"))
    return {"works": works(responses), "authors": authors, "sources": sources, "terms": terms}
