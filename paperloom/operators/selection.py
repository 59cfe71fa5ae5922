"""Keep lists: a reviewer's choice among the entries of a list, refused as a whole if anything about it is unclear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text


class KeepError(ValueError):
    """A choice that can't be applied; the message says why."""


def entry_id(value: Column) -> Column:
    """Trimmed id of a JSON entry, null unless it is a non-blank string of an object."""
    kind = F.schema_of_variant(F.try_variant_get(value, "$.id", "variant"))
    return F.when(kind == "STRING", text.or_null(F.try_variant_get(value, "$.id", "string")))


def label(value: Column) -> Column:
    """What an entry is shown as: the first of title, name and summary that isn't blank."""
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", text.or_null(F.try_variant_get(value, f"$.{k}", "string"))) for k in ("title", "name", "summary")])


def entries(document: DataFrame, body: str, path: str | None = None) -> DataFrame:
    """(place, entry, id, label) of the array at a dotted ``path`` of JSON documents; no array gives no rows."""
    at = "$" + "".join(f"['{k}']" for k in (path or "").split(".") if k)
    array = F.expr(f"try_variant_get(try_parse_json({body}), \"{at}\", 'array<variant>')")
    rows = document.select(F.posexplode(array).alias("place", "entry"))
    return rows.withColumn("id", entry_id(F.col("entry"))).withColumn("label", label(F.col("entry")))


def selectable(document: DataFrame, body: str, path: str | None = None) -> DataFrame:
    """(place, id, label) of the entries that can be chosen by id."""
    return entries(document, body, path).where("id IS NOT NULL").select("place", "id", "label")


def refusals(listed: DataFrame, keep: DataFrame) -> DataFrame:
    """(rule, detail) of everything that speaks against a choice ``keep`` (id) among ``listed`` (place, id).

    anonymous: entries without an id; colliding: ids alike once slugged; unknown: chosen
    ids no entry has; empty: nothing would be kept.  No row: the choice holds.
    """
    keyed = listed.where("id IS NOT NULL").withColumn("key", text.slug(F.trim("id")))
    wanted = keep.where(text.or_null(F.col("id")).isNotNull()).select(F.col("id"), text.slug(F.trim("id")).alias("key"))
    anonymous = listed.where("id IS NULL").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("anonymous").alias("rule"), F.col("n").cast("string").alias("detail"))
    colliding = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select(F.lit("colliding").alias("rule"), F.col("key").alias("detail"))
    unknown = wanted.join(keyed.select("key"), "key", "left_anti").select(F.lit("unknown").alias("rule"), F.col("id").alias("detail"))
    known = wanted.join(keyed.select("key"), "key", "left_semi").agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty").alias("rule"), F.lit("nothing would be kept").alias("detail"))
    return anonymous.unionByName(colliding).unionByName(unknown).unionByName(known)


def apply_keep(listed: DataFrame, keep: DataFrame) -> DataFrame:
    """``listed`` (place, id ...) with ``kept``, ids matched as slugs; raises KeepError naming up to ten refusals."""
    told = refusals(listed, keep).limit(10).collect()
    if told:
        raise KeepError("; ".join(f"{r['rule']}: {r['detail']}" for r in told))
    chosen = keep.where(text.or_null(F.col("id")).isNotNull()).select(text.slug(F.trim("id")).alias("_key")).distinct().withColumn("kept", F.lit(True))
    return listed.withColumn("_key", text.slug(F.trim("id"))).join(chosen, "_key", "left").drop("_key").withColumn("kept", F.coalesce("kept", F.lit(False)))


def replaced(body: str, path: str | None, kept: list) -> str:
    """A JSON document with the array at a dotted ``path`` replaced, its siblings untouched (driver side, one small file)."""
    import json

    keys = [k for k in (path or "").split(".") if k]
    document = json.loads(body)
    if not keys:
        return json.dumps(kept, indent=2, ensure_ascii=False) + "\n"
    parent = document
    for key in keys[:-1]:
        parent = parent.get(key) if isinstance(parent, dict) else None
    if not isinstance(parent, dict) or not isinstance(parent.get(keys[-1]), list):
        raise KeepError(f"no JSON array at path {path!r}")
    parent[keys[-1]] = kept
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"
