"""Ordered operators: interleaving, budgets, exclusion and keep lists.

Ranks are computed per partition key wherever the semantics allow it; a global order
appears only where a cap over everything is the feature, and then on keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interleaved(hits: DataFrame, backend: str, relevance: list[Column], weight: Column, partition: list[str] | None = None) -> DataFrame:
    """``hits`` with ``backend_rank`` (place within its backend) and ``weight_order``.

    Sorting by (backend_rank, weight descending, backend) gives the interleaved list:
    first every backend's best hit, the weightiest first, then every second one.
    """
    own = Window.partitionBy(*(partition or []), backend).orderBy(*relevance)
    return hits.withColumn("backend_rank", F.row_number().over(own)).withColumn("weight_order", -F.coalesce(weight, F.lit(0)))


def round_robin(ranked: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``ranked`` with ``turn``: its place within its group; sort by (turn, group) to take turns."""
    return ranked.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def capped(rows: DataFrame, order: list[str | Column], cap: int) -> DataFrame:
    """The first ``cap`` rows: a distributed top-k (sort and limit), never a global window."""
    return rows.orderBy(*order).limit(cap)


def flagged_within(rows: DataFrame, order: list[str | Column], cap: int, unique: str) -> DataFrame:
    """All rows with ``kept``: whether they are among the first ``cap``; both branches stay."""
    kept = rows.orderBy(*order).limit(cap).select(unique, F.lit(True).alias("kept"))
    return rows.join(kept, unique, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def exclude_any_key(rows: DataFrame, unique: str, keys: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows none of whose array of ``keys`` occurs in ``known``."""
    hit = rows.select(unique, F.explode(keys).alias(known_key)).join(known.select(known_key).distinct(), known_key, "left_semi").select(unique).distinct()
    return rows.join(hit, unique, "left_anti")


def keep_list(rows: DataFrame, unique: str, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``kept``, ids of ``keep`` that no row has): a non-empty second table refuses the list."""
    wanted = keep.select(unique).distinct()
    return (
        rows.join(wanted.withColumn("kept", F.lit(True)), unique, "left").withColumn("kept", F.coalesce("kept", F.lit(False))),
        wanted.join(rows.select(unique).distinct(), unique, "left_anti"),
    )


def colliding(rows: DataFrame, unique: str) -> DataFrame:
    """Ids borne by more than one row, and by how many."""
    return rows.groupBy(unique).agg(F.count("*").alias("n")).where("n > 1")


def latest_by_precedence(rows: DataFrame, key: str, precedence: list[Column]) -> DataFrame:
    """One row per key, that of highest precedence."""
    w = Window.partitionBy(key).orderBy(*precedence)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def unique_names(rows: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Names made unique in ``order`` with suffixes -2, -3 ... that no other row already bears.

    Rows of one stem (the name without a number at its end) are numbered together, one
    group at a time, as a suffix may collide with a name that ends in a number itself.
    """
    schema = rows.withColumn(out, F.lit("")).schema
    keyed = rows.withColumn("_stem", F.regexp_replace(name, r"(-\d+)+$", ""))

    def number(pdf):
        pdf = pdf.sort_values(order, kind="stable").drop(columns="_stem")
        used: set[str] = set()
        next_free: dict[str, int] = {}
        names = []
        for wanted in pdf[name]:
            got, k = wanted, next_free.get(wanted, 2)
            while got in used:
                got, k = f"{wanted}-{k}", k + 1
            if got != wanted:
                next_free[wanted] = k
            used.add(got)
            names.append(got)
        pdf[out] = names
        return pdf

    return keyed.groupBy("_stem").applyInPandas(number, schema)


def nearest_names(unknown: DataFrame, known: DataFrame, name: str = "name", top: int = 3) -> DataFrame:
    """(name, suggestion, distance): the closest known names within a third of the length, two at least.

    ``known`` is a list of names people choose from; it is broadcast only if Spark's
    size threshold allows, the pairs are cut to near lengths before the edit distance.
    """
    a, b = unknown.select(F.col(name), F.lower(name).alias("_a")).distinct(), known.select(F.col(name).alias("suggestion"), F.lower(name).alias("_b")).distinct()
    limit = F.greatest(F.lit(2), F.floor(F.length("_a") / 3))
    a = a.withColumn("_len", F.explode(F.sequence((F.length("_a") - limit).cast("int"), (F.length("_a") + limit).cast("int"))))
    met = a.join(b, F.col("_len") == F.length("_b")).withColumn("distance", F.levenshtein("_a", "_b")).where(F.col("distance") <= limit)
    w = Window.partitionBy(name).orderBy("distance", "suggestion")
    return met.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= top).select(name, "suggestion", "distance")
