"""Records of one work folded into one, keeping the richest value of each field.

Identity is a relation: records that share any key (arXiv id, DOI, title with first
surname) belong together, directly or through others.  Groups are labelled by minimum
propagation over record-key pairs with pointer jumping; the fold is a position-ordered
aggregation, so the result doesn't depend on the order of processing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids, text
from paperloom.skew import hot_values, split_join
from paperloom.storage import Scratch


#: Columns of which the first known value is kept, and array columns that are united.
FIRST_KNOWN = ("year", "venue", "doi", "arxivid", "s2_id", "openalex_id", "pdf_url")
UNITED = ("tags", "backends", "queries", "points")


def record_keys(title: Column, first_author: Column, doi: Column, arxiv: Column) -> Column:
    """Keys a record is known by; an arXiv-wrapping DOI counts as the arXiv id."""
    wrapped = ids.arxiv_id(doi)
    arxiv = F.coalesce(F.lower(text.or_null(arxiv)), wrapped)
    surname = text.title_key(text.last_name(F.coalesce(first_author, F.lit(""))))
    bare = text.title_key(title)
    return F.array_compact(F.array(
        F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("doi:"), ids.doi(doi)),
        F.when(F.length(bare) > 0, F.concat(F.lit("title:"), bare, F.lit("|"), surname)),
    ))


def group_labels(keyed: DataFrame) -> DataFrame:
    """(pos, root) for ``keyed`` (pos, key): the smallest position reachable over shared keys."""
    scratch = Scratch(keyed.sparkSession, "resolve")
    links = scratch.save(keyed.where("pos IS NOT NULL AND key IS NOT NULL").distinct())
    hot = scratch.save(hot_values(links, "key", links.count()))
    hot = hot if hot.limit(1).count() else None
    labels = scratch.save(links.select("pos", F.col("pos").alias("root")).distinct())
    while True:
        low = links.join(labels, "pos").groupBy("key").agg(F.min("root").alias("low"))
        heard = split_join(links, low, "key", hot).groupBy("pos").agg(F.min("low").alias("low"))
        met = labels.join(heard, "pos")
        hooks = met.where("low < root").select(F.col("root").alias("pos"), "low")
        best = heard.unionByName(hooks).groupBy("pos").agg(F.min("low").alias("low"))
        jump = best.select(F.col("pos").alias("low"), F.col("low").alias("far"))
        step = labels.join(best, "pos").join(jump, "low", "left").select("pos", F.least("root", "low", F.coalesce("far", "low")).alias("next"), "root")
        fresh = scratch.save(step.select("pos", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
        scratch.drop(labels)
        if not fresh.where("moved").limit(1).count():
            return fresh.select("pos", "root")
        labels = fresh.select("pos", "root")
        labels._scratch_path = fresh._scratch_path


def folded(records: DataFrame) -> DataFrame:
    """One record per root of ``records`` (root, pos, title, authors, abstract, citations and any of the columns below).

    Longest title, author list and abstract, the earlier on ties; first known value of
    ``FIRST_KNOWN``; most citations; unions of ``UNITED`` in order of position.
    """

    def longest(name: str, size: Column) -> Column:
        return F.max_by(name, F.struct(F.coalesce(size, F.lit(-1)), -F.col("pos"))).alias(name)

    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("pos"))).alias(name)

    def united(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(name, F.array().cast("array<string>")).alias("t"))))
        return F.filter(F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["t"]))), lambda t: t.isNotNull()).alias(name)

    there = set(records.columns)
    return records.groupBy("root").agg(
        F.count("*").alias("n_records"), longest("title", F.length("title")), longest("authors", F.size("authors")), longest("abstract", F.length("abstract")),
        *[first_known(c) for c in FIRST_KNOWN if c in there], F.max("citations").alias("citations"), *[united(c) for c in UNITED if c in there],
    )


def resolved(records: DataFrame) -> DataFrame:
    """``records`` folded to one per work; a record without any key is a work of its own."""
    first = F.get("authors", F.lit(0))
    keyed = records.select("pos", F.explode(record_keys(F.col("title"), first, F.col("doi"), F.col("arxivid"))).alias("key"))
    labelled = records.join(group_labels(keyed), "pos", "left").withColumn("root", F.coalesce("root", "pos"))
    return folded(labelled)


def candidate_name(first_author: Column, year: Column, title: Column) -> Column:
    """Surname, year and first four words of the title as a file name."""
    words = F.array_join(F.slice(F.split(text.collapse(title), " "), 1, 4), " ")
    parts = F.concat_ws(" ", F.nullif(text.last_name(F.coalesce(first_author, F.lit(""))), F.lit("")), year.cast("string"), F.nullif(words, F.lit("")))
    return F.coalesce(F.nullif(text.slug(F.concat(parts, F.lit(""))), F.lit("item")), F.lit("paper"))
