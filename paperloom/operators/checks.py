"""Checks over cards, sources and manuscripts: citations, markers, indexes, evidence, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text
from paperloom.storage import Scratch


def cited(manuscript: DataFrame, body: str = "text") -> DataFrame:
    """(raw, surname, year): each distinct citation of the manuscript's rows."""
    raw = manuscript.select(F.explode(text.citations(F.col(body))).alias("raw")).distinct()
    return raw.select("raw", F.lower(text.lead_surname(text.citation_author(F.col("raw")))).alias("surname"), text.citation_year(F.col("raw")).alias("year"))


_WORD = r"[\p{L}\p{N}]+"


def citation_support(citations: DataFrame, sources: DataFrame, position: str, body: str = "text") -> DataFrame:
    """(raw, surname, year, verdict, found_in) of each citation against ``sources``.

    supported: a source names surname and year; year-mismatch: one names the surname;
    else unsupported.  found_in is the first such source by ``position``.  Sources are
    tokenised once and met by the words that are cited: a surname of one word and a year
    are proven by the word itself, so no text moves; only surnames of several words are
    looked up in the texts that hold their first one.
    """
    scratch = Scratch(citations.sparkSession, "citations")
    keyed = scratch.save(citations.where("surname <> ''").select("surname", "year").distinct().withColumn("_head", F.regexp_extract("surname", _WORD, 0)).withColumn("_plain", F.col("surname").rlike(f"^{_WORD}$")))
    lowered = sources.select(F.col(position).alias("found_in"), F.lower(body).alias("_body"))
    wanted = keyed.select(F.col("_head").alias("_word")).union(keyed.select("year")).distinct()
    tokens = F.explode(F.array_distinct(F.regexp_extract_all("_body", F.lit(_WORD), F.lit(0))))
    # exploded words are many times what the optimizer expects, so they may not be broadcast
    words = scratch.save(lowered.select("found_in", tokens.alias("_word")).hint("merge").join(wanted, "_word").select("found_in", "_word"))
    names = keyed.select("surname", F.col("_head").alias("_word"), "_plain").distinct()
    named = words.join(names, "_word").select("found_in", "surname", "_plain")
    long = named.where("NOT _plain").join(lowered, "found_in").where(F.rlike(F.col("_body"), text.word_pattern(F.col("surname"))))
    met = named.where("_plain").select("found_in", "surname").unionByName(long.select("found_in", "surname"))
    dated = met.join(keyed.select("surname", "year"), "surname").join(words.select("found_in", F.col("_word").alias("year"), F.lit(False).alias("_late")), ["found_in", "year"], "left")
    best = dated.groupBy("surname", "year").agg(F.min(F.struct(F.coalesce("_late", F.lit(True)).alias("late"), "found_in")).alias("best"))
    verdict = F.when(F.col("best").isNull(), "unsupported").when(F.col("best.late"), "year-mismatch").otherwise("supported")
    return citations.join(best, ["surname", "year"], "left").select("raw", "surname", "year", verdict.alias("verdict"), F.col("best.found_in").alias("found_in"))


def markers(documents: DataFrame, unique: str, body: str = "text") -> DataFrame:
    """(id, line, kind, note): the first gap marker of each line."""
    lines = documents.select(unique, F.posexplode(F.split(body, "\n")).alias("_no", "_line"))
    found = lines.select(unique, (F.col("_no") + 1).alias("line"), F.regexp_extract("_line", text.MARKER, 1).alias("kind"), text.strip(F.regexp_extract("_line", text.MARKER, 2)).alias("note"))
    return found.where("kind <> ''")


def keyword_index(cards: DataFrame, tags: str, title: str, order: list[Column], examples: int = 8) -> DataFrame:
    """(tag, n_cards, titles, n_more): the cards of each tag, the first ``examples`` by ``order``.

    Ranked within (tag, salt) before the tag's own order, so a tag on a third of all
    cards is never ordered in one task.
    """
    tagged = cards.withColumn("tag", F.explode(tags)).withColumn("_title", F.col(title)).withColumn("_salt", F.pmod(F.xxhash64("_title"), F.lit(32)))
    count = tagged.groupBy("tag").agg(F.count("*").alias("n_cards"))
    for keys in (["tag", "_salt"], ["tag"]):
        tagged = tagged.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= examples)
    shown = tagged.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_title"))), lambda s: s["_title"]).alias("titles"))
    return count.join(shown, "tag").select("tag", "n_cards", "titles", (F.col("n_cards") - F.size("titles")).alias("n_more"))


def followup_groups(mentions: DataFrame) -> DataFrame:
    """Follow-ups grouped by one key: DOI, else arXiv id, else title.

    ``mentions`` (pos, title, authors, year, doi, arxivid, reason, card, points), reason
    and card one value or an array; a card naming a work twice counts twice, lists unite
    all values and keep the order of first mention.
    """
    key = F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("arxiv:"), "arxivid"), F.concat(F.lit("title:"), text.title_key(F.col("title"))))

    def known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("pos"))).alias(name)

    def united(name: str) -> Column:
        values = F.col(name) if isinstance(mentions.schema[name].dataType, T.ArrayType) else F.array(name)
        ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(values, F.array().cast("array<string>")).alias("v"))))
        return F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["v"])))

    def listed(name: str) -> Column:
        return F.filter(united(name), lambda v: v.isNotNull() & (v != "")).alias(f"{name}s")

    # exploded once, so that the identifiers' long expressions aren't repeated in every aggregate
    once = mentions.select(F.explode(F.array(F.struct(*mentions.columns))).alias("m")).select("m.*")
    grouped = once.withColumn("key", key).groupBy("key")
    return grouped.agg(F.count("*").alias("mentions"), F.min_by("title", "pos").alias("title"), *[known(c) for c in ("authors", "year", "doi", "arxivid")], listed("reason"), listed("card"), united("points").alias("points"))


def evidence(points: DataFrame, cards: DataFrame, failures: DataFrame, point: str) -> DataFrame:
    """Per point: cards, full texts, abstracts only, failed downloads.

    ``cards`` (card, points array, level), ``failures`` (points array); a card listing a
    point twice counts twice.  Points nobody asked for are left to ``orphaned``.
    """
    counted = cards.select(F.explode("points").alias(point), "level").groupBy(point).agg(
        F.count("*").alias("n_cards"), F.count_if(F.col("level") != "abstract_only").alias("full_text"), F.count_if(F.col("level") == "abstract_only").alias("abstract_only"))
    failed = failures.select(F.explode("points").alias(point)).groupBy(point).agg(F.count("*").alias("failed"))
    return points.select(point).join(counted, point, "left").join(failed, point, "left").fillna(0, ["n_cards", "full_text", "abstract_only", "failed"])


def orphaned(points: DataFrame, cards: DataFrame, point: str, card: str) -> DataFrame:
    """(card, point) of cards that name a point which doesn't exist."""
    return cards.select(card, F.explode("points").alias(point)).join(points.select(point), point, "left_anti").select(card, point)
