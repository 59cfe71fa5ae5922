"""Best representative of each duplicate group, field by field (problem 5).

Every row offers one value per field.  Equal values of a group are merged first
(map-side combined, so a group of any size shrinks before the shuffle), then ranked
by completeness, trust and recency with a deterministic tie-break: a window orders
the values of each (group, field, salt) and a second one the winners of the salts,
so that no group, however large, is ordered in one task.

* abstract: the longest content (letters, markup and stock sentences aside) any row
  shows is the complete one; it survives if some row holds it undamaged.
* openaccesspdf: whole file url with a status.
* citationcount: latest credible count (negatives and sentinels are not credible; a
  zero only where no row has more).
* venue: the longest spelling that is capitalised and no abbreviation of another venue
  of the corpus.

What publishers and web pages add to a text is learnt from the corpus, not listed: a
sentence in the abstracts of ``STOCK_PAPERS`` papers or more is a stock sentence
("All rights reserved.", "No abstract."), which is no content.  Sentinels are counts
beyond a gap of ``SENTINEL_GAP`` powers of two in which no paper has its count.

Defined results: rows without paperid are ignored; a field without a usable value
has no survivor; equal values are represented by the smallest hit_id; repeated rows
count as rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.storage import Scratch

#: Parts a group's values are spread over while they are ordered.
SALTS = 32
#: Papers whose abstracts share a sentence from which on it is a stock sentence.
STOCK_PAPERS = 5
#: Empty powers of two that part sentinels from counts.
SENTINEL_GAP = 5
#: Characters that don't count as content.
IGNORED = " \t\r\n.,;:!?()[]{}<>'\"-–—…“”‘’/\\&*_ "
_CUT_MARK = r"\s*(\[truncated\]|…|\.\.\.)\s*$"


def abstract_clean(text: Column) -> Column:
    """Whether a text shows no damage: whole sentences, no markup, no replacement characters."""
    damaged = text.rlike("\ufffd") | text.rlike(r"</?[A-Za-z][^<>]*>|&[a-z]+;")
    whole = text.rlike(r"^\s*[\"'“‘(\[]?[\p{Lu}\p{N}]") & text.rlike(r"[.!?][\"'”’)\]]?\s*$") & ~text.rlike(_CUT_MARK)
    return ~damaged & whole & ~text.rlike(r"[a-z)][.!?]\s+\p{Ll}")


def _content_size(text: Column) -> Column:
    return F.length(F.translate(text, IGNORED, ""))


def _sentences(text: Column) -> Column:
    """(hash, content size) of the sentences of a text, markup being a border, too."""
    parts = F.split(F.regexp_replace(text, _CUT_MARK, ""), r"(?<=[.!?])\s+|</?[A-Za-z][^<>]*>|\n")
    return F.filter(F.transform(parts, lambda x: F.struct(F.xxhash64(F.lower(F.trim(x))).alias("hash"), _content_size(x).alias("size"))), lambda x: x["size"] > 0)


def coded(papers: DataFrame) -> DataFrame:
    """The values of each hit without their texts, which are read once."""
    abstract, pdf = F.col("abstract"), F.col("openaccesspdf")
    return papers.where("paperid IS NOT NULL").select(
        "paperid", "hit_id", "retrieved_at", F.sha2("abstract", 256).alias("abstract_value"), _sentences(abstract).alias("sentences"), abstract_clean(abstract).alias("clean"),
        F.coalesce(pdf["url"].rlike(r"(?i)^https?://[^/\s]+\.[^/\s]+/\S+\.pdf$") & pdf["status"].rlike(r"\S"), F.lit(False)).alias("whole_url"), F.sha2(F.to_json(pdf), 256).alias("pdf_value"),
        "citationcount", "venue",
    )


def stock_sizes(coded: DataFrame, scratch: Scratch, papers: int = STOCK_PAPERS) -> DataFrame:
    """(value, stock): how much of each abstract is stock sentences, of those that have any."""
    shown = coded.select("paperid", F.col("abstract_value").alias("value"), F.explode("sentences").alias("s")).select("paperid", "value", "s.hash", "s.size")
    stock = shown.select("hash", "paperid").distinct().groupBy("hash").count().where(F.col("count") >= papers).select("hash")
    # a stored table has a known size: Spark broadcasts it if it is small and merges otherwise
    found = shown.join(scratch.save(stock), "hash", "left_semi").groupBy("value", "paperid").agg(F.sum("size").alias("stock"), F.count("*").alias("n"))
    # copies of one value under one paper are the same text: its share counts once
    copies = coded.groupBy(F.col("abstract_value").alias("value"), "paperid").agg(F.count("*").alias("rows"))
    return found.join(copies, ["value", "paperid"]).groupBy("value").agg(F.max(F.expr("stock div rows")).alias("stock"))


def credible_below(coded: DataFrame, gap: int = SENTINEL_GAP) -> int:
    """The smallest count that is a sentinel; one row per power of two, 63 at most, comes to the driver."""
    rows = coded.where("citationcount > 0").select(F.floor(F.log2("citationcount") + 1e-9).cast("int").alias("octave")).distinct().collect()
    octaves = sorted(r["octave"] for r in rows)
    for low, high in zip(octaves, octaves[1:], strict=False):
        if high - low > gap:
            return 2 ** (low + 1)
    return 2**63 - 1


def _offers(coded: DataFrame, too_much: int) -> DataFrame:
    """One row per hit and field: usable, the ranks and a hash that stands for the value."""
    venue, count = F.col("venue"), F.col("citationcount")
    has_text = F.size("sentences") > 0
    named = venue.rlike(r"^\s*\p{Lu}")
    size = F.aggregate("sentences", F.lit(0), lambda n, s: n + s["size"])
    zero = F.lit(0)

    def offer(name: str, shown: Column, usable: Column, size: Column, trust: Column, value: Column, text: Column) -> Column:
        ok = F.coalesce(usable, F.lit(False))
        return F.struct(
            F.lit(name).alias("field_name"), F.coalesce(shown, F.lit(False)).alias("shown"), ok.alias("usable"),
            F.coalesce(F.when(shown, size), zero).alias("size"), F.when(ok, trust).otherwise(zero).alias("trust"),
            F.when(F.coalesce(shown, F.lit(False)), value).alias("value"), F.when(ok, text).alias("text"),
        )

    nothing = F.lit(None).cast("string")
    credible = (count >= 0) & (count < too_much)
    fields = F.array(
        offer("abstract", has_text, has_text & F.col("clean"), size, F.lit(1), F.col("abstract_value"), nothing),
        offer("openaccesspdf", F.col("whole_url"), F.col("whole_url"), zero, F.lit(1), F.col("pdf_value"), nothing),
        offer("citationcount", credible, credible, zero, (count > 0).cast("int"), count.cast("string"), nothing),
        offer("venue", named, named & ~venue.rlike(r"\.(\s|$)"), _content_size(venue), F.lit(1), F.sha2(venue, 256), venue),
    )
    return coded.select("paperid", "hit_id", "retrieved_at", F.explode(fields).alias("f")).select("paperid", "hit_id", "retrieved_at", "f.*")


def abbreviated_venues(papers: DataFrame) -> DataFrame:
    """Venue spellings whose every word shortens the word at its place in another venue."""
    names = papers.select("venue").where("venue IS NOT NULL").distinct()
    words = F.filter(F.split(F.regexp_replace(F.lower("venue"), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (F.length(w) > 0) & ~w.isin("of", "the", "on", "in", "and", "for", "a"))
    names = names.withColumn("words", words).withColumn("sign", F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), ""))
    names = names.withColumn("phrase", F.array_join("words", " ")).where("length(sign) > 0")
    pattern = F.concat(F.lit("^"), F.array_join(F.transform("words", lambda w: F.regexp_replace(w, r"(.)", r"$1[^ ]*")), " "), F.lit("$"))
    short = names.select(F.col("venue").alias("short"), "sign", F.length("phrase").alias("short_size"), pattern.alias("pattern"))
    pairs = short.join(names.select("sign", "phrase"), "sign").where((F.length("phrase") > F.col("short_size")) & F.expr("phrase RLIKE pattern"))
    return pairs.select(F.col("short").alias("text")).distinct()


def best_values(papers: DataFrame) -> DataFrame:
    """(paperid, field_name, hit_id, n_rows) of the surviving value of each group and field."""
    scratch = Scratch(papers.sparkSession, "survivors")
    rows = scratch.save(coded(papers))
    value = ["paperid", "field_name", "value", "shown", "usable", "size", "trust", "text"]
    merged = _offers(rows, credible_below(rows)).groupBy(*value).agg(F.min("hit_id").alias("hit_id"), F.max("retrieved_at").alias("seen"), F.count("*").alias("n"))
    # stock sentences are no content, and a text with some isn't undamaged
    stock = stock_sizes(rows, scratch).withColumn("field_name", F.lit("abstract"))
    merged = merged.join(stock, ["field_name", "value"], "left").withColumn("size", F.col("size") - F.coalesce("stock", F.lit(0)))
    merged = merged.withColumn("shown", F.expr("shown AND (stock IS NULL OR size > 0)")).withColumn("usable", F.expr("usable AND stock IS NULL"))
    # the largest content comes first, undamaged before damaged, then trust, recency and the value itself
    order = [F.desc("shown"), F.desc("size"), F.desc("usable"), F.desc("trust"), F.desc("seen"), F.asc("hit_id")]
    group = ["paperid", "field_name"]
    merged = merged.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))

    def top(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys)
        ranked = rows.withColumn("n", F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order)))
        return ranked.where("place = 1").drop("place")

    best = top(top(merged, [*group, "salt"]), group).where("usable")
    kept = best.join(abbreviated_venues(papers), "text", "left_anti")
    return kept.select("paperid", "field_name", "hit_id", F.col("n").alias("n_rows"))


def survivors(papers: DataFrame) -> DataFrame:
    """One built record per paperid: each field from the row that holds its best value."""
    best = best_values(papers)
    values = papers.select("hit_id", "abstract", "openaccesspdf", "citationcount", "venue")
    joined = best.join(values, "hit_id")

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("field_name") == name, F.col(name))).alias(name)

    built = joined.groupBy("paperid").agg(F.max("n_rows").alias("n_rows"), *[pick(n) for n in ("abstract", "openaccesspdf", "citationcount", "venue")])
    return papers.where("paperid IS NOT NULL").select("paperid").distinct().join(built, "paperid", "left")
