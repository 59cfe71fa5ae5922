"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import components, exact_copies, matching, mixing, names, packing, reading, survivors
from paperloom.llm.tokens import token_count
from paperloom.parity import IDS_SQL
from paperloom.storage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.all_names(*[table(spark, sf_dir, t) for t in ("s2_papers", "openalex_works", "followups")])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.labelled_names(table(spark, sf_dir, "s2_papers"), table(spark, sf_dir, "openalex_works"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.spelling_pairs(_names(spark, sf_dir), _labelled(spark, sf_dir))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.attributed(_names(spark, sf_dir), _labelled(spark, sf_dir))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, works = table(spark, sf_dir, "s2_papers"), table(spark, sf_dir, "openalex_works")
    pairs = matching.matches(matching.s2_records(papers), matching.openalex_records(works))
    return pairs.select(F.col("left_id").alias("paperid"), F.col("right_id").alias("openalexid"), "score", "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("paperid", "openalexid")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = components.followup_links(table(spark, sf_dir, "followups"))
    return components.groups(links).select("group_id", F.col("id").alias("followup_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_copies.copies(exact_copies.followup_keys(table(spark, sf_dir, "followups")))
    return rows.where("kept_id <> id").select("kept_id", F.col("id").alias("copy_id"))


def p6_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.representatives(exact_copies.followup_keys(table(spark, sf_dir, "followups")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = survivors.best_values(table(spark, sf_dir, "s2_papers"))
    return best.where("n_rows >= 2").select("paperid", "field_name", "hit_id")


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = survivors.survivors(table(spark, sf_dir, "s2_papers"))
    pdf = F.col("openaccesspdf")
    return built.select("paperid", "n_rows", "abstract", pdf["url"].alias("pdf_url"), pdf["status"].alias("pdf_status"), "citationcount", "venue")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of every text, counted once."""
    sized = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return Scratch(spark, "sizes").save(sized)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_sized(spark, sf_dir), table(spark, sf_dir, "bin_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "bin_sizes")
    return packing.fill_report(packing.containers(_sized(spark, sf_dir), bins), bins)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = F.col("text")
    documents = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source", token_count(text).alias("n_tokens"), F.sha2(text, 256).alias("text_hash"))
    return mixing.mix(documents, table(spark, sf_dir, "mix_targets"))


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(table(spark, sf_dir, "documents"), reading.fit(table(spark, sf_dir, "reading_anchors")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = p9_levels(spark, sf_dir)
    return judged.where("language = 'en' AND n_chars >= 200 AND level IS NOT NULL").select("doc_id", "level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_canonical": p1_canonical,
    "p2_found": p2_found,
    "p2_matches": p2_matches,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p6_found": p6_found,
    "p6_copy_counts": p6_copy_counts,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_draws": p8_draws,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}

ORACLE: dict[str, str] = {
    "p3_found": rf"""
WITH RECURSIVE {IDS_SQL},
cards AS (SELECT followup_id, regexp_replace(regexp_replace(lower(trim(unnest(citedby))), '^.*[/\\]', ''), '\.(md|markdown|txt|tex|pdf)$', '') AS c FROM followups),
links AS (SELECT followup_id AS id, 'd:' || doi AS k FROM ids WHERE doi IS NOT NULL UNION SELECT followup_id, 'a:' || arxivid FROM ids WHERE arxivid IS NOT NULL UNION SELECT followup_id, 'c:' || c FROM cards WHERE c <> ''),
stars AS (SELECT id AS u, min(id) OVER (PARTITION BY k) AS v FROM links), edges AS (SELECT u, v FROM stars WHERE u <> v UNION SELECT v, u FROM stars WHERE u <> v),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u)
SELECT least(u, min(v)) AS group_id, u AS followup_id FROM reach GROUP BY u""",
    "p6_found": rf"""
WITH {IDS_SQL}, keyed AS (SELECT followup_id, regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '[\s\p{{P}}\p{{Z}}\p{{C}}]', '', 'g') AS t, coalesce(doi, '') AS d, coalesce(arxivid, '') AS a FROM ids),
heads AS (SELECT followup_id, min(followup_id) OVER (PARTITION BY t, d, a) AS kept_id FROM keyed)
SELECT kept_id, followup_id AS copy_id FROM heads WHERE kept_id <> followup_id""",
    "p6_copy_counts": rf"""
WITH {IDS_SQL}, keyed AS (SELECT followup_id, regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '[\s\p{{P}}\p{{Z}}\p{{C}}]', '', 'g') AS t, coalesce(doi, '') AS d, coalesce(arxivid, '') AS a FROM ids)
SELECT min(followup_id) AS kept_id, count(*) AS n_copies FROM keyed GROUP BY t, d, a""",
}
