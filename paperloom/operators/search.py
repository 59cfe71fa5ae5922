"""A literature search as one plan: interleave, merge, take turns, exclude, cap, merge again, name, warn.

Hits of any number of queries and backends are one table; each stage is a window or a
join on it.  The order of the result is a number, ``place``, so nothing is sorted until
the cap, which is a distributed top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import ranking, resolve
from paperloom.operators.checks import followup_groups
from paperloom.storage import Scratch

#: Bounds and default of a probe's limit.
PROBE_LIMITS = (1, 20, 10)
#: Fixed value: the point of a follow-up query that no card's point led to.
DEFAULT_POINT = "ip-1"
#: Place of a hit: its turn times this, plus its query's number.
_TURN = 2**31


@dataclass
class SearchResult:
    """``papers``: one row per work with ``paper_id`` and ``place``; ``warnings`` (order_no, subject, warning)."""

    papers: DataFrame
    warnings: DataFrame
    n_known: int
    n_dropped: int


def keys_of(records: DataFrame) -> Column:
    return resolve.record_keys(F.col("title"), F.get("authors", F.lit(0)), F.col("doi"), F.col("arxivid"))


def merged_per_query(hits: DataFrame) -> DataFrame:
    """One record per query and work of ``hits`` (query_no, backend, rank, record columns), with ``turn`` in its query.

    Within a query the backends' own orders are interleaved; citations only decide
    between backends at one rank.
    """
    ranked = ranking.interleaved(hits, "backend", [F.asc("rank")], F.col("citations"), ["query_no"])
    own = Window.partitionBy("query_no").orderBy("backend_rank", "weight_order", "backend")
    ranked = ranked.withColumn("pos", F.col("query_no").cast("bigint") * _TURN + F.row_number().over(own))
    keyed = ranked.select("pos", F.explode(F.transform(keys_of(ranked), lambda k: F.concat(F.col("query_no").cast("string"), F.lit("|"), k))).alias("key"))
    labelled = ranked.join(resolve.group_labels(keyed), "pos", "left").withColumn("root", F.coalesce("root", "pos"))
    merged = resolve.folded(labelled.withColumn("backends", F.coalesce("backends", F.array("backend")) if "backends" in hits.columns else F.array("backend")))
    merged = merged.withColumn("query_no", F.floor(F.col("root") / _TURN).cast("int"))
    return ranking.round_robin(merged, "query_no", [F.asc("root")])


def search_warnings(answers: DataFrame, n_queries: int) -> DataFrame:
    """(order_no, subject, warning) for ``answers`` (query_no, label, backend, n_found, error), a row per query and backend."""
    silent = answers.groupBy("query_no", "label").agg(F.bool_and(F.col("error").isNotNull()).alias("silent"), F.sum("n_found").alias("n")).where("silent AND coalesce(n, 0) = 0")
    first = silent.select(F.col("query_no").cast("bigint").alias("order_no"), F.col("label").alias("subject"), F.concat(F.lit("No backend answered for "), "label", F.lit(".")).alias("warning"))
    failed = answers.where("error IS NOT NULL").groupBy("backend").agg(F.count("*").alias("n"))
    noun = "query" if n_queries == 1 else "queries"
    told = F.concat("backend", F.lit(" failed on "), F.col("n").cast("string"), F.lit(f" of {n_queries} {noun}; results are narrower than they look."))
    return first.unionByName(failed.select(F.lit(2**40).cast("bigint").alias("order_no"), F.col("backend").alias("subject"), told.alias("warning")))


def execute_search(hits: DataFrame, answers: DataFrame, max_total: int, known: DataFrame | None = None) -> SearchResult:
    """Papers of a whole search.

    ``hits`` (query_no, backend, rank, title, authors, abstract, year, venue, doi,
    arxivid, citations, points ...) are the records the backends returned, ``answers``
    (query_no, label, backend, n_found, error) how each backend answered, ``known``
    records of an earlier round, dropped under any of their keys.  The cap comes before
    the merge over queries, so fewer than ``max_total`` papers may come out.
    """
    scratch = Scratch(hits.sparkSession, "search")
    ranked = scratch.save(merged_per_query(hits).withColumn("place", F.col("turn").cast("bigint") * _TURN + F.col("query_no")).drop("root"))
    n_all = ranked.count()
    kept = ranked.withColumn("keys", keys_of(ranked))
    if known is not None:
        kept = ranking.exclude_any_key(kept, "place", "keys", known.select(F.explode(keys_of(known)).alias("key")), "key")
    kept = scratch.save(kept.drop("keys"))
    n_kept = kept.count()
    capped = ranking.capped(kept, ["place"], max(0, max_total)).drop("n_records")
    papers = resolve.resolved(capped.withColumn("pos", F.col("place"))).withColumnRenamed("root", "place")
    wanted = papers.withColumn("_name", resolve.candidate_name(F.get("authors", F.lit(0)), F.col("year"), F.col("title")))
    named = ranking.unique_names(wanted.select("place", "_name"), "_name", ["place"], "paper_id").select("place", "paper_id")
    warnings = search_warnings(answers, answers.select("query_no").distinct().count())
    n_dropped = n_kept - min(n_kept, max(0, max_total))
    if n_dropped:
        told = f"Cap of {max_total} reached: {n_dropped} further result(s) were dropped. Raise max_total or narrow the queries."
        warnings = warnings.unionByName(hits.sparkSession.createDataFrame([(2**41, "cap", told)], warnings.schema))
    return SearchResult(papers.join(named, "place"), warnings, n_all - n_kept, n_dropped)


def not_before(papers: DataFrame, year_min: int | None) -> DataFrame:
    """Papers of ``year_min`` or later; a paper without a year stays."""
    return papers if year_min is None else papers.where(F.col("year").isNull() | (F.col("year") >= year_min))


def probe(papers: DataFrame, limit: int | None = None, year_min: int | None = None) -> DataFrame:
    """The most cited papers, as many as ``limit`` clamped to its bounds allows."""
    low, high, usual = PROBE_LIMITS
    n = usual if limit is None else min(high, max(low, int(limit)))
    return not_before(papers, year_min).orderBy(F.desc(F.coalesce("citations", F.lit(0))), "title").limit(n)


def probe_lines(papers: DataFrame) -> DataFrame:
    """(citations, title, line): a paper as one entry of a listing with the head of its abstract."""
    people = F.when(F.size("authors") > 3, F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join("authors", ", "))
    facts = F.concat_ws(", ", F.nullif(people, F.lit("")), F.col("year").cast("string"), F.col("venue"), F.concat(F.coalesce("citations", F.lit(0)).cast("string"), F.lit(" citations")))
    head = text.first_words(F.coalesce("abstract", F.lit("(no abstract)")), 40)
    return papers.select("citations", "title", F.concat(F.lit("- "), "title", F.lit("\n  "), facts, F.lit("\n  "), head).alias("line"))


def followup_plan(groups: DataFrame, known: DataFrame, max_total: int) -> DataFrame:
    """``groups`` (key, mentions, title ...) that are not ``known`` (key), with ``place`` and ``kept``.

    The budget is what the known papers leave of ``max_total``; what exceeds it stays in
    the table with ``kept`` false.  The order is by mentions, then title and key.
    """
    fresh = groups.join(known.select("key").distinct(), "key", "left_anti")
    budget = max(0, max_total - known.count())
    return ranking.flagged_within(fresh, [F.desc("mentions"), F.asc("title"), F.asc("key")], budget, "key")


def known_key(title: Column, doi: Column, arxiv: Column) -> Column:
    """The one key a known paper has: DOI, else arXiv id, else title."""
    doi, arxiv = text.or_null(doi), text.or_null(arxiv)
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("title:"), text.title_key(title)))


def to_queries(followups: DataFrame) -> DataFrame:
    """(key, kind, point, doi, arxivid, title): the lookup of each follow-up by its best identifier."""
    arxiv = F.when(F.col("doi").isNull(), F.col("arxivid"))
    return followups.select("key", F.lit("id").alias("kind"), F.coalesce(F.get("points", F.lit(0)), F.lit(DEFAULT_POINT)).alias("point"), "doi", arxiv.alias("arxivid"), "title")


def two_rounds(hits: DataFrame, answers: DataFrame, mentions: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], tuple[DataFrame, DataFrame]], max_total: int) -> tuple[SearchResult, DataFrame, SearchResult]:
    """(first round, plan of follow-ups, second round) of a snowball search.

    ``mentions`` gives the follow-ups the first round's papers name (as
    ``checks.followup_groups`` takes them), ``second`` the hits and answers of their
    lookups.  The second round knows every paper of the first under all of its keys.
    """
    first = execute_search(hits, answers, max_total)
    known = first.papers.select(known_key(F.col("title"), F.col("doi"), F.col("arxivid")).alias("key"))
    plan = followup_plan(followup_groups(mentions(first.papers)), known, max_total)
    more = second(to_queries(plan.where("kept")))
    return first, plan, execute_search(*more, max(0, max_total - first.papers.count()), first.papers)
