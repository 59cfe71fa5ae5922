"""Markdown reports, rendered as ordered tables of lines.

Every report is a DataFrame (section, place, line): sections in their order, lines of a
section in theirs.  Rows are rendered where they are; ``written`` sorts and writes them
as one text file per report, so no report is ever one array in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.storage import Scratch

_LINES = "section int, place bigint, line string"


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, i, x) for i, x in enumerate(lines)], _LINES)


def _rows(table: DataFrame, section: int, place: str, line: Column) -> DataFrame:
    return table.select(F.lit(section).alias("section"), F.col(place).cast("bigint").alias("place"), line.alias("line"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _cells(*columns: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))


def ordered(table: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``table`` with the place of each row in a global order.

    Rows are range-partitioned and sorted, numbered within their partition, and the
    partitions' row counts, one number each, give the offsets: no window over everything.
    """
    sorted_rows = table.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered = sorted_rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_no", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = Scratch(table.sparkSession, "ordered").save(numbered)  # the numbers must be the same in both uses
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(out, F.col("_before") + F.col("_no")).drop("_id", "_part", "_no", "_before")


def index_cards(cards: DataFrame) -> DataFrame:
    """Cards (name, fields, error) with the defaults of a reference index; unreadable ones are left out.

    A card without a title is listed under its file name and marked ``untitled``.
    """
    f = F.col("fields")
    stem = F.regexp_replace("name", r"\.md$", "")

    def known(key: str) -> Column:
        return F.coalesce(text.or_null(f[key]), F.lit("unknown")).alias(key)

    title = text.or_null(f["title"])
    return cards.where("error IS NULL").select(
        "name", F.coalesce(title, stem).alias("title"), title.isNull().alias("untitled"), known("authors"), known("year"), known("venue"), known("kind"),
        tag_list(f["tags"]).alias("tags"), F.coalesce(text.or_null(f["cite_for"]), F.lit("")).alias("cite_for"),
    )


def tag_list(field: Column) -> Column:
    """Lower-case tags of a JSON array or a comma-separated text."""
    from paperloom.sources.scan import listed

    return F.transform(listed(F.coalesce(field, F.lit(""))), F.lower)


def newest_first(title: str = "title", year: str = "year") -> list[Column]:
    """Latest year first, an unreadable year last, then title in dictionary order."""
    return [F.desc_nulls_last(text.leading_int(F.col(year).cast("string"))), F.asc(F.collate(F.col(title), "UNICODE")), F.asc(F.col(title))]


def reference_index(cards: DataFrame, unreadable: DataFrame | None = None, folder: str = "") -> DataFrame:
    """Lines of the index of ``cards`` (as ``index_cards`` gives them): the table, the keywords, what needs attention."""
    spark = cards.sparkSession
    from paperloom.operators.checks import keyword_index

    n = cards.count()
    head = ["# Reference index", "", f"{n} paper(s). One line each, newest first.", ""] + ([f"Cards are in `{folder}/`.", ""] if folder else [])
    placed = ordered(cards, [*newest_first(), F.asc("name")])
    table = _rows(placed, 2, "place", _cells(text.table_cell(F.col("year")), text.table_cell(F.col("venue")), text.table_cell(F.col("title")), text.table_cell(F.col("cite_for")), F.concat(F.lit("`"), "name", F.lit("`"))))
    tags = ordered(keyword_index(cards, "tags", "title", [*newest_first(), F.asc("name")]), [F.desc("n_cards"), F.asc("tag")])
    more = F.when(F.col("n_more") > 0, F.concat(F.lit("; …"), F.col("n_more").cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    keywords = _rows(tags, 4, "place", F.concat(F.lit("- **"), "tag", F.lit("** ("), F.col("n_cards").cast("string"), F.lit("): "), F.array_join("titles", "; "), more))
    parts = [_fixed(spark, 0, *head), _fixed(spark, 1, "| Year | Venue | Title | Cite for | Card |", "|---|---|---|---|---|"), table, _fixed(spark, 3, "", "## By keyword", ""), keywords]
    attention = ordered(cards.where("untitled").select("name"), [F.asc("name")])
    parts.append(_rows(attention, 6, "place", F.concat(F.lit("- `"), "name", F.lit("` — no title; listed under its file name"))))
    if unreadable is not None:
        parts.append(_rows(ordered(unreadable.select("name"), [F.asc("name")]), 5, "place", F.concat(F.lit("- `"), "name", F.lit("` — front matter could not be read"))))
    return _union(*parts)


def card_order(points: DataFrame, point: str = "point") -> DataFrame:
    """``points`` (point, title, citations ...) with the ``place`` of each card in its packet: most cited first, then title."""
    w = Window.partitionBy(point).orderBy(F.desc(F.coalesce("citations", F.lit(0))), F.asc(F.collate(F.col("title"), "UNICODE")), F.asc("title"), F.asc("card"))
    return points.withColumn("place", F.row_number().over(w))


def evidence_packets(packets: DataFrame, cards: DataFrame, n_unchased: int, point: str = "point") -> DataFrame:
    """(point, section, place, line): a packet for every point, also for one without any card.

    ``packets`` (point, title, n_cards, full_text, abstract_only, failed), ``cards``
    (point, card, title, year, venue, citations, level).
    """
    counts = [
        F.concat(F.lit("# Evidence for "), F.col(point), F.lit(": "), "title"), F.lit(""), F.lit("## Coverage"), F.lit(""),
        F.concat(F.lit("- **"), F.col("n_cards").cast("string"), F.lit(" analysed paper(s)** bear on this candidate.")),
        F.concat(F.lit("- "), F.col("full_text").cast("string"), F.lit(" read in full text, "), F.col("abstract_only").cast("string"), F.lit(" from the abstract only.")),
        F.concat(F.lit("- "), F.col("failed").cast("string"), F.lit(" related paper(s) could not be fetched at all.")),
        F.lit(f"- {n_unchased} follow-up reference(s) were proposed but never fetched."), F.lit(""),
        F.when(F.col("n_cards") == 0, "## No evidence").otherwise("## Cards"), F.lit(""),
        F.when(F.col("n_cards") == 0, "The search returned no analysed paper relevant to this candidate.").otherwise("| Evidence | Year | Venue | Cited | Title | Card |"),
        F.when(F.col("n_cards") > 0, "|---|---|---|---|---|---|"),
    ]
    head = packets.select(point, F.posexplode(F.array(*counts)).alias("place", "line")).where("line IS NOT NULL")
    head = head.select(point, F.lit(0).alias("section"), F.col("place").cast("bigint").alias("place"), "line")
    level = F.when(F.col("level") == "abstract_only", "abstract").otherwise("full text")
    row = _cells(level, text.table_cell(F.coalesce(F.col("year").cast("string"), F.lit("unknown"))), text.table_cell(F.coalesce("venue", F.lit("unknown"))), F.coalesce(F.col("citations").cast("string"), F.lit("?")), text.table_cell(F.col("title")), F.concat(F.lit("`"), "card", F.lit("`")))
    body = card_order(cards, point).join(packets.select(point), point).select(point, F.lit(1).alias("section"), F.col("place").cast("bigint").alias("place"), row.alias("line"))
    return head.unionByName(body)


def unchased(proposed: DataFrame, fetched: DataFrame) -> int:
    """Follow-ups proposed for the second round that no paper came back for."""
    return max(0, proposed.count() - fetched.count())


def followup_report(plan: DataFrame, n_known: int, max_total: int) -> DataFrame:
    """Lines of the follow-ups of ``plan`` (as ``search.followup_plan`` gives them): proposed, and left out for the cap."""
    spark = plan.sparkSession
    placed = ordered(plan, [F.desc("mentions"), F.asc("title"), F.asc("key")])
    n_kept = plan.where("kept").count()
    head = ["# Follow-up references for round 2", "", f"{n_kept} reference(s) proposed, ranked by how many analyses named them.", f"Round 1 fetched {n_known} paper(s); the cap across both rounds is {max_total}.", "", "| Named by | Title | Year | Identifier | Why |", "|---|---|---|---|---|"]
    row = _cells(F.col("mentions").cast("string"), text.table_cell(F.col("title")), F.coalesce(F.col("year").cast("string"), F.lit("?")), text.table_cell(F.coalesce("doi", "arxivid", F.lit("—"))), text.table_cell(F.array_join("reasons", "; ")))
    left = F.concat(F.lit("- "), "title", F.lit(" (named by "), F.col("mentions").cast("string"), F.lit(")"))
    return _union(_fixed(spark, 0, *head), _rows(placed.where("kept"), 1, "place", row), _fixed(spark, 2, "", "## Not proposed", ""), _rows(placed.where("NOT kept"), 3, "place", left))


def citation_report(manuscript: str, citations: DataFrame, markers: DataFrame, n_sources: int) -> DataFrame:
    """Lines of a citation check: unsupported, wrong years, and the gaps the author left, kinds in order of first line."""
    spark = citations.sparkSession
    head = [f"# Citation check: {manuscript}", "", f"Checked {citations.count()} distinct citation(s) against {n_sources} indexed file(s).", "", "## Unsupported citations", ""]
    placed = ordered(citations, [F.asc("raw")])
    missing = _rows(placed.where("verdict = 'unsupported'"), 1, "place", F.concat(F.lit("- "), "raw", F.lit(' — no document mentions "'), "surname", F.lit('"')))
    years = _rows(placed.where("verdict = 'year-mismatch'"), 3, "place", F.concat(F.lit("- "), "raw", F.lit(' — "'), "surname", F.lit('" appears in '), F.col("found_in").cast("string"), F.lit(", "), "year", F.lit(" does not")))
    kinds = markers.groupBy("kind").agg(F.min("line").alias("first"), F.count("*").alias("n"))  # three kinds at most
    titles = kinds.select("kind", "first", F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit("### "), "kind", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    note = F.when(F.length("note") > 0, F.col("note")).otherwise(F.lit("(no detail given)"))
    items = markers.join(F.broadcast(kinds), "kind").select("kind", "first", F.col("line").cast("bigint").alias("at"), F.concat(F.lit("- line "), F.col("line").cast("string"), F.lit(": "), note).alias("line"))
    gaps = _rows(ordered(titles.unionByName(items), [F.asc("first"), F.asc("kind"), F.asc("at")]), 5, "place", F.col("line"))
    return _union(_fixed(spark, 0, *head), missing, _fixed(spark, 2, "", "## Possible year errors", ""), years, _fixed(spark, 4, "", "## Author's outstanding work", ""), gaps)


def citation_outcome(citations: DataFrame, markers: DataFrame) -> tuple[bool, str]:
    """(ok, summary): an unsupported citation fails the check, a marker never does."""
    counts = citations.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "unsupported").alias("bad")).first()
    return counts["bad"] == 0, f"{counts['n']} citation(s) checked, {counts['bad']} unsupported, {markers.count()} outstanding marker(s)"


USAGE = ("input", "output", "cache_read", "cache_write", "total", "cost")


def usage_lines(usage: DataFrame, run_status: str) -> DataFrame:
    """Rows of a usage table as text: ``usage`` (step, status, turns, the six measures), steps in order of ``step_no``, then the total.

    A step has a handful of rows at most, so the totals are one aggregation.
    """
    zero = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("turns", *USAGE)]
    steps = usage.groupBy("step_no", "step", "status").agg(*zero)
    total = usage.agg(*zero).select(F.lit(2**31 - 1).alias("step_no"), F.lit("TOTAL").alias("step"), F.lit(run_status).alias("status"), "turns", *USAGE)
    rows = steps.select("step_no", "step", "status", "turns", *USAGE).unionByName(total)
    shown = F.format_string("%s %s %d %d %d %d %d $%.4f", "step", "status", F.col("turns").cast("bigint"), *[F.col(m).cast("bigint") for m in USAGE[:4]], F.col("cost").cast("double"))
    return _rows(rows, 0, "step_no", shown)


def step_durations(steps: DataFrame, started: str = "started_at", ended: str = "ended_at") -> DataFrame:
    """``steps`` with ``duration_ms``; null while a step hasn't ended."""
    return steps.withColumn("duration_ms", F.timestamp_diff("MICROSECOND", F.col(started), F.col(ended)) / 1000)


def written(lines: DataFrame, path: str) -> None:
    """Write a report's lines in order below ``path``, its parts in the order of their names."""
    lines.orderBy("section", "place").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
