import datetime as dt

from pyspark.sql import functions as F

from paperloom.operators import checks, ingest, ranking, resolve, runlog
from tests.conftest import rows


def test_relevance_beats_fame_when_interleaving(spark):
    hits = spark.createDataFrame([("a", 1, 5), ("a", 2, 900), ("b", 1, 50), ("b", 2, None)], "backend string, rank int, cites int")
    got = ranking.interleaved(hits, "backend", [F.asc("rank")], F.col("cites")).orderBy("backend_rank", "weight_order", "backend")
    assert [(r.backend, r["rank"]) for r in got.collect()] == [("b", 1), ("a", 1), ("a", 2), ("b", 2)]


def test_budget_keeps_both_branches(spark):
    got = ranking.flagged_within(spark.range(5), [F.desc("id")], 2, "id")
    assert rows(got) == [(0, False), (1, False), (2, False), (3, True), (4, True)]


def test_exclusion_on_any_key(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, [])], "id int, keys array<string>")
    assert rows(ranking.exclude_any_key(a, "id", "keys", spark.createDataFrame([("y",)], "k string"), "k"), "id") == [(2,), (3,)]


def test_keep_list_reports_unknown_ids(spark):
    kept, unknown = ranking.keep_list(spark.range(3), "id", spark.createDataFrame([(1,), (9,)], "id bigint"))
    assert rows(kept) == [(0, False), (1, True), (2, False)] and rows(unknown) == [(9,)]


def test_unique_names_avoid_natural_suffixes(spark):
    df = spark.createDataFrame([(1, "paper"), (2, "paper-2"), (3, "paper"), (4, "other"), (5, "paper")], "pos int, name string")
    assert rows(ranking.unique_names(df, "name", ["pos"]), "pos", "unique_name") == [(1, "paper"), (2, "paper-2"), (3, "paper-3"), (4, "other"), (5, "paper-4")]


def test_nearest_names(spark):
    got = ranking.nearest_names(spark.createDataFrame([("reviwer",)], "name string"), spark.createDataFrame([("reviewer",), ("Review",), ("writer",), ("polisher",)], "name string"))
    assert [r.suggestion for r in got.orderBy("distance", "suggestion").collect()] == ["reviewer", "Review"]


def test_records_link_through_a_third(spark):
    schema = "pos bigint, title string, authors array<string>, abstract string, year int, venue string, doi string, arxivid string, citations bigint, tags array<string>"
    data = [(1, "Tides", ["Jane Doe"], None, None, None, None, "7501.00001", 3, ["a"]), (2, "Other title", ["X Y"], "long abstract", 2020, "J", "10.1/x", None, 9, ["b", "a"]),
            (3, "Other  Title", ["Y, X"], "short", 2021, "K", "10.48550/arXiv.7501.00001", None, None, None), (4, "Tides", ["John Roe"], None, None, None, None, None, None, None)]
    records = spark.createDataFrame(data, schema)
    keyed = records.select("pos", F.explode(resolve.record_keys(F.col("title"), F.get("authors", F.lit(0)), F.col("doi"), F.col("arxivid"))).alias("key"))
    assert not [r for r in keyed.collect() if r.key is None]
    surname_differs = records.join(resolve.group_labels(keyed), "pos")
    got = {r.root: r for r in resolve.folded(surname_differs).collect()}
    assert set(got) == {1, 4}
    assert got[1].arxivid == "7501.00001" and got[4].n_records == 1


def test_citation_verdicts(spark):
    manuscript = spark.createDataFrame([("As [Smith et al., 2020] and [Li 2019] and [Doe 2001a] say [1] [see below].",)], "text string")
    sources = spark.createDataFrame([(1, "Smith wrote in 1999."), (2, "By Smith, 2020."), (3, "quality and more"), (4, "Doe, 2002")], "pos int, text string")
    got = {r.surname: (r.verdict, r.found_in) for r in checks.citation_support(checks.cited(manuscript), sources, "pos").collect()}
    assert got == {"smith": ("supported", 2), "li": ("unsupported", None), "doe": ("year-mismatch", 4)}


def test_markers_by_line(spark):
    got = checks.markers(spark.createDataFrame([(1, "x\nEVIDENCE NEEDED: why? \nNOCITATION NEEDED\nCITATION NEEDED")], "id int, text string"), "id")
    assert rows(got, "line", "kind", "note") == [(2, "EVIDENCE NEEDED", "why?"), (4, "CITATION NEEDED", "")]


def test_followups_group_by_one_key_and_count_lines(spark):
    schema = "pos bigint, title string, authors string, year int, doi string, arxivid string, reason string, card string, points array<string>"
    data = [(1, "A", None, None, "10.1/a", None, "r", "c1", ["p"]), (2, "A!", "Doe", 2020, "10.1/a", "7501.1", "r", "c1", ["q", "p"]), (3, "a", None, None, None, None, "s", "c2", None)]
    got = {r.key: r for r in checks.followup_groups(spark.createDataFrame(data, schema)).collect()}
    assert (got["doi:10.1/a"].mentions, got["doi:10.1/a"].cards, got["doi:10.1/a"].points, got["doi:10.1/a"].year) == (2, ["c1"], ["p", "q"], 2020)
    assert got["title:a"].mentions == 1


def test_evidence_and_orphans(spark):
    points = spark.createDataFrame([("p",), ("q",)], "point string")
    cards = spark.createDataFrame([("c1", ["p", "p", "x"], "full_text"), ("c2", ["p"], "abstract_only")], "card string, points array<string>, level string")
    failed = spark.createDataFrame([(["q"],)], "points array<string>")
    assert rows(checks.evidence(points, cards, failed, "point")) == [("p", 3, 2, 1, 0), ("q", 0, 0, 0, 1)]
    assert rows(checks.orphaned(points, cards, "point", "card")) == [("c1", "x")]


def test_exactly_half_textless_is_no_scan(spark):
    long = "x" * 100
    df = spark.createDataFrame([(1, [long, " "]), (2, [long, "", ""]), (3, []), (4, [""])], "id int, pages array<string>")
    got = {r.id: (r.status, r.textless) for r in ingest.page_stats(df, "pages").collect()}
    assert got == {1: ("extracted", [2]), 2: ("mostly_scanned", [2, 3]), 3: ("scanned", []), 4: ("scanned", [1])}


def test_rendering(spark):
    df = spark.createDataFrame([("a b.pdf", [" one ", "two"], [2])], "s string, p array<string>, t array<int>")
    got = df.select(ingest.rendered(F.col("s"), F.col("p"), F.col("t")).alias("d")).first()["d"]
    assert got == '---\nsource: "a b.pdf"\npages: 2\ntextless_pages: [2]\n---\n<!-- page 1 -->\n\none\n\n<!-- page 2 -->\n\ntwo\n'


def test_freshness_needs_every_output(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    sources = spark.createDataFrame([(1, at(5)), (2, at(5)), (3, at(5))], "id int, changed timestamp")
    outputs = spark.createDataFrame([(1, at(5)), (1, at(6)), (2, at(6)), (2, at(4))], "id int, written timestamp")
    assert rows(ingest.fresh(sources, outputs, "id", "changed", "written")) == [(1, 2, True), (2, 2, False), (3, 0, False)]


def test_adoption_is_unique_both_ways(spark):
    files = spark.createDataFrame([("b.pdf", "see doi:10.99/abcdefg now"), ("a.pdf", "https://doi.org/10.99/abcdefg"), ("c.pdf", "10.99/abcdefg 10.98/hijklmn"), ("d.pdf", "short 10.1/x")], "file string, first_page string")
    papers = spark.createDataFrame([("p1", "10.99/abcdefg"), ("p2", "10.98/hijklmn"), ("p3", "10.1/x")], "paper string, identifier string")
    assert rows(ingest.adopted(files, papers)) == [("a.pdf", "p1"), ("c.pdf", "p2")]  # b.pdf finds its paper taken


def test_pdf_and_status(spark):
    df = spark.createDataFrame([(b"%PDF-" + b"x" * 2000,), (b"<html>" + b"x" * 2000,), (b"%PDF-",)], "c binary")
    assert [r[0] for r in df.select(ingest.is_pdf(F.col("c"))).collect()] == [True, False, False]


def test_assembly_marks_gaps(spark):
    sections = spark.createDataFrame([(1, 1, "intro", "Introduction"), (1, 2, "end", "End")], "g int, pos int, id string, title string")
    drafts = spark.createDataFrame([("intro", " text ")], "id string, text string")
    got = ingest.assembled(sections, drafts, "g", "pos", "id").first()
    assert (got.n_missing, got.document) == (1, "text\n\n## End\n\nSECTION MISSING: end was not drafted.")


def test_budgets_and_ladders(spark):
    turns = spark.createDataFrame([("s", i) for i in range(6)], "s string, i int")
    assert [r.action for r in runlog.turn_budget(turns, "s", ["i"], 5, 0.8).orderBy("i").collect()] == ["continue"] * 3 + ["steer", "abort", "continue"]
    fails = runlog.failure_budget(turns, "s", ["i"], F.col("i") % 2 == 0, 2).orderBy("i").collect()
    assert [r.scheduled for r in fails] == [True, True, True, False, False, False]
    waits = spark.createDataFrame([(1, None, 1500), (3, None, 1500), (9, None, 250), (1, 7000, 1500), (1, 10, 3100)], "n int, asked int, interval int")
    assert [r[0] for r in waits.select(runlog.retry_wait(F.col("n"), F.col("asked"), F.col("interval"))).collect()] == [1500, 4000, 60000, 7000, 3100]


def test_usage_flags_any_unpriced_row(spark):
    usage = spark.createDataFrame([("a", 10, 0.0), ("a", 5, 1.0), ("b", 0, 0.0)], "step string, tokens bigint, cost double")
    got = {r.step: r for r in runlog.usage_rollup(usage, "step", ["tokens", "cost"], "tokens", "cost").collect()}
    assert (got["a"].unpriced, got["b"].unpriced, got[None].unpriced, got[None].tokens) == (True, False, True, 15)


def test_silences(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("u", at(0)), ("u", at(5)), ("u", at(30))], "k string, at timestamp")
    assert rows(runlog.gaps(df, "k", "at", ["at"], 20), "k", "gap_s") == [("u", 25.0)]
