import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import checks, corpus, fetching, ingest, ranking, reports, resolve, search, selection
from tests.conftest import rows

HITS = "query_no int, backend string, rank int, title string, authors array<string>, abstract string, year int, venue string, doi string, arxivid string, citations bigint, points array<string>"
ANSWERS = "query_no int, label string, backend string, n_found int, error string"


def hit(q, backend, rank, title, cites=0, doi=None, year=2020, point="p", arxiv=None):
    return (q, backend, rank, title, ["Jane Doe"], None, year, None, doi, arxiv, cites, [point])


def test_a_search_interleaves_merges_excludes_caps_and_names(spark):
    hits = spark.createDataFrame([
        hit(1, "arxiv", 1, "Alpha", 1), hit(1, "openalex", 1, "Beta", 900, doi="10.1000/b"), hit(1, "openalex", 2, "Alpha", 5, doi="10.1000/a"),
        hit(2, "arxiv", 1, "Beta!", 3, doi="10.1000/b", point="q"), hit(2, "arxiv", 2, "Gamma", 0), hit(2, "arxiv", 3, "Known", 0, doi="10.1000/k"), hit(2, "arxiv", 4, "Delta", 0),
    ], HITS)
    answers = spark.createDataFrame([(1, "one", "arxiv", 1, None), (1, "one", "openalex", 2, None), (2, "two", "arxiv", 4, None), (2, "two", "openalex", 0, "HTTP 500"), (3, "three", "arxiv", 0, "x"), (3, "three", "openalex", 0, "y")], ANSWERS)
    known = spark.createDataFrame([(1, "Else", ["X"], "10.1000/k", None)], "n int, title string, authors array<string>, doi string, arxivid string")
    found = search.execute_search(hits, answers, 4, known)
    papers = found.papers.orderBy("place").collect()
    # turns: Beta (1), Beta! (2), Alpha (1), Gamma (2), then Delta is cut; the two Betas become one
    assert [(p.title, p.points) for p in papers] == [("Beta!", ["p", "q"]), ("Alpha", ["p"]), ("Gamma", ["p"])]
    assert [p.paper_id for p in papers] == ["doe-2020-beta", "doe-2020-alpha", "doe-2020-gamma"]
    assert papers[1].doi == "10.1000/a" and papers[1].citations == 5 and papers[1].backends == ["arxiv", "openalex"]
    assert (found.n_known, found.n_dropped) == (1, 1)
    told = [r.warning for r in found.warnings.orderBy("order_no", "subject").collect()]
    assert told == ["No backend answered for three.", "arxiv failed on 1 of 3 queries; results are narrower than they look.", "openalex failed on 2 of 3 queries; results are narrower than they look.",
                    "Cap of 4 reached: 1 further result(s) were dropped. Raise max_total or narrow the queries."]
    assert search.execute_search(hits.limit(0), answers.limit(0), 4).papers.count() == 0


def test_two_rounds_know_the_first(spark):
    hits = spark.createDataFrame([hit(1, "arxiv", 1, "Alpha", doi="10.1000/a"), hit(1, "arxiv", 2, "Beta", doi="10.1000/b")], HITS)
    answers = spark.createDataFrame([(1, "one", "arxiv", 2, None)], ANSWERS)
    named = spark.createDataFrame([(1, "Alpha", None, None, "10.1000/a", None, "r", "c1", ["p"]), (2, "Gamma", None, None, "10.1000/g", None, "r", "c1", ["p"]), (3, "Delta", None, None, None, None, "r", "c2", ["p"])], "pos bigint, title string, authors string, year int, doi string, arxivid string, reason string, card string, points array<string>")
    second = lambda q: (spark.createDataFrame([hit(1, "arxiv", 1, "Beta", doi="10.1000/b"), hit(1, "arxiv", 2, "Gamma", doi="10.1000/g")], HITS), answers)
    first, plan, more = search.two_rounds(hits, answers, lambda papers: named, second, 3)
    assert first.papers.count() == 2 and rows(plan, "key", "kept") == [("doi:10.1000/g", False), ("title:delta", True)]
    assert [r.title for r in more.papers.collect()] == ["Gamma"] and more.n_known == 1


def test_sections_without_an_id_count_as_missing(spark):
    sections = spark.createDataFrame([(1, 1, "a", "A"), (1, 2, None, "B")], "g int, pos int, id string, title string")
    got = ingest.assembled(sections, spark.createDataFrame([("a", "text")], "id string, text string"), "g", "pos", "id").first()
    assert (got.n_sections, got.n_missing, got.document) == (2, 1, "text")


def test_probe_clamps_and_keeps_unknown_years(spark):
    papers = spark.createDataFrame([(f"t{i}", i, None if i == 0 else 2000 + i) for i in range(30)], "title string, citations bigint, year int")
    assert search.probe(papers, 99).count() == 20 and search.probe(papers, -5).count() == 1 and search.probe(papers).count() == 10
    assert rows(search.not_before(papers, 2028), "title") == [("t0",), ("t28",), ("t29",)]


def test_followup_budget_and_queries(spark):
    groups = spark.createDataFrame([("doi:10.1000/a", 3, "A", 2020, "10.1000/a", None, ["why"], ["p"]), ("title:b", 5, "B", None, None, None, [], []), ("arxiv:7501.1", 3, "C", None, None, "7501.1", [], ["q"]), ("doi:10.1000/k", 9, "K", None, "10.1000/k", "7501.9", [], [])],
                                   "key string, mentions int, title string, year int, doi string, arxivid string, reasons array<string>, points array<string>")
    known = spark.createDataFrame([("doi:10.1000/k",)], "key string")
    plan = search.followup_plan(groups, known, 3)
    assert rows(plan, "key", "kept") == [("arxiv:7501.1", False), ("doi:10.1000/a", True), ("title:b", True)]
    assert rows(search.to_queries(plan), "key", "point", "doi", "arxivid") == [("arxiv:7501.1", "q", None, "7501.1"), ("doi:10.1000/a", "p", "10.1000/a", None), ("title:b", "ip-1", None, None)]
    assert search.followup_plan(groups, known, 0).where("kept").count() == 0
    lines = [r.line for r in reports.followup_report(plan, 1, 3).orderBy("section", "place").collect()]
    assert "| 5 | B | ? | — |  |" in lines and lines[-1] == "- C (named by 3)" and lines.index("| 5 | B | ? | — |  |") < lines.index("| 3 | A | 2020 | 10.1000/a | why |")


def test_keyless_records_stay(spark):
    schema = "pos bigint, title string, authors array<string>, abstract string, year int, doi string, arxivid string, citations bigint, backends array<string>, queries array<string>, s2_id string"
    data = [(1, "東京の潮汐", [], None, None, None, None, 1, ["a"], ["q"], None), (2, "Tides", ["Jane Doe"], None, None, None, None, 3, ["a"], ["q"], None), (3, "Tides", ["Doe, Jane"], "x", 2020, None, None, None, ["b", "a"], ["r"], "s9")]
    got = {r.root: r for r in resolve.resolved(spark.createDataFrame(data, schema)).collect()}
    assert set(got) == {1, 2} and (got[2].backends, got[2].queries, got[2].s2_id) == (["a", "b"], ["q", "r"], "s9")


def test_ingest_status_prune_and_policy(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    page = b"x" * 150
    files = spark.createDataFrame([("/c/a.pdf", at(5), page + b"\f" + page), ("/c/b.md", at(5), b"# B"), ("/c/c.docx", at(5), b"x"), ("/c/d.pdf", at(5), b" \f \f" + page), ("/c/e.pdf", at(5), b"!"), ("/c/f.txt", at(5), b"old"), ("/d/b.md", at(5), b"other")], "path string, changed timestamp, content binary")
    outputs = spark.createDataFrame([("f.md", at(6)), ("gone.md", at(6)), ("c.md", at(1)), ("keep.txt", at(1))], "name string, written timestamp")

    def pages(content):
        if content == b"!":
            raise ValueError("damaged")
        return content.decode().split("\f")

    status = corpus.ingest_status(files, outputs, pages)
    got = {r.path: r for r in status.collect()}
    assert {p: r.status for p, r in got.items()} == {"/c/a.pdf": "extracted", "/c/b.md": "copied", "/c/c.docx": "failed", "/c/d.pdf": "failed", "/c/e.pdf": "failed", "/c/f.txt": "skipped", "/d/b.md": "copied"}
    assert got["/c/b.md"].document == '---\nsource: "/c/b.md"\npages: 1\n---\n# B\n' and got["/d/b.md"].output == "b-2.md"
    assert got["/c/a.pdf"].n_pages == 2 and got["/c/a.pdf"].document.startswith('---\nsource: "/c/a.pdf"\npages: 2\n---\n<!-- page 1 -->')
    assert got["/c/d.pdf"].error == "no text layer on 2 of 3 page(s) (1-2)" and got["/c/e.pdf"].error == "ValueError: damaged" and got["/c/c.docx"].error == 'unsupported extension ".docx"'
    assert rows(corpus.pruned(outputs, status)) == [("gone.md",)]
    assert corpus.ingest_outcome(status)[:2] == (False, "3 of 7 document(s) failed to extract") and corpus.ingest_outcome(status, optional=True)[0]
    assert corpus.ingest_outcome(status.limit(0), optional=True)[0] and not corpus.ingest_outcome(status.limit(0))[0]
    assert {r.status for r in corpus.ingest_status(files, outputs, pages, force=True).where("path = '/c/f.txt'").collect()} == {"copied"}


PAPERS = "id string, title string, authors array<string>, year int, venue string, abstract string, doi string, arxivid string, pdf_url string, points array<string>"


def test_manifest_follows_what_is_there(spark):
    papers = spark.createDataFrame([("a", "A: x", ["J D"], 2020, "V", "abs", "10.1/a", None, "u", ["p"]), ("b", "B", [], None, None, None, None, None, "u", ["q"]), ("c", "C", [], None, None, "abs", None, "7501.1", None, ["p"]), ("d", "D", [], None, None, None, None, None, None, None), ("e", "E", [], None, None, None, None, None, "u", ["r"])], PAPERS)
    files = spark.createDataFrame([("a.pdf", 5000), ("a.md", 10), ("manifest.json", 3)], "name string, bytes bigint")
    old = spark.createDataFrame([("a", "A", "abstract-only", ["z"], "a.md", None, None), ("gone", "G", "failed", [], None, None, "x")], fetching.MANIFEST)
    downloads = spark.createDataFrame([("b", b"<html>" + b"x" * 2000, None), ("e", b"%PDF-" + b"x" * 2000, None)], "id string, content binary, error string")
    got = {r.id: r for r in fetching.manifest(papers, files, old, downloads).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "downloaded", "b": "failed", "c": "abstract-only", "d": "failed", "e": "downloaded", "gone": "failed"}
    assert got["a"].points == ["z", "p"] and got["a"].bytes == 5000 and got["b"].error.startswith("response was not a PDF") and got["d"].error == "no open-access PDF and no abstract"
    assert rows(fetching.superseded_stubs(files)) == [("a.md",)]
    lines = [r.line for r in fetching.missing_list(papers, fetching.manifest(papers, files, old, downloads), ["id"]).orderBy("place").collect()]
    assert [x.split("\n")[0] for x in lines] == ["## 1. B", "## 2. C", "## 3. D"] and "- https://arxiv.org/abs/7501.1" in lines[1] and "abstract only" in lines[1]
    stubs = dict(papers.select("id", fetching.stub(papers)).collect())
    assert stubs["b"] is None and 'title: "A: x"' in stubs["a"] and "J D. 2020. V" in stubs["a"] and stubs["a"].endswith("abs\n")
    side = dict(fetching.sidecars(papers).collect())
    assert json.loads(side["meta/a.json"])["doi"] == "10.1/a"
    assert fetching.with_metadata(spark.createDataFrame([("a.md",)], "name string"), papers).first()["title"] == "A: x"


def test_keep_lists_are_refused_as_a_whole(spark):
    doc = spark.createDataFrame([(json.dumps({"v": 1, "a": {"list": [{"id": "IP 1", "name": "n"}, {"id": "ip-2", "title": " T "}, {"id": 7}]}}),)], "body string")
    listed = selection.entries(doc, "body", "a.list")
    assert rows(selection.selectable(doc, "body", "a.list")) == [(0, "IP 1", "n"), (1, "ip-2", "T")] and selection.selectable(doc, "body", "nothing").count() == 0
    keep = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert rows(selection.refusals(listed.select("place", "id"), keep("ip-1", " "))) == [("anonymous", "1")]
    named = spark.createDataFrame([(0, "IP 1"), (1, "ip-2"), (2, "ip-3")], "place int, id string")
    assert rows(selection.apply_keep(named, keep("ip-1", "IP-3")), "id", "kept") == [("IP 1", True), ("ip-2", False), ("ip-3", True)]
    twice = named.union(spark.createDataFrame([(3, "ip 2")], "place int, id string"))
    for table, chosen, rule in ((named, keep("ip-9"), "unknown: ip-9"), (named, keep(" "), "empty"), (twice, keep("ip-1"), "colliding: ip-2")):
        with pytest.raises(selection.KeepError, match=rule):
            selection.apply_keep(table, chosen)
    back = json.loads(selection.replaced(doc.first()["body"], "a.list", [{"id": "x"}]))
    assert back == {"v": 1, "a": {"list": [{"id": "x"}]}}
    with pytest.raises(selection.KeepError):
        selection.replaced("{}", "a.b", [])


def test_claims_in_file_order(spark):
    files = spark.createDataFrame([("a.pdf", "10.99/abcdefg"), ("c.pdf", "10.99/abcdefg and 10.98/hij\nklmn"), ("d.pdf", "arXiv:7501.00001v2"), ("e.pdf", "10.97/xxxxxxx 10.96/yyyyyyy"), ("f.pdf", "short 10.1/x"), ("g.pdf", "10.99/abcdefg")], "file string, first_page string")
    papers = spark.createDataFrame([("p1", "10.99/abcdefg"), ("p2", "10.98/hijklmn"), ("p3", "arxiv:7501.00001"), ("p4", "10.97/xxxxxxx"), ("p5", "10.96/yyyyyyy"), ("p6", "10.1/x")], "paper string, identifier string")
    assert rows(ingest.adopted(files, papers)) == [("a.pdf", "p1"), ("c.pdf", "p2"), ("d.pdf", "p3")]
    ids = spark.createDataFrame([("https://doi.org/10.99/ABC", "7501.00001"), ("10.1/x", None)], "doi string, arxivid string")
    assert [r[0] for r in ids.select(ingest.distinctive(F.col("doi"), F.col("arxivid"))).collect()] == [["arxiv:7501.00001"], []]


def test_reference_index_and_evidence_reports(spark):
    cards = spark.createDataFrame([("a.md", {"title": "Beta|x", "year": "2020", "tags": '["One", "two"]', "cite_for": "c"}, None), ("b.md", {"title": "alpha", "year": "2020 (online)", "tags": "one"}, None), ("c.md", {"year": "soon"}, None), ("d.md", None, "broken")], "name string, fields map<string,string>, error string")
    index = reports.index_cards(cards)
    lines = [r.line for r in reports.reference_index(index, cards.where("error IS NOT NULL"), "refs").orderBy("section", "place").collect()]
    table = [x for x in lines if x.startswith("| ") and "Year" not in x]
    assert table == ["| 2020 (online) | unknown | alpha |  | `b.md` |", "| 2020 | unknown | Beta\\|x | c | `a.md` |", "| soon | unknown | c |  | `c.md` |"]
    assert "- **one** (2): alpha; Beta|x" in lines and lines[-2:] == ["- `d.md` — front matter could not be read", "- `c.md` — no title; listed under its file name"]
    packets = spark.createDataFrame([("p", "P", 2, 1, 1, 0), ("q", "Q", 0, 0, 0, 3)], "point string, title string, n_cards int, full_text int, abstract_only int, failed int")
    used = spark.createDataFrame([("p", "x.md", "B", 2020, None, None, "full_text"), ("p", "y.md", "A", None, "V", 9, "abstract_only")], "point string, card string, title string, year int, venue string, citations bigint, level string")
    got = reports.evidence_packets(packets, used, 4)
    p = [r.line for r in got.where("point = 'p'").orderBy("section", "place").collect()]
    assert p[-2:] == ["| abstract | unknown | V | 9 | A | `y.md` |", "| full text | 2020 | unknown | ? | B | `x.md` |"] and "- 4 follow-up reference(s) were proposed but never fetched." in p
    assert "## No evidence" in [r.line for r in got.where("point = 'q'").collect()]
    assert reports.unchased(spark.range(5), spark.range(2)) == 3 and reports.unchased(spark.range(1), spark.range(2)) == 0


def test_citation_and_usage_reports(spark, tmp_path):
    citations = spark.createDataFrame([("[Doe 2001]", "doe", "2001", "unsupported", None), ("[Li 2019]", "li", "2019", "year-mismatch", 4), ("[Roe 2000]", "roe", "2000", "supported", 1)], "raw string, surname string, year string, verdict string, found_in int")
    markers = spark.createDataFrame([(7, "CITATION NEEDED", ""), (2, "EVIDENCE NEEDED", "why"), (9, "EVIDENCE NEEDED", "x")], "line int, kind string, note string")
    report = reports.citation_report("m.md", citations, markers, 3)
    lines = [r.line for r in report.orderBy("section", "place").collect()]
    assert '- [Doe 2001] — no document mentions "doe"' in lines and '- [Li 2019] — "li" appears in 4, 2019 does not' in lines
    assert lines[-5:] == ["### EVIDENCE NEEDED (2)", "- line 2: why", "- line 9: x", "### CITATION NEEDED (1)", "- line 7: (no detail given)"]
    assert reports.citation_outcome(citations, markers) == (False, "3 citation(s) checked, 1 unsupported, 3 outstanding marker(s)")
    reports.written(report, str(tmp_path / "r"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))).startswith("# Citation check: m.md\n\nChecked 3")
    usage = spark.createDataFrame([(1, "a", "completed", 2, 10, 5, 1, 0, 16, 0.5), (2, "b", "failed", 1, 1, 1, 0, 0, 2, None)], "step_no int, step string, status string, turns int, input bigint, output bigint, cache_read bigint, cache_write bigint, total bigint, cost double")
    assert [r.line for r in reports.usage_lines(usage, "failed").orderBy("place").collect()] == ["a completed 2 10 5 1 0 $0.5000", "b failed 1 1 1 0 0 $0.0000", "TOTAL failed 3 11 6 1 0 $0.5000"]


def test_small_text_functions(spark):
    now = dt.datetime(2024, 1, 1, 0, 0, 0)
    df = spark.createDataFrame([("120",), ("Mon, 01 Jan 2024 00:00:30 GMT",), ("Sun, 31 Dec 2023 00:00:00 GMT",), ("soon",), (None,)], "h string")
    assert [r[0] for r in df.select(text.retry_after_ms(F.col("h"), F.lit(now))).collect()] == [120000.0, 30000.0, 0.0, None, None]
    long = spark.createDataFrame([("\n".join(map(str, range(40))),), ("a\nb",)], "t string")
    assert [r[0].split("\n")[-1] for r in long.select(text.preview(F.col("t"))).collect()] == ["… 10 more lines", "b"]
    paths = spark.createDataFrame([("/x/Über Paper.v2.pdf",), ("C:\\d\\???.md",), (".pdf",)], "p string")
    assert [r[0] for r in paths.select(text.path_slug("p")).collect()] == ["u-ber-paper-v2", "document", "pdf"]
    import re

    assert re.match(text.RUN_ID, text.new_run_id())
    q = spark.createDataFrame([("id", None, None, "7501.1", "T"), ("query", "words", None, None, None), ("id", None, None, None, None), ("query", None, None, None, None)], "kind string, query string, doi string, arxivid string, title string")
    assert [r[0] for r in q.select(text.query_label(*[F.col(c) for c in q.columns])).collect()] == ["7501.1", "words", "(no identifier)", "(empty query)"]
    y = spark.createDataFrame([("plain title",), ("a: b",), ("2 x",), ('say "hi"',)], "t string")
    assert [r[0] for r in y.select(text.yaml_scalar(F.col("t"))).collect()] == ["plain title", '"a: b"', "2 x", 'say "hi"']
    assert ranking and checks
