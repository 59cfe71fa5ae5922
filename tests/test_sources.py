import json

import pytest
from pyspark.sql import functions as F

from paperloom.plans import pipeline
from paperloom.sources import adapters, scan, sinks
from paperloom.streaming import events as streams
from tests.conftest import rows


def test_document_scan_skips_what_is_none(spark, tmp_path):
    for name in ("a.md", "B.PDF", "_x.md", ".y.md", "README.md", "index.html", "c.txt", "d.bin"):
        (tmp_path / name).write_text("x")
    assert [r.name for r in scan.documents(spark, str(tmp_path)).orderBy("name").collect()] == ["B.PDF", "a.md", "c.txt"]
    assert [r.name for r in scan.documents(spark, str(tmp_path), "pdf").collect()] == ["B.PDF"]


def test_cards_report_broken_front_matter(spark, tmp_path):
    (tmp_path / "good.md").write_text("---\ntitle: Tides\nyear: 2020\ntags: [a, B]\n---\nbody")
    (tmp_path / "bad.md").write_text("---\ntitle: [unclosed\n---\n")
    (tmp_path / "none.md").write_text("no front matter")
    got = {r.name: r for r in scan.cards(spark, str(tmp_path)).withColumn("tags", scan.listed(F.col("fields")["tags"])).collect()}
    assert got["good.md"].fields["title"] == "Tides" and got["good.md"].tags == ["a", "B"] and got["good.md"].error is None
    assert got["bad.md"].error and got["bad.md"].fields is None and got["none.md"].fields == {}


def test_json_items_and_event_log(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"candidates": [{"id": "x"}, {"id": "y"}]}}))
    assert rows(scan.json_items(spark, str(tmp_path / "c.json"), "a.candidates", "struct<id: string>").select("item_index", "item.id")) == [(0, "x"), (1, "y")]
    (tmp_path / "e.jsonl").write_text('{"at":"2024-01-01T00:00:00Z","type":"go","n":1}\nbroken\n\n{"type":"end"}\n')
    assert rows(scan.events(spark, str(tmp_path / "e.jsonl")), "type") == [("end",), ("go",)]


def test_adapters_agree_on_one_work(spark):
    s2 = {"data": [{"paperId": "s1", "title": " Tides ", "year": 2020, "citationCount": 3, "externalIds": {"DOI": "10.1109/X", "ArXiv": "7501.00001v2"}, "authors": [{"name": "Jane Doe"}, {"name": ""}], "openAccessPdf": None}, {"title": ""}]}
    oa = {"results": [{"id": "W1", "display_name": "Tides", "doi": "https://doi.org/10.1109/x", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0]}}]}
    atom = ('<feed><entry><id>http://arxiv.org/abs/7501.00001v3</id><title>Tides\n &amp; waves</title><summary> s </summary><published>2025-01-02</published>'
            "<author><name>J&#225;ne Doe</name></author></entry><entry><id>http://arxiv.org/api/errors#1</id><title>Error</title></entry></feed>")
    frame = lambda b: spark.createDataFrame([(b,)], "body string")
    a = adapters.semantic_scholar(frame(json.dumps(s2))).collect()
    b = adapters.openalex(frame(json.dumps(oa))).collect()
    c = adapters.arxiv(frame(atom)).collect()
    assert len(a) == len(b) == len(c) == 1
    assert (a[0].title, a[0].doi, a[0].arxivid, a[0].authors, a[0].pdf_url) == ("Tides", "10.1109/x", "7501.00001", ["Jane Doe"], "https://arxiv.org/pdf/7501.00001")
    assert (b[0].doi, b[0].abstract) == ("10.1109/x", "a b")
    assert (c[0].title, c[0].authors, c[0].arxivid, c[0].year, c[0].venue) == ("Tides & waves", ["Jáne Doe"], "7501.00001", 2025, "arXiv")
    assert adapters.openalex(frame(json.dumps(oa["results"][0]))).count() == 1


def test_sinks(spark, tmp_path):
    sinks.write_files(spark.createDataFrame([("d/a.md", "text")], "name string, text string"), str(tmp_path))
    assert (tmp_path / "d/a.md").read_text() == "text"
    sinks.append_events(spark.createDataFrame([("sk-abcdefghijklmnop1234",)], "key string"), str(tmp_path / "log"))
    assert "REDACTED" in spark.read.text(str(tmp_path / "log")).first()["value"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"event_id": i, "ts": f"2024-01-01T0{i}:00:00Z", "user_id": 1, "event_type": "view", "value": 1.0} for i in (0, 1, 5)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = streams.event_stream(spark, str(tmp_path / "in"))
    for name, df, mode in (("counts", streams.windowed_counts(stream, "ts", "event_type", "2 hours", "1 hour"), "complete"), ("quiet", streams.silences(stream, "user_id", "ts", 7200, "1 hour"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n_events for r in spark.table("counts").collect()) == [1, 2]
    assert spark.table("quiet").count() == 1


FUNCTIONS = {"double": lambda t, column: t.withColumn(column, F.col(column) * 2), "total": lambda t, column: t.agg(F.sum(column).alias(column))}
PLAN = "version: 1\nsteps:\n- {id: a, uses: double, inputs: ['table:t'], options: {column: '${col}'}}\n- {id: b, uses: total, inputs: [a], options: {column: id}}\n"


def test_plan_runs_and_resumes(spark, tmp_path):
    steps = pipeline.load_plan(PLAN, FUNCTIONS)
    run = lambda t, **more: pipeline.run_plan(spark, steps, FUNCTIONS, t, str(tmp_path), {"col": "id"}, **more)["b"].first()["id"]
    assert run(lambda name: spark.range(4)) == 12
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert run(lambda name: spark.range(4)) == 12 and before == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}  # read back
    with pytest.raises(pipeline.PlanError, match="step a"):
        run(lambda name: spark.range(100))
    assert run(lambda name: spark.range(100), force=True) == 9900


def test_plan_problems_are_all_named(spark):
    with pytest.raises(pipeline.PlanError) as e:
        pipeline.load_plan("version: 1\nsteps:\n- {id: a, uses: nothing, inputs: [z]}\n- {id: a, uses: total}\n", FUNCTIONS)
    assert all(x in str(e.value) for x in ("nothing", "'z'", "used before"))
    assert "4:3 step 1" in str(e.value)
    with pytest.raises(pipeline.PlanError, match="2:1|unknown reference"):
        pipeline.load_plan(PLAN, FUNCTIONS, ["other"])
    assert len(pipeline.load_plan(PLAN, FUNCTIONS, ["col"])) == 2
    with pytest.raises(pipeline.PlanError):
        pipeline.interpolate("${missing}", {})


def test_stage_failures_are_values(spark):
    got = pipeline.apply_stage(spark.range(3), lambda item: {"x": 1 // int(item["id"])}, "id")
    assert [(r.id, r.status) for r in got.orderBy("id").collect()] == [(0, "failed"), (1, "completed"), (2, "completed")]
