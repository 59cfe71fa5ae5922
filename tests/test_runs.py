import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from paperloom.plans import runs
from paperloom.sources import readers, requests, scan, sinks
from paperloom.sources.readers import Decision
from paperloom.streaming import events as streams
from tests.conftest import rows


def make_item(item, feedback=None, **_):
    if item["id"] == "bad":
        raise ValueError("no")
    if item["id"] == "short":
        return {"other": 1}
    return {"card": f"card of {item['id']}" + (" again" if feedback else ""), "turns": 2}


FUNCTIONS = {"upper": lambda t, feedback="": t.withColumn("name", F.upper("name")).withColumn("note", F.lit(feedback)), "card": make_item, "fails": lambda t: t.select("nothing")}
STEPS = [runs.RunStep("items", uses="upper", inputs=("table:t",)), runs.RunStep("cards", "foreach", "card", ("items",), outputs=("card",)), runs.RunStep("gate", "gate", inputs=("cards",), on_reject="items"), runs.RunStep("last", uses="upper", inputs=("items",))]


def items(spark, *ids):
    return spark.createDataFrame([(i, k, i) for k, i in enumerate(ids)], "id string, item_index int, name string")


def test_a_run_fans_out_waits_is_sent_back_and_ends(spark, tmp_path):
    said = []
    gate = lambda step, run: said.pop(0) if said else None
    make = lambda *ids, steps=STEPS, **more: runs.Run(spark, str(tmp_path / "r"), steps, FUNCTIONS, lambda name: items(spark, *ids), {"a": "b"}, gate, **more)
    run = make("x", "bad", "short", "y")
    assert run.run() == "awaiting"
    assert run.state["steps"]["cards"]["tally"] == {"completed": 2, "failed": 2, "carried": 0, "turns": 4}
    assert rows(run.failures()) == [("cards", "bad", "ValueError: no"), ("cards", "short", "MISSING_OUTPUT: card")]
    assert [r.id for r in run.table("cards").orderBy("item_index").collect()] == ["x", "bad", "short", "y"]
    with pytest.raises(runs.DriftError):
        make("x", steps=STEPS[:3])
    said += [Decision("revise", "more"), Decision("approve")]
    again = make("x", "bad", "short", "y")
    assert again.run() == "completed" and "more" in again.table("items").first()["note"]
    # carried items keep their work; those that failed were tried again
    assert again.state["steps"]["cards"]["tally"] == {"completed": 0, "failed": 2, "carried": 2, "turns": 4}
    assert again.state["steps"]["items"]["attempts"] == 2 and (tmp_path / "r/items/attempt=1").exists()
    assert again.redo("cards", "anew") == "awaiting"
    assert "card of x again" in {json.loads(r.outputs)["card"] for r in again.table("cards").where("status = 'completed'").collect()}
    assert scan.events(spark, str(tmp_path / "r/events")).where("type = 'gate_decided'").count() == 2
    assert make("x", steps=STEPS[:3], force=True).state["run_id"] == again.state["run_id"]


def test_failing_steps_and_budgets_end_a_run(spark, tmp_path):
    table = lambda name: items(spark, "x", "bad")
    run = runs.Run(spark, str(tmp_path / "a"), [runs.RunStep("s", uses="fails", inputs=("table:t",)), STEPS[0]], FUNCTIONS, table)
    assert run.run() == "failed" and "items" not in run.state["steps"] and run.failures().count() == 1
    strict = [runs.RunStep("c", "foreach", "card", ("table:t",), max_failures=1)]
    assert runs.Run(spark, str(tmp_path / "b"), strict, FUNCTIONS, table).run() == "failed"
    empty = [runs.RunStep("none", uses="upper", inputs=("table:t",)), runs.RunStep("g", "gate", inputs=("none",), optional=True)]
    assert runs.Run(spark, str(tmp_path / "c"), empty, FUNCTIONS, lambda name: items(spark)).run() == "completed"
    abort = [STEPS[0], runs.RunStep("g", "gate", inputs=("items",))]
    assert runs.Run(spark, str(tmp_path / "d"), abort, FUNCTIONS, table, gate=lambda s, r: Decision("abort")).run() == "failed"
    with pytest.raises(runs.PlanError) as e:
        runs.checked([runs.RunStep("a", "odd"), runs.RunStep("a", "foreach", "card", ("z", "y"), on_reject="q")], FUNCTIONS)
    assert all(x in str(e.value) for x in ("'odd'", "'z'", "'q'", "one input", "used before"))


def test_outcomes_contracts_models_and_preflight(spark):
    df = spark.createDataFrame([(1, True, True, False, True, "m"), (2, False, False, True, True, "m"), (3, False, False, False, True, "m"), (4, False, False, False, False, "m"), (5, False, False, False, False, None)], "n int, b boolean, t boolean, s boolean, a boolean, m string")
    got = df.select("n", runs.stage_outcome(*[F.col(c) for c in "btsam"]).alias("o")).orderBy("n").select("o.status", "o.code").collect()
    assert [tuple(r) for r in got] == [("failed", "TURN_BUDGET_EXCEEDED"), ("failed", "TIMEOUT"), ("aborted", "EXTERNAL_ABORT"), ("failed", "AGENT_ERROR"), ("completed", None)]
    results = spark.createDataFrame([("a", "failed", '{"x": 1}', "TURN_BUDGET_EXCEEDED: 9"), ("b", "completed", "{}", None), ("c", "failed", None, "boom")], "id string, status string, outputs string, error string")
    assert rows(runs.contract(results, ("x",)), "id", "status", "error") == [("a", "completed", None), ("b", "failed", "MISSING_OUTPUT: x"), ("c", "failed", "boom")]
    steps = spark.createDataFrame([("s", "w", None, 5), ("t", "r", "p/m2", None), ("u", "q", None, None)], "step string, agent string, model string, max_turns int")
    agents = spark.createDataFrame([("w", "p/m1", 9), ("r", None, None)], "name string, model string, max_turns int")
    choices = runs.model_choices(steps, agents, "z/m3")
    assert rows(choices) == [("s", "w", "p/m1", 9), ("t", "r", "p/m2", None), ("u", "q", "z/m3", None)]
    assert rows(runs.preflight(choices, spark.createDataFrame([("p/m1",), ("z/m3",)], "model string"), spark.createDataFrame([("p",)], "provider string"))) == [("p", "unknown model p/m2"), ("z", "no credentials")]


def test_gates_answered_through_files(spark, tmp_path):
    steps = [STEPS[0], runs.RunStep("g", "gate", inputs=("items",))]
    make = lambda: runs.Run(spark, str(tmp_path / "r"), steps, FUNCTIONS, lambda name: items(spark, "x"), gate=runs.file_gate(spark, str(tmp_path / "gates")))
    assert make().run() == "awaiting" and json.loads((tmp_path / "gates/g.request.json").read_text())["step"] == "g"
    (tmp_path / "gates/g.decision.json").write_text('{"action": "approve"}')
    assert make().run() == "completed" and (tmp_path / "gates/g.decision.json").read_text() == ""


def test_defaults_and_deletion(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"model": " m ", "thinking": 3}')
    assert readers.run_defaults(spark, str(tmp_path / "d.json")) == {"model": "m"} and readers.run_defaults(spark, str(tmp_path / "none")) == {}
    (tmp_path / "a.md").write_text("x")
    assert sinks.delete_files(spark.createDataFrame([("a.md",), ("gone.md",)], "name string"), str(tmp_path)) == 1 and not (tmp_path / "a.md").exists()


def test_item_sources(spark, tmp_path):
    for n in ("Über x.md", "b.md"):
        (tmp_path / n).write_text("x")
    assert [(r.id, r.item_index, r.stem) for r in readers.glob_items(spark, str(tmp_path / "*.md")).orderBy("item_index").collect()] in ([("b", 0, "b"), ("u-ber-x", 1, "Über x")], [("u-ber-x", 0, "Über x"), ("b", 1, "b")])
    (tmp_path / "i.json").write_text(json.dumps({"a": {"l": [{"id": "IP 1", "t": 1}, {"t": 2}, "Some Thing", 7]}}))
    got = readers.json_items(spark, str(tmp_path / "i.json"), "a.l").orderBy("item_index").collect()
    assert [(r.id, r.stem) for r in got] == [("ip-1", None), ("item-2", None), ("some-thing", "Some Thing"), ("7", "7")]
    assert rows(readers.literal_items(spark, ["A b", 3]), "id", "item_index") == [("3", 1), ("a-b", 0)]
    for bad in (lambda: readers.json_items(spark, str(tmp_path / "i.json"), "a"), lambda: readers.literal_items(spark, ["a b", "A  B"])):
        with pytest.raises(readers.ReadError):
            bad()


def test_lists_and_control_files(spark, tmp_path):
    p = lambda name, body: (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body)) and str(tmp_path / name)
    q = readers.queries(spark, p("q.json", {"queries": [{"point": "p", "query": " tides "}, {"query": "lost"}, {"point": "q", "kind": "id", "doi": "10.1/x", "limit": 3}]}))
    assert rows(q, "query_no", "kind", "query", "doi", "limit") == [(0, "query", "tides", None, None), (2, "id", None, "10.1/x", 3)]
    with pytest.raises(readers.ReadError):
        readers.queries(spark, p("bad.json", "{}"))
    assert readers.results(spark, str(tmp_path / "none.json")).count() == 0 and readers.results(spark, p("r0.json", "{broken")).count() == 0
    assert readers.results(spark, p("r.json", {"papers": [{"id": "a", "arxivId": "7501.1"}]})).first()["arxivid"] == "7501.1"
    assert readers.manifest(spark, str(tmp_path / "none.json")).count() == 0
    rows_ = readers.manifest(spark, p("m.json", {"papers": [{"id": "b", "status": "failed", "points": ["x"]}, {"id": "a"}]}))
    assert rows(rows_, "id", "status", "points") == [("a", None, None), ("b", "failed", ["x"])]
    readers.write_manifest(rows_, str(tmp_path / "out"))
    assert [json.loads(x)["id"] for f in sorted(pathlib.Path(tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()] == ["a", "b"]
    for name, body, word in (("none", None, "no run state"), ("s1", "{", "not valid"), ("s2", '{"version": 9}', "version 9")):
        with pytest.raises(readers.ReadError, match=word):
            readers.checkpoint(spark, str(tmp_path / name) if body is None else p(name, body))
    readers.write_small(spark, str(tmp_path / "x/y.txt"), "ü")
    assert readers.read_small(spark, str(tmp_path / "x/y.txt")) == "ü" and readers.read_small(spark, str(tmp_path / "x/z")) is None
    assert readers.decision('{"action": "reject", "feedback": " more ", "keep": [1]}') == Decision("revise", "more", None, None)
    assert readers.decision('{"action": "approve", "keep": ["a"]}').keep == ("a",) and readers.decision("{") is None and readers.decision(None) is None and readers.decision('{"action": "x"}') is None
    assert (readers.option({"n": " 150 "}, "n", 3), readers.option({"n": "x"}, "n", 3), readers.option({"s": " a "}, "s", "z"), readers.option({}, "s", "z"), readers.option({"b": "yes"}, "b", False)) == (150, 3, "a", "z", True)
    for name in ("20240101T000000-00ff", "20250101T000000-0000", "latest"):
        (tmp_path / "runs" / name).mkdir(parents=True)
    assert readers.latest_run(spark, str(tmp_path / "runs")) == "20250101T000000-0000" and readers.latest_run(spark, str(tmp_path / "no")) is None
    assert readers.inside("/w", "a/../b") == "/w/b"
    with pytest.raises(readers.ReadError):
        readers.inside("/w", "../x")


def test_agents(spark, tmp_path):
    for folder, name, body in (("a", "w.md", "---\nname: writer\ndescription: d\ntools: read, write\nmax_turns: 3\noutputs: out.md\ncolour: red\n---\nDo it."), ("b", "w.md", "---\nname: writer\ndescription: later\ntools: none\n---\n"), ("b", "x.md", "---\nname: x\nmax_turns: 0\n---\n"), ("b", "y.md", "nothing")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(body)
    first, none = readers.discover_agents(spark, [str(tmp_path / "a")])
    assert (first[0].tools, first[0].max_turns, first[0].outputs, first[0].extra, first[0].body, none) == (("read", "write"), 3, ("out.md",), {"colour": "red"}, "Do it.", [])
    both, problems = readers.discover_agents(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c")])
    assert [(a.description, a.tools) for a in both] == [("later", ())] and len(problems) == 2 and "max_turns" in problems[0]
    assert readers.tool_list("all") is None
    with pytest.raises(readers.ReadError):
        readers.tool_list(["fly"])


def test_collected_inputs_and_source_texts(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    for n in ("d/a.md", "d/README.md", "x.docx", "d/sub/B.txt", "d/_p.md"):
        (tmp_path / n).write_text("Text")
    got = readers.collected(spark, [str(tmp_path / "x.docx"), str(tmp_path / "d"), str(tmp_path / "gone")])
    assert [r.name for r in got.collect()] == ["a.md", "x.docx"] and [r.name for r in readers.collected(spark, [str(tmp_path / "x.docx"), str(tmp_path / "d")], "md").collect()] == ["a.md"]
    assert readers.collected(spark, []).count() == 0
    assert [r.text for r in readers.source_texts(spark, str(tmp_path / "d")).collect()] == ["text", "text"]


def test_request_addresses(spark):
    q = spark.createDataFrame([("query", ' a "b" c ', None, None, None, 999), ("id", None, "10.1/x y", "7501.1", "T t", 5), ("id", None, None, None, "T t", 5), ("query", " ", None, None, None, 1)], "kind string, query string, doi string, arxivid string, title string, n int")
    c = {x: F.col(x) for x in q.columns}
    a = [r[0] for r in q.select(requests.arxiv_url(c["kind"], c["query"], c["arxivid"], c["title"], c["n"])).collect()]
    s = [r[0] for r in q.select(requests.semantic_scholar_url(c["kind"], c["query"], c["doi"], c["arxivid"], c["n"])).collect()]
    o = [r[0] for r in q.select(requests.openalex_url(c["kind"], c["query"], c["doi"], c["title"], c["n"], "me@x.example")).collect()]
    assert a[0].endswith("?search_query=all%3Aa%20%20b%20%20c&start=0&max_results=100&sortBy=relevance") and a[1].endswith("?id_list=7501.1&max_results=1") and a[2].endswith("?search_query=ti%3A%22T%20t%22&max_results=5") and a[3] is None
    assert "query=a%20%22b%22%20c&limit=100" in s[0] and "/paper/DOI:10.1%2Fx%20y?" in s[1] and s[2] is None
    assert o[0].endswith("search=a%20%22b%22%20c&per-page=200&mailto=me%40x.example") and o[1].endswith("/works/doi:10.1%2Fx%20y?mailto=me%40x.example") and "title.search%3AT%20t&per-page=5" in o[2]


def test_silences_that_never_end_are_told(spark, tmp_path):
    stream_in = tmp_path / "in"
    stream_in.mkdir()
    line = lambda k, at: json.dumps({"event_id": 1, "ts": at, "user_id": k, "event_type": "v", "value": 1.0})
    (stream_in / "a.json").write_text("\n".join([line(1, "2024-01-01T00:00:00Z"), line(2, "2024-01-01T00:00:00Z")]))
    quiet = streams.silences(streams.event_stream(spark, str(stream_in), files_per_trigger=1), "user_id", "ts", 3600, "10 minutes")
    q = quiet.writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    for n, at in (("b", "2024-01-01T00:30:00Z"), ("c", "2024-01-01T05:00:00Z"), ("d", "2024-01-01T05:30:00Z")):
        (stream_in / f"{n}.json").write_text(line(2, at))
        q.processAllAvailable()
    assert streams.progress(q)["batch"] >= 3
    q.stop()
    got = rows(spark.table("ended"), "user_id", "last_at", "next_at")
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    assert (1, at(0), None) in got and (2, at(0, 30), at(5)) in got and len(got) == 2


def test_heartbeats(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, s // 60, s % 60)
    df = spark.createDataFrame([("k", at(s)) for s in (0, 15, 25, 40, 46)] + [("l", at(1))], "key string, at timestamp")
    assert [r.beat for r in streams.heartbeats(df, "key", "at", 20).orderBy("key", "at").collect()] == [True, False, True, False, True, True]
