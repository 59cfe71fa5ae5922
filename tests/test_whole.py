"""Queries do the whole job: inputs that a cap, a first element or an inner join would cut."""

import json

from pyspark.sql import functions as F

from paperloom import composed, parity
from paperloom.operators import checks
from paperloom.sources import adapters
from tests.conftest import rows


def test_reference_index_lists_every_paper_in_order(spark, tmp_path):
    data = [(i, f"Title {i % 7}", None if i % 10 == 0 else 1900 + i % 100) for i in range(1201)]
    spark.createDataFrame(data, "hit_id bigint, title string, year int").write.parquet(f"{tmp_path}/s2_papers.parquet")
    got = [tuple(r) for r in parity.reference_index(spark, str(tmp_path)).collect()]
    assert got == sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0), r[1], r[0]))


def test_followups_unite_all_cards_and_reasons(spark, tmp_path):
    schema = "followup_id bigint, title string, authors string, year int, doi string, arxivid string, reasons array<string>, citedby array<string>, points array<string>"
    data = [(1, "A", None, None, "10.1234/a", None, ["r1", "r2"], ["c1", "c2", "c1"], ["p"]), (2, "A", None, 2020, "10.1234/a", None, ["r2", None, "", "r3"], ["c2", "c3"], ["q", "p"]),
            (3, "B", None, None, None, None, None, None, None), (4, "C", None, None, None, None, [], [], [])]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/followups.parquet")
    assert rows(parity.followup_collate(spark, str(tmp_path)), "key", "n_cards") == [("doi:10.1234/a", 3), ("title:b", 0), ("title:c", 0)]
    got = {r.key: r for r in checks.followup_groups(parity._mentions(spark, str(tmp_path))).collect()}
    assert (got["doi:10.1234/a"].reasons, got["doi:10.1234/a"].cards, got["doi:10.1234/a"].points) == (["r1", "r2", "r3"], ["c1", "c2", "c3"], ["p", "q"])
    assert (got["title:b"].reasons, got["title:b"].cards, got["title:b"].points) == ([], [], [])


def test_records_without_any_key_are_kept(spark, monkeypatch):
    schema = "pos bigint, title string, authors array<string>, abstract string, year int, venue string, doi string, arxivid string, citations bigint, tags array<string>"
    work = lambda pos, title, doi=None: (pos, title, ["Jane Doe"], None, 2020, None, doi, None, 1, None)
    data = [work(2, "深度学习"), work(3, "Машинное обучение"), work(4, "深度学习"), work(5, "تعلم الآلة", "10.1234/a"), work(6, "Tides"), work(8, "Tides"), work(9, "Other", "10.1234/a")]
    monkeypatch.setattr(composed, "_records", lambda *_: spark.createDataFrame(data, schema))
    assert rows(composed.merged_records(spark, ""), "root", "n_records") == [(2, 1), (3, 1), (4, 1), (5, 2), (6, 2)]


def test_answers_are_read_whole(spark):
    n = 450
    entries = "".join(f"<entry><id>http://arxiv.org/abs/{i}</id><title>T{i}</title></entry>" for i in range(n))
    bodies = {adapters.openalex: json.dumps({"results": [{"title": f"T{i}"} for i in range(n)]}), adapters.semantic_scholar: json.dumps({"data": [{"title": f"T{i}"} for i in range(n)]}), adapters.arxiv: f"<feed>{entries}</feed>"}
    for read, body in bodies.items():
        assert rows(read(spark.createDataFrame([(body,)], "body string")), "rank", "title") == [(i, f"T{i}") for i in range(n)]


def test_single_words_get_name_suggestions_too(spark, tmp_path):
    spark.createDataFrame([("Natur",), ("Scence Letters",), (" ",), (None,)], "venue string").write.parquet(f"{tmp_path}/s2_papers.parquet")
    known = spark.createDataFrame([("Nature",), ("Science Letters",)], "name string")
    known.select(F.struct(F.struct(F.col("name").alias("display_name")).alias("source")).alias("primary_location")).write.parquet(f"{tmp_path}/openalex_works.parquet")
    assert rows(parity.name_suggestions(spark, str(tmp_path))) == [("Natur", "Nature", 1), ("Scence Letters", "Science Letters", 1)]
