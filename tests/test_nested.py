import json

from paperloom.operators import nested
from tests.conftest import rows


def work(**parts):
    return {"id": "W1", "display_name": "T"} | parts


def body(*works, **rest):
    return json.dumps({"meta": {}, "results": list(works)} | rest)


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "response_id bigint, body string, child string")


def test_children_keep_their_parent(spark):
    b = body(work(), work(authorships=[{"author": {"id": "A1"}}, None, {"author": None}, {"author": {"id": " "}}, {"author": {"id": "A2", "display_name": "N"}, "extra": [1]}],
                          primary_location={"source": {"display_name": "J"}}, abstract_inverted_index={"w": [0, 2], "v": [1]}))
    got = rows(nested.child_rows(frame(spark, b)), "result_no", "child", "child_no", "child_key")
    assert got == [(1, "author", 0, "A1"), (1, "author", 4, "A2"), (1, "source", 0, "J"), (1, "term", 0, "w"), (1, "term", 1, "v"), (1, "term", 2, "w")]


def test_odd_positions_lone_objects_and_unreadable_bodies(spark):
    odd = work(authorships={"author": {"id": "A9"}}, abstract_inverted_index={"a": [0, -1, "7", "1,2,3", 3.5, None, 4, 4], "b": None, " ": [5], "c": "x"}, primary_location=None)
    alone = json.dumps({"results": work(authorships=[{"author": {"id": "A1"}}])})
    got = rows(nested.child_rows(frame(spark, body(odd), alone, "{broken", "", None, "null", "[]", json.dumps({"results": None}))), "response_id", "child", "child_no", "child_key")
    assert got == [(0, "author", 0, "A9"), (0, "term", 0, "a"), (0, "term", 4, "a"), (1, "author", 0, "A1")]


def test_positions_beyond_bigint_and_nested_arrays(spark):
    index = '{"big": [99999999999999999999, 1], "deep": [[1, 2, 3], 4], "edge": [9223372036854775807, 9223372036854775808], "whole": [2.0, 2.5]}'
    got = rows(nested.child_rows(frame(spark, '{"results": [{"abstract_inverted_index": ' + index + "}]}")), "child_no", "child_key")
    assert got == [(1, "big"), (2, "whole"), (4, "deep"), (9223372036854775807, "edge")]


def test_flat_tables(spark):
    tables = nested.flat_tables(frame(spark, body(work(publication_year=2020, cited_by_count=3, doi=None, best_oa_location={"pdf_url": "u"}), "no work")))
    assert rows(tables["works"]) == [(0, 0, "W1", None, "T", 2020, 3, "u")]
    assert [tables[t].count() for t in ("authors", "sources", "terms")] == [0, 0, 0]


def test_empty_table(spark):
    assert nested.child_rows(frame(spark).limit(0)).count() == 0


def test_long_bodies(spark):
    many = work(authorships=[{"author": {"id": f"A{i}"}} for i in range(3000)], abstract_inverted_index={f"w{i}": [i] for i in range(5000)})
    assert nested.child_rows(frame(spark, body(many))).count() == 8000
