from pyspark.sql import functions as F

from paperloom.functions import ids, text


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first()["r"]


def test_identifiers_in_any_formatting(spark):
    for raw in ("10.99101/AM.2020.5", " https://doi.example/10.99101/am.2020.5 ", "doi: 10.99101 / am.2020.5", "DOI:10.99101/am.2020.5.", "http://dx.doi.org/10.99101/am.2020.5"):
        assert one(spark, raw, ids.doi) == "10.99101/am.2020.5"
        assert one(spark, raw, ids.arxiv_id) is None
    for raw in ("7501.00094", "arXiv:7501.00094v3", "https://arxiv.example/abs/7501.00094v2", "10.48550/arXiv.7501.00094", "doi:10.48550/ARXIV.7501.00094v1"):
        assert one(spark, raw, ids.arxiv_id) == "7501.00094"
        assert one(spark, raw, ids.doi) is None
    for raw in (None, "", " ", "-", "n/a", "unknown", "10.", "doi:", "0000.00000", "arXiv", "pending"):
        assert one(spark, raw, ids.doi) is None and one(spark, raw, ids.arxiv_id) is None


def test_card_names(spark):
    assert one(spark, " cards/Doe-2020-Tides.md", ids.card_name) == "doe-2020-tides"
    assert one(spark, "doe-2020-tides-2", ids.card_name) == "doe-2020-tides-2"
    assert one(spark, " ", ids.card_name) is None


def test_lead_surname_keeps_particles_and_stops_at_et(spark):
    for raw, name in (("Smith et al.", "Smith"), ("Smith,", "Smith"), ("Van Dijk", "Van Dijk"), ("De la Cruz and Roe", "De la Cruz"), ("et al.", ""), ("", "")):
        assert one(spark, raw, text.lead_surname) == name


def test_slug_and_title_key_differ_in_accents(spark):
    assert one(spark, "González", text.slug) == "gonza-lez"
    assert one(spark, "González", text.title_key) == "gonzalez"
    assert one(spark, "東京", text.slug) == "item"
    assert one(spark, None, text.slug) is None
    assert text.slug_of("a" * 90) == "a" * 80


def test_redaction(spark):
    assert one(spark, "key sk-abcdefghijklmnop1234 end", text.redact) == "key sk-[REDACTED] end"
    assert one(spark, "Authorization: Bearer abcdefghijklmnop12", text.redact).endswith("Bearer [REDACTED]")
    assert one(spark, "a" * 39 + " " + "b" * 40, text.redact) == "a" * 39 + " [REDACTED]"
    assert one(spark, '"api_key": "longsecret"', text.redact) == '"api_key": "[REDACTED]"'


def test_truncation_counts_bytes_and_cuts_no_character(spark):
    assert one(spark, "short", lambda c: text.truncated(c, 100)) == "short"
    cut = one(spark, "ü" * 200, lambda c: text.truncated(c, 100))
    assert len(cut.encode()) <= 100 and cut.startswith("ü") and "[truncated: 400 B of output, capped at 100 B]" in cut and "�" not in cut


def test_duration_and_sizes(spark):
    for ms, shown in ((45_000, "45s"), (150_000, "2m30s"), (120_000, "2m"), (3_900_000, "1h05m"), (7_200_000, "2h"), (-5, "0s")):
        assert one(spark, ms, text.duration, "bigint") == shown
    assert one(spark, 2048, text.byte_size, "bigint") == "2.0 KB"


def test_page_ranges_and_inverted_text(spark):
    assert one(spark, [3, 4, 5, 9], text.page_ranges, "array<int>") == "3-5, 9"
    assert one(spark, [], text.page_ranges, "array<int>") == ""
    assert one(spark, {"b": [1, 3], "a": [0], "c": [-1], "d": None}, text.rebuilt_text, "map<string,array<int>>") == "a b b"
    assert one(spark, {}, text.rebuilt_text, "map<string,array<int>>") is None


def test_numbers_and_names(spark):
    assert one(spark, "12abc", text.leading_int) == 12
    assert one(spark, "abc", text.leading_int) is None
    assert one(spark, "2020-01-02T00:00:00Z", text.year_of) == 2020
    assert one(spark, "1700", text.year_of) is None
    assert one(spark, "Doe, Jane", text.last_name) == one(spark, "Jane Q. Doe", text.last_name) == "Doe"
    assert one(spark, "&lt;b&gt; &#225; &#xe9; &amp;lt;", text.decode_entities) == "<b> á é &lt;"


def test_markdown_and_yaml(spark):
    assert one(spark, " a|b\nc ", text.table_cell) == "a\\|b c"
    assert one(spark, "plain title", text.yaml_scalar) == "plain title"
    assert one(spark, 'with: "quotes"', text.yaml_scalar) == '"with: \\"quotes\\""'
    assert one(spark, " a 　b ", text.collapse) == "a b"
    assert one(spark, "αβγ", text.outside_latin) and not one(spark, "Señor Élan", text.outside_latin)
