"""Text functions as column expressions; Python only where Unicode decomposition is needed."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace including the Unicode spaces that ``trim`` and Java's ``\s`` leave.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Surname particles that stay with the name behind them.
PARTICLES = ("van", "von", "de", "del", "della", "da", "di", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "op")
#: Author part and year of a bracketed citation, and the gap markers of a draft.
CITATION = r"\[\s*(\p{Lu}[^\]\[\d]{0,80}?)\s+(\d{4}[a-z]?)\s*\]"
MARKER = r"(?<![A-Za-z0-9_])(EVIDENCE NEEDED|CITATION NEEDED|SECTION MISSING)(?![A-Za-z0-9_])\s*:?\s*(.*)"
#: Credential shapes and what replaces them, in this order; word boundaries are ASCII.
SECRETS = (
    (r"(?<![A-Za-z0-9_])(sk|pk|rk)-[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_])", "$1-[REDACTED]"),
    (r"(?i)(?<![A-Za-z0-9_])(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{16,}", "$1 [REDACTED]"),
    (r"(?i)(?<![A-Za-z0-9_])[a-f0-9]{40,}(?![A-Za-z0-9_])", "[REDACTED]"),
    (r"""(?i)(["']?(?:api[_-]?key|authorization|token|secret)["']?\s*[:=]\s*["'])[^"']{8,}(["'])""", "$1[REDACTED]$2"),
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """One line: runs of whitespace become single spaces."""
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def or_null(text: Column) -> Column:
    """Trimmed text; blank gives null."""
    bare = strip(text)
    return F.when(F.length(bare) > 0, bare)


def redact(text: Column) -> Column:
    for pattern, shown in SECRETS:
        text = F.regexp_replace(text, pattern, shown)
    return text


def table_cell(text: Column) -> Column:
    """Text that can stand in one cell of a Markdown table."""
    return F.trim(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def yaml_scalar(text: Column) -> Column:
    """One line; bare if it begins with a letter or digit and has no colon or hash, else a JSON string."""
    line = collapse(text)
    return F.when(line.rlike(r"^[A-Za-z0-9][^:#]*$"), line).otherwise(json_string(line))


def json_string(text: Column) -> Column:
    """The JSON form of a string, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def citations(text: Column) -> Column:
    """Bracketed author-year citations of a text: array of their raw strings, in order."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))


def citation_author(raw: Column) -> Column:
    return F.regexp_extract(raw, CITATION, 1)


def citation_year(raw: Column) -> Column:
    """Four digits, without the letter that tells works of one year apart."""
    return F.substring(F.regexp_extract(raw, CITATION, 2), 1, 4)


def lead_surname(authors: Column) -> Column:
    """The name a work is filed under: leading particles and the first other word, up to "et"."""
    words = F.filter(F.transform(F.split(authors, rf"{SPACE}+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: F.length(w) > 0)
    empty = F.struct(F.lit("").alias("name"), F.lit(False).alias("done"))

    def step(state: Column, word: Column) -> Column:
        stop = state["done"] | (F.lower(word) == "et")
        name = F.when(stop, state["name"]).otherwise(F.trim(F.concat(state["name"], F.lit(" "), word)))
        return F.struct(name.alias("name"), (stop | ~F.lower(word).isin(*PARTICLES)).alias("done"))

    return F.aggregate(words, empty, step)["name"]


def word_pattern(key: Column) -> Column:
    """Regular expression that finds ``key`` as whole words, inner whitespace of any width."""
    quoted = F.regexp_replace(F.lower(F.trim(key)), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(quoted, r"\s+", r"\\s+"), F.lit(r"(?![\p{L}\p{N}])"))


def outside_latin(text: Column) -> Column:
    return text.rlike(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]")


def last_name(author: Column) -> Column:
    """"Doe, Jane" and "Jane Doe" both give "Doe"."""
    return F.coalesce(F.when(author.contains(","), strip(F.split_part(author, F.lit(","), F.lit(1)))), F.element_at(F.split(collapse(author), " "), -1), F.lit(""))


def leading_int(text: Column) -> Column:
    """The integer a text begins with, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1), F.lit("")), F.lit("S999999999999999999")).cast("bigint")


def year_of(text: Column) -> Column:
    year = leading_int(F.substring(strip(text), 1, 4))
    return F.when(year > 1800, year.cast("int"))


def first_words(text: Column, n: int) -> Column:
    words = F.split(collapse(text), " ")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("…"))).otherwise(collapse(text))


def duration(ms: Column) -> Column:
    """Two units at most: 45s, 2m30s, 1h05m."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5)).cast("bigint")
    m, h = F.floor(s / 60), F.floor(s / 3600)

    def two(big: Column, a: str, small: Column, b: str) -> Column:
        head = F.concat(big.cast("string"), F.lit(a))
        return F.when(small == 0, head).otherwise(F.concat(head, F.lpad(small.cast("string"), 2, "0"), F.lit(b)))

    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, two(m, "m", s % 60, "s")).otherwise(two(h, "h", m % 60, "m"))


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, a closing notice included; no character is cut in two."""
    size = F.octet_length(text)
    notice = F.concat(F.lit("\n\n[truncated: "), byte_size(size), F.lit(" of output, capped at "), byte_size(F.lit(limit)), F.lit("]"))
    room = F.greatest(F.lit(0), F.lit(limit) - F.octet_length(notice))
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), room).cast("string")), "�+$", "")
    return F.when(size <= limit, text).otherwise(F.concat(head, notice))


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def short_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def _decomposed(text: str) -> str:
    return unicodedata.normalize("NFKD", text).lower()


@F.pandas_udf(T.StringType())
def title_key(titles: pd.Series) -> pd.Series:
    """ASCII letters and digits of the decomposed title: the key titles are compared by."""
    return titles.map(lambda t: re.sub(r"[^a-z0-9]+", "", _decomposed(t)), na_action="ignore")


def slug_of(text: str, fallback: str = "item", limit: int = 80) -> str:
    """File name form: marks of decomposed letters count as separators."""
    bare = re.sub(r"[^a-z0-9]+", "-", _decomposed(text)).strip("-")
    return bare[:limit].rstrip("-") or fallback


@F.pandas_udf(T.StringType())
def slug(texts: pd.Series) -> pd.Series:
    return texts.map(slug_of, na_action="ignore")


_NUMERIC = re.compile(r"&#(?:x([0-9a-f]+)|(\d+));", re.I)


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Named, decimal and hexadecimal entities; the ampersand last, so nothing decodes twice."""

    def point(m: re.Match) -> str:
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if n <= 0x10FFFF else ""

    def decode(text: str) -> str:
        text = _NUMERIC.sub(point, text)
        for name in ("lt", "gt", "quot", "apos", "amp"):
            text = text.replace(f"&{name};", html.unescape(f"&{name};"))
        return text

    return texts.map(decode, na_action="ignore")


def tag_text(xml: Column, name: str) -> Column:
    """Text of the first element ``name``, on one line, entities still encoded."""
    return F.regexp_extract(xml, rf"(?s)<{re.escape(name)}\b[^>]*>(.*?)</{re.escape(name)}>", 1)


def rebuilt_text(index: Column) -> Column:
    """Text of an inverted index {word: positions}; positions below zero are dropped, none gives null."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: p >= 0), lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    ordered = F.transform(F.array_sort(spots), lambda s: s["word"])
    return F.when(F.size(ordered) > 0, F.array_join(ordered, " "))


def page_ranges(pages: Column) -> Column:
    """Sorted page numbers as "3-5, 9"."""
    empty = F.array().cast("array<struct<a:bigint,z:bigint>>")

    def step(done: Column, page: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        p = page.cast("bigint")
        return F.when(last["z"] + 1 == p, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), p.alias("z"))))).otherwise(
            F.concat(done, F.array(F.struct(p.alias("a"), p.alias("z"))))
        )

    ranges = F.aggregate(pages, empty, step)
    shown = F.transform(ranges, lambda r: F.when(r["a"] == r["z"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("-"), r["z"].cast("string"))))
    return F.array_join(shown, ", ")


def slug_of_path(path: str) -> str:
    """File name form of a path's last part without its extension."""
    name = re.split(r"[/\\]", path)[-1]
    return slug_of(re.sub(r"(?<=.)\.[^.]*$", "", name), "document")


@F.pandas_udf(T.StringType())
def path_slug(paths: pd.Series) -> pd.Series:
    return paths.map(slug_of_path, na_action="ignore")


#: Fixed value: the form of a run's id, whose order is the order of time.
RUN_ID = r"^\d{8}T\d{6}-[0-9a-f]{4}$"


def new_run_id(now=None) -> str:
    """UTC stamp and four hexadecimal digits."""
    import datetime
    import secrets

    now = now or datetime.datetime.now(datetime.timezone.utc)
    return f"{now:%Y%m%dT%H%M%S}-{secrets.token_hex(2)}"


def query_label(kind: Column, query: Column, doi: Column, arxiv: Column, title: Column) -> Column:
    """What a search asked for: the first identifier of an id lookup, else the query's text."""
    return F.when(kind == "id", F.coalesce(doi, arxiv, title, F.lit("(no identifier)"))).otherwise(F.coalesce(query, F.lit("(empty query)")))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds a Retry-After header asks for: seconds or an HTTP date; null if it is neither."""
    bare = strip(header)
    at = F.try_to_timestamp(F.regexp_replace(bare, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(at) - F.unix_micros(now)) / 1000
    return F.when(bare.rlike(r"^\d+(\.\d+)?$"), bare.cast("double") * 1000).when(until.isNotNull(), F.greatest(F.lit(0.0), until))  # a date in the past asks for no wait


def preview(text: Column, lines: int = 30) -> Column:
    """The first lines of a text and how many more there are."""
    parts = F.split(text, "\n", -1)
    rest = F.size(parts) - lines
    return F.when(rest > 0, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n… "), rest.cast("string"), F.lit(" more lines"))).otherwise(text)
