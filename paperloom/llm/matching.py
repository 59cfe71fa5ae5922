"""Matching works across two sources without a common key (problem 2).

The q-grams of a record's title and of its first author's name are encoded as fixed
256-bit vectors.  Pairs within ``RADIUS`` bits are found exactly by multi-index Hamming
hashing: two vectors that differ in fewer bits than there are blocks agree in at least
one whole block, so an equi-join on (block number, block) sees every such pair.  The
pairs get field-weighted Dice scores of title, authors and year, which isotonic
regression turns into confidences, calibrated on the pairs whose DOIs agree or differ.

A record is encoded more than once, because sources shorten differently: its whole
title and the title before a colon, each with every long part of the first author's
name (radius 7), and its whole title alone, if it has four words or more that mean
something (radius 3).  Titles like "Introduction" therefore match through an author only.

Defined results: a record without title matches nothing; missing authors or years
count as unknown, not as different; copies of a row add nothing; a correction, comment,
reply or later part never matches the work itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.ids import arxiv_id, doi
from paperloom.llm.reading import isotonic
from paperloom.storage import Scratch

BITS = 256
#: Vector kinds: blocks of equal width; pairs closer than the number of blocks are found.
BLOCKS = {"author": 8, "title": 4}
#: Weights of the fields in a pair's score.
WEIGHTS = {"title": 0.5, "authors": 0.4, "year": 0.1}
#: Pairs below this confidence are not reported as the same work.
THRESHOLD = 0.5
#: Labelled pairs that the score, as its own confidence, counts for in each score interval.
PRIOR_PAIRS = 0.1
#: Score intervals of the calibration, which bounds what it brings to the driver.
BINS = 200

#: Words that carry no meaning of their own in a title.
_FILLERS = frozenset("the a an of and for in on at to from with near off by under is".split())
_PARTICLES = frozenset("von van der den de la del di da bin ibn le el dos dr prof et al jr the".split())
_TAGS = re.compile(r"</?[a-z][^<>]*>", re.I)
_ADDED = re.compile(r"[(\[](?:preprint|technical report|extended version|accepted manuscript|in press|extended abstract)[)\]]\s*\.?\s*$|\bpreprint\s*\.?\s*$", re.I)
_NOTICE = re.compile(r"^\W*(correction|corrigendum|erratum|addendum|retraction|comment|reply|response|rejoinder|discussion)s?\b\W*(?:to|on|for|of)\b\W*", re.I)
_PART = re.compile(r"[\s,:;(\-–—]*\b(?:part\s+(\d+|[ivx]+)|(ii|iii|iv|v|vi)|the (second|third|fourth) (?:decade|part|year))\W*$", re.I)
_NUMBERS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "second": "2", "third": "3", "fourth": "4"}
_WORDS = re.compile(r"[^\W_]+")


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def title_parts(title: str) -> tuple[list[str], list[str], str]:
    """(words, words before a colon, marker) of a title; the marker tells notices and later parts."""
    text = _ADDED.sub("", _TAGS.sub("", title))
    marker = ""
    if found := _NOTICE.match(text):
        marker, text = found[1].lower(), text[found.end() :]
    if found := _PART.search(text):
        number = (found[1] or found[2] or found[3]).lower()
        number = _NUMBERS.get(number, number)
        if number != "1":
            marker, text = f"{marker}#{number}", text[: found.start()]
    head = re.split(r":|\s[-–—]\s", text, maxsplit=1)[0]
    return [w for w in _WORDS.findall(_plain(text)) if w not in _FILLERS], [w for w in _WORDS.findall(_plain(head)) if w not in _FILLERS], marker


def name_words(name: str) -> list[str]:
    """The long words of a name, hyphenated ones joined, without initials and particles."""
    return [w for w in _WORDS.findall(_plain(name).replace("-", "").replace("'", "")) if len(w) > 2 and w not in _PARTICLES]


def _gram_mask(field: str, word: str, memory: dict) -> int:
    key = (field, word)
    mask = memory.get(key)
    if mask is None:
        mask, padded = 0, f"^{word}$"
        for i in range(len(padded) - 1):
            mask |= 1 << (zlib.crc32(f"{field}{padded[i : i + 2]}".encode()) * 2654435761 % 2**32 * BITS >> 32)
        if len(memory) < 500_000:
            memory[key] = mask
    return mask


def _longs(mask: int) -> list[int]:
    return np.frombuffer(mask.to_bytes(BITS // 8, "little"), dtype="<i8").tolist()


_BITS_TYPE = T.ArrayType(T.LongType())
_VECTOR_TYPE = T.StructType().add("kind", "string").add("initial", "string").add("bits", _BITS_TYPE)
_ENCODED = T.StructType().add("vectors", T.ArrayType(_VECTOR_TYPE)).add("title", _BITS_TYPE).add("head", _BITS_TYPE).add("authors", _BITS_TYPE).add("marker", "string").add("plain", "boolean")


@F.pandas_udf(_ENCODED)
def _encode(titles: pd.Series, authors: pd.Series) -> pd.DataFrame:
    memory: dict = {}

    def mask(field: str, words) -> int:
        bits = 0
        for w in words:
            bits |= _gram_mask(field, w, memory)
        return bits

    rows = []
    for title, names in zip(titles, authors, strict=True):
        words, head, marker = title_parts(title)
        named = [name_words(n) for n in names if n]
        vectors, full, short = [], mask("t", words), mask("t", head)
        first = next((n for n in named if n), [])
        for bits in {full, short} if words else ():
            vectors += [{"kind": "author", "initial": w[0], "bits": _longs(bits | mask("a", [w]))} for w in dict.fromkeys(first)]
        plain = len(words) < 4
        if words and not plain:
            vectors.append({"kind": "title", "initial": "", "bits": _longs(full)})
        rows.append((vectors, _longs(full), _longs(short), _longs(mask("a", {w for n in named for w in n})), marker, plain))
    return pd.DataFrame(rows, columns=["vectors", "title", "head", "authors", "marker", "plain"])


def encode(records: DataFrame) -> DataFrame:
    """Distinct ``records`` (id, title, authors array<string>, year, doi, arxiv) with their vectors."""
    rows = records.where("id IS NOT NULL AND title RLIKE '[^\\\\s]'").groupBy("id", "title", "authors").agg(*[F.max(c).alias(c) for c in ("year", "doi", "arxiv")])
    coded = rows.withColumn("e", _encode("title", F.coalesce("authors", F.array().cast("array<string>"))))
    return coded.select(F.monotonically_increasing_id().alias("rid"), "id", "year", "doi", "arxiv", "e.*")


def _blocks(encoded: DataFrame, rid: str) -> DataFrame:
    """(key, rid, fold): one row per block of each vector.

    fold is the vector's four quarters xored: two vectors differ in at least as many
    bits as their folds, which drops most pairs the moment they meet.
    """
    vector = encoded.select(F.col("rid").alias(rid), F.explode("vectors").alias("v")).select(rid, "v.*")
    parts = {}
    for kind, n in BLOCKS.items():
        width = BITS // n
        longs = [F.col("bits")[i] for i in range(BITS // 64)]
        cuts = longs if width == 64 else [F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << width) - 1)) for x in longs for s in range(0, 64, width)]
        parts[kind] = F.transform(F.array(*[F.struct(F.lit(i).alias("no"), c.alias("cut")) for i, c in enumerate(cuts)]), lambda b: F.xxhash64("kind", "initial", b["no"], b["cut"]))
    keys = F.when(F.col("kind") == "author", parts["author"]).otherwise(parts["title"])
    fold = longs[0]
    for part in longs[1:]:
        fold = fold.bitwiseXOR(part)
    return vector.select(rid, fold.alias(f"{rid}_fold"), F.explode(keys).alias("key"))


def _ones(bits: list[Column]) -> Column:
    return sum((F.bit_count(b) for b in bits[1:]), F.bit_count(bits[0]))


def _overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(common, bits of a, bits of b) of two bit vectors."""
    n = range(BITS // 64)
    return _ones([a[i].bitwiseAND(b[i]) for i in n]), _ones([a[i] for i in n]), _ones([b[i] for i in n])


def dice(a: Column, b: Column) -> Column:
    common, left, right = _overlap(a, b)
    return F.when(left + right > 0, 2 * common / (left + right)).otherwise(F.lit(0.0))


def close_pairs(left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """(l, r): rids of all records with vectors of one kind closer than its number of blocks."""
    # exploded blocks are many times what the optimizer expects, so neither side may be broadcast
    met = _blocks(left, "l").join(_blocks(right, "r").hint("merge"), "key")
    met = met.where(F.bit_count(F.col("l_fold").bitwiseXOR(F.col("r_fold"))) < max(BLOCKS.values())).select("l", "r").distinct()
    a = left.select(F.col("rid").alias("l"), F.col("vectors").alias("lv"))
    b = right.select(F.col("rid").alias("r"), F.col("vectors").alias("rv"))
    near = " + ".join(f"bit_count(x.bits[{i}] ^ y.bits[{i}])" for i in range(BITS // 64))
    within = f"exists(lv, x -> exists(rv, y -> x.kind = y.kind AND x.initial = y.initial AND {near} < CASE x.kind WHEN 'author' THEN {BLOCKS['author']} ELSE {BLOCKS['title']} END))"
    return met.join(a, "l").join(b, "r").where(F.expr(within)).select("l", "r")


def scored(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, score, same_doi) of each pair of works, by its best pair of records."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("rid").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "year", "doi", "arxiv", "title", "head", "authors", "marker", "plain")])

    rows = pairs.join(side(left, "l"), "l").join(side(right, "r"), "r").where("l_marker = r_marker")
    title = F.greatest(dice(F.col("l_title"), F.col("r_title")), 0.95 * dice(F.col("l_head"), F.col("r_head")))
    common, a, b = _overlap(F.col("l_authors"), F.col("r_authors"))
    # half Dice, half share of the shorter list, as sources cut lists short
    authors = F.when((a > 0) & (b > 0), common / (a + b) + 0.5 * common / F.least(a, b))
    apart = F.abs(F.col("l_year") - F.col("r_year"))
    year = F.when(apart.isNull(), 0.7).when(apart == 0, 1.0).when(apart == 1, 0.85).when(apart == 2, 0.6).otherwise(0.0)
    known = WEIGHTS["title"] * title + WEIGHTS["year"] * year
    score = F.when(authors.isNotNull(), known + WEIGHTS["authors"] * authors).otherwise(0.9 * known / (WEIGHTS["title"] + WEIGHTS["year"]))
    # a title that says nothing proves nothing: it needs an author and the year
    score = F.when(F.col("l_plain") & F.col("r_plain") & (authors.isNull() | (apart > 1)), 0.0).otherwise(score)
    # identifiers of one kind agree or differ; a DOI says nothing about an arXiv id
    same = F.greatest(F.col("l_doi") == F.col("r_doi"), F.col("l_arxiv") == F.col("r_arxiv"))
    pair = rows.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), score.alias("score"), same.alias("same"))
    return pair.groupBy("left_id", "right_id").agg(F.max("score").alias("score"), F.max("same").alias("same_doi"))


def calibrate(pairs: DataFrame) -> tuple[list[float], list[float]]:
    """Knots of the confidence curve: share of agreeing DOIs by score, made monotone."""
    binned = pairs.where("same_doi IS NOT NULL").groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("same_doi").cast("int")).alias("same"))
    rows = sorted((r["bin"], r["n"], r["same"]) for r in binned.collect())  # BINS + 1 rows at most
    bins = np.arange(BINS + 1)
    centre = np.minimum(1.0, (bins + 0.5) / BINS)
    counts, same = np.full(BINS + 1, PRIOR_PAIRS), PRIOR_PAIRS * centre
    for k, n, agreeing in rows:
        counts[int(k)] += n
        same[int(k)] += agreeing
    knots, values = isotonic(centre, same / counts, counts, steps=True)
    return knots.tolist(), values.tolist()


def _curve(score: Column, knots: list[float], values: list[float]) -> Column:
    """Piecewise linear interpolation as a column."""
    result = F.when(score <= knots[0], F.lit(values[0]))
    for (x0, y0), (x1, y1) in zip(zip(knots, values, strict=True), zip(knots[1:], values[1:], strict=True), strict=False):
        result = result.when(score <= x1, y0 + (score - x0) * ((y1 - y0) / max(x1 - x0, 1e-9)))
    return result.otherwise(F.lit(values[-1]))


def matches(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(left_id, right_id, score, confidence) of the pairs of works at or above ``threshold``."""
    scratch = Scratch(left.sparkSession, "matching")
    left, right = scratch.save(encode(left)), scratch.save(encode(right))
    pairs = scratch.save(scored(left, right, close_pairs(left, right, scratch)))
    knots, values = calibrate(pairs)
    rows = pairs.withColumn("confidence", _curve(F.col("score"), knots, values))
    return rows.where(F.col("confidence") >= threshold).select("left_id", "right_id", "score", "confidence")


def s2_records(papers: DataFrame) -> DataFrame:
    """Semantic Scholar hits as records."""
    ids = F.col("externalids")
    names = F.transform("authors", lambda a: a["name"])
    arxiv = F.coalesce(arxiv_id(ids["ArXiv"]), arxiv_id(ids["DOI"]))
    return papers.select(F.col("paperid").alias("id"), "title", names.alias("authors"), "year", doi(ids["DOI"]).alias("doi"), arxiv.alias("arxiv"))


def openalex_records(works: DataFrame) -> DataFrame:
    """OpenAlex hits as records."""
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    return works.select("id", F.coalesce("display_name", "title").alias("title"), names.alias("authors"), F.col("publication_year").alias("year"), doi(F.col("doi")).alias("doi"), arxiv_id(F.col("doi")).alias("arxiv"))
