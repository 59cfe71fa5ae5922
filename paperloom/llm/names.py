"""Variant spellings of names typed by people (problem 1).

Method: noisy-channel attribution.  Spellings are counted and parsed into forms
(given name, middle initials, surname; or place and words of an organisation), which
undoes order, case, titles and accents.  Frequent full forms are candidate canonical
forms; every form is joined with the candidates that share a key with it and attached
to the one of maximum posterior: a frequency prior, and the likelihood of the typo,
nickname or abbreviation that would turn the candidate into the form.

The likelihoods are learnt from the data: where a source gives spellings an author id,
the spellings of one id are labelled pairs (``learn``).  They tell which given names
are short for which, how often, and how often initials and typos occur.  Names without
an id, and those of ids not seen, are attributed by what was learnt; ids themselves
link nothing.  Without any id no nickname is known and default likelihoods hold.

Nothing is paired within a surname or any other group: a form only meets candidates of
its own given name (or one it is short for) whose surname is one edit away, of its own
surname whose given name is one edit away, or, if it has initials only, of its initial
and a surname at most one edit away; on distinct forms and not on rows.  Statistics
cover all spellings.

Defined results: null and blank names are no names; a spelling that fits no other
author stands alone; ties go to the smaller form; repeated rows raise the frequency;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.storage import Scratch

#: Words that stand between given name and surname, and titles.
_PARTICLES = frozenset("von van der den de la del di da dos bin ibn al el le ter ten zu".split())
_TITLES = re.compile(r"^(?:(?:Dr|DR|dr|Prof|prof|Professor|Mr|Mrs|Ms|Sir)\b\.?\s+)+")
#: Words only organisations carry, with what they are shortened to.
_ORG = re.compile(r"\b(?:institute?|inst\.|network|netw\.|working group|group|wg|collaboration|collab\.|consortium|consort\.|observatory|obs\.|centre|center|survey|university|univ\.|agency|council|laboratory|lab\.|society|association|team|project)(?:\W|$)", re.I)
_ORG_WORDS = frozenset("institute network working group wg collaboration consortium observatory centre center survey university agency council laboratory society association team project inst netw collab consort obs univ lab".split())
_GLUE = frozenset("the of for and on in".split())

#: Negative log-likelihoods of what a typist does to a canonical form, before any labelled pair is seen.
COSTS = {"nickname": 2.0, "initial": 1.0, "typo": 3.5, "middle_agrees": -2.0, "middle_differs": 6.0}
#: Labelled pairs the default likelihoods count for.
PRIOR_PAIRS = 50
#: A given name is short for another if at least this share of its labelled authors are known by the other.
NICKNAME_SHARE = 0.1
#: A given name borne with so many times fewer surnames may be a typo of the other.
GIVEN_RATIO = 5


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def _letters(text: str) -> str:
    return re.sub(r"[\W\d_]+", "", plain(text)).replace("ph", "f")


def _is_initials(token: str) -> bool:
    bare = token.replace(".", "").replace("-", "")
    return 0 < len(bare) <= 3 and bare.isalpha() and bare.isupper() and ("." in token or len(bare) <= 2)


def _in_front(token: str) -> bool:
    """Initials, but not a particle in capitals."""
    return _is_initials(token) and token.lower() not in _PARTICLES


def _person(given: list[str], family: list[str], turned: bool) -> dict | None:
    surname = _letters("".join(family))
    if not surname or not given:
        return None
    full = [t for t in given if not _is_initials(t)]
    first = _letters(full[0]) if full else ""
    initials = "".join(_letters(t) if _is_initials(t) else _letters(t)[:1] for t in given)
    if full and _is_initials(given[0]):  # "J. Robert Smith": known by the second name
        first = ""
    return {"kind": "person", "given": first, "initial": (first or initials)[:1], "middle": initials[1:], "surname": surname, "turned": turned}


def readings(name: str) -> list[dict]:
    """The ways a spelling can be read; the plainest comes first."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip()
    if _ORG.search(text):
        bare = re.sub(r"\([^)]*\)", " ", text)
        head, _, tail = bare.partition(",")
        words = [w for w in re.findall(r"[^\W\d_]+", plain(head)) if w not in _GLUE]
        place = [w for w in re.findall(r"[^\W\d_]+", plain(tail))]
        if place:
            kinds = [w for w in words if w in _ORG_WORDS]
            words = place + [w for w in words if w not in _ORG_WORDS] + kinds
        return [{"kind": "org", "given": " ".join(words[1:]), "initial": "", "middle": "", "surname": words[0].replace("ph", "f"), "turned": False}] if words else []
    text = _TITLES.sub("", text)
    if "," in text:
        family, _, given = text.partition(",")
        own = [t for t in given.split() if t.lower() not in _PARTICLES]
        moved = [t for t in given.split() if t.lower() in _PARTICLES]
        found = [_person(own, moved + family.split(), False)]
        return [r for r in found if r]
    tokens = text.split(" ")
    found = []
    if len(tokens) == 1:
        return [{"kind": "person", "given": "", "initial": "", "middle": "", "surname": s, "turned": False}] if (s := _letters(text)) else []
    k = len(tokens)
    while k > 1 and _is_initials(tokens[k - 1]):
        k -= 1
    if k < len(tokens) and k >= 1 and not _is_initials(tokens[0]):  # "Smith JR"
        found.append(_person(tokens[k:], tokens[:k], False))
    else:
        cut = 1  # "J. R. van der Smith": the surname begins after given names and initials
        while cut < len(tokens) - 1 and _in_front(tokens[cut]):
            cut += 1
        particle = next((i for i in range(1, len(tokens) - 1) if tokens[i].lower() in _PARTICLES), None)
        if particle is not None and particle >= cut:
            cut = particle
        elif len(tokens) - cut > 1 and not (tokens[cut].lower() in _PARTICLES):
            cut = len(tokens) - 1
        found.append(_person(tokens[:cut], tokens[cut:], False))
        if particle is None and cut == len(tokens) - 1 and cut > 1 and not _is_initials(tokens[cut - 1]):  # "Jane Double Name"
            found.append(_person(tokens[: cut - 1], tokens[cut - 1 :], False))
        if not _is_initials(tokens[0]) and not _is_initials(tokens[-1]):  # "Smith Jane"
            found.append(_person(tokens[-1:], tokens[:-1], True))
    for short, place in (tokens[::-1], tokens) if len(tokens) == 2 else ():  # "Place ABC", "ABC Place"
        if short.isupper() and short.isalpha() and 3 <= len(short) <= 6 and _letters(place):
            found.append({"kind": "org", "given": "*" + short.lower(), "initial": "", "middle": "", "surname": _letters(place), "turned": True})
    return [r for r in found if r]


_READING = T.StructType().add("kind", "string").add("given", "string").add("initial", "string").add("middle", "string").add("surname", "string").add("turned", "boolean")


@F.pandas_udf(T.ArrayType(_READING))
def _readings_udf(names: pd.Series) -> pd.Series:
    return names.map(readings)


def distance(a: str, b: str) -> int:
    """Edits between two words, swapped neighbours counting as one; 2 stands for more than one."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    x, y = a[start:], b[start:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if len(x) <= 1 and len(y) <= 1:
        return 1
    return 1 if len(x) == len(y) == 2 and x == y[::-1] else 2


def _deletions(word: str) -> str:
    """SQL for ``word`` and all words one letter shorter: words one edit apart share one."""
    return f"array_union(array({word}), transform(sequence(1, greatest(1, length({word}))), i -> concat(substring({word}, 1, i - 1), substring({word}, i + 1))))"


def _keys(canonical: bool) -> Column:
    """Keys under which forms (kind, given, initial, surname, fulls) meet candidates."""
    surnames, givens = _deletions("surname"), _deletions("given")
    names = "array(given)" if canonical else "array_union(array(given), transform(fulls, f -> f.full))"
    full = f"concat(flatten(transform({names}, g -> transform({surnames}, d -> concat('f|', g, '|', d)))), transform({givens}, d -> concat('g|', surname, '|', d)))"
    brief = f"transform({surnames}, d -> concat('i|', initial, '|', d))"
    person = f"concat({full}, {brief})" if canonical else f"CASE WHEN given <> '' THEN {full} ELSE {brief} END"
    return F.expr(f"array_distinct(CASE WHEN kind = 'org' THEN transform({surnames}, d -> concat('o|', d)) ELSE {person} END)")


def _org_cost(words: str, other: str, costs: dict) -> float:
    """Cost of writing the organisation ``other`` as ``words``; both without the place."""
    if words == other:
        return 0.0
    long = other.replace("wg", "working group").split()
    if words[:1] == "*" or other[:1] == "*":
        short, full = (words[1:], long) if words[:1] == "*" else (other[1:], words.replace("wg", "working group").split())
        return costs["initial"] + 1 if short == "".join(w[0] for w in full) else math.inf
    short = words.replace("wg", "working group").split()
    cost, at = 0.0, 0
    for word in short:  # in order, each word shortens or misspells one of the other's
        for step in range(at, len(long)):
            if long[step].startswith(word) and len(word) > 1:
                cost += 0.0 if word == long[step] else 0.5
                break
            if distance(word, long[step]) == 1 and len(word) > 1:
                cost += costs["typo"]
                break
        else:
            return math.inf
        cost += 1.0 * (step - at)
        at = step + 1
    return cost + 1.0 * (len(long) - at) if len(short) * 2 >= len(long) else math.inf


def channel(kind: str, given: str, initial: str, middle: str, surname: str, given2: str, middles2: str, surname2: str, kind2: str, nickname: float | None = None, costs: dict = COSTS) -> float:
    """Negative log-likelihood of the first form, typed for the canonical second one; infinite if it isn't one.

    ``nickname``: that of the given name as a short form of the second one, if it is known as one.
    """
    if kind != kind2:
        return math.inf
    apart = distance(surname, surname2)
    if apart > 1 or (apart and min(len(surname), len(surname2)) < 4):
        return math.inf
    cost = costs["typo"] * apart
    if kind == "org":
        return cost + _org_cost(given, given2, costs)
    if not given:
        if initial and given2[:1] != initial:
            return math.inf
        cost += costs["initial"]
    elif given != given2:
        if nickname is not None and nickname == nickname:
            cost += nickname
        elif distance(given, given2) == 1 and min(len(given), len(given2)) > 3 and not apart:
            cost += costs["typo"]
        else:
            return math.inf
    if middle and middles2:
        cost += costs["middle_agrees"] if set(middle) & set(middles2) else costs["middle_differs"]
    return cost


def _channel_column(costs: dict) -> Column:
    @F.pandas_udf(T.DoubleType())
    def priced(kind: pd.Series, given: pd.Series, initial: pd.Series, middle: pd.Series, surname: pd.Series, given2: pd.Series, middles2: pd.Series, surname2: pd.Series, kind2: pd.Series, nickname: pd.Series) -> pd.Series:
        return pd.Series([channel(*row, costs=costs) for row in zip(kind, given, initial, middle, surname, given2, middles2, surname2, kind2, nickname, strict=True)])

    return priced("kind", "given", "initial", "middle", "surname", "given2", "middle2", "surname2", "kind2", "nickname")


@F.pandas_udf(T.IntegerType())
def _distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def spellings(*columns: DataFrame) -> DataFrame:
    """(name, n): every non-blank spelling of the one-column ``columns`` and its rows."""
    rows = columns[0]
    for more in columns[1:]:
        rows = rows.union(more)
    rows = rows.toDF("name").where("name RLIKE '[\\\\p{L}]'")
    return rows.groupBy("name").agg(F.count("*").alias("n"))


def followup_names(followups: DataFrame) -> DataFrame:
    bare = F.regexp_replace("authors", r"(?i)[;,]?\s*\bet al\.?\s*$", "")
    return followups.select(F.explode(F.split(bare, "; ")).alias("name"))


def all_names(papers: DataFrame, works: DataFrame, followups: DataFrame) -> DataFrame:
    """(name, n) over the three fields of problem 1."""
    s2 = papers.select(F.explode("authors").alias("a")).select("a.name")
    openalex = works.select(F.explode("authorships").alias("a")).select("a.author.display_name")
    return spellings(s2, openalex, followup_names(followups))


def labelled_names(papers: DataFrame, works: DataFrame) -> DataFrame:
    """(person, name): spellings under the author id a source gave them."""
    s2 = papers.select(F.explode("authors").alias("a")).select(F.concat(F.lit("s"), "a.authorid").alias("person"), "a.name")
    openalex = works.select(F.explode("authorships").alias("a")).select(F.concat(F.lit("o"), "a.author.id").alias("person"), F.col("a.author.display_name").alias("name"))
    return s2.union(openalex).where("person IS NOT NULL AND name IS NOT NULL").distinct()


_FORM = ["kind", "given", "initial", "middle", "surname"]


def _chosen_readings(names: DataFrame) -> DataFrame:
    """One form per spelling: a turned reading is taken if its given name is far commoner as one."""
    read = names.select("name", "n", F.posexplode(_readings_udf("name")).alias("no", "r")).select("name", "n", "no", "r.*")
    straight = read.where("kind = 'person' AND NOT turned AND given <> ''")
    usual = straight.groupBy("given").agg(F.count_distinct("surname").alias("df"))
    places = read.where("kind = 'org' AND NOT turned").groupBy("surname").agg(F.lit(True).alias("is_place")).withColumnRenamed("surname", "place")
    known = read.where("no = 0").groupBy("surname").agg(F.count("*").alias("known"))
    scored = read.join(known, "surname", "left").join(usual, "given", "left").join(places, (F.col("kind") == "org") & F.col("turned") & (F.col("surname") == F.col("place")), "left")
    df = F.coalesce("df", F.lit(0))
    others = 3 * F.log1p(F.coalesce("known", F.lit(0)) - F.when(F.col("no") == 0, 1).otherwise(0))
    merit = F.when(F.col("kind") == "org", F.when(F.col("turned"), F.when(F.col("is_place"), 1e9).otherwise(-1.0)).otherwise(1e9)).when(F.col("turned"), df / 3.0 - 0.5 + others).otherwise(df + others)
    return scored.groupBy("name").agg(F.max_by(F.struct("n", *_FORM), F.struct(merit, -F.col("no"))).alias("best")).select("name", "best.*")


def learn(read: DataFrame, forms: DataFrame, labelled: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict]:
    """(short forms, likelihoods) from the spellings of ``labelled`` (person, name), an author id each.

    The commonest given name of an id is its canonical one; every other spelling of the
    id with a form of its own is compared with that one alone, so an id with any number
    of spellings costs as many rows.  Short forms: (given, fulls array<struct<full,
    cost>>); as every id has one canonical name and the share a full name needs is
    ``NICKNAME_SHARE``, a given name has 1 / NICKNAME_SHARE full ones at most.
    """
    known = read.where("kind = 'person'").select("name", "given", "initial", "surname", "form").join(forms.select("form", "given_df", "freq"), "form")
    rows = labelled.join(known, "name").groupBy("person", "given", "initial", "surname").agg(F.max("given_df").alias("df"), F.max("freq").alias("freq"))
    rows = scratch.save(rows)
    modes = rows.where("given <> ''").groupBy("person").agg(F.max(F.struct("df", "freq", "given", "surname")).alias("m")).select("person", F.col("m.given").alias("full"), F.col("m.surname").alias("full_surname"))
    met = rows.join(modes, "person").withColumn("apart", _distance_udf("given", "full")).withColumn("surname_apart", _distance_udf("surname", "full_surname"))
    met = scratch.save(met)
    own = met.where("given <> '' AND surname_apart = 0").groupBy("given", "full").agg(F.count("*").alias("n"), F.max("apart").alias("apart"))
    borne = own.groupBy("given").agg(F.sum("n").alias("all"))
    called = modes.groupBy("full").agg(F.count("*").alias("authors"))
    pairs = own.where("given <> full AND apart > 1").join(borne, "given").join(called, "full").where(F.col("n") >= NICKNAME_SHARE * F.col("all"))
    cost = -F.log((F.col("n") + 0.5) / (F.col("authors") + 1.0))
    short = pairs.groupBy("given").agg(F.array_sort(F.collect_list(F.struct("full", cost.alias("cost")))).alias("fulls"))
    counts = met.agg(F.count("*").alias("n"), F.count_if(F.expr("given = ''")).alias("initial"), F.count_if(F.expr("(given <> '' AND apart = 1 AND surname_apart = 0) OR (surname_apart = 1 AND given IN ('', full))")).alias("typo")).first()
    costs = dict(COSTS)
    for kind in ("initial", "typo"):
        costs[kind] = -math.log((counts[kind] + PRIOR_PAIRS * math.exp(-COSTS[kind])) / (counts["n"] + PRIOR_PAIRS))
    return scratch.save(short), costs


def attributed(names: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(name, n, canonical, posterior): the canonical form each spelling of ``names`` (name, n) is attached to.

    ``labelled`` (person, name): spellings under author ids, to learn the likelihoods from.
    """
    scratch = Scratch(names.sparkSession, "names")
    read = scratch.save(_chosen_readings(names))
    identity = F.concat_ws("|", "kind", "surname", F.when(F.col("given") != "", F.col("given")).otherwise(F.concat(F.lit("~"), F.col("initial"), F.lit("~"), F.col("middle"))))
    read = read.withColumn("form", identity)
    forms = read.groupBy("form", "kind", "given", "initial", "surname").agg(F.sum("n").alias("freq"), F.count("*").alias("spelt"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("middle") != "", F.col("middle")))), "").alias("middle"))
    usual = forms.where("kind = 'person' AND given <> ''").groupBy("given").agg(F.count_distinct("surname").alias("given_df"))
    borne = forms.where("kind = 'person' AND given <> ''").groupBy("surname").agg(F.count_distinct("given").alias("surname_df"))
    forms = scratch.save(forms.join(usual, "given", "left").join(borne, "surname", "left").fillna(0, ["given_df", "surname_df"]))
    none = F.array().cast("array<struct<full:string,cost:double>>")
    costs = COSTS
    if labelled is None:
        forms = forms.withColumn("fulls", none)
    else:
        short, costs = learn(read, forms, labelled, scratch)
        forms = scratch.save(forms.join(short, "given", "left").withColumn("fulls", F.when(F.col("kind") == "person", F.coalesce("fulls", none)).otherwise(none)))

    full = forms.where("given <> '' AND substring(given, 1, 1) <> '*'")
    candidates = full.select(*[F.col(c).alias(f"{c}2") for c in ("form", "kind", "given", "surname", "middle", "freq", "spelt", "given_df", "surname_df")], F.explode(_keys(True)).alias("key"))
    seekers = forms.select("form", F.explode(_keys(False)).alias("key"))
    # exploded keys are many times what the optimizer expects, so neither side may be broadcast
    met = seekers.join(candidates.hint("merge"), "key").where("form <> form2").drop("key").distinct()
    met = met.join(forms, "form").withColumn("nickname", F.expr("get(filter(fulls, f -> f.full = given2), 0).cost"))
    met = met.withColumn("cost", _channel_column(costs)).where("cost < 50")
    same_given, same_surname = F.col("given") == F.col("given2"), F.col("surname") == F.col("surname2")
    # of two spellings of a surname the one with more bearers, then more rows, is the canonical one
    standing = [F.struct(F.col(f"surname_df{x}").alias("bearers"), F.col(f"freq{x}").alias("rows"), F.col(f"form{x}").alias("form")) for x in ("", "2")]
    rarer = standing[0] < standing[1]
    short = (F.col("given") == "") | (F.substring("given", 1, 1) == "*")
    nick = F.col("nickname").isNotNull() & same_surname & (F.col("given_df") * 2 < F.col("given_df2"))
    wrong_given = ~same_given & same_surname & (F.col("given_df") * GIVEN_RATIO <= F.col("given_df2"))
    wrong_surname = ~same_surname & rarer & (same_given | (F.col("given_df") * 2 < F.col("given_df2")))
    allowed = F.when(F.col("kind") == "org", short | rarer).otherwise(short | nick | wrong_given | wrong_surname)
    # prior: authors known under several spellings are those whose name gets varied
    prior = F.log(F.col("freq2").cast("double")) * 0.5 + 1.5 * F.log(F.col("spelt2").cast("double"))
    scored = scratch.save(met.where(allowed).select("form", "form2", "freq2", short.alias("short"), (prior - F.col("cost")).alias("posterior")))

    def best(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("form").orderBy(F.desc("posterior"), "form2")
        return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")

    # full forms first; their own variants then tell how freely each author's name is varied
    parent = scratch.save(best(scored.where("NOT short")).select("form", F.col("form2").alias("up"), "posterior"))
    while True:  # a typo of a nickname hangs on the nickname's own author; links rise in standing, so chains end
        above = parent.select(F.col("form").alias("up"), F.col("up").alias("top"))
        fresh = scratch.save(parent.join(above, "up", "left").select("form", F.coalesce("top", "up").alias("up"), "posterior", F.col("top").isNotNull().alias("moved")))
        scratch.drop(parent)
        parent = fresh.drop("moved")
        parent._scratch_path = fresh._scratch_path
        if not fresh.where("moved").limit(1).count():
            break
    rich = parent.join(forms.select("form", "spelt"), "form").groupBy("up").agg(F.sum("spelt").alias("variants")).withColumnRenamed("up", "root")
    brief = scored.where("short").join(parent.select(F.col("form").alias("form2"), "up"), "form2", "left").withColumn("root", F.coalesce("up", "form2"))
    brief = brief.join(rich, "root", "left").withColumn("posterior", F.col("posterior") + 2.0 * F.log1p(F.coalesce(F.col("variants"), F.lit(0)).cast("double")))
    brief = best(brief.groupBy("form", F.col("root").alias("form2")).agg(F.max("posterior").alias("posterior"))).select("form", F.col("form2").alias("up"), "posterior")
    attached = parent.unionByName(brief)
    return read.select("name", "n", "form").join(attached, "form", "left").select("name", "n", F.coalesce("up", "form").alias("canonical"), "posterior")


def spelling_pairs(names: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(name_a, name_b): all pairs of spellings of one author, name_a < name_b."""
    a = attributed(names, labelled).select("canonical", "name")
    a = Scratch(names.sparkSession, "pairs").save(a)
    return a.toDF("canonical", "name_a").join(a.toDF("canonical", "name_b"), "canonical").where("name_a < name_b").select("name_a", "name_b")
