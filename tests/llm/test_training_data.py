"""Operators of the llm subpackage against brute force, and their defined edge cases."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import components, exact_copies, matching, mixing, names, packing, reading, survivors, tokens
from tests.conftest import rows


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


# problem 3


@pytest.mark.parametrize("seed,bfs", [(1, 40), (2, 1), (3, 0)])
def test_components_match_union_find(spark, seed, bfs):
    random.seed(seed)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(1000, 1070)] + [(2000, i) for i in range(2001, 2100)]
    edges = [(a, b) for a, b in edges if a != b]
    got = rows(components.connected(spark.createDataFrame(edges, "u bigint, v bigint"), bfs), "id", "group_id")
    assert got == sorted(union_find(edges).items())


def test_group_of_shared_keys(spark):
    schema = "followup_id bigint, doi string, arxivid string, citedby array<string>, key string"
    data = [(1, "10.1000/A", None, None, "k"), (2, None, "doi:10.1000/a", [], "k"), (3, "10.48550/arXiv.7501.00001v2", "n/a", None, "k"), (4, None, "7501.00001", ["cards/X.md"], "k"), (5, None, "0000.00000", ["x"], "k"), (6, "-", "", ["", "-"], "k"), (7, None, None, None, None)]
    got = rows(components.groups(components.followup_links(spark.createDataFrame(data, schema))))
    assert got == [(1, 1), (1, 2), (3, 3), (3, 4), (3, 5)]
    assert components.groups(components.followup_links(spark.createDataFrame([], schema))).count() == 0


# problem 6


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_copies_across_partitions(spark, partitions):
    random.seed(partitions)
    data = [(i, random.choice(["a", "a", "a", "b", "c", f"only{i}"])) for i in random.sample(range(900), 600)]
    first = defaultdict(lambda: 10**9)
    for i, k in data:
        first[k] = min(first[k], i)
    got = rows(exact_copies.copies(spark.createDataFrame(data, "id bigint, key string"), partitions), "kept_id", "id")
    assert got == sorted((first[k], i) for i, k in data)


def test_formatting_is_ignored_and_nothing_else(spark):
    titles = ["Sea-Ice: drift!", "sea ice  drift", "SEA​ICE　DRIFT", unicodedata.normalize("NFD", "Séa ice drift"), "Séa ice drift", "sea ice drifts", None, " "]
    data = [(i, t, "10.1000/x", None) for i, t in enumerate(titles)] + [(20, "sea ice drift", None, "https://doi.org/10.1000/X"), (21, "sea ice drift", None, None)]
    df = spark.createDataFrame(data, "followup_id bigint, title string, doi string, arxivid string")
    got = rows(exact_copies.copies(exact_copies.followup_keys(df)).where("kept_id <> id"))
    assert got == [(0, 1), (0, 2), (0, 20), (3, 4), (6, 7)]
    counts = dict(rows(exact_copies.representatives(exact_copies.followup_keys(df))))
    assert counts[0] == 4 and sum(counts.values()) == len(data)
    assert exact_copies.copies(exact_copies.followup_keys(df.limit(0))).count() == 0


# problem 5

PAPERS = "paperid string, hit_id bigint, retrieved_at timestamp_ntz, abstract string, openaccesspdf struct<url: string, status: string>, citationcount bigint, venue string, size int"


def paper(pid, hit, day=1, abstract=None, pdf=None, count=None, venue=None):
    import datetime as dt

    return (pid, hit, dt.datetime(2024, 1, day), abstract, pdf, count, venue, 1)


def test_best_value_of_each_field(spark):
    full = "The tide rose. It fell again later on."
    data = [
        paper("p", 9, 1, full, ("https://a.example/x.pdf", "GOLD"), 7, "J. Terr. Learn."),
        paper("p", 3, 2, full, ("https://a.example/x.pd", "GOLD"), 9, "Journal of Terrain Learning"),
        paper("p", 1, 3, "The tide rose.", ("https://a.example/x.pdf", None), 999999999, "unknown"),
        paper("p", 2, 4, "<jats:p>The tide rose</jats:p><jats:p>It fell again later on</jats:p><jats:p>&copy; All rights reserved.</jats:p>", None, 0, "journal of terr"),
        paper("p", 4, 5, "Th� tide r�se. It fell again later on.", None, -9, ""),
        paper("q", 5, 1, "The tide ro…", None, None, None), paper("q", 6, 2, "No abstract.", ("", ""), None, "preprint server"), paper(None, 7), paper("r", 8, 1, full, None, 0, "Letters in Tides"),
    ]
    # what recurs over unrelated papers is no content
    data += [paper(f"c{i}", 100 + i, 1, "No abstract.") for i in range(4)] + [paper(f"d{i}", 200 + i, 1, f"Reef {i} grew. &copy; All rights reserved.") for i in range(4)]
    best = {(r.paperid, r.field_name): (r.hit_id, r.n_rows) for r in survivors.best_values(spark.createDataFrame(data, PAPERS)).collect()}
    got = {k: v for k, v in best.items() if k[0] in "pqr"}
    assert not any(f == "abstract" for p, f in best if p[0] in "cd")
    assert got == {("p", "abstract"): (3, 5), ("p", "openaccesspdf"): (9, 5), ("p", "citationcount"): (3, 5), ("p", "venue"): (3, 5), ("r", "abstract"): (8, 1), ("r", "citationcount"): (8, 1), ("r", "venue"): (8, 1)}
    built = {r.paperid: r for r in survivors.survivors(spark.createDataFrame(data, PAPERS)).collect()}
    assert built["p"].citationcount == 9 and built["q"].abstract is None
    assert survivors.best_values(spark.createDataFrame([], PAPERS)).count() == 0


# problem 1

CLUSTERS = [
    ["Abigail Fariguld", "Fariguld, A.", "FARIGULD, Abigail", "Gail Fariguld", "Aibgail Fariguld", "Dr. Abigail M. Fariguld"],
    ["Benjamin Fariguld", "Fariguld Benjamin"], ["Nikolai Nöstoveck", "Nostoveck, N.", "Kolya Nöstoveck", "N Nöstoveck", "Nikolai Nöstovek"],
    ["Gokrudult Snow Hydrology Institute", "Institute for Snow Hydrology, Gokrudult", "The Gokrudult Snow Hydrology Inst.", "Gokrudult SHI", "GOKRUDULT SNOW HYDROLOGY INSTITUTE"],
    ["Ursula von Kralivack", "von Kralivack, U.", "VON KRALIVACK, Ursula"],
]


def test_spellings_of_one_author(spark):
    crowd = [f"{g} {s}" for g in ("Abigail", "Benjamin", "Nikolai", "Ursula", "Stefan", "Noor") for s in ("Vutezek", "Zadofild", "Kevotirn", "Bafobrock", "Rosodal", "Mohostald", "Tetijur")]
    spelt = [(n,) for c in CLUSTERS for k, n in enumerate(c) for _ in range(12 if k == 0 else 3)] + [(n,) for n in crowd for _ in range(4)] + [(None,), (" ",), ("-",)]
    # short forms are learnt from other authors, whose spellings carry an id; a single wrong id teaches nothing
    taught = [("a", "Abigail Pervolt"), ("a", "Gail Pervolt"), ("b", "Nikolai Dustrel"), ("b", "Kolya Dustrel"), ("c", "Noor Vutezek"), ("c", "Stefan Vutezek"), *((f"d{i}", n) for i, n in enumerate(crowd)), ("e", None)]
    spelt += [(n,) for _, n in taught]
    names_, ids = names.spellings(spark.createDataFrame(spelt, "name string")), spark.createDataFrame(taught, "person string, name string")
    got = set(rows(names.spelling_pairs(names_, ids)))
    own = [["Abigail Pervolt", "Gail Pervolt"], ["Kolya Dustrel", "Nikolai Dustrel"]]
    assert got == {(a, b) for c in CLUSTERS + own for a in c for b in c if a < b}
    untaught = set(rows(names.spelling_pairs(names_)))
    assert untaught < got and ("Kolya Nöstoveck", "Nikolai Nöstoveck") not in untaught


def test_short_forms_nobody_listed(spark):
    people = [("Zorander", "Quib"), ("Meldrith", "Oxy"), ("Tarquille", "Benno")]
    places = ["Vutezek", "Zadofild", "Kevotirn", "Bafobrock", "Rosodal", "Mohostald", "Tetijur", "Gramblet"]
    spelt = [(f"{g} {s}",) for full, _ in people for s in places for g in [full] * 3] + [(f"{short} {s}",) for (_, short), s in zip(people, places)] + [(f"{short} Gramblet",) for _, short in people]
    taught = [(f"{full}{s}", f"{g} {s}") for (full, short), s in zip(people, places) for g in (full, short)]
    got = set(rows(names.spelling_pairs(names.spellings(spark.createDataFrame(spelt, "name string")), spark.createDataFrame(taught, "person string, name string"))))
    assert got == {tuple(sorted((f"{full} {s}", f"{short} {s}"))) for k, (full, short) in enumerate(people) for s in (places[k], "Gramblet")}


def test_followup_names_and_empty_tables(spark):
    df = spark.createDataFrame([("A B; C D; et al.",), ("E F et al.",), (None,), ("",)], "authors string")
    assert rows(names.followup_names(df).where("name <> ''")) == [("A B",), ("C D",), ("E F",)]
    assert names.spelling_pairs(names.spellings(spark.createDataFrame([], "name string"))).count() == 0


def test_edit_distance_of_one():
    assert [names.distance(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "abxc"), ("abc", "xbc"), ("abcd", "badc"), ("a", "abc"))] == [0, 1, 1, 1, 1, 2, 2]


# problem 2

RECORDS = "id string, title string, authors array<string>, year int, doi string, arxiv string"


def test_same_works_are_matched(spark):
    left = [("a", "How snow melt responds to weak supervision in Tobranarn Basin", ["Jane Vutezek"], 2020, None, None), ("b", "Introduction", ["Noor Zadofild"], 2020, None, None), ("c", "Tidal mixing near Kekrild Fjord shelf", [], 2019, None, None), ("d", None, None, None, None, None), ("a", "How snow melt responds to weak supervision in Tobranarn Basin", ["Jane Vutezek"], 2020, None, None)]
    right = [("A", "<i>HOW</i> snow mellt responds to weak supervision in Tobranarn Basin (preprint)", ["Vutezek, J."], 2021, None, None), ("A2", "Correction to: How snow melt responds to weak supervision in Tobranarn Basin", ["Jane Vutezek"], 2020, None, None), ("A3", "How snow melt responds to weak supervision in Tobranarn Basin, part 2", ["Jane Vutezek"], 2020, None, None),
             ("B", "Introduction", ["Zadofild N"], 2020, None, None), ("B2", "Introduction", ["Ursula Rosodal"], 2020, None, None), ("B3", "Introduction", ["Noor Zadofild"], 2012, None, None), ("C", "tidal mixing near kekrild fjord shelf", ["X Y"], 2019, None, None)]
    got = matching.matches(spark.createDataFrame(left, RECORDS), spark.createDataFrame(right, RECORDS), 0.8)
    assert rows(got, "left_id", "right_id") == [("a", "A"), ("b", "B"), ("c", "C")]
    empty = spark.createDataFrame([], RECORDS)
    assert matching.matches(empty, spark.createDataFrame(right, RECORDS)).count() == 0


def test_no_close_pair_is_missed(spark):
    """Multi-index hashing against all pairs of vectors."""
    random.seed(4)
    words = ["tidal", "mixing", "snow", "melt", "radar", "reef", "basin", "delta", "krobiher", "tobranarn", "zadofild", "fjord"]
    titles = [" ".join(random.sample(words, 6)) for _ in range(60)]
    typed = [t[: (k := random.randrange(len(t)))] + random.choice("aeiou") + t[k:] for t in titles]
    from paperloom.storage import Scratch

    scratch = Scratch(spark, "test")
    left, right = (scratch.save(matching.encode(spark.createDataFrame([(f"{s}{i}", t, ["Jane Doebert"], 2020, None, None) for i, t in enumerate(ts)], RECORDS))) for s, ts in (("l", titles), ("r", typed)))
    apart = lambda x, y: sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x["bits"], y["bits"], strict=True))
    close = {(a.rid, b.rid) for a in left.collect() for b in right.collect() if any(x["kind"] == y["kind"] and x["initial"] == y["initial"] and apart(x, y) < matching.BLOCKS[x["kind"]] for x in a.vectors for y in b.vectors)}
    assert close and set(rows(matching.close_pairs(left, right, scratch))) == close


def test_isotonic_is_monotone():
    knots, values = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert values.tolist() == [1, 2.5, 4] and (np.diff(knots) > 0).all()


# problems 7 and 8


def test_token_counts_are_exact(spark):
    import base64

    import tiktoken

    with open(tokens.default_vocabulary(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    exact = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["", None, " a  b\n\nc ", "it's we'll\t\tdon’t", "東京  タワー", "x" * 3000, "a\x1cb \x1f c", "tail  \n ", "1 234 5,6", " nbsp ", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert rows(df.select("i", tokens.token_count(F.col("t")))) == [(i, len(exact(t or ""))) for i, t in enumerate(texts)]


def test_packing_is_tight_and_never_overfull():
    random.seed(3)
    sizes = np.array([random.choice([1, 5, 30, 64, 100, random.randrange(1, 100)]) for _ in range(2000)] + [0, 0])
    place = packing.best_two_fit(sizes, 100)
    filled = Counter()
    for p, s in zip(place.tolist(), sizes.tolist(), strict=True):
        filled[p] += s
    assert max(filled.values()) <= 100 and len(filled) <= 1.01 * -(-sizes.sum() // 100) + 1
    assert len(packing.best_two_fit(np.array([], dtype=int), 10)) == 0


def test_pair_replaces_the_smallest():
    # greedy takes 6 and 3 and leaves 1; 2 + 2 fill the gap of 4 exactly
    place = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert place[0] == place[2] == place[3] != place[1]


def test_containers_hold_every_text_once(spark):
    sized = spark.createDataFrame([(i, n) for i, n in enumerate([0, 5, 10, 11, 37, 3, 3, 10**5])], "doc_id bigint, n_tokens bigint")
    bins = spark.createDataFrame([("s", 10), ("l", 100)], "bin_name string, capacity_tokens int")
    got = packing.containers(sized, bins, shard_items=3).collect()
    held = defaultdict(int)
    for r in got:
        held[r.bin_name, r.doc_id] += r.n_tokens
        assert r.n_tokens <= {"s": 10, "l": 100}[r.bin_name]
    assert held == {(b, r.doc_id): r.n_tokens for b in "sl" for r in sized.collect()}
    assert [r.start_token for r in sorted(got, key=lambda r: r.piece_no) if (r.bin_name, r.doc_id) == ("s", 4)] == [0, 10, 20, 30]
    assert packing.containers(sized.limit(0), bins).count() == 0
    report = {r.bin_name: r for r in packing.fill_report(packing.containers(sized, bins), bins).collect()}
    assert report["s"].tokens == sized.agg(F.sum("n_tokens")).first()[0]


def test_permutation_is_one():
    for size in (1, 2, 7, 100, 1000):
        got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 12345))
        assert sorted(got.tolist()) == list(range(size))


DOCUMENTS = "doc_id bigint, source string, n_tokens bigint, text_hash string"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_shares_are_met_within_the_caps(spark):
    random.seed(9)
    data = [(i, "big" if i < 800 else "small", random.randrange(20, 400), f"h{i}") for i in range(900)] + [(5000, "small", 50, "h0"), (5001, None, 9, "z"), (5002, "big", 0, "e")]
    targets = [("m", "big", 2.0, 1), ("m", "small", 1.0, 2), ("m", "absent", 1.0, 3), ("n", "small", 1.0, 2)]
    inputs = spark.createDataFrame(data, DOCUMENTS), spark.createDataFrame(targets, TARGETS)
    whole = {(r.mix_name, r.source): r for r in mixing.mix(*inputs, block_tokens=32, shards=5, bucket_texts=50)[1].collect()}
    total = sum(r.available_tokens for k, r in whole.items() if k[0] == "m")
    # the whole mix's size is asked for: a source gives its share of it, or all its repeats allow
    for k, most in (("big", 2 / 3 * total), ("small", 2 * whole["m", "small"].available_tokens)):
        assert abs(whole["m", k].drawn_tokens - min(most, whole["m", k].available_tokens * whole["m", k].max_repeats)) <= 64
    draws, shares = mixing.mix(*inputs, block_tokens=32, shards=5, bucket_texts=50, total_tokens=mixing.EXACT_SHARES)
    got = {(r.mix_name, r.source): r for r in shares.collect()}
    assert abs(got["m", "big"].reached_share - 2 / 3) < 0.01 and abs(got["m", "small"].reached_share - 1 / 3) < 0.01
    assert got["m", "absent"].drawn_tokens == 0 and got["n", "small"].reached_share == 1
    pieces = draws.collect()
    size = {(d[0]): d[2] for d in data}
    seen = Counter()
    for r in pieces:
        assert 0 <= r.start_token and r.start_token + r.n_tokens <= size[r.doc_id]
        for t in range(r.start_token, r.start_token + r.n_tokens):
            seen[r.mix_name, r.doc_id, t] += 1
    cap = {("m", "big"): 1, ("m", "small"): 2, ("n", "small"): 2}
    source = {d[0]: d[1] for d in data}
    assert all(n <= cap[m, source[d]] for (m, d, _), n in seen.items())
    assert not {5000} & {r.doc_id for r in pieces if r.mix_name == "m"}  # a copy of h0
    assert len({r.shard for r in pieces}) == 5
    empty = mixing.mix(spark.createDataFrame([], DOCUMENTS), spark.createDataFrame(targets, TARGETS))
    assert empty[0].count() == 0 and empty[1].count() == 4


# problem 9


@pytest.fixture(scope="module")
def anchors():
    import duckdb

    from tests.conftest import DATA

    path = DATA / "sf0.001/reading_anchors.parquet"
    if not path.exists():
        pytest.skip("driver tables are not here")
    return duckdb.sql(f"SELECT text, level FROM '{path}' ORDER BY anchor_id").fetchall()


def test_held_out_levels(anchors):
    order = np.random.default_rng(2).permutation(len(anchors))
    held = set(order[:50].tolist())
    rest = [anchors[i] for i in range(len(anchors)) if i not in held]
    ranker = reading.Ranker([t for t, _ in rest], [n for _, n in rest])
    parts = [(reading.sentences_only(anchors[i][0]), anchors[i][1]) for i in held]
    got = ranker.level(np.array([ranker.score(t, reading.words_of(t)) for t, _ in parts]))
    right = np.array([n for _, n in parts])
    assert (got == right).mean() >= 0.8 and (abs(got - right) <= 1).all()


def test_what_is_no_sentence_is_left_out():
    text = "---\ntitle: x\n---\n# Head\n<!-- page 1 -->\nThe cat sat [Doe 2001].\n| a | b |\n- The dog ran\n## References\n- Doe, J. (2001). Cats. J. Cats 1, 2–3.\n"
    bare = reading.sentences_only(text)
    assert "cat sat" in bare and "dog ran" in bare and not any(x in bare for x in ("title", "Head", "page", "Doe", "| a", "Cats"))
    assert reading.sentences_only("# only a heading") == "# only a heading"


def test_languages_and_edge_cases(spark, anchors):
    df = spark.createDataFrame([(1, 300, anchors[0][0]), (2, 5, ""), (3, 0, None), (4, 9, "!!! ..."), (5, 99, "Das Team fand, dass die Messung und der Wind im Winter stark ist."), (6, 99, "zzz qqq"), (7, 10**6, anchors[0][0] * 50)], "doc_id bigint, n_chars bigint, text string")
    sample = spark.createDataFrame([(i, n, t) for i, (t, n) in enumerate(anchors)], "anchor_id bigint, level int, text string")
    got = {r.doc_id: r for r in reading.levels(df, reading.fit(sample)).collect()}
    assert got[1].language == got[7].language == "en" and got[1].level == got[7].level and got[5].language == "de"
    assert got[2].level is got[3].level is got[4].level is None and got[6].language is None and got[6].level in range(1, 6)
    unlearnt = reading.levels(df, reading.fit(sample.limit(0)))
    assert unlearnt.where("level IS NOT NULL").count() == 0
