"""Registered queries of the literature operators over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import ids, text
from paperloom.operators import checks, ingest, ranking, resolve, runlog
from paperloom.sources import adapters
from paperloom.streaming import events as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same rows."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPLIT = "(?:" + "|".join(text.PARTICLES) + ")"


@query(rf"""
WITH found AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\[\s*(\p{{Lu}}[^\]\[\d]{{0,80}}?)\s+(\d{{4}}[a-z]?)\s*\]')) AS raw FROM documents WHERE doc_kind = 'draft'),
named AS (SELECT raw, lower(regexp_replace(regexp_extract(raw, '(?i)^\[\s*((?:{_SPLIT}\s+)*[^\s\]]+)', 1), '[^\p{{L}}\p{{N}}]+$', '')) AS surname, regexp_extract(raw, '(\d{{4}})[a-z]?\s*\]$', 1) AS year FROM found),
sources AS (SELECT doc_id, lower(text) AS body FROM documents WHERE doc_kind <> 'draft'),
words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '[\p{{L}}\p{{N}}]+')) AS word FROM sources),
simple AS (SELECT raw, year, doc_id FROM named JOIN words ON word = surname),
complex AS (SELECT raw, year, doc_id FROM named JOIN sources ON contains(body, surname) AND regexp_matches(body, '(^|[^\p{{L}}\p{{N}}])' || replace(surname, ' ', '\s+') || '($|[^\p{{L}}\p{{N}}])')
  WHERE surname <> '' AND NOT regexp_full_match(surname, '[\p{{L}}\p{{N}}]+')),
met AS (SELECT m.raw, m.doc_id, w.word IS NOT NULL AS dated FROM (SELECT * FROM simple UNION ALL SELECT * FROM complex) m LEFT JOIN words w ON w.doc_id = m.doc_id AND w.word = m.year),
best AS (SELECT raw, min(doc_id) FILTER (WHERE dated) AS both_in, min(doc_id) AS name_in FROM met GROUP BY raw)
SELECT n.raw, surname, year, CASE WHEN both_in IS NOT NULL THEN 'supported' WHEN name_in IS NOT NULL THEN 'year-mismatch' ELSE 'unsupported' END AS verdict, coalesce(both_in, name_in) AS found_in
FROM named n LEFT JOIN best b ON n.raw = b.raw""")
def citation_support(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return checks.citation_support(checks.cited(documents.where("doc_kind = 'draft'")), documents.where("doc_kind <> 'draft'"), "doc_id")


@query(r"""
WITH lines AS (SELECT doc_id, string_split(regexp_replace(text, '\[(\p{Lu}[^\]\[\d]{0,80}?\s+\d{4}[a-z]?)\]', 'CITATION NEEDED: \1', 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM lines)
SELECT doc_id, line, regexp_extract(body, '\b(EVIDENCE NEEDED|CITATION NEEDED|SECTION MISSING)\b', 1) AS kind, regexp_replace(trim(regexp_extract(body, '\b(?:EVIDENCE NEEDED|CITATION NEEDED|SECTION MISSING)\b\s*:?\s*(.*)', 1)), '\s+$', '') AS note FROM l WHERE regexp_matches(body, '\b(EVIDENCE NEEDED|CITATION NEEDED|SECTION MISSING)\b')""")
def draft_markers(spark, sf_dir):
    # the tables hold no markers: every citation is withdrawn, which leaves one behind
    withdrawn = F.regexp_replace("text", r"\[(\p{Lu}[^\]\[\d]{0,80}?\s+\d{4}[a-z]?)\]", "CITATION NEEDED: $1")
    return checks.markers(table(spark, sf_dir, "documents").select("doc_id", withdrawn.alias("text")), "doc_id").withColumn("line", F.col("line").cast("bigint"))


def _paged(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return ingest.page_stats(documents.withColumn("pages", ingest.pages_of(F.coalesce("text", F.lit("")), 1500)), "pages")


_PAGED = r"""
paged AS (SELECT doc_id, source, CAST(greatest(1, ceil(length(coalesce(text, '')) / 1500.0)) AS INT) AS n_pages, coalesce(text, '') AS t FROM documents),
stats AS (SELECT doc_id, source, n_pages, length(t) AS characters, [i FOR i IN range(1, n_pages + 1) IF length(regexp_replace(substring(t, (i - 1) * 1500 + 1, 1500), '^[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$', '', 'g')) < 100] AS bare FROM paged),
status AS (SELECT *, CASE WHEN len(bare) = n_pages THEN 'scanned' WHEN len(bare) > 0.5 * n_pages THEN 'mostly_scanned' ELSE 'extracted' END AS status FROM stats)"""


@query(f"WITH {_PAGED} SELECT status, count(*) AS n_documents, CAST(sum(n_pages) AS BIGINT) AS n_pages, CAST(sum(characters) AS BIGINT) AS characters FROM status GROUP BY status")
def scan_status(spark, sf_dir):
    return _paged(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_documents"), F.sum("n_pages").alias("n_pages"), F.sum("characters").alias("characters"))


@query(f"""WITH {_PAGED}, spots AS (SELECT doc_id, unnest(bare) AS page FROM status),
runs AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS run FROM spots),
islands AS (SELECT doc_id, min(page) AS a, max(page) AS z FROM runs GROUP BY doc_id, run)
SELECT doc_id, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '-' || z END, ', ' ORDER BY a) AS textless_pages FROM islands GROUP BY doc_id""")
def textless_pages(spark, sf_dir):
    return _paged(spark, sf_dir).where(F.size("textless") > 0).select("doc_id", text.page_ranges(F.col("textless")).alias("textless_pages"))


@query("""
WITH tagged AS (SELECT p_partkey, p_name, unnest(list_concat([lower(p_brand), lower(p_type)], string_split(lower(p_name), ' '))) AS tag FROM part),
placed AS (SELECT tag, p_name, row_number() OVER (PARTITION BY tag ORDER BY p_size DESC, t.p_partkey) AS place, count(*) OVER (PARTITION BY tag) AS n_cards FROM tagged t JOIN part USING (p_partkey, p_name))
SELECT tag, n_cards, string_agg(p_name, '; ' ORDER BY place) FILTER (WHERE place <= 8) AS shown, n_cards - least(n_cards, 8) AS n_more FROM placed GROUP BY tag, n_cards""")
def keyword_index(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    part = part.withColumn("tags", F.concat(F.array(F.lower("p_brand"), F.lower("p_type")), F.split(F.lower("p_name"), " ")))
    index = checks.keyword_index(part, "tags", "p_name", [F.desc("p_size"), F.asc("p_partkey")])
    return index.select("tag", "n_cards", F.array_join("titles", "; ").alias("shown"), "n_more")


@query("SELECT hit_id, title, year FROM s2_papers ORDER BY year DESC NULLS LAST, title, hit_id")
def reference_index(spark, sf_dir):
    papers = table(spark, sf_dir, "s2_papers").select("hit_id", "title", "year")
    return papers.orderBy(F.desc_nulls_last("year"), "title", "hit_id")


@query("""
WITH c AS (SELECT point AS id, count(*) AS n_cards, count(*) FILTER (WHERE openaccesspdf.url IS NOT NULL) AS full_text FROM s2_papers GROUP BY 1),
f AS (SELECT point AS id, count(*) AS failed FROM openalex_works WHERE best_oa_location IS NULL GROUP BY 1)
SELECT id, coalesce(n_cards, 0) AS n_cards, coalesce(full_text, 0) AS full_text, coalesce(n_cards - full_text, 0) AS abstract_only, coalesce(failed, 0) AS failed
FROM candidates LEFT JOIN c USING (id) LEFT JOIN f USING (id)""")
def evidence_packets(spark, sf_dir):
    cards = table(spark, sf_dir, "s2_papers").where("point IS NOT NULL")
    cards = cards.select(F.array("point").alias("points"), F.when(F.col("openaccesspdf.url").isNull(), "abstract_only").otherwise("full_text").alias("level"))
    failures = table(spark, sf_dir, "openalex_works").where("point IS NOT NULL AND best_oa_location IS NULL").select(F.array("point").alias("points"))
    return checks.evidence(table(spark, sf_dir, "candidates"), cards, failures, "id")


@query("""
SELECT followup_id, p AS id FROM (SELECT followup_id, unnest(points) AS p FROM followups) WHERE p NOT IN (SELECT id FROM candidates WHERE rationale IS NOT NULL)""")
def orphaned_links(spark, sf_dir):
    cards = table(spark, sf_dir, "followups").select("followup_id", "points")
    return checks.orphaned(table(spark, sf_dir, "candidates").where("rationale IS NOT NULL"), cards, "id", "followup_id")


def _mentions(spark, sf_dir):
    rows = table(spark, sf_dir, "followups")
    doi, arxiv = ids.work_ids(F.col("doi"), F.col("arxivid"))
    return rows.select(F.col("followup_id").alias("pos"), "title", text.or_null(F.col("authors")).alias("authors"), "year", doi.alias("doi"), arxiv.alias("arxivid"), F.col("reasons").alias("reason"), F.col("citedby").alias("card"), "points")


#: DOI and arXiv id of each followup from whichever field holds them, as SQL.
IDS_SQL = r"""
bare AS (SELECT *, [regexp_replace(regexp_replace(lower(x), '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g'), '^["''<(\[]+|["''>)\].,;]+$', '', 'g') FOR x IN [doi, arxivid] IF x IS NOT NULL] AS xs FROM followups),
split AS (SELECT *, [regexp_replace(x, '^(?:https?://)?(?:[\w-]+\.)*doi\.[a-z]+/|^doi[:.]*', '') FOR x IN xs] AS ds, [regexp_replace(x, '^(?:https?://)?(?:[\w-]+\.)*arxiv\.[a-z]+/(?:abs|pdf)/|^arxiv[:.]*', '') FOR x IN xs] AS as_ FROM bare),
ids AS (SELECT * EXCLUDE (doi, arxivid, xs, ds, as_), [d FOR d IN ds IF regexp_matches(d, '^10\.\d{3,9}(?:\.\d+)*/.+') AND NOT starts_with(d, '10.48550/arxiv.')][1] AS doi,
  [regexp_extract(z, '^(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$', 1) FOR z IN list_concat([d[16:] FOR d IN ds IF starts_with(d, '10.48550/arxiv.')], as_)
   IF regexp_matches(z, '^(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$') AND NOT regexp_matches(z, '^[0.]+$')][1] AS arxivid FROM split)"""


@query(f"WITH {IDS_SQL} SELECT followup_id, doi, arxivid FROM ids")
def identifiers(spark, sf_dir):
    doi, arxiv = ids.work_ids(F.col("doi"), F.col("arxivid"))
    return table(spark, sf_dir, "followups").select("followup_id", doi.alias("doi"), arxiv.alias("arxivid"))


@query(f"""
WITH {IDS_SQL}, keyed AS (SELECT *, coalesce('doi:' || doi, 'arxiv:' || arxivid, 'title:' || regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '', 'g')) AS key FROM ids),
cards AS (SELECT key, count(DISTINCT c) AS n FROM (SELECT key, unnest(citedby) AS c FROM keyed) WHERE c <> '' GROUP BY key),
grouped AS (SELECT key, count(*) AS mentions, min_by(title, followup_id) AS title, min_by(year, followup_id) FILTER (WHERE year IS NOT NULL) AS year FROM keyed GROUP BY key)
SELECT key, mentions, title, year, coalesce(n, 0) AS n_cards FROM grouped LEFT JOIN cards USING (key)""")
def followup_collate(spark, sf_dir):
    return checks.followup_groups(_mentions(spark, sf_dir)).select("key", "mentions", "title", "year", F.size("cards").cast("bigint").alias("n_cards"))


@query("""
WITH g AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS backend_rank, o_orderpriority FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY backend_rank, o_totalprice DESC, o_orderpriority) AS place FROM g""")
def interleave_backends(spark, sf_dir):
    hits = ranking.interleaved(table(spark, sf_dir, "orders"), "o_orderpriority", [F.asc("o_orderdate"), F.asc("o_orderkey")], F.col("o_totalprice"), ["o_custkey"])
    turned = ranking.round_robin(hits, "o_custkey", [F.asc("backend_rank"), F.asc("weight_order"), F.asc("o_orderpriority")])
    return turned.select("o_custkey", "o_orderkey", F.col("turn").alias("place"))


@query("SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000) AS kept FROM orders")
def budget_flags(spark, sf_dir):
    return ranking.flagged_within(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 1000, "o_orderkey").select("o_orderkey", "kept")


@query(r"""
WITH known AS (SELECT lower(trim(externalids['DOI'])) AS k FROM s2_papers UNION SELECT '10.48550/arxiv.' || lower(externalids['ArXiv']) FROM s2_papers),
w AS (SELECT hit_id, regexp_replace(regexp_replace(regexp_replace(lower(doi), '\s', '', 'g'), '^(?:https?://)?(?:[\w-]+\.)*doi\.[a-z]+/|^doi[:.]*', ''), '[.,;]+$', '') AS k FROM openalex_works)
SELECT hit_id FROM w WHERE k IS NULL OR k NOT IN (SELECT k FROM known WHERE k IS NOT NULL)""")
def exclude_known(spark, sf_dir):
    works = table(spark, sf_dir, "openalex_works").select("hit_id", F.array_compact(F.array(ids.doi_text(F.col("doi")))).alias("keys"))
    papers = table(spark, sf_dir, "s2_papers").select(F.explode(F.array(F.lower(F.trim(F.col("externalids")["DOI"])), F.concat(F.lit("10.48550/arxiv."), F.lower(F.col("externalids")["ArXiv"])))).alias("k")).where("k IS NOT NULL")
    return ranking.exclude_any_key(works, "hit_id", "keys", papers, "k").select("hit_id")


def _records(spark, sf_dir):
    s2, oa = table(spark, sf_dir, "s2_papers"), table(spark, sf_dir, "openalex_works")
    left = s2.select((F.col("hit_id") * 2).alias("pos"), *adapters.s2_fields(lambda n: F.col(n)), F.array("point").alias("tags"))
    right = oa.select((F.col("hit_id") * 2 + 1).alias("pos"), *adapters.openalex_fields(lambda n: F.col(n)), F.array("point").alias("tags"))
    return left.unionByName(right).where("title IS NOT NULL")


@query(r"SELECT hit_id, regexp_replace(lower(strip_accents(regexp_replace(title, '\s+', ' ', 'g'))), '[^a-z0-9]+', '', 'g') AS title_key FROM s2_papers")
def title_keys(spark, sf_dir):
    return table(spark, sf_dir, "s2_papers").select("hit_id", text.title_key("title").alias("title_key"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '\b(sk|pk|rk)-[A-Za-z0-9_-]{16,}\b', '\1-[REDACTED]', 'g'), '(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{16,}', '\1 [REDACTED]', 'g'), '(?i)\b[a-f0-9]{40,}\b', '[REDACTED]', 'g'),
 '(?i)(["'']?(?:api[_-]?key|authorization|token|secret)["'']?\s*[:=]\s*["''])[^"'']{8,}(["''])', '\1[REDACTED]\2', 'g')) AS redacted_md5 FROM documents""")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


@query("SELECT regexp_extract(openaccesspdf.url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM s2_papers WHERE regexp_matches(openaccesspdf.url, '^https?://[^/?#]+') GROUP BY 1")
def url_hosts(spark, sf_dir):
    rows = table(spark, sf_dir, "s2_papers").where("openaccesspdf.url RLIKE '^https?://[^/?#]+'").select(text.url_host(F.col("openaccesspdf.url")).alias("host"))
    return rows.groupBy("host").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT hit_id, unnest(map_entries(abstract_inverted_index)) AS e FROM openalex_works), p AS (SELECT hit_id, e.key AS word, unnest(e.value) AS spot FROM e)
SELECT hit_id, string_agg(word, ' ' ORDER BY spot, word) AS abstract FROM p WHERE spot >= 0 GROUP BY hit_id""")
def inverted_abstract(spark, sf_dir):
    return table(spark, sf_dir, "openalex_works").select("hit_id", text.rebuilt_text(F.col("abstract_inverted_index")).alias("abstract")).where("abstract IS NOT NULL")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), d AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT l_orderkey, count(*) AS n_sections, count(*) FILTER (WHERE part IS NULL) AS n_missing,
  string_agg(CASE WHEN part IS NOT NULL THEN 'part ' || part ELSE '## line ' || l_linenumber || chr(10) || chr(10) || 'SECTION MISSING: ' || l_orderkey || '-' || l_linenumber || ' was not drafted.' END, chr(10) || chr(10) ORDER BY l_linenumber) AS document
FROM s LEFT JOIN d USING (l_orderkey, l_linenumber) GROUP BY l_orderkey""")
def assemble_sections(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("section", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    sections = lines.select("l_orderkey", "l_linenumber", "section", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("title")).distinct()
    drafts = lines.where("l_returnflag = 'N'").groupBy("section").agg(F.concat(F.lit("part "), F.min("l_partkey").cast("string")).alias("text"))
    return ingest.assembled(sections, drafts, "l_orderkey", "l_linenumber", "section")


@query("SELECT s_suppkey, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS kept FROM supplier")
def keep_list(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    chosen = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return ranking.keep_list(supplier, "s_nationkey", chosen)[0].select("s_suppkey", "kept")


@query("SELECT paperid, count(*) AS n FROM s2_papers WHERE paperid IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def id_collisions(spark, sf_dir):
    return ranking.colliding(table(spark, sf_dir, "s2_papers").where("paperid IS NOT NULL"), "paperid")


@query("SELECT o_orderkey, count(l_shipdate) AS n_outputs, coalesce(bool_and(l_shipdate >= o_orderdate), false) AS fresh FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def cache_freshness(spark, sf_dir):
    outputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return ingest.fresh(table(spark, sf_dir, "orders"), outputs, "o_orderkey", "o_orderdate", "l_shipdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orphan_outputs(spark, sf_dir):
    expected = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.orphans(table(spark, sf_dir, "orders").select("o_orderkey"), expected, "o_orderkey")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def resume_pending(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return ingest.pending(events.select("event_id", "user_id"), events.where("event_type = 'purchase' AND value > 100"), "user_id").select("event_id")


@query("""
WITH s AS (SELECT paperid AS k, max(CASE WHEN openaccesspdf.url LIKE '%.pdf' THEN 'downloaded' ELSE 'failed' END) AS status, list_sort(list_distinct(list(point))) AS points FROM s2_papers WHERE hit_id % 2 = 0 GROUP BY 1),
n AS (SELECT paperid AS k, min(CASE WHEN openaccesspdf.url LIKE '%.pdf' THEN 'downloaded' ELSE 'failed' END) AS status, list_sort(list_distinct(list(point))) AS points FROM s2_papers WHERE hit_id % 2 = 1 GROUP BY 1)
SELECT coalesce(n.k, s.k) AS paperid, coalesce(n.status, s.status) AS status, array_to_string(list_sort(list_distinct(list_concat(coalesce(s.points, []), coalesce(n.points, [])))), ',') AS points FROM s FULL JOIN n ON s.k = n.k""")
def manifest_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "s2_papers").withColumn("s", F.when(F.col("openaccesspdf.url").like("%.pdf"), "downloaded").otherwise("failed"))
    old = rows.where("hit_id % 2 = 0").groupBy("paperid").agg(F.max("s").alias("status"), F.array_sort(F.collect_set("point")).alias("points"))
    new = rows.where("hit_id % 2 = 1").groupBy("paperid").agg(F.min("s").alias("status"), F.array_sort(F.collect_set("point")).alias("points"))
    return ingest.manifest_upsert(old, new, "paperid").select("paperid", "status", F.array_join(F.array_sort("points"), ",").alias("points"))


@query("""
SELECT event_type, round(coalesce(sum(value), 0), 2) AS value, count(*) AS n_rows, bool_or(event_id > 0 AND coalesce(value, 0) = 0) AS unpriced FROM events GROUP BY ROLLUP (event_type)""")
def usage_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("cost", F.col("value"))
    usage = runlog.usage_rollup(rows, "event_type", ["value"], "event_id", "cost")
    return usage.select("event_type", F.round("value", 2).alias("value"), "n_rows", "unpriced")


@query("""
WITH t AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_no FROM events)
SELECT event_id, turn_no, CASE WHEN turn_no = 40 THEN 'abort' WHEN turn_no = 32 THEN 'steer' ELSE 'continue' END AS action FROM t""")
def turn_budget(spark, sf_dir):
    return runlog.turn_budget(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 40, 0.8).select("event_id", "turn_no", "action")


@query("""
WITH f AS (SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failures FROM events)
SELECT event_id, CAST(failures AS BIGINT) AS failures, failures < 3 AS scheduled FROM f""")
def failure_budget(spark, sf_dir):
    return runlog.failure_budget(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3).select("event_id", "failures", "scheduled")


@query("""
WITH g AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_at, ts AS next_at FROM events)
SELECT user_id, last_at, next_at, (epoch_us(next_at) - epoch_us(last_at)) / 1e6 AS gap_s FROM g WHERE epoch_us(next_at) - epoch_us(last_at) >= 86400000000""")
def stall_gaps(spark, sf_dir):
    return runlog.gaps(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], 86400)


@query("""
WITH t AS (SELECT event_id, user_id % 4 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE WHEN event_type = 'error' THEN value * 1000 END AS asked FROM events)
SELECT event_id, greatest(coalesce(asked, least(60000.0, 1000 * pow(2.0, attempt - 1))), CASE h WHEN 0 THEN 3100 WHEN 1 THEN 1100 WHEN 2 THEN 250 ELSE 1500 END) AS wait_ms FROM t""")
def retry_ladder(spark, sf_dir):
    rows = runlog.turn_budget(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 1_000_000, 0.5)
    host = F.element_at(F.array(*[F.lit(h) for h in ("export.arxiv.org", "api.semanticscholar.org", "api.openalex.org", "elsewhere.example")]), (F.col("user_id") % 4 + 1).cast("int"))
    asked = F.when(F.col("event_type") == "error", F.col("value") * 1000)
    return rows.select("event_id", runlog.retry_wait(F.col("turn_no"), asked, runlog.host_interval(host)).alias("wait_ms"))


@query("""
WITH e AS (SELECT event_id, user_id, row_number() OVER w AS done, count(*) OVER (PARTITION BY user_id) AS total, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e3 AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN done >= 3 AND done < total AND elapsed > 0 THEN floor((total - done) * elapsed / done / 1e3) END AS left_s FROM e""")
def eta(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    begun = events.groupBy("user_id").agg(F.count("*").alias("total"), F.min("ts").alias("begun"))
    rows = events.join(begun, "user_id").withColumn("elapsed", F.timestamp_diff("MICROSECOND", F.col("begun"), F.col("ts")) / 1000)
    return runlog.remaining(rows, "user_id", ["ts", "event_id"], "elapsed", "total").select("event_id", F.floor(F.col("left_ms") / 1e3).alias("left_s"))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place = 1")
def precedence(spark, sf_dir):
    return ranking.latest_by_precedence(table(spark, sf_dir, "part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey")


@query("""
WITH u AS (SELECT DISTINCT venue AS name FROM s2_papers WHERE trim(venue) <> ''), k AS (SELECT DISTINCT primary_location.source.display_name AS suggestion FROM openalex_works WHERE primary_location.source.display_name IS NOT NULL),
d AS (SELECT name, suggestion, levenshtein(lower(name), lower(suggestion)) AS distance FROM u, k WHERE abs(length(name) - length(suggestion)) <= greatest(2, length(name) // 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, suggestion) AS place FROM d WHERE distance <= greatest(2, length(name) // 3))
SELECT name, suggestion, CAST(distance AS INT) AS distance FROM r WHERE place <= 3""")
def name_suggestions(spark, sf_dir):
    unknown = table(spark, sf_dir, "s2_papers").where(F.trim("venue") != "").select(F.col("venue").alias("name"))
    known = table(spark, sf_dir, "openalex_works").select(F.col("primary_location.source.display_name").alias("name")).where("name IS NOT NULL")
    return ranking.nearest_names(unknown, known)


@query(r"SELECT lang, count(*) AS n_documents, count(*) FILTER (WHERE regexp_matches(text, '[^\p{Latin}\p{Common}\p{Inherited}]')) AS n_outside FROM documents GROUP BY lang")
def non_latin(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", text.outside_latin(F.col("text")).alias("outside"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_documents"), F.count_if("outside").alias("n_outside"))


@query()
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 2048).alias("text"))


@query()
def candidate_names(spark, sf_dir):
    names = _records(spark, sf_dir).select("pos", resolve.candidate_name(F.get("authors", F.lit(0)), F.col("year"), F.col("title")).alias("name"))
    return ranking.unique_names(names, "name", ["pos"])


@query("""SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    counts = streams.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "6 hours", "1 day")
    return counts.withColumn("total", F.round("total", 2))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n_events FROM s GROUP BY user_id, no""")
def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "2 hours", "1 day")


@query("SELECT point AS backend, count(*) AS n_failed FROM openalex_responses WHERE NOT json_valid(body) GROUP BY point")
def answer_failures(spark, sf_dir):
    answers = table(spark, sf_dir, "openalex_responses").select("response_id", F.col("point").alias("backend"), F.expr("CASE WHEN try_parse_json(body) IS NULL THEN 'unreadable' END").alias("error"), F.lit(0).alias("found"))
    return runlog.backend_failures(answers, "response_id", "backend", "error", "found")[0]


@query(r"""
WITH b AS (SELECT response_id, CAST(body AS JSON) AS j FROM openalex_responses WHERE json_valid(body)),
w AS (SELECT response_id, unnest(range(len(ws))) AS rank, unnest(ws) AS w FROM (SELECT response_id, CAST(json_extract(j, '$.results') AS JSON[]) AS ws FROM b WHERE json_type(j, '$.results') = 'ARRAY'))
SELECT response_id, CAST(rank AS INT) AS rank, trim(coalesce(nullif(json_extract_string(w, '$.display_name'), ''), json_extract_string(w, '$.title'))) AS title, TRY_CAST(json_extract_string(w, '$.publication_year') AS INT) AS year,
  TRY_CAST(json_extract_string(w, '$.cited_by_count') AS BIGINT) AS citations, nullif(trim(json_extract_string(w, '$.id')), '') AS source_id, nullif(trim(json_extract_string(w, '$.primary_location.source.display_name')), '') AS venue,
  nullif(trim(json_extract_string(w, '$.best_oa_location.pdf_url')), '') AS pdf_url FROM w WHERE json_type(w) = 'OBJECT' AND coalesce(nullif(json_extract_string(w, '$.display_name'), ''), json_extract_string(w, '$.title')) IS NOT NULL""")
def openalex_papers(spark, sf_dir):
    rows = adapters.openalex(table(spark, sf_dir, "openalex_responses").where("try_parse_json(body) IS NOT NULL"), "body", "response_id")
    return rows.select("response_id", "rank", "title", "year", "citations", "source_id", "venue", "pdf_url")
