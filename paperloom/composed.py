"""Registered queries of the composed operators over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import ids, text
from paperloom.operators import checks, corpus, fetching, ingest, ranking, reports, resolve, runlog, search, selection
from paperloom.parity import _PAGED, IDS_SQL, _mentions, _records, query, table

#: The keys of the records of both sources, as SQL.
RECORDS_SQL = r"""
raw AS (SELECT hit_id * 2 AS pos, title, [a.name FOR a IN authors] AS names, year, venue, externalids['DOI'] AS d, regexp_replace(trim(externalids['ArXiv']), '(?i)v\d+$', '') AS ax, citationcount AS citations, abstract FROM s2_papers
 UNION ALL SELECT hit_id * 2 + 1, coalesce(nullif(trim(display_name), ''), title), [a.author.display_name FOR a IN authorships], publication_year, primary_location.source.display_name, doi, NULL, cited_by_count, NULL FROM openalex_works),
bare AS (SELECT *, [trim(n) FOR n IN coalesce(names, []) IF trim(n) <> ''] AS authors, regexp_replace(regexp_replace(regexp_replace(lower(d), '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g'), '^["''<(\[]+|["''>)\].,;]+$', '', 'g'), '^(?:https?://)?(?:[\w-]+\.)*doi\.[a-z]+/|^doi[:.]*', '') AS dt FROM raw WHERE trim(title) <> ''),
rec AS (SELECT pos, trim(title) AS title, authors, year, nullif(trim(venue), '') AS venue, CASE WHEN regexp_matches(dt, '^10\.\d{3,9}(?:\.\d+)*/.+') THEN dt END AS doi, nullif(ax, '') AS arxivid, citations FROM bare),
parts AS (SELECT *, regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '', 'g') AS tk,
  regexp_replace(lower(strip_accents(coalesce(CASE WHEN contains(authors[1], ',') THEN trim(split_part(authors[1], ',', 1)) ELSE regexp_extract(authors[1], '(\S+)$', 1) END, ''))), '[^a-z0-9]+', '', 'g') AS sn FROM rec),
keyed AS (SELECT pos, unnest([k FOR k IN [CASE WHEN arxivid IS NOT NULL THEN 'arxiv:' || lower(arxivid) WHEN starts_with(doi, '10.48550/arxiv.') THEN 'arxiv:' || regexp_replace(doi[16:], 'v\d+$', '') END,
  CASE WHEN NOT starts_with(doi, '10.48550/arxiv.') THEN 'doi:' || doi END, CASE WHEN tk <> '' THEN 'title:' || tk || '|' || sn END] IF k IS NOT NULL]) AS key FROM parts)"""

#: Every record with the smallest position it is connected with, as SQL.
ROOTS_SQL = r"""
stars AS (SELECT pos AS u, min(pos) OVER (PARTITION BY key) AS v FROM keyed), edges AS (SELECT DISTINCT u, v FROM stars WHERE u <> v UNION SELECT DISTINCT v, u FROM stars WHERE u <> v),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
roots AS (SELECT r.pos, least(r.pos, coalesce(m.low, r.pos)) AS root FROM rec r LEFT JOIN (SELECT u, min(v) AS low FROM reach GROUP BY u) m ON m.u = r.pos)"""


@query(rf"""
WITH RECURSIVE {RECORDS_SQL}, {ROOTS_SQL}
SELECT root, count(*) AS n_records, arg_min(title, (-length(title), pos)) AS title, arg_min(year, pos) FILTER (WHERE year IS NOT NULL) AS year, arg_min(venue, pos) FILTER (WHERE venue IS NOT NULL) AS venue,
  arg_min(doi, pos) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(arxivid, pos) FILTER (WHERE arxivid IS NOT NULL) AS arxivid, max(citations) AS citations FROM rec JOIN roots USING (pos) GROUP BY root""")
def merged_records(spark, sf_dir):
    return resolve.resolved(_records(spark, sf_dir)).select("root", "n_records", "title", "year", "venue", "doi", "arxivid", "citations")


def _hits(spark, sf_dir):
    """Hits of every point's query: two backends, their orders given by hit_id."""
    number = F.regexp_extract("point", r"(\d+)$", 1).cast("int")
    records = _records(spark, sf_dir).withColumn("point", F.get("tags", F.lit(0))).where("point IS NOT NULL")
    backend = F.when(F.col("pos") % 2 == 0, "semanticscholar").otherwise("openalex")
    return records.select(number.alias("query_no"), backend.alias("backend"), F.col("pos").alias("rank"), "title", "authors", "abstract", "year", "venue", "doi", "arxivid", "citations", F.array("point").alias("points"))


def _answers(spark, sf_dir):
    responses = table(spark, sf_dir, "openalex_responses").where("point IS NOT NULL")
    failed = F.expr("try_parse_json(body) IS NULL")
    return responses.select(F.regexp_extract("point", r"(\d+)$", 1).cast("int").alias("query_no"), F.col("point").alias("label"), F.lit("openalex").alias("backend"), F.lit(0).alias("n_found"), F.when(failed, "unreadable").alias("error"))


@query()
def search_run(spark, sf_dir):
    found = search.execute_search(_hits(spark, sf_dir), _answers(spark, sf_dir), 100_000)
    return found.papers.select("place", "paper_id", "title", "year", "doi", "arxivid", "citations", F.size("points").cast("bigint").alias("n_points"))


@query(rf"""
WITH {RECORDS_SQL}, h AS (SELECT pos, CAST(regexp_extract(p.point, '(\d+)$', 1) AS INT) AS query_no, pos % 2 AS b, coalesce(citations, 0) AS c FROM rec JOIN (SELECT hit_id * 2 AS pos, point FROM s2_papers UNION ALL SELECT hit_id * 2 + 1, point FROM openalex_works) p USING (pos) WHERE p.point IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_no, b ORDER BY pos) AS backend_rank FROM h)
SELECT query_no, pos, row_number() OVER (PARTITION BY query_no ORDER BY backend_rank, c DESC, 1 - b) AS turn FROM r""")
def search_turns(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumnRenamed("rank", "pos")
    ranked = ranking.interleaved(hits, "backend", [F.asc("pos")], F.col("citations"), ["query_no"])
    return ranking.round_robin(ranked, "query_no", [F.asc("backend_rank"), F.asc("weight_order"), F.asc("backend")]).select("query_no", "pos", "turn")


@query(r"""
WITH a AS (SELECT CAST(regexp_extract(point, '(\d+)$', 1) AS INT) AS query_no, point, NOT json_valid(body) AS failed FROM openalex_responses WHERE point IS NOT NULL),
n AS (SELECT count(DISTINCT query_no) AS n FROM a), q AS (SELECT query_no, point FROM a GROUP BY ALL HAVING bool_and(failed)), f AS (SELECT count(*) AS k FROM a WHERE failed)
SELECT CAST(query_no AS BIGINT) AS order_no, point AS subject, 'No backend answered for ' || point || '.' AS warning FROM q
UNION ALL SELECT 1099511627776, 'openalex', 'openalex failed on ' || k || ' of ' || n || CASE WHEN n = 1 THEN ' query' ELSE ' queries' END || '; results are narrower than they look.' FROM f, n WHERE k > 0""")
def search_warnings(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    return search.search_warnings(answers, answers.select("query_no").distinct().count())


@query("""
WITH p AS (SELECT hit_id, title, citationcount, year FROM s2_papers WHERE year IS NULL OR year >= 2015)
SELECT hit_id, title FROM p ORDER BY coalesce(citationcount, 0) DESC, title, hit_id LIMIT 20""")
def search_probe(spark, sf_dir):
    papers = table(spark, sf_dir, "s2_papers").select("hit_id", "title", F.col("citationcount").alias("citations"), "year")
    return ranking.capped(search.not_before(papers, 2015), [F.desc(F.coalesce("citations", F.lit(0))), "title", "hit_id"], search.PROBE_LIMITS[1]).select("hit_id", "title")


_GROUPS_SQL = f"""{IDS_SQL}, keyed AS (SELECT *, coalesce('doi:' || doi, 'arxiv:' || arxivid, 'title:' || regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '', 'g')) AS key FROM ids),
grouped AS (SELECT key, count(*) AS mentions, min_by(title, followup_id) AS title, min_by(doi, followup_id) FILTER (WHERE doi IS NOT NULL) AS doi, min_by(arxivid, followup_id) FILTER (WHERE arxivid IS NOT NULL) AS arxivid FROM keyed GROUP BY key),
known AS (SELECT DISTINCT 'doi:' || lower(trim(externalids['DOI'])) AS key FROM s2_papers WHERE trim(externalids['DOI']) <> ''),
fresh AS (SELECT * FROM grouped WHERE key NOT IN (SELECT key FROM known))"""


def _known(spark, sf_dir):
    doi = F.lower(F.trim(F.col("externalids")["DOI"]))
    return table(spark, sf_dir, "s2_papers").where(doi != "").select(F.concat(F.lit("doi:"), doi).alias("key")).distinct()


def _plan(spark, sf_dir):
    known = _known(spark, sf_dir)
    return search.followup_plan(checks.followup_groups(_mentions(spark, sf_dir)), known, known.count() + 150)


@query(f"WITH {_GROUPS_SQL}, top AS (SELECT key FROM fresh ORDER BY mentions DESC, title, key LIMIT 150) SELECT key, mentions, title, key IN (SELECT key FROM top) AS kept FROM fresh")
def followup_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("key", "mentions", "title", "kept")


@query(f"WITH {_GROUPS_SQL} SELECT key, 'id' AS kind, doi, CASE WHEN doi IS NULL THEN arxivid END AS arxivid, title FROM fresh")
def followup_queries(spark, sf_dir):
    return search.to_queries(_plan(spark, sf_dir)).select("key", "kind", "doi", "arxivid", "title")


@query(f"""
WITH {_PAGED}, f AS (SELECT s.*, d.doc_kind, d.doc_id % 3 = 0 AS fresh, lower(d.doc_kind) AS k FROM status s JOIN documents d USING (doc_id))
SELECT doc_id, CASE WHEN fresh THEN 'skipped' WHEN k = 'table' THEN 'failed' WHEN k <> 'pages' THEN 'copied' WHEN status <> 'extracted' THEN 'failed' ELSE 'extracted' END AS status,
  CASE WHEN NOT fresh AND k = 'pages' THEN n_pages END AS n_pages, CASE WHEN NOT fresh THEN CASE WHEN k = 'table' THEN 0 ELSE characters END END AS characters,
  CASE WHEN fresh THEN NULL WHEN k = 'table' THEN 'unsupported extension ".csv"' WHEN k = 'pages' AND status = 'scanned' THEN 'no text layer on any of ' || n_pages || ' page(s)' END AS reason FROM f""")
def ingest_status(spark, sf_dir):
    kind = F.when(F.lower("doc_kind") == "pages", ".pdf").when(F.lower("doc_kind") == "table", ".csv").otherwise(".md")
    documents = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.coalesce(kind, F.lit(".md"))).alias("path"), F.col("written_at").alias("changed"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    outputs = documents.where("doc_id % 3 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.coalesce("changed", F.current_timestamp()).alias("written"))

    def pages(content: bytes) -> list[str]:
        body = content.decode("utf-8")
        return [body[i : i + 1500] for i in range(0, max(1, len(body)), 1500)]

    status = corpus.ingest_status(documents.drop("doc_id").withColumn("changed", F.coalesce("changed", F.lit("2000-01-01").cast("timestamp"))), outputs, pages)
    reason = F.when(F.col("error").contains("(s) ("), None).otherwise(F.col("error"))
    return status.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"), "status", "n_pages", "characters", reason.alias("reason"))


_SPACES = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


@query(rf"""WITH {_PAGED}
SELECT doc_id, md5('---' || chr(10) || 'source: "doc ' || doc_id || '"' || chr(10) || 'pages: ' || n_pages || chr(10) || CASE WHEN len(bare) > 0 THEN 'textless_pages: [' || array_to_string(bare, ', ') || ']' || chr(10) ELSE '' END || '---' || chr(10)
  || array_to_string(['<!-- page ' || i || ' -->' || chr(10) || chr(10) || regexp_replace(substring(coalesce(text, ''), (i - 1) * 1500 + 1, 1500), '^{_SPACES}|{_SPACES}$', '', 'g') FOR i IN range(1, n_pages + 1)], chr(10) || chr(10)) || chr(10)) AS document_md5
FROM status JOIN documents USING (doc_id)""")
def rendered_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    paged = ingest.page_stats(documents.withColumn("pages", ingest.pages_of(F.coalesce("text", F.lit("")), 1500)), "pages")
    return paged.select("doc_id", F.md5(ingest.rendered(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("pages"), F.col("textless"))).alias("document_md5"))


@query(r"""
WITH p AS (SELECT paperid AS id, max(openaccesspdf.url) AS url, max(abstract) AS abstract FROM s2_papers WHERE paperid IS NOT NULL GROUP BY 1), f AS (SELECT DISTINCT paperid AS id, paperid || '.pdf' AS file FROM documents WHERE paperid IS NOT NULL AND doc_kind = 'card')
SELECT id, CASE WHEN f.file IS NOT NULL THEN 'downloaded' WHEN regexp_matches(abstract, '[^\s]') THEN 'abstract-only' ELSE 'failed' END AS status, coalesce(f.file, CASE WHEN regexp_matches(abstract, '[^\s]') THEN id || '.md' END) AS file,
  CASE WHEN f.file IS NOT NULL THEN NULL WHEN regexp_matches(url, '[^\s]') THEN 'no answer' WHEN NOT coalesce(regexp_matches(abstract, '[^\s]'), false) THEN 'no open-access PDF and no abstract' END AS error FROM p LEFT JOIN f USING (id)""")
def fetch_manifest(spark, sf_dir):
    papers = table(spark, sf_dir, "s2_papers").where("paperid IS NOT NULL").groupBy(F.col("paperid").alias("id")).agg(
        F.max("openaccesspdf.url").alias("pdf_url"), F.max("abstract").alias("abstract"), F.max("title").alias("title"), F.max("year").alias("year"), F.max("venue").alias("venue"), F.array_sort(F.collect_set("point")).alias("points"))
    papers = papers.withColumns({"authors": F.array().cast("array<string>"), "doi": F.lit(None).cast("string"), "arxivid": F.lit(None).cast("string")})
    files = table(spark, sf_dir, "documents").where("paperid IS NOT NULL AND doc_kind = 'card'").groupBy("paperid").agg(F.max("n_chars").alias("bytes")).select(F.concat("paperid", F.lit(".pdf")).alias("name"), "bytes")
    none = spark.createDataFrame([], "id string, content binary, error string")
    return fetching.manifest(papers, files, spark.createDataFrame([], fetching.MANIFEST), none).select("id", "status", "file", "error")


@query(r"""
WITH e AS (SELECT response_id, CAST(unnest(CAST(json_extract(CAST(body AS JSON), '$.results') AS JSON[])) AS JSON) AS w FROM openalex_responses WHERE json_valid(body) AND json_type(CAST(body AS JSON), '$.results') = 'ARRAY'),
i AS (SELECT trim(json_extract_string(w, '$.id')) AS id FROM e WHERE json_type(w) = 'OBJECT' AND json_type(w, '$.id') = 'VARCHAR')
SELECT id, count(*) AS n FROM i WHERE id <> '' GROUP BY id""")
def selectable_works(spark, sf_dir):
    listed = selection.selectable(table(spark, sf_dir, "openalex_responses"), "body", "results")
    return listed.groupBy("id").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT DISTINCT point AS id FROM openalex_works WHERE point IS NOT NULL UNION SELECT 'nowhere-1'), c AS (SELECT id FROM candidates WHERE rationale IS NOT NULL)
SELECT 'unknown' AS rule, id AS detail FROM w WHERE id NOT IN (SELECT id FROM c)""")
def keep_refusals(spark, sf_dir):
    listed = table(spark, sf_dir, "candidates").where("rationale IS NOT NULL").select("id")
    keep = table(spark, sf_dir, "openalex_works").where("point IS NOT NULL").select(F.col("point").alias("id")).distinct().union(spark.createDataFrame([("nowhere-1",)], "id string"))
    return selection.refusals(listed, keep)


@query("""
SELECT event_id, gap_ms FROM (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e3 AS gap_ms FROM events) WHERE gap_ms < 60000""")
def request_spacing(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ended", F.col("ts"))
    return runlog.too_close(events, "user_id", ["ts", "event_id"], "ended", F.lit(60_000), "ts").select("event_id", "gap_ms")


@query("SELECT event_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e3 AS duration_ms FROM events")
def step_durations(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    begun = events.groupBy("user_id").agg(F.min("ts").alias("started_at"))
    return reports.step_durations(events.join(begun, "user_id").withColumnRenamed("ts", "ended_at")).select("event_id", "duration_ms")


@query("""
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_rows, round(sum(l_quantity), 2) AS input, round(sum(l_linenumber), 2) AS output, round(sum(l_discount), 2) AS cache_read, round(sum(l_tax), 2) AS cache_write, round(sum(l_extendedprice), 2) AS total, round(sum(CASE WHEN l_tax = 0 THEN 0 ELSE l_tax END), 2) AS cost,
  bool_or(l_quantity > 0 AND l_tax = 0) AS unpriced FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def usage_measures(spark, sf_dir):
    names = {"l_quantity": "input", "l_linenumber": "output", "l_discount": "cache_read", "l_tax": "cache_write", "l_extendedprice": "total"}
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed(names).withColumn("cost", F.col("cache_write"))
    usage = runlog.usage_rollup(lines, "l_returnflag", list(reports.USAGE), "input", "cost")
    return usage.select("l_returnflag", "n_rows", *[F.round(m, 2).cast("double").alias(m) for m in reports.USAGE], "unpriced")


@query("""
WITH c AS (SELECT hit_id, point, title, coalesce(citationcount, 0) AS n FROM s2_papers WHERE point IS NOT NULL)
SELECT point, hit_id, row_number() OVER (PARTITION BY point ORDER BY n DESC, title COLLATE en, title, lpad(CAST(hit_id AS VARCHAR), 12, '0')) AS place FROM c""")
def evidence_order(spark, sf_dir):
    cards = table(spark, sf_dir, "s2_papers").where("point IS NOT NULL").select("point", "hit_id", "title", F.col("citationcount").alias("citations"), F.lpad(F.col("hit_id").cast("string"), 12, "0").alias("card"))
    return reports.card_order(cards).select("point", "hit_id", "place")


@query("SELECT hit_id, title, year, row_number() OVER (ORDER BY year DESC NULLS LAST, title COLLATE en NULLS FIRST, title NULLS FIRST, hit_id) - 1 AS place FROM s2_papers")
def reference_order(spark, sf_dir):
    papers = table(spark, sf_dir, "s2_papers").select("hit_id", "title", "year")
    return reports.ordered(papers, [*reports.newest_first(), F.asc("hit_id")]).select("hit_id", "title", "year", "place")


@query("""
WITH p AS (SELECT count(*) AS n FROM followups), f AS (SELECT count(*) AS n FROM openalex_works), c AS (SELECT point AS id, count(*) AS n_cards FROM s2_papers GROUP BY 1)
SELECT id, coalesce(n_cards, 0) AS n_cards, greatest(0, (SELECT n FROM p) - (SELECT n FROM f)) AS n_unchased FROM candidates LEFT JOIN c USING (id)""")
def unchased_followups(spark, sf_dir):
    n = reports.unchased(table(spark, sf_dir, "followups"), table(spark, sf_dir, "openalex_works"))
    cards = table(spark, sf_dir, "s2_papers").where("point IS NOT NULL").select(F.array("point").alias("points"), F.lit("full_text").alias("level"))
    packets = checks.evidence(table(spark, sf_dir, "candidates"), cards, spark.createDataFrame([], "points array<string>"), "id")
    return packets.select("id", "n_cards", F.lit(n).cast("bigint").alias("n_unchased"))


@query("SELECT CAST(p_size AS BIGINT) AS size, p_partkey, slug FROM (SELECT p_size, p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part)")
def name_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("size"), "p_partkey", text.slug("p_name").alias("slug"))


@query(f"WITH {IDS_SQL} SELECT followup_id, coalesce(doi, arxivid, title) AS label FROM ids")
def query_labels(spark, sf_dir):
    doi, arxiv = ids.work_ids(F.col("doi"), F.col("arxivid"))
    # exploded, so that the two long expressions don't end up in one
    rows = table(spark, sf_dir, "followups").withColumn("_doi", F.explode(F.array(doi))).withColumn("_arxiv", F.explode(F.array(arxiv)))
    doi, arxiv = F.col("_doi"), F.col("_arxiv")
    return rows.select("followup_id", text.query_label(F.lit("id"), F.lit(None).cast("string"), doi, arxiv, F.col("title")).alias("label"))
