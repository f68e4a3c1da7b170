"""Queries and oracle SQL of the archive's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import audit, catalog, fulltext, packs, vault, web, windows
from quillspan.operators import chunking, federation, identity
from quillspan.functions.text import count_of, deadline_us, index_tokens, page_letters, sparse_pages, tidy_tags
from quillspan.plans.bindings import candidates, document_chunks, document_index, document_items, items
from quillspan.sources.tables import table
from quillspan.streaming import jobs

NOW_US = 1_740_787_200_000_000  # 2025-03-01T00:00:00Z, a parameter of the freshness queries
QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- shared SQL -----------------------------------------------------------------
_WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ESC = _WS.replace("{", "{{").replace("}", "}}")
_STRIP = "regexp_replace({0}, '^" + _ESC + "+|" + _ESC + "+$', '', 'g')"
_NK = r"nullif(lower(" + _STRIP + "), '')"


def _first(t: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at) AS rn FROM {t}) WHERE rn = 1)"


ITEMS, CANDS = _first("items", "item_id"), _first("candidates", "candidate_id")
_TAGS = "array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda x: " + _STRIP.format("x") + "), lambda x: x <> ''))), ',')"

DOCS = rf"""(SELECT 'lib_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS item_id,
  array_to_string(string_split(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))[1], ' ')[1:6], ' ') AS title,
  source, trust_class, 'v1.' || (doc_id % 10) AS version_label,
  ['format:' || coalesce(media_type, 'unknown'), 'lang:' || coalesce(lang, 'und')] AS tags,
  sha256(text) AS sha256, text, doc_id
  FROM documents WHERE text IS NOT NULL AND {_STRIP.format('text')} <> '')"""

_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
CHUNKS = rf"""(SELECT item_id, 'chk_' || left(sha256(sha256 || '|' || place || '|' || sha256(body)), 24) AS chunk_id,
  CAST(row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS INTEGER) AS ordinal, body, kind, a AS start_line, b AS end_line, page,
  sha256(body) AS text_sha256, title, source, tags
  FROM (
    SELECT item_id, sha256, title, source, tags, k, {_STRIP.format("array_to_string(ls[k * 40 + 1:k * 40 + 40], chr(10))")} AS body, 'lines' AS kind,
      CAST(k * 40 + 1 AS INTEGER) AS a, CAST(least(len(ls), k * 40 + 40) AS INTEGER) AS b, CAST(NULL AS INTEGER) AS page,
      'lines:' || (k * 40 + 1) || '-' || least(len(ls), k * 40 + 40) AS place
    FROM (SELECT *, unnest(range((len(ls) - 1) // 40 + 1)) AS k FROM (
      SELECT *, CASE WHEN ls0[-1] = '' THEN ls0[:-2] ELSE ls0 END AS ls FROM (
        SELECT *, regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '{_BREAK}') AS ls0 FROM {DOCS} WHERE NOT contains(text, chr(12)))))
    UNION ALL
    SELECT item_id, sha256, title, source, tags, k, {_STRIP.format("ps[k + 1]")}, 'page', NULL, NULL, CAST(k + 1 AS INTEGER), 'page:' || (k + 1)
    FROM (SELECT *, unnest(range(len(ps))) AS k FROM (
      SELECT *, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(12)) AS ps FROM {DOCS} WHERE contains(text, chr(12)))))
  WHERE body <> '')"""


def _tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


TOKENS = f"""(SELECT item_id, chunk_id, title, title_t, source_t, tags_t, body_t, len(title_t) + len(source_t) + len(tags_t) + len(body_t) AS dl
  FROM (SELECT item_id, chunk_id, title, {_tok('title')} AS title_t, {_tok('source')} AS source_t,
        {_tok("array_to_string(tags, ' ')")} AS tags_t, {_tok('body')} AS body_t FROM {CHUNKS}))"""


def _bm25_sql(query: str) -> str:
    phrases = [p for p in map(fulltext.phrase, fulltext.query_terms(query)) if p]

    def hits(col: str, p: list[str]) -> str:
        test = " AND ".join(f"{col}[i + {j}] = '{w}'" for j, w in enumerate(p))
        return f"len(list_filter(range(1, len({col}) + 1), lambda i: {test}))"

    freq = ", ".join(
        "(" + " + ".join(f"{w} * {hits(f + '_t', p)}" for f, w in fulltext.WEIGHTS.items()) + f") AS f{i}" for i, p in enumerate(phrases)
    )
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))
    score = " + ".join(
        f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)"
        f" * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
        for i in range(len(phrases))
    )
    every = " AND ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""WITH fr AS (SELECT item_id, chunk_id, title, dl, {freq} FROM {TOKENS}),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {ns} FROM fr)
SELECT item_id, chunk_id, title, round({score}, 6) AS score FROM fr, st WHERE {every}"""


def _top(sql: str, k: int) -> str:
    return f"SELECT * FROM ({sql}) ORDER BY score DESC, lower(title), item_id, chunk_id LIMIT {k}"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# --- catalog --------------------------------------------------------------------
@query(f"""WITH i AS (SELECT * FROM {ITEMS}),
n AS (SELECT {_NK.format('supersedes_item_id')} AS k, min(item_id) AS successor_item_id FROM i GROUP BY 1)
SELECT item_id, title, imported_at, {_TAGS} AS tags, n.successor_item_id FROM i LEFT JOIN n ON n.k = {_NK.format('item_id')}""")
def catalog_items(s: SparkSession, b: str) -> DataFrame:
    out = catalog.catalog_items(items(s, b))
    return out.select("item_id", "title", "imported_at", F.array_join("tags", ",").alias("tags"), "successor_item_id")


@query(f"SELECT candidate_id, title, source, staged_at FROM {CANDS} WHERE state = 'staged'")
def candidates_by_state(s, b):
    return catalog.staged_candidates(candidates(s, b), "staged").select("candidate_id", "title", "source", "staged_at")


_WANTED = "SELECT DISTINCT left(item_id, CASE WHEN ascii(right(item_id, 1)) % 3 = 0 THEN 8 WHEN ascii(right(item_id, 1)) % 3 = 1 THEN 7 ELSE 36 END) AS wanted FROM items"


@query(f"""WITH w AS ({_WANTED}), i AS (SELECT * FROM {ITEMS}),
h AS (SELECT wanted, item_id, max(x = wanted) AS exact FROM w JOIN (SELECT item_id, item_id AS x FROM i UNION ALL SELECT item_id, sha256 FROM i) n
      ON starts_with(x, wanted) GROUP BY 1, 2),
g AS (SELECT wanted, min(item_id) FILTER (exact) AS e, min(item_id) AS o, count(*) AS n FROM h GROUP BY 1)
SELECT w.wanted, coalesce(e, CASE WHEN n = 1 THEN o END) AS item_id,
       CASE WHEN e IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'prefix' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status
FROM w LEFT JOIN g USING (wanted)""")
def lookup_prefix(s, b):
    i = items(s, b)
    mod = F.ascii(F.right("item_id", F.lit(1))) % 3
    size = F.when(mod == 0, 8).when(mod == 1, 7).otherwise(36)
    return catalog.lookup(i, i.select(F.left("item_id", size).alias("wanted")), "item_id")


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def payload_sha256(s, b):
    d = table(s, b, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"SELECT item_id, chunk_id, ordinal, kind, start_line, end_line, page, text_sha256 FROM {CHUNKS}")
def chunk_lines(s, b):
    d = document_items(s, b).select("item_id", "sha256", "text")
    c = chunking.chunk_texts(d)
    return c.select("item_id", "chunk_id", "ordinal", "location.kind", "location.start_line", "location.end_line", "location.page", "text_sha256")


@query(rf"""SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS INTEGER) AS ordinal, CAST(k + 1 AS INTEGER) AS page, sha256(body) AS text_sha256
FROM (SELECT item_id, k, {_STRIP.format("ps[k + 1]")} AS body FROM (SELECT *, unnest(range(len(ps))) AS k FROM (
  SELECT item_id, string_split(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10) || chr(10), chr(12)), chr(12)) AS ps FROM {DOCS}))) WHERE body <> ''""")
def chunk_pages(s, b):
    d = document_items(s, b)
    paged = F.replace(F.regexp_replace("text", r"\r\n?", "\n"), F.lit("\n\n"), F.lit("\f"))
    c = chunking.chunk_texts(d.select("item_id", "sha256", paged.alias("text"), F.lit("application/pdf").alias("media_type")))
    return c.select("item_id", "ordinal", "location.page", "text_sha256")


@query(f"""SELECT term, count(DISTINCT chunk_id || item_id) AS n_chunks, CAST(sum(tf) AS BIGINT) AS n_total FROM (
SELECT item_id, chunk_id, term, count(*) AS tf FROM (
  SELECT item_id, chunk_id, unnest(list_concat(list_concat(title_t, source_t), list_concat(tags_t, body_t))) AS term FROM {TOKENS}) GROUP BY 1, 2, 3) GROUP BY 1""")
def tokens_postings(s, b):
    c = document_index(s, b).postings().groupBy("term", "item_id", "chunk_id").agg(F.sum(F.size("positions")).alias("tf"))
    return c.groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("n_total"))


@query(f"SELECT count(*) AS n_rows, CAST(sum(dl) AS BIGINT) AS total_tokens, round(avg(dl), 6) AS avgdl FROM {TOKENS}")
def corpus_stats(s, b):
    return document_index(s, b).stats()


def _search(text: str, k: int = 20):
    return lambda s, b: fulltext.top(document_index(s, b).search(text), k)


for _name, _text in (
    ("bm25_single", "rheostat"),
    ("bm25_and", "gasket Brannick"),
    ("bm25_phrase", "low-pressure line-carries the"),
    ("bm25_repeated_term", "valve valve night"),
    ("bm25_idf_clamp", "the"),
    ("bm25_title_phrase", "owner-import thermostat"),
    ("bm25_no_match", "low-pressure v1.4 the"),
):
    QUERIES[_name], SQL[_name] = _search(_text), _top(_bm25_sql(_text), 20)


def _sub_sql(body: str, terms: list[str], weight: int = 1) -> str:
    return " + ".join(f"CAST((length({body}) - length(replace({body}, '{t}', ''))) // length('{t}') AS INTEGER) * {weight}" for t in terms)


_F_TERMS = fulltext.query_terms("rheostat night-watch")


@query(_top(f"SELECT item_id, chunk_id, title, CAST({_sub_sql('lower(body)', _F_TERMS)} AS DOUBLE) AS score FROM {CHUNKS} WHERE {_sub_sql('lower(body)', _F_TERMS)} > 0", 25))
def substring_fallback(s, b):
    return fulltext.top(fulltext.substring_search(document_chunks(s, b), "rheostat night-watch").drop("snippet"), 25)


_HAY = "lower(title || ' ' || source || ' ' || trust_class || ' ' || coalesce(version_label, '') || ' ' || array_to_string(tags, ' '))"
_M_TERMS = fulltext.query_terms("harrow lang:de v1.4")


def _meta_sql(terms, src):
    return f"SELECT item_id, title, CAST({_sub_sql(_HAY, terms, 5)} AS DOUBLE) AS score FROM {src} WHERE {_sub_sql(_HAY, terms, 5)} > 0"


@query(f"SELECT * FROM ({_meta_sql(_M_TERMS, DOCS)}) ORDER BY score DESC, lower(title), item_id LIMIT 30")
def metadata_search(s, b):
    d = fulltext.metadata_search(document_items(s, b), "harrow lang:de v1.4")
    return d.orderBy(F.desc("score"), F.lower("title"), "item_id").limit(30)


_E = "Umberdale harrow-radio"


@query(f"""WITH c AS ({_top(_bm25_sql(_E), 40)}),
m AS ({_meta_sql(fulltext.query_terms(_E), DOCS)})
SELECT * FROM (SELECT 1 AS stage, item_id, chunk_id, title, score, 'full_text' AS retrieval_method FROM c
UNION ALL SELECT 2, item_id, NULL, title, score, 'metadata' FROM m WHERE item_id NOT IN (SELECT item_id FROM c))
ORDER BY stage, score DESC, lower(title), item_id, chunk_id LIMIT 40""")
def evidence_two_stage(s, b):
    return fulltext.evidence(document_index(s, b), document_items(s, b), _E, 40)


@query(f"""WITH c AS ({_top(_bm25_sql(_E), 40)}),
m AS ({_meta_sql(fulltext.query_terms(_E), DOCS)}), e AS (
SELECT * FROM (SELECT 1 AS stage, item_id, chunk_id, title, score FROM c
UNION ALL SELECT 2, item_id, NULL, title, score FROM m WHERE item_id NOT IN (SELECT item_id FROM c))
ORDER BY stage, score DESC, lower(title), item_id, chunk_id LIMIT 40)
SELECT 'fs_' || left(sha256('library|' || e.item_id || '|' || coalesce(chunk_id, 'metadata')), 24) AS result_id, 'library' AS provider, 'library:' || e.item_id AS uri,
substr(trim(e.title), 1, 300) AS title, substr(trim(d.source), 1, 300) AS source FROM e JOIN {DOCS} d ON d.item_id = e.item_id""")
def library_results(s, b):
    d = document_items(s, b)
    rows = fulltext.evidence(document_index(s, b), d, _E, 40).join(d.select("item_id", "source", "sha256", "trust_class"), "item_id")
    return federation.library_rows(rows.withColumn("snippet", F.lit(""))).select("result_id", "provider", "uri", "title", "source")


def _shown(s, b, text: str, k: int) -> DataFrame:
    """Ranked chunks with what evidence rows carry."""
    hits = fulltext.top(document_index(s, b).search(text), k)
    rows = fulltext.with_snippets(hits, document_chunks(s, b), text)
    sha = document_items(s, b).select("item_id", "sha256")
    return rows.join(sha, "item_id").withColumn("retrieval_method", F.lit("full_text"))


@query()
def search_snippets(s, b):
    return _shown(s, b, "rheostat night", 25)


@query()
def evidence_window_text(s, b):
    return windows.expand_evidence(_shown(s, b, "rheostat", 20), document_items(s, b), document_chunks(s, b), "rheostat")


@query()
def fulltext_snippet(s, b):
    return fulltext.top(fulltext.substring_search(document_chunks(s, b), "thermostat"), 25)


_PAGES = _first("chunks", "item_id, chunk_id")


@query(f"""WITH c AS (SELECT * FROM {_PAGES}), n AS (
SELECT a.chunk_id AS seed_id, a.item_id, a.ordinal AS seed_ordinal, b.chunk_id, b.ordinal, b.body
FROM c a JOIN c b ON a.item_id = b.item_id AND b.ordinal BETWEEN a.ordinal - 1 AND a.ordinal + 1)
SELECT seed_id, item_id, seed_ordinal, chunk_id, ordinal,
  CAST(coalesce(sum(length(body) + 1) OVER (PARTITION BY seed_id, item_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM n""")
def evidence_window_neighbors(s, b):
    c = catalog.first_delivery(table(s, b, "chunks").withColumn("k", F.concat_ws("|", "item_id", "chunk_id")), "k")
    n = windows.neighbours(c.select("item_id", "chunk_id", "ordinal"), c, 1)
    return n.select("seed_id", "item_id", "seed_ordinal", "chunk_id", "ordinal", F.col("start").cast("long").alias("start"))


# --- lifecycle, lineage, freshness ------------------------------------------------
_ISO = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d)(:\d\d(?:[.]\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?$"
_SA = _STRIP.format("stale_after")
_DL = rf"""CASE WHEN regexp_matches({_SA}, '^\d{{4}}-\d\d-\d\d$') THEN epoch_us(TRY_CAST({_SA} || ' 00:00:00' AS TIMESTAMP))
WHEN regexp_matches({_SA}, '{_ISO}') THEN epoch_us(TRY_CAST(regexp_extract({_SA}, '{_ISO}', 1) || ' ' || regexp_extract({_SA}, '{_ISO}', 2)
  || CASE WHEN regexp_extract({_SA}, '{_ISO}', 3) = '' THEN ':00' ELSE regexp_extract({_SA}, '{_ISO}', 3) END AS TIMESTAMP))
 - CASE WHEN regexp_extract({_SA}, '{_ISO}', 4) IN ('', 'Z') THEN 0 ELSE
   (CASE WHEN left(regexp_extract({_SA}, '{_ISO}', 4), 1) = '-' THEN -1 ELSE 1 END)
   * (CAST(substr(regexp_extract({_SA}, '{_ISO}', 4), 2, 2) AS BIGINT) * 60 + CAST(right(regexp_extract({_SA}, '{_ISO}', 4), 2) AS BIGINT)) * 60000000 END END"""
_WARN = f"""concat_ws(',', CASE lifecycle_state WHEN 'superseded' THEN 'source_superseded' WHEN 'stale' THEN 'source_stale' END,
CASE WHEN nullif({_SA}, '') IS NOT NULL AND ({_DL}) IS NULL THEN 'invalid_stale_after' WHEN ({_DL}) <= {NOW_US} THEN 'freshness_deadline_passed' END)"""


@query(f"SELECT item_id, {_WARN} AS warnings, {_DL} AS deadline_us FROM {ITEMS}")
def lifecycle_warnings(s, b):
    return items(s, b).select("item_id", F.array_join(catalog.warnings(NOW_US), ",").alias("warnings"), deadline_us(F.col("stale_after")).alias("deadline_us"))


@query(f"SELECT item_id, lifecycle_state, stale_after FROM {ITEMS} WHERE lifecycle_state = 'stale' OR ({_DL}) <= {NOW_US}")
def stale_items(s, b):
    return catalog.stale_items(items(s, b), NOW_US).select("item_id", "lifecycle_state", "stale_after")


@query(f"""WITH i AS (SELECT * FROM {ITEMS}), n AS (SELECT {_NK.format('supersedes_item_id')} AS k, min(item_id) AS successor_item_id, count(*) AS n_successors FROM i GROUP BY 1)
SELECT item_id, successor_item_id, n_successors FROM i JOIN n ON n.k = {_NK.format('item_id')}""")
def lineage_successor(s, b):
    return catalog.with_successor(items(s, b)).filter("successor_item_id is not null").select("item_id", "successor_item_id", "n_successors")


@query(f"""WITH i AS (SELECT * FROM {ITEMS}), w AS (SELECT item_id, {_NK.format('supersedes_item_id')} AS k FROM i),
t AS (SELECT w.*, i.lifecycle_state AS st FROM w LEFT JOIN i ON {_NK.format('i.item_id')} = w.k WHERE w.k IS NOT NULL)
SELECT item_id, 'missing_target' AS code FROM t WHERE st IS NULL UNION ALL SELECT item_id, 'target_not_superseded' FROM t WHERE st <> 'superseded'
UNION ALL SELECT item_id, 'multiple_successors' FROM t WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)""")
def lineage_violations(s, b):
    return catalog.lineage_violations(items(s, b))


@query(f"""WITH c AS (SELECT * FROM {CANDS} WHERE state = 'staged'), i AS (SELECT * FROM {ITEMS})
SELECT item_id, title, sha256, CASE WHEN {_NK.format('item_id')} IN (SELECT {_NK.format('supersedes_item_id')} FROM c WHERE {_NK.format('supersedes_item_id')} IS NOT NULL)
  THEN 'superseded' ELSE lifecycle_state END AS lifecycle_state FROM i
UNION ALL SELECT 'lib_' || left(sha256(candidate_id), 32), title, sha256, 'active' FROM c""")
def publish_staged(s, b):
    return catalog.publish(candidates(s, b), items(s, b))


@query(f"""WITH i AS (SELECT *, source = 'owner-import' AND nullif({_STRIP.format('supersedes_item_id')}, '') IS NULL AND nullif({_STRIP.format('superseded_by_item_id')}, '') IS NULL AS gone FROM {ITEMS})
SELECT sha256, count(*) AS n_before, count(*) FILTER (NOT coalesce(gone, false)) AS n_after, count(*) FILTER (NOT coalesce(gone, false)) = 0 AS drop_payload
FROM i GROUP BY 1 HAVING count(*) FILTER (coalesce(gone, false)) > 0""")
def remove_refcount(s, b):
    return catalog.remove(items(s, b), F.col("source") == "owner-import")


@query(f"SELECT item_id, CASE WHEN source = 'owner-import' AND lifecycle_state <> 'superseded' THEN 'stale' ELSE lifecycle_state END AS lifecycle_state FROM {ITEMS}")
def mark_stale(s, b):
    return catalog.mark_stale(items(s, b), F.col("source") == "owner-import")


# --- ingest -----------------------------------------------------------------------
def _files(s, b):
    d = document_items(s, b)
    return d.select(
        F.concat_ws("/", F.lit("drop"), "source", F.concat("item_id", F.lit(".txt"))).alias("path"), "sha256", "source",
        F.lit(None).cast("string").alias("source_uri"), F.octet_length("text").cast("long").alias("bytes"), (F.col("doc_id") % 11 == 0).alias("ignore"),
    )


def _known(s, b):
    d = document_items(s, b).filter("doc_id % 5 = 0")
    return d.select("sha256", "source", F.lit(None).cast("string").alias("source_uri"), F.when(F.col("doc_id") % 2 == 0, "rejected").otherwise("published").alias("state"))


_PLAN = f"""WITH d AS (SELECT 'drop/' || source || '/' || item_id || '.txt' AS path, sha256, source, octet_length(encode(text)) AS bytes, doc_id % 11 = 0 AS ign, doc_id FROM {DOCS}),
k AS (SELECT DISTINCT sha256, source FROM d WHERE doc_id % 5 = 0 AND doc_id % 2 <> 0),
f AS (SELECT d.*, k.sha256 IS NOT NULL AS there FROM d LEFT JOIN k USING (sha256, source)),
u AS (SELECT sha256, source, min(path) AS first_path FROM f WHERE NOT ign AND bytes <= 12000 AND NOT there GROUP BY 1, 2),
p AS (SELECT path, CASE WHEN ign THEN 'sidecar_ignore' WHEN bytes > 12000 THEN 'file_too_large'
      WHEN there @again@ THEN 'already_present' END AS reason FROM f LEFT JOIN u USING (sha256, source)),
plan AS (SELECT path, CASE WHEN reason IS NOT NULL THEN 'skipped' ELSE '@done@' END AS action, reason FROM p)
"""


def _plan_sql(again: str, done: str) -> str:
    return _PLAN.replace("@again@", again).replace("@done@", done)


@query(_plan_sql("OR coalesce(first_path <> path, false)", "staged") + "SELECT * FROM plan")
def ingest_plan(s, b):
    return catalog.ingest_plan(_files(s, b), _known(s, b), max_bytes=12000)


@query(_plan_sql("", "planned_publish") + "SELECT * FROM plan")
def ingest_plan_dry(s, b):
    return catalog.ingest_plan(_files(s, b), _known(s, b), publish=True, dry_run=True, max_bytes=12000)


@query(_plan_sql("OR coalesce(first_path <> path, false)", "staged") + "SELECT action, count(*) AS n_files FROM plan GROUP BY 1")
def ingest_summary(s, b):
    return ingest_plan(s, b).groupBy("action").agg(F.count("*").alias("n_files"))


@query(rf"""SELECT 'in/' || item_id || '_a.TXT' AS path, CASE WHEN doc_id % 3 = 0 THEN title_s WHEN doc_id % 4 = 0 THEN 'emb ' || doc_id ELSE regexp_replace(item_id || '_a', '_+', ' ', 'g') END AS title,
CASE WHEN doc_id % 5 = 0 THEN 'side' ELSE source END AS source, trust_class, coalesce(nullif(lang, ''), 'en') AS language,
array_to_string(list_sort(list_distinct(list_filter(['format:txt', source, CASE WHEN doc_id % 4 = 0 THEN 'author:A' END], lambda x: x IS NOT NULL))), ',') AS tags
FROM (SELECT d.*, {_STRIP.format('title')} AS title_n, coalesce(nullif({_STRIP.format('title')}, ''), CASE WHEN doc_id % 4 = 0 THEN 'emb ' || doc_id ELSE regexp_replace(item_id || '_a', '_+', ' ', 'g') END) AS title_s,
  (SELECT lang FROM documents x WHERE x.doc_id = d.doc_id) AS lang FROM {DOCS} d)""")
def metadata_resolution(s, b):
    d = document_items(s, b).join(table(s, b, "documents").select("doc_id", "lang"), "doc_id")
    n = lambda c, k, v: F.when(F.col("doc_id") % k == 0, v).alias(c)
    f = d.select(
        F.concat(F.lit("in/"), "item_id", F.lit("_a.TXT")).alias("path"), n("side_title", 3, F.col("title")), n("emb_title", 4, F.concat(F.lit("emb "), "doc_id")),
        n("side_source", 5, F.lit("side")), F.col("source").alias("arg_source"), F.lit(None).cast("string").alias("side_trust"), F.col("trust_class").alias("arg_trust"),
        F.lit(None).cast("string").alias("side_language"), F.col("lang").alias("emb_language"), F.lit("en").alias("arg_language"),
        F.array("source").alias("arg_tags"), F.lit(None).cast("array<string>").alias("side_tags"), n("emb_author", 4, F.lit("A")),
    )
    return catalog.resolve_metadata(f).withColumn("tags", F.array_join("tags", ","))


# --- audit, snapshots ---------------------------------------------------------------
@query(f"SELECT sha256, count(*) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS item_ids FROM {DOCS} GROUP BY 1 HAVING count(*) > 1")
def duplicate_payload_groups(s, b):
    return audit.duplicate_payloads(document_items(s, b))


def _stored(s, b):
    i, c = items(s, b), candidates(s, b)
    last = F.ascii(F.right("sha256", F.lit(1)))
    a = i.filter(last % 7 != 0).select(F.col("storage_path").alias("path"), F.when(last % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    t = i.filter(last % 6 != 0).select(F.col("extracted_text_path").alias("path"), F.col("sha256"))
    n = c.filter(last % 4 != 0).select(F.col("staged_path").alias("path"), F.when(last % 9 != 0, F.col("sha256")).alias("sha256"))
    return a.unionByName(t).unionByName(n).filter("path is not null").groupBy("path").agg(F.max("sha256").alias("sha256"))


_AUDIT = f"""WITH i AS (SELECT *, ascii(right(sha256, 1)) AS z FROM {ITEMS}), c AS (SELECT *, ascii(right(sha256, 1)) AS z FROM {CANDS}), s AS (SELECT * FROM c WHERE state = 'staged'),
f AS (SELECT path, max(sha) AS sha FROM (
  SELECT storage_path AS path, CASE WHEN z % 5 = 0 THEN sha256(sha256) ELSE sha256 END AS sha FROM i WHERE z % 7 <> 0
  UNION ALL SELECT extracted_text_path, sha256 FROM i WHERE z % 6 <> 0 UNION ALL SELECT staged_path, CASE WHEN z % 9 <> 0 THEN sha256 END FROM c WHERE z % 4 <> 0)
  WHERE path IS NOT NULL GROUP BY 1),
chk AS (SELECT 'archive' AS p, item_id AS identifier, storage_path AS path, sha256 FROM i UNION ALL SELECT 'staged_payload', candidate_id, staged_path, sha256 FROM s),
a AS (
SELECT 'error' AS severity, CASE WHEN f.path IS NULL THEN p || '_missing' WHEN f.sha IS NULL THEN p || '_unreadable' WHEN f.sha <> sha256 THEN p || '_checksum_mismatch' END AS code, identifier, chk.path
FROM chk LEFT JOIN f USING (path)
UNION ALL SELECT 'warning', 'extracted_text_missing', item_id, extracted_text_path FROM i WHERE extracted_text_path IS NOT NULL AND extracted_text_path NOT IN (SELECT path FROM f)
UNION ALL SELECT 'warning', 'orphan_archive_payload', NULL, path FROM f WHERE starts_with(path, 'archive/') AND path NOT IN (SELECT storage_path FROM i WHERE storage_path IS NOT NULL)
UNION ALL SELECT 'warning', 'orphan_extracted_text', NULL, path FROM f WHERE starts_with(path, 'text/') AND path NOT IN (SELECT extracted_text_path FROM i WHERE extracted_text_path IS NOT NULL)
UNION ALL SELECT 'warning', 'orphan_incoming_payload', NULL, path FROM f WHERE starts_with(path, 'incoming/') AND path NOT IN (SELECT staged_path FROM s WHERE staged_path IS NOT NULL))
"""


@query(_AUDIT + "SELECT * FROM a WHERE code IS NOT NULL")
def audit_findings(s, b):
    return audit.payload_findings(items(s, b), candidates(s, b), _stored(s, b))


@query(_AUDIT + "SELECT count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'error') = 0 AS healthy FROM a WHERE code IS NOT NULL")
def audit_summary(s, b):
    return audit.findings_summary(audit_findings(s, b))


@query(_AUDIT + "SELECT path FROM a WHERE code LIKE 'orphan%'")
def orphan_payloads(s, b):
    return audit_findings(s, b).filter(F.startswith("code", F.lit("orphan"))).select("path")


def _record_sql(key: str, fields: tuple[str, ...]) -> str:
    value = lambda f: "coalesce(tags, [])" if f == "tags" else f"nullif({f}, '')" if f in audit.PATH_FIELDS else f
    return "CAST(to_json({" + ", ".join(f"'{f}': {value(f)}" for f in sorted([key, *fields])) + "}) AS VARCHAR)"


_ITEM_RECORD, _CAND_RECORD = _record_sql("item_id", audit.SNAPSHOT_FIELDS), _record_sql("candidate_id", audit.CANDIDATE_FIELDS)
SNAPSHOT_SCHEMA, PACK_SCHEMA = "archive-snapshot.v1", "archive-pack.v1"


@query(f"SELECT item_id, {_ITEM_RECORD} AS record FROM {ITEMS}")
def snapshot_records(s, b):
    return audit.snapshot_records(items(s, b))


@query(f"SELECT candidate_id, {_CAND_RECORD} AS record FROM {CANDS}")
def snapshot_candidate_records(s, b):
    return audit.candidate_records(candidates(s, b))


@query(f"""SELECT 'snap_' || sha256('{{"authority":"none","candidates":[' || (SELECT string_agg({_CAND_RECORD}, ',' ORDER BY candidate_id) FROM {CANDS})
|| '],"canonical_bytes_embedded":false,"canonical_receipt":false,"include_candidates":true,"items":[' || (SELECT string_agg({_ITEM_RECORD}, ',' ORDER BY item_id) FROM {ITEMS})
|| '],"schema":"{SNAPSHOT_SCHEMA}"}}') AS snapshot_id, (SELECT count(*) FROM {ITEMS}) AS n_items, (SELECT count(*) FROM {CANDS}) AS n_candidates""")
def snapshot_id(s, b):
    return identity.snapshot_ids(items(s, b), candidates(s, b), SNAPSHOT_SCHEMA)


@query(f"""WITH i AS (SELECT *, ascii(right(item_id, 1)) AS z FROM {ITEMS}),
o AS (SELECT item_id, title || '|' || sha256 AS r FROM i WHERE z % 10 <> 0), n AS (SELECT item_id, CASE WHEN z % 7 = 0 THEN title || '!' ELSE title END || '|' || sha256 AS r FROM i WHERE z % 13 <> 0)
SELECT item_id, CASE WHEN o.r IS NULL THEN 'added' WHEN n.r IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (item_id) WHERE o.r IS DISTINCT FROM n.r""")
def snapshot_drift(s, b):
    i = items(s, b).withColumn("z", F.ascii(F.right("item_id", F.lit(1))))
    old = i.filter("z % 10 <> 0")
    new = i.filter("z % 13 <> 0").withColumn("title", F.when(F.col("z") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return audit.drift(audit.snapshot_records(old), audit.snapshot_records(new))


# --- packs ------------------------------------------------------------------------
def _sidecars(s, b):
    return catalog.first_delivery(table(s, b, "source_provenance"), "item_id")


def _altered(m):
    z = F.ascii(F.right("item_id", F.lit(1)))
    return m.withColumns({
        "title": F.when(z % 11 == 0, " ").otherwise(F.col("title")), "sha256": F.when(z % 13 == 0, "bad").otherwise(F.col("sha256")),
        "version_label": F.when(z % 5 == 0, F.lit("v9")).otherwise(F.col("version_label")),
    })


def _whole_members(s, b):
    return _altered(packs.members(items(s, b), _sidecars(s, b), table(s, b, "acquisitions").select("sha256", "bytes")))


def _members(s, b):
    m = _altered(items(s, b).withColumn("pack_name", F.col("source")))
    return m.select("pack_name", "item_id", "title", "sha256", "trust_class", "media_type", "version_label", "lifecycle_state", "stale_after")


@query()
def pack_manifest_members(s, b):
    return _whole_members(s, b)


_MEMBER_SQL = """w AS (SELECT i.*, ascii(right(i.item_id, 1)) AS z, p.payload_bytes, v.item_id IS NOT NULL AS has_sidecar, v.author, v.publisher, v.license_status,
 v.source_published_at, v.acquired_at, v.acquisition_method, v.source_library_imported_at FROM (SELECT * FROM ITEMS_) i
 LEFT JOIN (SELECT sha256, max(bytes) AS payload_bytes FROM acquisitions GROUP BY 1) p USING (sha256) LEFT JOIN (SELECT * FROM PROV_) v ON v.item_id = i.item_id),
x AS (SELECT * REPLACE (CASE WHEN z % 11 = 0 THEN ' ' ELSE title END AS title, CASE WHEN z % 13 = 0 THEN 'bad' ELSE sha256 END AS sha256,
 CASE WHEN z % 5 = 0 THEN 'v9' ELSE version_label END AS version_label) FROM w)""".replace("ITEMS_", ITEMS).replace("PROV_", _first("source_provenance", "item_id"))


def _member_json() -> str:
    blank = lambda c: f"nullif({_STRIP.format(c)}, '')"
    side = "{" + ", ".join(f"'{f}': {blank(f)}" for f in packs.SIDECAR_FIELDS) + "}"
    value = {"tags": "coalesce(tags, [])", "source_provenance": side}
    fields = sorted([*packs.MEMBER_FIELDS, "payload_bytes"])
    made = lambda names: "CAST(to_json({" + ", ".join(f"'{f}': {value.get(f, f)}" for f in names) + "}) AS VARCHAR)"
    return f"CASE WHEN has_sidecar THEN {made(sorted([*fields, 'source_provenance']))} ELSE {made(fields)} END"


@query(f"""WITH {_MEMBER_SQL} SELECT source AS pack_name, 'kpack_' || left(sha256('{{"description":null,"members":[' || string_agg({_member_json()}, ',' ORDER BY item_id)
|| '],"name":' || CAST(to_json(source) AS VARCHAR) || ',"schema":"{PACK_SCHEMA}","version":"1"}}'), 24) AS pack_id, count(*) AS n_members FROM x GROUP BY source""")
def pack_manifest_ids(s, b):
    m = _whole_members(s, b)
    versions = m.select("pack_name").distinct().select("pack_name", F.lit("1").alias("version"), F.lit(None).cast("string").alias("description"))
    return identity.manifest_digests(m, versions, PACK_SCHEMA)


_MEM = f"""m AS (SELECT source AS pack_name, item_id, CASE WHEN z % 11 = 0 THEN ' ' ELSE title END AS title, CASE WHEN z % 13 = 0 THEN 'bad' ELSE sha256 END AS sha256,
trust_class, media_type, CASE WHEN z % 5 = 0 THEN 'v9' ELSE version_label END AS version_label, lifecycle_state, stale_after FROM (SELECT *, ascii(right(item_id, 1)) AS z FROM {ITEMS}))"""


@query(f"WITH {_MEM} SELECT * FROM m")
def pack_members(s, b):
    return _members(s, b)


@query(f"""WITH {_MEM}, g AS (SELECT pack_name, left(sha256(item_id), 2) AS g, sha256(string_agg(l, '|' ORDER BY l)) AS h, count(*) AS n
FROM (SELECT *, sha256(item_id || '|' || sha256 || '|' || title) AS l FROM m) GROUP BY 1, 2)
SELECT pack_name, 'kpack_' || left(sha256(pack_name || '|' || string_agg(g || ':' || h, '|' ORDER BY g || ':' || h)), 24) AS pack_id, CAST(sum(n) AS BIGINT) AS n_members FROM g GROUP BY 1""")
def pack_ids(s, b):
    return packs.pack_ids(_members(s, b))


@query(f"""WITH {_MEM} SELECT pack_name, item_id, concat_ws(',', CASE WHEN trim(title) = '' THEN 'member_title_missing' END, CASE WHEN NOT regexp_matches(sha256, '^[0-9a-f]{{64}}$') THEN 'member_sha256_invalid' END) AS codes
FROM m WHERE trim(title) = '' OR NOT regexp_matches(sha256, '^[0-9a-f]{{64}}$')""")
def pack_verify_codes(s, b):
    return packs.member_codes(_members(s, b))


@query(f"""WITH {_MEM}, i AS (SELECT * FROM {ITEMS} WHERE ascii(right(item_id, 1)) % 9 <> 0), x AS (SELECT m.pack_name, m.item_id, CASE WHEN i.item_id IS NULL THEN 'missing_library_item' ELSE
concat_ws(',', CASE WHEN m.lifecycle_state IS DISTINCT FROM i.lifecycle_state THEN 'drift_lifecycle_state' END, CASE WHEN m.stale_after IS DISTINCT FROM i.stale_after THEN 'drift_stale_after' END,
 CASE WHEN m.title IS DISTINCT FROM i.title THEN 'drift_title' END, CASE WHEN m.trust_class IS DISTINCT FROM i.trust_class THEN 'drift_trust_class' END,
 CASE WHEN m.version_label IS DISTINCT FROM i.version_label THEN 'drift_version_label' END, CASE WHEN m.sha256 <> i.sha256 THEN 'payload_checksum_mismatch' END) END AS codes
FROM m LEFT JOIN i ON i.item_id = m.item_id) SELECT * FROM x WHERE codes <> ''""")
def pack_vs_library_drift(s, b):
    return packs.against_library(_whole_members(s, b), items(s, b).filter(F.ascii(F.right("item_id", F.lit(1))) % 9 != 0), _sidecars(s, b))


@query(f"""WITH {_MEM}, p AS (SELECT sha256, max(bytes) AS bytes FROM acquisitions GROUP BY 1), d AS (SELECT DISTINCT pack_name, sha256 FROM m),
a AS (SELECT pack_name, count(*) AS n_payloads, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes FROM d LEFT JOIN p USING (sha256) GROUP BY 1), n AS (SELECT pack_name, count(*) AS n_members FROM m GROUP BY 1)
SELECT pack_name, n_members, n_payloads, total_bytes, n_members <= 10000 AND total_bytes <= 8589934592 AS within_limits FROM n JOIN a USING (pack_name)""")
def pack_bytes(s, b):
    return packs.pack_sizes(_members(s, b), table(s, b, "acquisitions").select("sha256", "bytes"))


@query(f"""WITH {_MEM}, h AS (SELECT sha256, count(*) AS n FROM {ITEMS} GROUP BY 1)
SELECT pack_name, item_id, CASE WHEN NOT regexp_matches(m.sha256, '^[0-9a-f]{{64}}$') THEN 'blocked' WHEN lifecycle_state = 'superseded' THEN 'warn_superseded' WHEN n > 1 THEN 'adopt_shared' ELSE 'adopt' END AS action,
'adopted:' || left(sha256(pack_name || '|' || item_id), 24) AS adoption_tag FROM m LEFT JOIN h USING (sha256)""")
def adoption_plan(s, b):
    return packs.adoption_plan(_members(s, b), items(s, b))


_ADOPT = _first("adoptions", "adoption_id")


@query(f"SELECT adoption_id, 'adopt_' || left(sha256(candidate_id || '|' || pack_id), 24) AS derived_id, left(sha256(adoption_id || '|completed'), 24) AS event_id FROM {_ADOPT}")
def adoption_ids(s, b):
    a = catalog.first_delivery(table(s, b, "adoptions"), "adoption_id")
    event = F.left(F.sha2(F.concat_ws("|", "adoption_id", F.lit("completed")), 256), F.lit(24))
    return a.select("adoption_id", packs.adoption_id(F.col("candidate_id"), F.col("pack_id")).alias("derived_id"), event.alias("event_id"))


_PROV = _first("source_provenance", "item_id")


@query(f"""SELECT p.item_id, a.adoption_id, a.pack_name, a.pack_version, regexp_matches(p.sha256, '^[0-9a-f]{{64}}$') AS sha_bound
FROM {_PROV} p JOIN {_ADOPT} a ON {_NK.format('p.origin_adoption_id')} = {_NK.format('a.adoption_id')}""")
def adoption_origin(s, b):
    p = catalog.first_delivery(table(s, b, "source_provenance"), "item_id")
    return packs.origins(p, catalog.first_delivery(table(s, b, "adoptions"), "adoption_id"))


_HIST = f"""WITH h AS (SELECT 'pfam_' || left(sha256(lower(trim(regexp_replace(pack_name, '\\s+', ' ', 'g')))), 24) AS family_id, adoption_id, CAST(adopted_at AS TIMESTAMPTZ) AS t FROM {_ADOPT}),
r AS (SELECT family_id, adoption_id, CAST(row_number() OVER w AS INTEGER) AS revision_no, lead(adoption_id) OVER w AS superseded_by FROM h WINDOW w AS (PARTITION BY family_id ORDER BY t, adoption_id)),
x AS (SELECT family_id, adoption_id, revision_no, CASE WHEN superseded_by IS NULL THEN 'active' ELSE 'superseded' END AS state, superseded_by FROM r)
"""


def _history(s, b):
    return packs.revision_history(catalog.first_delivery(table(s, b, "adoptions"), "adoption_id"))


@query(_HIST + "SELECT * FROM x")
def pack_lifecycle_history(s, b):
    return _history(s, b)


@query(_HIST + "SELECT family_id, adoption_id FROM x WHERE state = 'active'")
def pack_lifecycle_current(s, b):
    return _history(s, b).filter("state = 'active'").select("family_id", "adoption_id")


@query(_HIST + """SELECT family_id, count(*) AS n_revisions, count(*) FILTER (state = 'active') AS n_active, count(DISTINCT adoption_id) = count(*) AS ids_unique,
count(*) FILTER (state = 'active') <= 1 AND count(DISTINCT adoption_id) = count(*) AS valid FROM x GROUP BY 1""")
def pack_lifecycle_invariants(s, b):
    return packs.revision_invariants(_history(s, b))


@query()
def pack_lifecycle_fold(s, b):
    e = table(s, b, "events")
    names = F.array(*[F.lit(x) for x in ("register", "activate", "stale", "supersede", "remove")])
    return packs.fold_lifecycle(e.select(F.col("user_id").alias("family_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.abs(F.hash("event_type")) % 5 + 1).cast("int")).alias("action")))


_PF = packs.PROVENANCE_FIELDS
_blank = lambda c: f"nullif({_STRIP.format(c)}, '')"


@query(f"""WITH o AS (SELECT * FROM {_PROV} WHERE ascii(right(item_id, 1)) % 3 <> 0), n AS (SELECT item_id, CASE WHEN ascii(right(item_id, 1)) % 7 = 0 THEN 'x' ELSE sha256 END AS sha256,
 CASE WHEN ascii(right(item_id, 1)) % 2 = 0 THEN 'New Author' END AS author, ' ' AS publisher, license_status, source_published_at, acquired_at, acquisition_method FROM {_PROV}),
j AS (SELECT coalesce(o.item_id, n.item_id) AS item_id, coalesce(o.sha256, n.sha256) AS sha256, n.sha256 IS NULL OR o.sha256 IS NULL OR n.sha256 = o.sha256 AS sha_bound,
 {', '.join(f'{_blank("o." + f)} AS o_{f}, {_blank("n." + f)} AS n_{f}' for f in _PF)} FROM o FULL JOIN n ON o.item_id = n.item_id)
SELECT item_id, sha256, sha_bound, {', '.join(f'CASE WHEN sha_bound THEN coalesce(n_{f}, o_{f}) ELSE o_{f} END AS {f}' for f in _PF)} FROM j""")
def provenance_merge(s, b):
    p = catalog.first_delivery(table(s, b, "source_provenance"), "item_id")
    z = F.ascii(F.right("item_id", F.lit(1)))
    new = p.withColumn("sha256", F.when(z % 7 == 0, "x").otherwise(F.col("sha256"))).withColumn("author", F.when(z % 2 == 0, "New Author")).withColumn("publisher", F.lit(" "))
    return packs.merge_provenance(p.filter(z % 3 != 0), new)


@query(f"""SELECT p.item_id, CASE WHEN i.item_id IS NULL THEN 'item_missing' ELSE 'sha256_drift' END AS code FROM {_PROV} p LEFT JOIN {ITEMS} i ON i.item_id = p.item_id
WHERE i.item_id IS NULL OR lower(trim(p.sha256)) <> lower(trim(i.sha256))""")
def provenance_validate(s, b):
    return packs.provenance_codes(catalog.first_delivery(table(s, b, "source_provenance"), "item_id"), items(s, b))


def _adopted(s, b):
    """Items as adopted from the pack of their source, some of them drifted since."""
    z = F.ascii(F.right("item_id", F.lit(1)))
    tag = F.concat(F.lit("adopted:"), F.left(F.sha2(F.col("item_id"), 256), F.lit(24)))
    return items(s, b).select(
        F.concat(F.lit("adopt_"), F.left(F.sha2(F.col("source"), 256), F.lit(24))).alias("adoption_id"), F.col("source").alias("pack_id"),
        F.col("item_id").alias("local_item_id"), F.when(z % 11 == 0, F.concat(F.lit("gone_"), "item_id")).otherwise(F.col("item_id")).alias("remote_item_id"),
        F.when(z % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(z % 5 == 0, "owner").otherwise(F.col("trust_class")).alias("local_trust"),
        tag.alias("adoption_tag"), z.alias("z"),
    )


_ADOPTED = f"""d AS (SELECT *, ascii(right(item_id, 1)) AS z FROM {ITEMS}), a AS (SELECT 'adopt_' || left(sha256(source), 24) AS adoption_id, source AS pack_id, item_id AS local_item_id,
CASE WHEN z % 11 = 0 THEN 'gone_' || item_id ELSE item_id END AS remote_item_id, CASE WHEN z % 7 = 0 THEN sha256(sha256) ELSE sha256 END AS sha256,
CASE WHEN z % 5 = 0 THEN 'owner' ELSE trust_class END AS local_trust, trust_class, sha256 AS l_sha, z FROM d)"""


@query(f"""WITH {_ADOPTED} SELECT adoption_id, local_item_id, concat_ws(',', CASE WHEN l_sha <> sha256 THEN 'hash_drift' END, CASE WHEN local_trust <> trust_class THEN 'trust_drift' END,
CASE WHEN z % 3 = 0 THEN 'tag_missing' END) AS codes FROM a WHERE l_sha <> sha256 OR local_trust <> trust_class OR z % 3 = 0""")
def adoption_drift(s, b):
    a = _adopted(s, b)
    tag = F.concat(F.lit("adopted:"), F.left(F.sha2(F.col("item_id"), 256), F.lit(24)))
    tags = F.when(F.ascii(F.right("item_id", F.lit(1))) % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(tag))
    return packs.adopted_drift(a, items(s, b).withColumn("tags", tags))


@query(f"""WITH {_ADOPTED}, v AS (SELECT * FROM {_PROV}) SELECT local_item_id, pack_id AS origin_pack_id, adoption_id AS origin_adoption_id,
CASE WHEN z % 11 = 0 THEN 'member_missing' WHEN v.item_id IS NULL THEN 'no_provenance' WHEN a.sha256 <> l_sha THEN 'payload_drift' ELSE 'restored' END AS status,
CASE WHEN z % 11 <> 0 AND v.item_id IS NOT NULL AND a.sha256 = l_sha THEN {_blank('author')} END AS author FROM a LEFT JOIN v ON v.item_id = a.local_item_id""")
def provenance_import(s, b):
    m = packs.members(items(s, b), _sidecars(s, b), table(s, b, "acquisitions").select("sha256", "bytes")).withColumnRenamed("pack_name", "pack_id")
    got = packs.imported_provenance(_adopted(s, b), m, items(s, b))
    return got.select("local_item_id", "origin_pack_id", "origin_adoption_id", "status", F.col("source_provenance.author").alias("author"))


@query(f"""WITH r AS (SELECT *, ascii(right(adoption_id, 1)) AS z FROM {_first('adoptions', 'adoption_id')})
SELECT adoption_id, CASE WHEN z % 5 = 0 THEN 'record_missing' ELSE concat_ws(',', CASE WHEN z % 2 = 0 THEN 'drift_pack_version' END, CASE WHEN z % 3 = 0 THEN 'drift_local_trust' END) END AS codes
FROM r WHERE z % 5 = 0 OR z % 2 = 0 OR z % 3 = 0""")
def revision_binding(s, b):
    r = catalog.first_delivery(table(s, b, "adoptions"), "adoption_id").withColumn("z", F.ascii(F.right("adoption_id", F.lit(1))))
    said = r.filter("z % 5 <> 0").withColumns({
        "pack_version": F.when(F.col("z") % 2 == 0, F.concat("pack_version", F.lit("+"))).otherwise(F.col("pack_version")),
        "local_trust": F.when(F.col("z") % 3 == 0, "other").otherwise(F.col("local_trust")),
    })
    return packs.binding_drift(r, said)


# --- files and pages ----------------------------------------------------------------
@query("SELECT item_id, 'https://files.example/a/' || replace(url_encode(title), '%2F', '/') AS address FROM " + ITEMS)
def file_addresses(s, b):
    return items(s, b).select("item_id", web.file_address(F.lit("https://files.example/a/"), F.col("title")).alias("address"))


_TYPE = "CASE WHEN lower(trim(string_split(coalesce(content_type, ''), ';')[1])) = '' THEN 'application/octet-stream' ELSE lower(trim(string_split(coalesce(content_type, ''), ';')[1])) END"
_BY_TYPE = f"CASE {_TYPE} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in web.SUFFIX_OF.items()) + f" ELSE CASE WHEN starts_with({_TYPE}, 'text/') THEN '.txt' ELSE '.bin' END END"


@query(rf"""WITH u AS (SELECT acquisition_id, {_BY_TYPE} AS by_type, CASE WHEN {_TYPE} = 'text/html' THEN '.html' ELSE {_BY_TYPE} END AS guessed,
lower(regexp_extract(regexp_extract(regexp_extract(trim(final_url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), '^[^/]*[^./](\.[^./]+)$', 1)) AS own
FROM {_first('acquisitions', 'acquisition_id')})
SELECT acquisition_id, by_type, CASE WHEN length(own) <= 12 AND regexp_matches(own, '^\.[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*$') THEN own ELSE guessed END AS safe FROM u""")
def payload_suffixes(s, b):
    a = catalog.first_delivery(table(s, b, "acquisitions"), "acquisition_id")
    kind = F.col("content_type")
    return a.select("acquisition_id", web.suffix_of_type(kind).alias("by_type"), web.safe_suffix(F.col("final_url"), kind).alias("safe"))


def _between(*nets: tuple[str, int]) -> str:
    number = lambda ip: sum(int(x) << 8 * (3 - i) for i, x in enumerate(ip.split(".")))
    return " OR ".join(f"n BETWEEN {number(ip)} AND {number(ip) + (1 << 32 - bits) - 1}" for ip, bits in nets)


_NONPUBLIC = _between(
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("192.0.2.0", 24), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


@query(f"""WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders)
SELECT o_orderkey, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS address, {_NONPUBLIC} AS nonpublic FROM a""")
def address_class(s, b):
    n = (F.col("o_orderkey").cast("long") * F.lit(2654435761)) % F.lit(4294967296)
    part = lambda k: (F.floor(F.col("n") / (1 << 8 * k)) % 256).cast("string")
    ip = table(s, b, "orders").select("o_orderkey", n.alias("n")).select("o_orderkey", F.concat_ws(".", *[part(k) for k in (3, 2, 1, 0)]).alias("address"))
    return ip.withColumn("nonpublic", web.nonpublic_address("address"))


@query(f"""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(12)), lambda x: length(regexp_replace(x, '{_WS}', '', 'g'))) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(list_sum(l) AS BIGINT) AS n_letters, list_sum(l) < 80 OR len(list_filter(l, lambda n: n >= 24)) < greatest(1, len(l) // 4) AS sparse FROM p""")
def sparse_documents(s, b):
    d = table(s, b, "documents").filter("text is not null").select("doc_id", page_letters(F.col("text")).alias("l"))
    return d.select("doc_id", F.aggregate("l", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_letters"), sparse_pages(F.col("l")).alias("sparse"))


@query(f"SELECT item_id, CAST(to_json(string_split({_TAGS}, ',')) AS VARCHAR) AS tags_json FROM {ITEMS} WHERE {_TAGS} <> '' AND NOT contains(array_to_string(tags, ''), ',')")
def tags_json(s, b):
    plain = items(s, b).filter(~F.contains(F.array_join("tags", ""), F.lit(","))).withColumn("t", tidy_tags(F.col("tags")))
    return plain.filter(F.size("t") > 0).select("item_id", F.to_json("t").alias("tags_json"))


# --- federation -------------------------------------------------------------------
_REF = _first("fetched_references", "page_id")


def _results(s, b, limit: int | None):
    lib = federation.result_row(items(s, b).withColumn("u", F.concat(F.lit("library://"), "item_id")), "library", "u", "title", "source", "rights_note")
    docs = federation.result_row(document_items(s, b).withColumn("u", F.concat(F.lit("zim://"), "item_id")), "zim", "u", "title", "source", "text")
    pages = catalog.first_delivery(table(s, b, "fetched_references").filter("page_id is not null"), "page_id")
    web_rows = federation.result_row(pages, "web", "url", "title", "source", "html")
    return federation.federate({"library": lib, "zim": docs, "web": web_rows, "off": None, "broken": lambda: docs.select("no_such_column")}, limit)


def _unescaped(c: str) -> str:
    for seen, wanted in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{seen}', '{wanted}')"
    return c


_SUMM = "substr(trim(regexp_replace(" + _unescaped("regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g')") + r", '[\s\x{{A0}}]+', ' ', 'g')), 1, 900)"
_FED = f"""WITH u AS (
SELECT 0 AS provider_rank, 'library' AS provider, 'library://' || item_id AS uri, title AS t, source AS s, {_SUMM.format('rights_note')} AS summary FROM {ITEMS}
UNION ALL SELECT 1, 'zim', 'zim://' || item_id, title, source, {_SUMM.format('text')} FROM {DOCS}
UNION ALL SELECT 2, 'web', url, title, source, {_SUMM.format('html')} FROM {_REF}),
c AS (SELECT *, substr(trim(t), 1, 300) AS title, substr(trim(s), 1, 300) AS source, 'fs_' || left(sha256(provider || '|' || uri || '|' || t), 24) AS result_id FROM u),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY provider ORDER BY title, uri) AS INTEGER) AS position FROM c)
"""


@query(_FED + "SELECT provider_rank, provider, uri, title, source, summary, position, result_id FROM r WHERE position <= 8")
def federated_top_per_provider(s, b):
    return _results(s, b, 8)[0]


@query(_FED + """SELECT provider, 'ok' AS status, count(*) AS n_results FROM r WHERE position <= 25 GROUP BY 1
UNION ALL SELECT 'off', 'disabled', 0 UNION ALL SELECT 'broken', 'error: AnalysisException', 0""")
def federated_status(s, b):
    return federation.provider_counts(*_results(s, b, 25))


@query(_FED + "SELECT result_id, provider, uri FROM c")
def federated_union(s, b):
    return _results(s, b, None)[0].select("result_id", "provider", "uri")


@query(f"SELECT page_id, {_SUMM.format('html')} AS summary FROM {_REF}")
def tag_strip_summary(s, b):
    p = catalog.first_delivery(table(s, b, "fetched_references"), "page_id")
    return p.select("page_id", F.substring(F.coalesce(web.tag_strip(F.col("html")), F.lit("")), 1, 900).alias("summary"))


# --- vault ------------------------------------------------------------------------
def _objects(s, b):
    o = table(s, b, "orders")
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.concat(F.lit("obj_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("object_id"), F.col("o_orderstatus").alias("kind"),
        F.col("o_orderdate").alias("created"), F.element_at(F.array(*map(F.lit, vault.RETENTION)), n).alias("retention"), "o_totalprice",
    )


_OBJ = """o AS (SELECT 'obj_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS object_id, o_orderstatus AS kind, o_orderdate AS created,
['CACHE', 'ROLLING', 'STANDARD', 'PROTECTED', 'PERMANENT'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS retention FROM orders)"""


@query(f"WITH {_OBJ} SELECT object_id, kind, retention FROM o WHERE kind = 'F' AND retention = 'STANDARD' ORDER BY created DESC, object_id DESC LIMIT 100")
def vault_list(s, b):
    return vault.list_objects(_objects(s, b), "F", "STANDARD", 100).select("object_id", "kind", "retention")


@query(f"""WITH {_OBJ} SELECT object_id, CASE WHEN retention IN ('CACHE', 'ROLLING', 'STANDARD') THEN 'PROTECTED' ELSE retention END AS retention,
retention IN ('CACHE', 'ROLLING', 'STANDARD') AS promoted FROM o""")
def vault_promote(s, b):
    return vault.promote(_objects(s, b), "PROTECTED")


@query(f"WITH {_OBJ} SELECT kind, count(*) AS n_purgeable FROM o WHERE retention IN ('CACHE', 'ROLLING') GROUP BY 1")
def vault_purgeable(s, b):
    return vault.purgeable(_objects(s, b)).groupBy("kind").agg(F.count("*").alias("n_purgeable"))


@query("""SELECT c_name AS name, round(CASE WHEN c_custkey > 0 THEN (c_custkey * 7 % 100) / 400.0 ELSE 0 END, 6) AS free_fraction,
CASE WHEN (c_custkey * 7 % 100) / 400.0 <= 0.10 OR c_custkey <= 0 THEN 'reserve_guard' WHEN (c_custkey * 7 % 100) / 400.0 <= 0.15 THEN 'cleanup_due' ELSE 'healthy' END AS state FROM customer""")
def vault_health(s, b):
    c = table(s, b, "customer").select(F.col("c_name").alias("name"), F.lit(4096).alias("frsize"), F.when(F.col("c_custkey") > 0, 400).otherwise(0).alias("blocks"), (F.col("c_custkey") * 7 % 100).alias("bavail"))
    return vault.health(c)


# --- web --------------------------------------------------------------------------
_U = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_up = lambda n: f"regexp_extract(trim(url), '{_U}', {n})"
_CANON = f"""CASE WHEN lower({_up(1)}) IN ('http', 'https') AND {_up(2)} = '' AND {_up(3)} <> '' THEN lower({_up(1)}) || '://' || lower({_up(3)})
|| CASE WHEN (lower({_up(1)}) = 'https' AND {_up(4)} = '443') OR (lower({_up(1)}) = 'http' AND {_up(4)} = '80') OR {_up(4)} = '' THEN '' ELSE ':' || {_up(4)} END
|| CASE WHEN {_up(5)} = '' THEN '/' ELSE {_up(5)} END || CASE WHEN {_up(6)} = '' THEN '' ELSE '?' || {_up(6)} END END"""
_URLS = "(SELECT DISTINCT source_uri AS url FROM candidates WHERE source_uri IS NOT NULL UNION SELECT DISTINCT requested_url FROM acquisitions)"


def _urls(s, b):
    c = table(s, b, "candidates").filter("source_uri is not null").select(F.col("source_uri").alias("url"))
    return c.union(table(s, b, "acquisitions").select("requested_url")).distinct()


@query(f"SELECT url, {_CANON} AS canonical FROM {_URLS}")
def url_canonical(s, b):
    return _urls(s, b).select("url", web.canonical_url(F.col("url")).alias("canonical"))


@query(rf"""SELECT url, CASE WHEN lower({_up(1)}) NOT IN ('http', 'https') THEN 'scheme' WHEN {_up(2)} <> '' THEN 'credentials'
WHEN lower({_up(3)}) = 'localhost' OR lower({_up(3)}) LIKE '%.localhost' OR lower({_up(3)}) LIKE '%.local' THEN 'local_host'
WHEN regexp_matches({_up(3)}, '^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)') THEN 'private_address'
WHEN regexp_matches({_up(3)}, '^\d+(\.\d+){{3}}$') OR starts_with({_up(3)}, '[') THEN 'ip_literal' END AS reason FROM {_URLS}""")
def url_safety(s, b):
    return _urls(s, b).select("url", web.unsafe_reason(F.col("url")).alias("reason"))


def _rules(s, b):
    u = _urls(s, b).select(web.canonical_url(F.col("url")).alias("c")).filter("c is not null")
    o = u.select(F.regexp_extract("c", r"^([a-z]+://[^/]+)", 1).alias("origin")).distinct()
    r = F.explode(F.array(F.struct(F.lit(1).alias("rule_no"), F.lit("/guides").alias("path_prefix")), F.struct(F.lit(2).alias("rule_no"), F.lit("/g").alias("path_prefix")), F.struct(F.lit(3).alias("rule_no"), F.lit("/notes/").alias("path_prefix"))))
    return o.select("origin", r.alias("r")).select("origin", "r.*").withColumn("rule_id", F.concat("origin", F.lit("#"), "rule_no"))


@query(f"""WITH u AS (SELECT url, {_CANON} AS c FROM {_URLS}), o AS (SELECT url, regexp_extract(c, '^([a-z]+://[^/]+)', 1) AS origin, regexp_extract(c, '^[a-z]+://[^/]+([^?]*)', 1) AS path FROM u)
SELECT url, CASE WHEN starts_with(path, '/guides') THEN origin || '#1' WHEN starts_with(path, '/g') THEN origin || '#2' WHEN starts_with(path, '/notes/') THEN origin || '#3' END AS rule_id FROM o""")
def url_policy_match(s, b):
    return web.match_rules(_urls(s, b), _rules(s, b))


@query("""SELECT content_type, count(*) AS n, bool_or(starts_with(lower(trim(string_split(content_type, ';')[1])), 'text/') OR lower(trim(string_split(content_type, ';')[1])) = 'application/pdf') AS allowed FROM acquisitions GROUP BY 1""")
def content_type_match(s, b):
    a = table(s, b, "acquisitions").withColumn("ok", web.type_allowed(F.col("content_type"), F.array(F.lit("text/*"), F.lit("application/pdf"))))
    return a.groupBy("content_type").agg(F.count("*").alias("n"), F.bool_or("ok").alias("allowed"))


@query()
def html_text(s, b):
    return catalog.first_delivery(table(s, b, "fetched_references"), "page_id").select("page_id", web.html_text("html").alias("text"))


@query()
def html_sanitize(s, b):
    return catalog.first_delivery(table(s, b, "fetched_references"), "page_id").select("page_id", web.html_clean("html").alias("html"))


@query(rf"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<(?:title|h1)[^>]*>(.*?)</(?:title|h1)>', 1, 'si'), '\s+', ' ', 'g')), '') AS heading FROM {_REF}""")
def html_title(s, b):
    return catalog.first_delivery(table(s, b, "fetched_references"), "page_id").select("page_id", web.title_of(F.col("html")).alias("heading"))


# --- events -----------------------------------------------------------------------
@query("SELECT event_id, ts, user_id, event_type FROM events")
def event_log_dedup(s, b):
    e = table(s, b, "events").select("event_id", "ts", "user_id", "event_type")
    return catalog.dedup_events(e.unionByName(e.filter("event_id % 3 = 0")))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY 1")
def event_state(s, b):
    return catalog.latest_state(table(s, b, "events"), "user_id", "ts", "event_type")


@query("""SELECT event_type AS node_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n_requests, round(sum(value), 4) AS total_value FROM events GROUP BY 1, 2""")
def audit_by_node_window(s, b):
    e = table(s, b, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.col("event_type").alias("node_id"), F.window("t", "1 hour").alias("w")).agg(F.count("*").alias("n_requests"), F.round(F.sum("value"), 4).alias("total_value"))
    return g.select("node_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_requests", "total_value")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS n FROM events),
x AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_events, min(ts) AS first_at, max(ts) AS last_at FROM x GROUP BY 1, 2""")
def audit_sessions(s, b):
    return catalog.sessions(table(s, b, "events"), "user_id", "ts", 3600)


@query("SELECT event_id, sha256(props) AS query_sha256, false AS raw_query_recorded FROM events")
def query_hash_audit(s, b):
    return table(s, b, "events").select("event_id", F.sha2("props", 256).alias("query_sha256"), F.lit(False).alias("raw_query_recorded"))


@query("""WITH f AS (SELECT 'shelf/' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '.zim' ELSE '.zim' || 'a' || chr(CAST(97 + p_partkey % 26 AS INTEGER)) END AS path, CAST(p_size AS BIGINT) AS size FROM part)
SELECT CASE WHEN regexp_matches(path, '\\.zim[a-z]{2}$') THEN left(path, length(path) - 2) ELSE path END AS archive, regexp_matches(path, '\\.zim[a-z]{2}$') AS split, count(*) AS n_parts, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2""".replace("\\\\", "\\"))
def zim_inventory_grouping(s, b):
    p = table(s, b, "part")
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".zim").otherwise(F.concat(F.lit(".zima"), F.chr((F.lit(97) + F.col("p_partkey") % 26))))
    from quillspan.sources.files import group_archives

    return group_archives(p.select(F.concat(F.lit("shelf/"), "p_brand", suffix).alias("path"), F.col("p_size").cast("long").alias("size")))


@query("SELECT event_type, count(*) AS n_events, round(sum(value), 4) AS total_value FROM events GROUP BY 1")
def event_stream_totals(s, b):
    return jobs.stream_totals(s, b)


@query("SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events GROUP BY 1")
def event_stream_state(s, b):
    return jobs.stream_state(s, b)


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
