"""Sources, classification and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, paths, text as T
from ..operators import authority, chunking, graph, records, symbols
from ..sources import events as EV, files as SF, index_store
from .registry import files_of, fresh_dir, query
from .views import table, view

# How the oracles classify the paths of v_files, whose layout is known.
KIND = """CASE WHEN path LIKE '%.md' THEN 'doc' WHEN path LIKE 'tests/%' OR path LIKE '%.spec.ts' THEN 'test'
  WHEN path LIKE '%.json' THEN 'config' ELSE 'code' END"""
EXT = "regexp_extract(path, '\\.[a-z]+$')"
MODULE = "regexp_replace(path, '/[^/]*$', '')"


def toks(text: str) -> str:
    """DuckDB: distinct tokens of a text."""
    stop = ", ".join(f"'{w}'" for w in K.STOPWORDS)
    return (f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda t: lower(t)), "
            f"lambda t: length(t) > 1 AND NOT list_contains([{stop}], t)))")


@query("a1_cut_content", "SELECT path, length(left(content, 16000)) AS kept_chars FROM v_files")
def cut_content(spark, sf):
    cut = SF.cut_content(view(spark, sf, "v_files"), 16_000)
    return cut.select("path", F.length("content").cast("long").alias("kept_chars"))


@query("a1_cut_content_whole", "SELECT path, length(content) AS kept_chars FROM v_files")
def cut_content_whole(spark, sf):
    return SF.cut_content(view(spark, sf, "v_files")).select("path", F.length("content").cast("long").alias("kept_chars"))


@query("a2_supported_paths", """SELECT DISTINCT path FROM v_diff WHERE regexp_matches(path, '\\.(py|md|yaml|ts)$')""")
def supported_paths(spark, sf):
    return SF.supported_paths(view(spark, sf, "v_diff").select("path").distinct())


def _log(spark, sf, label):
    """v_feedback written as a JSON-lines log with a blank and a broken line per file."""
    out = fresh_dir(spark, label)
    log = view(spark, sf, "v_feedback").select(
        "event_type", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"), "bundle_id", "path",
        "action", "relevance")
    lines = log.select(F.to_json(F.struct("*")).alias("value"))
    broken = log.groupBy("event_type").agg(F.lit("{broken").alias("value")).select("value")
    lines.unionByName(broken).unionByName(broken.select(F.lit("").alias("value"))).write.text(out)
    return out


@query("a3_read_events", """
SELECT event_type, strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS event_time, bundle_id, path, action, relevance FROM v_feedback
WHERE strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') >= '2024-01-03T00:00:00Z'""")
def read_events(spark, sf):
    log = EV.read_events(spark, _log(spark, sf, "log"), since="2024-01-03T00:00:00Z")
    return log.select("event_type", "event_time", "bundle_id", "path", "action", "relevance")


@query("a4_read_telemetry", """
SELECT op, surface, task_id, repo_hash, success, error_type, duration_ms, output_bytes, embed_ms FROM v_telemetry""")
def read_telemetry(spark, sf):
    out = fresh_dir(spark, "telemetry")
    view(spark, sf, "v_telemetry").drop("seq").write.json(out)
    return EV.read_telemetry(spark, out).select(
        "op", "surface", "task_id", "repo_hash", "success", "error_type", "duration_ms", "output_bytes", "embed_ms")


@query("a5_append_events", """
SELECT 1 AS schema_version, event_type, CAST(CAST(event_time AS DATE) AS VARCHAR) AS event_date, count(*) AS n
FROM v_telemetry GROUP BY ALL""")
def append_events(spark, sf):
    out = fresh_dir(spark, "events")
    EV.append_events(view(spark, sf, "v_telemetry"), out)
    stored = spark.read.parquet(out)
    return stored.groupBy("schema_version", "event_type", F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("n"))


def _stored_index(spark, sf):
    out = fresh_dir(spark, "index")
    chunks = view(spark, sf, "v_chunks")
    index_store.save_index(chunks, out, "m1", 64, chunking.ChunkSettings().as_dict(), {"built_from": "origin-main"})
    return out


@query("a6_save_load_index", """
SELECT path, chunk_index, content_hash, 2 AS schema_version, 'm1' AS model_name, (SELECT count(*) FROM v_chunks) AS entry_count
FROM v_chunks""")
def save_load_index(spark, sf):
    out = _stored_index(spark, sf)
    meta = index_store.load_meta(spark, out)
    facts = {c: meta.select(c).scalar() for c in ("schema_version", "model_name", "entry_count")}
    return index_store.load_index(spark, out).select("path", "chunk_index", "content_hash", *[v.alias(k) for k, v in facts.items()])


@query("a7_index_summary", "SELECT count(*) AS entry_count, count(DISTINCT path) AS file_count FROM v_chunks")
def index_summary(spark, sf):
    return index_store.index_summary(view(spark, sf, "v_chunks"))


@query("a8_dedupe_content", f"""
SELECT path, sha256(content) AS content_sha, count(*) OVER (PARTITION BY content) AS copies, len({toks('content')}) AS n_tokens
FROM v_files""")
def dedupe_content(spark, sf):
    files = view(spark, sf, "v_files")
    once = SF.dedupe_content(files).select("content_sha", "copies", F.size(T.token_set("content")).cast("long").alias("n_tokens"))
    return SF.reattach_content(files, once).select("path", "content_sha", "copies", "n_tokens")


@query("b1_kind", f"SELECT path, {KIND} AS kind FROM v_files")
def kind(spark, sf):
    return view(spark, sf, "v_files").select("path", paths.kind("path").alias("kind"))


SUBKIND = f"""CASE WHEN {KIND} = 'doc' THEN CASE WHEN path LIKE 'docs/adr/%' THEN 'architecture'
    WHEN path LIKE '%/README.md' THEN 'readme' ELSE 'other' END
  WHEN {KIND} = 'config' THEN 'other' WHEN {KIND} = 'test' THEN ''
  WHEN regexp_matches(left(content, 2048), '(?i)\\b(generated|do\\s*not\\s*edit|auto-?generated|codegen)\\b') THEN 'generated'
  WHEN path LIKE '%/api/%' THEN 'handler' WHEN path LIKE '%/models/%' THEN 'model' WHEN path LIKE '%/utils/%' THEN 'util'
  WHEN content = '' THEN 'other'
  WHEN regexp_matches(left(content, 2048), '(?m)^\\s*class\\s+\\w+\\b') THEN 'other' ELSE 'util' END"""


@query("b2_subkind", f"SELECT path, {SUBKIND} AS subkind FROM v_files")
def subkind(spark, sf):
    return files_of(spark, sf).select("path", "subkind")


@query("b2_subkind_whole", f"SELECT path, {SUBKIND.replace('left(content, 2048)', 'content')} AS subkind FROM v_files")
def subkind_whole(spark, sf):
    return paths.classify(view(spark, sf, "v_files").select("repo", "path", "content")).select("path", "subkind")


@query("b3_full_kind", f"""
SELECT path, {KIND} || CASE WHEN {SUBKIND} = '' THEN '' ELSE '/' || {SUBKIND} END AS full_kind, {KIND} AS parent_kind FROM v_files""")
def full_kind(spark, sf):
    full = paths.full_kind("kind", "subkind")
    return files_of(spark, sf).select("path", full.alias("full_kind"), paths.parent_kind(full).alias("parent_kind"))


@query("b4_miss_kind", """
SELECT path, CASE WHEN path LIKE '%.json' THEN 'config/other'
  WHEN path LIKE 'docs/adr/%' THEN 'doc/architecture' WHEN path LIKE '%/README.md' THEN 'doc/readme' WHEN path LIKE '%.md' THEN 'doc/other'
  WHEN path LIKE '%.spec.%' OR path LIKE '%/test\\_%' ESCAPE '\\' THEN 'test'
  WHEN path LIKE '%/api/%' THEN 'code/handler' WHEN path LIKE '%/models/%' THEN 'code/model' WHEN path LIKE '%/utils/%' THEN 'code/util'
  ELSE 'code/other' END AS miss_kind FROM v_files""")
def miss_kind(spark, sf):
    return view(spark, sf, "v_files").select("path", paths.miss_kind("path").alias("miss_kind"))


@query("b5_doc_score", """
SELECT path, CASE WHEN path LIKE 'docs/adr/%' THEN 5.0 WHEN path LIKE '%/README.md' THEN 9.0 WHEN path LIKE 'contracts/%' THEN 4.0
  ELSE 0.0 END::DOUBLE AS doc_score FROM v_files
UNION ALL SELECT path, CASE WHEN path LIKE '%/AGENTS.md' THEN 17.0 WHEN path LIKE 'contracts/%' THEN 4.0 ELSE 0.0 END::DOUBLE FROM v_source""")
def doc_score(spark, sf):
    return files_of(spark, sf).select("path", "doc_score").unionByName(
        files_of(spark, sf, "v_source").select("path", "doc_score"))


@query("b6_tokens", f"""
SELECT path, len({toks('content')}) AS n_distinct, coalesce(array_to_string(list_sort({toks('content')}), ' '), '') AS token_list FROM v_files""")
def tokens(spark, sf):
    return view(spark, sf, "v_files").select("path", T.token_set("content").alias("t")).select(
        "path", F.size("t").cast("long").alias("n_distinct"), F.array_join(F.array_sort("t"), " ").alias("token_list"))


EST = "CASE WHEN {0} = '' THEN 0 ELSE greatest(1, CAST(round_even(len(regexp_extract_all({0}, '[^\\s\\x0b\\x1c-\\x1f]+')) * 1.3::DOUBLE, 0) AS INT)) END"


@query("b7_est_tokens", f"SELECT path, {EST.format('content')} AS est_tokens FROM v_files")
def est_tokens(spark, sf):
    return view(spark, sf, "v_files").select("path", T.est_tokens("content").alias("est_tokens"))


@query("b8_content_hash", "SELECT path, left(sha256(content), 16) AS content_hash FROM v_files")
def content_hash(spark, sf):
    return view(spark, sf, "v_files").select("path", T.content_hash("content").alias("content_hash"))


@query("b9_enriched_text", f"""
SELECT path, 'file: ' || path || chr(10) || 'kind: ' || {KIND} || chr(10) || 'module: ' || {MODULE} || chr(10) || chr(10)
  || left(content, 8000) AS enriched FROM v_files""")
def enriched_text(spark, sf):
    return files_of(spark, sf).select("path", T.enriched_text("path", "kind", "content", 8000).alias("enriched"))


@query("b9_enriched_text_whole", f"""
SELECT path, 'file: ' || path || chr(10) || 'kind: ' || {KIND} || chr(10) || 'module: ' || {MODULE} || chr(10) || chr(10)
  || content AS enriched FROM v_files""")
def enriched_text_whole(spark, sf):
    return files_of(spark, sf).select("path", T.enriched_text("path", "kind", "content").alias("enriched"))


@query("b9_enriched_chunk_text", """
SELECT path, 'file: ' || path || chr(10) || 'kind: code' || chr(10) || 'module: pkg' || c_nationkey || chr(10) || 'symbol: C' || c_custkey
  || chr(10) || 'lines: 8-10' || chr(10) || chr(10) || 'class C' || c_custkey || ':' AS enriched
FROM (SELECT *, 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path FROM customer)""")
def enriched_chunk_text(spark, sf):
    spans = symbols.symbol_spans(files_of(spark, sf, "v_source")).where("kind = 'class'")
    text = F.concat(F.lit("class "), "qualified_name", F.lit(":"))
    enriched = T.enriched_chunk_text("path", F.lit("code"), text, "qualified_name", "start_line", "end_line")
    return spans.select("path", enriched.alias("enriched"))


@query("b10_file_records", f"""
SELECT path AS id, {KIND} || '_chunk' AS record_type, 'repo' AS namespace, {EXT} AS extension, {MODULE} AS module,
  CASE {EXT} WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.md' THEN 'markdown'
    ELSE 'json' END AS language,
  CASE WHEN path LIKE 'docs/adr/%' THEN '5.0' WHEN path LIKE '%/README.md' THEN '9.0' WHEN path LIKE 'contracts/%' THEN '4.0' END AS doc_score
FROM v_files""")
def file_records(spark, sf):
    rows = records.file_records(files_of(spark, sf))
    facts = [F.element_at("metadata", F.lit(k)).alias(k) for k in ("extension", "module", "language", "doc_score")]
    return rows.select("id", "record_type", "namespace", *facts)


@query("b11_authority_to_records", """
SELECT 'contract:contracts/n' || n_nationkey || '.md' AS id, 'contract' AS record_type, 'authority' AS namespace, '1' AS authority_level,
  '["pkg' || n_nationkey || '/*"]' AS applies_to, 'title: ---' || chr(10) || 'type: contract' || chr(10) || 'tags: contract' AS head
FROM nation""")
def authority_to_records(spark, sf):
    auth = authority.authority_records(files_of(spark, sf, "v_source")).where("ord.stage = 0 and type = 'contract'")
    rows = records.authority_to_records(auth)
    return rows.select(
        "id", "record_type", "namespace", F.element_at("metadata", F.lit("authority_level")).alias("authority_level"),
        F.element_at("metadata", F.lit("applies_to_paths")).alias("applies_to"),
        F.substring_index("text", "\n", 3).alias("head"))


@query("b12_symbol_spans", """
SELECT 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path, s.name AS qualified_name, s.kind, s.a AS start_line, s.b AS end_line
FROM customer, LATERAL (VALUES ('C' || c_custkey, 'class', 8, 10), ('C' || c_custkey || '.run', 'method', 9, 10),
  ('main', 'function', 13, 14)) AS s(name, kind, a, b)
UNION ALL SELECT 'tests/test_c' || s_suppkey || '.py', 'test_main', 'function', 3, 4 FROM supplier""")
def symbol_spans(spark, sf):
    return symbols.symbol_spans(files_of(spark, sf, "v_source")).select(
        "path", "qualified_name", "kind", "start_line", "end_line")


@query("b13_line_priorities", f"""
WITH l AS (SELECT path, {KIND} AS kind, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS line,
    generate_subscripts(string_split(regexp_replace(content, '\\n$', ''), chr(10)), 1) AS line_no FROM v_files WHERE content <> ''),
p AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM l)
SELECT path, line_no, {EST.format("(line || ' ')")} AS tokens, CASE WHEN prev IS NULL THEN 1
  WHEN trim(prev) = '' THEN CASE WHEN kind = 'doc' THEN 4 ELSE 2 END
  WHEN kind = 'doc' AND regexp_matches(prev, '[.!?]\\s*$') THEN 2 ELSE 1 END AS priority FROM p""")
def line_priorities(spark, sf):
    prose = files_of(spark, sf).withColumn("symbols", F.array().cast(f"array<{symbols.SYMBOL}>"))
    return chunking.line_priorities(prose).select("path", F.col("line_no").cast("long").alias("line_no"), "tokens", "priority")


@query("b13_chunk_files")
def chunk_files(spark, sf):
    return chunking.chunk_files(files_of(spark, sf)).select(
        "path", "chunk_index", "start_line", "end_line", "enclosing_symbol", "content_hash")


@query("b13_chunk_source", """
SELECT 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path, 0 AS chunk_index, 1 AS start_line, 14 AS end_line FROM customer
UNION ALL SELECT 'tests/test_c' || s_suppkey || '.py', 0, 1, 4 FROM supplier
UNION ALL SELECT 'contracts/n' || n_nationkey || '.md', 0, 1, 20 FROM nation
UNION ALL SELECT 'docs/r' || r_regionkey || '/AGENTS.md', 0, 1, 1 FROM region
UNION ALL SELECT 'web/b' || p_size || '/p' || p_partkey || '.ts', 0, 1, 4 FROM part""")
def chunk_source(spark, sf):
    return chunking.chunk_files(files_of(spark, sf, "v_source")).select("path", "chunk_index", "start_line", "end_line")


@query("b14_import_lines", """
SELECT 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path, 'from .c' || (c_custkey + 1) || ' import run as nxt' || chr(10)
  || 'from pkg' || ((c_nationkey + 1) % 25) || ' import c' || (c_custkey + 2) || chr(10)
  || 'import pkg' || c_nationkey || '.c' || greatest(c_custkey - 1, 0) || ' as prev' AS import_source FROM customer
UNION ALL SELECT 'tests/test_c' || s_suppkey || '.py', 'from pkg' || s_nationkey || '.c' || s_suppkey || ' import main' FROM supplier""")
def import_lines(spark, sf):
    python = view(spark, sf, "v_source").where("path like '%.py'")
    return python.select("path", SF.import_lines("content").alias("import_source"))


@query("b15_snippet", f"""
WITH l AS (SELECT path, {toks('path')} AS words, trim(unnest(string_split(content, chr(10)))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) AS n FROM v_files),
k AS (SELECT path, line, n, len(list_filter(words, lambda w: contains(lower(line), w))) > 0 AS hit FROM l WHERE line <> '')
SELECT path, left(coalesce(min_by(line, n) FILTER (hit), min_by(line, n)), 160) AS snippet FROM k GROUP BY path""")
def snippet(spark, sf):
    shown = view(spark, sf, "v_files").select("path", T.snippet("content", T.token_set("path")).alias("snippet"))
    return shown.where("snippet is not null")


@query("b16_test_stem", """
SELECT path, CASE WHEN path LIKE 'tests/test_%' THEN regexp_extract(path, 'test_(h-?\\d+)', 1)
  WHEN path LIKE '%.spec.ts' THEN regexp_extract(path, '/(w\\d+)\\.spec', 1)
  WHEN path LIKE '%/README.md' THEN 'readme' ELSE regexp_extract(path, '([^/]*)\\.[a-z]+$', 1) END AS stem FROM v_files""")
def test_stem(spark, sf):
    return view(spark, sf, "v_files").select("path", paths.test_stem("path").alias("stem"))


@query("b17_substantive", """
SELECT conv_id, turn, length(trim(text)) > 40 OR regexp_matches(text, '(?i)(^|[^a-z0-9_])(implement|refactor|fix|add|build|rewrite|migrate|integrate|design)($|[^a-z0-9_])') AS substantive
FROM v_transcript WHERE role = 'user'""")
def substantive(spark, sf):
    prompts = view(spark, sf, "v_transcript").where("role = 'user'")
    return prompts.select("conv_id", "turn", T.is_substantive("text").alias("substantive"))


@query("d3_marker_lines", """
WITH l AS (SELECT path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM v_files)
SELECT path, line, trim(regexp_extract(raw, '(?i)^\\s*Licensed under\\s+(.+?)\\s*$', 1)) AS body FROM l
WHERE regexp_matches(raw, '(?i)^\\s*Licensed under\\s+.+')""")
def marker_lines(spark, sf):
    hits = authority.marker_lines(view(spark, sf, "v_files"), r"(?i)^(Licensed under)\s+(.+?)\s*$")
    return hits.select("path", F.col("line").cast("long").alias("line"), "body")


# ---- graph -----------------------------------------------------------------------------------------------------------


@query("c1_module_map", """
SELECT replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module, path FROM v_source WHERE path LIKE '%.py'""")
def module_map(spark, sf):
    return graph.module_map(view(spark, sf, "v_source")).select("module", "path")


@query("c2_python_imports", """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path FROM customer)
SELECT path, 'pkg' || n || '.c' || (k + 1) AS candidate FROM c
UNION ALL SELECT path, 'pkg' || n || '.c' || (k + 1) || '.run' FROM c
UNION ALL SELECT path, 'pkg' || ((n + 1) % 25) FROM c
UNION ALL SELECT path, 'pkg' || ((n + 1) % 25) || '.c' || (k + 2) FROM c
UNION ALL SELECT path, 'pkg' || n || '.c' || greatest(k - 1, 0) FROM c
UNION ALL SELECT 'tests/test_c' || s_suppkey || '.py', 'pkg' || s_nationkey || '.c' || s_suppkey FROM supplier
UNION ALL SELECT 'tests/test_c' || s_suppkey || '.py', 'pkg' || s_nationkey || '.c' || s_suppkey || '.main' FROM supplier""")
def python_imports(spark, sf):
    return graph.python_imports(view(spark, sf, "v_source")).select("path", "candidate")


@query("c3_ts_specifiers", """
SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(html,
    '(?:import|export)\\s+(?:[^''"]+?\\s+from\\s+)?[''"][^''"]+[''"]|require\\(\\s*[''"][^''"]+[''"]\\s*\\)|href="[^"]+"'),
    lambda m: regexp_extract(m, '[''"]([^''"]+)[''"]', 1)), lambda s: s <> '')) AS specifier
FROM (SELECT page_id, regexp_replace(html, 'href=', 'import ', 'g') AS html FROM pages)""")
def ts_specifiers(spark, sf):
    # The pages hold no scripts that import; their links, read as import statements, exercise the same grammar.
    rows = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "href=", "import ").alias("content"))
    return graph.ts_specifiers(rows).select("page_id", "specifier")


EDGES = """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path FROM customer),
p AS (SELECT p_partkey AS k, p_size AS s, 'web/b' || p_size || '/p' || p_partkey || '.ts' AS path FROM part),
e AS (
  SELECT a.path AS src, b.path AS dst FROM c a JOIN c b ON (b.k = a.k + 1 AND b.n = a.n)
  UNION SELECT a.path, b.path FROM c a JOIN c b ON b.k = a.k + 2 AND b.n = (a.n + 1) % 25
  UNION SELECT a.path, b.path FROM c a JOIN c b ON b.k = a.k - 1 AND b.n = a.n
  UNION SELECT 'tests/test_c' || s_suppkey || '.py', path FROM supplier JOIN c ON k = s_suppkey AND n = s_nationkey
  UNION SELECT a.path, b.path FROM p a JOIN p b ON b.k = a.k + 1 AND b.s = a.s)
"""


@query("c3_ts_imports", EDGES + """SELECT src, dst FROM e WHERE src LIKE 'web/%' UNION SELECT path, path FROM p""")
def ts_imports(spark, sf):
    return graph.ts_imports(view(spark, sf, "v_source")).select("src", "dst")


@query("c3_ts_imports_normalized", EDGES + """
SELECT src, dst FROM e WHERE src LIKE 'web/%' UNION SELECT path, path FROM p
UNION SELECT a.path, b.path FROM p a JOIN p b ON b.k = a.k + 2 AND b.s = a.s""")
def ts_imports_normalized(spark, sf):
    return graph.ts_imports(view(spark, sf, "v_source"), normalize=True).select("src", "dst")


@query("c4_dependency_edges", EDGES + "SELECT src, dst FROM e")
def dependency_edges(spark, sf):
    return graph.dependency_edges(files_of(spark, sf, "v_source")).select("src", "dst")


@query("c5_expand_neighbors", """
WITH s AS (SELECT c_nationkey AS task_id, 'c' || c_custkey AS seed, c_custkey AS rank FROM customer),
n AS (SELECT task_id, dst AS path, 4.0 AS score, rank, seed, 'Imported by ' AS verb FROM s JOIN v_edges ON src = seed
  UNION ALL SELECT task_id, src, 4.5, rank, seed, 'References ' FROM s JOIN v_edges ON dst = seed),
b AS (SELECT *, row_number() OVER (PARTITION BY task_id, path ORDER BY score DESC, rank) AS i FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path) AS rank_ FROM b WHERE i = 1
  AND (task_id, path) NOT IN (SELECT task_id, seed FROM s))
SELECT task_id, path, score::DOUBLE AS score, verb || '`' || seed || '`' AS reason, rank_ AS rank FROM r WHERE rank_ <= 8""")
def expand_neighbors(spark, sf):
    seeds = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("task_id"), F.lit("main").alias("repo"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").alias("rank"))
    return graph.expand_neighbors(view(spark, sf, "v_edges"), seeds).select("task_id", "path", "score", "reason", "rank")


def _changed_nodes(spark, sf):
    nodes = view(spark, sf, "v_edges").select("repo", F.col("dst").alias("path")).distinct()
    return nodes.where("path not like 'c%'")


@query("c6_impact", """
WITH e AS (SELECT DISTINCT src, dst FROM v_edges), s AS (SELECT DISTINCT dst AS changed FROM e WHERE dst NOT LIKE 'c%'),
d AS (SELECT changed, src FROM s JOIN e ON dst = changed),
i AS (SELECT DISTINCT d.changed, e.src FROM d JOIN e ON e.dst = d.src WHERE e.src <> d.changed AND (d.changed, e.src) NOT IN (SELECT changed, src FROM d)),
m AS (SELECT changed, dst FROM s JOIN e ON src = changed)
SELECT changed, coalesce((SELECT array_to_string(list_sort(list(src))[:25], ',') FROM d WHERE d.changed = s.changed), '') AS direct_callers,
  coalesce((SELECT array_to_string(list_sort(list(src))[:25], ',') FROM i WHERE i.changed = s.changed), '') AS indirect_callers,
  coalesce((SELECT array_to_string(list_sort(list(dst))[:25], ',') FROM m WHERE m.changed = s.changed), '') AS imports FROM s""")
def impact(spark, sf):
    out = graph.impact(view(spark, sf, "v_edges"), _changed_nodes(spark, sf), cap=25)
    return out.select("changed", *[F.array_join(c, ",").alias(c) for c in ("direct_callers", "indirect_callers", "imports")])


@query("c6_impact_all", """
WITH e AS (SELECT DISTINCT src, dst FROM v_edges), s AS (SELECT DISTINCT dst AS changed FROM e WHERE dst NOT LIKE 'c%'),
d AS (SELECT changed, src FROM s JOIN e ON dst = changed),
i AS (SELECT DISTINCT d.changed, e.src FROM d JOIN e ON e.dst = d.src WHERE e.src <> d.changed AND (d.changed, e.src) NOT IN (SELECT changed, src FROM d))
SELECT changed, coalesce((SELECT array_to_string(list_sort(list(src)), ',') FROM d WHERE d.changed = s.changed), '') AS direct_callers,
  coalesce((SELECT array_to_string(list_sort(list(src)), ',') FROM i WHERE i.changed = s.changed), '') AS indirect_callers FROM s""")
def impact_all(spark, sf):
    out = graph.impact(view(spark, sf, "v_edges"), _changed_nodes(spark, sf))
    return out.select("changed", *[F.array_join(c, ",").alias(c) for c in ("direct_callers", "indirect_callers")])


@query("c6_impact_lists", """
WITH e AS (SELECT DISTINCT src, dst FROM v_edges), s AS (SELECT DISTINCT dst AS changed FROM e WHERE dst NOT LIKE 'c%'),
d AS (SELECT changed, src FROM s JOIN e ON dst = changed),
i AS (SELECT DISTINCT d.changed, e.src FROM d JOIN e ON e.dst = d.src WHERE e.src <> d.changed AND (d.changed, e.src) NOT IN (SELECT changed, src FROM d)),
m AS (SELECT changed, dst AS src FROM s JOIN e ON src = changed)
SELECT changed, list, count(*) AS n, array_to_string(list(src ORDER BY src), ',') AS held FROM (
  SELECT 'direct_callers' AS list, * FROM d UNION ALL SELECT 'indirect_callers', * FROM i UNION ALL SELECT 'imports', * FROM m) GROUP BY ALL""")
def impact_lists(spark, sf):
    pieces = graph.impact_lists(view(spark, sf, "v_edges"), _changed_nodes(spark, sf), piece_rows=100)
    ordered = F.array_sort(F.collect_list(F.struct("piece", "values")))
    held = F.flatten(F.transform("l", lambda p: p["values"]))
    return pieces.groupBy("changed", "list").agg(ordered.alias("l")).select(
        "changed", "list", F.size(held).cast("long").alias("n"), F.array_join(held, ",").alias("held"))


@query("c6_impact_summary", """
WITH e AS (SELECT DISTINCT src, dst FROM v_edges), s AS (SELECT DISTINCT dst AS changed FROM e WHERE dst NOT LIKE 'c%'),
d AS (SELECT src FROM s JOIN e ON dst = changed), i AS (SELECT e.src FROM d JOIN e ON e.dst = d.src)
SELECT (SELECT count(*) FROM s) AS changed_count,
  (SELECT count(DISTINCT src) FROM (SELECT src FROM d UNION ALL SELECT src FROM i) WHERE src NOT IN (SELECT changed FROM s)) AS unique_callers""")
def impact_summary(spark, sf):
    return graph.impact_summary(view(spark, sf, "v_edges"), _changed_nodes(spark, sf)).select("changed_count", "unique_callers")
