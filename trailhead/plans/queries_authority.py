"""Authority, scope, risk, bundles and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import globs
from ..operators import authority as A, graph, ranking
from ..operators.skew import top_k
from . import context
from ..session import settle
from .queries_rank import _corpus
from .queries_text import KIND
from .registry import files_of, query, stored_files
from .views import table, view

_FILE_TYPE = """CASE WHEN path LIKE 'contracts/%' THEN 'contract' WHEN path LIKE 'docs/adr/%' THEN 'architecture_note' END"""


@query("d1_authority_type", f"SELECT path, {_FILE_TYPE} AS type, CASE {_FILE_TYPE} WHEN 'contract' THEN 1 WHEN 'architecture_note' THEN 2 END AS level FROM v_files")
def authority_type(spark, sf):
    return view(spark, sf, "v_files").select("path", A.authority_type("path").alias("a")).select("path", "a.type", "a.level")


# What the contracts, modules and scripts of v_source state, from their keys.
_AUTH = """
au AS (
  SELECT 'contract:contracts/n' || n_nationkey || '.md' AS id, 'contract' AS type, 'contracts/n' || n_nationkey || '.md' AS path, '---' AS title, '---' AS summary,
    1 AS level, ['contract'] AS tags, ['pkg' || n_nationkey || '/*'] AS applies, n_nationkey AS k, n_name AS name FROM nation
  UNION ALL SELECT 'invariant:pkg' || c_nationkey || '/c' || c_custkey || '.py#L7', 'invariant', 'pkg' || c_nationkey || '/c' || c_custkey || '.py:7',
    'INVARIANT: balance of ' || c_name || ' stays above zero', 'balance of ' || c_name || ' stays above zero', 1, ['invariant', 'inline'],
    ['pkg' || c_nationkey || '/c' || c_custkey || '.py'], NULL, NULL FROM customer
  UNION ALL SELECT 'architecture_note:web/b' || p_size || '/p' || p_partkey || '.ts#L1', 'architecture_note', 'web/b' || p_size || '/p' || p_partkey || '.ts:1',
    'See contract: contracts/n' || (p_partkey % 30) || '.md', 'contracts/n' || (p_partkey % 30) || '.md', 2, ['architecture_note', 'inline'],
    ['web/b' || p_size || '/p' || p_partkey || '.ts'], NULL, NULL FROM part),
co AS (
  SELECT au.id AS source_record_id, s.st AS statement, 'subsystem' AS scope, applies, CASE WHEN k % 3 = 1 THEN 'guided' ELSE 'hard' END AS severity,
    ['test:tests/test_c' || k || '.py'] AS refs
  FROM au, LATERAL (VALUES ('balance of ' || name || ' is settled every day'), ('names are unique'), ('drop ' || name)) AS s(st) WHERE type = 'contract'
  UNION ALL SELECT id, summary, 'path', applies, CASE level WHEN 1 THEN 'hard' ELSE 'guided' END, [] FROM au WHERE list_contains(tags, 'inline')),
cs AS (SELECT 'const:' || left(sha256(source_record_id || '|' || statement), 12) AS id, * FROM co)"""


def _auth(spark, sf):
    return A.authority_records(files_of(spark, sf, "v_source"))


@query("d2_front_matter", """
SELECT 'contracts/n' || n_nationkey || '.md' AS path, 'pkg' || n_nationkey || '/*' AS applies_to, CASE n_nationkey % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'Guided' ELSE 'unknown' END AS severity,
  '"tests/test_c' || n_nationkey || '.py"' AS validated_by, '# Contract ' || n_name AS first_line FROM nation""")
def front_matter(spark, sf):
    docs = view(spark, sf, "v_source").where("path like 'contracts/%'").select("path", A.front_matter("content").alias("f"))
    items = [F.array_join(F.element_at("f.data", F.lit(k))["items"], ",").alias(k) for k in ("applies_to", "severity", "validated_by")]
    return docs.select("path", *items, F.substring_index("f.body", "\n", 1).alias("first_line"))


@query("d3_markers", """
SELECT 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path, 7 AS line, 'invariant' AS kind, 'balance of ' || c_name || ' stays above zero' AS body FROM customer
UNION ALL SELECT 'web/b' || p_size || '/p' || p_partkey || '.ts', 1, 'see_contract', 'contracts/n' || (p_partkey % 30) || '.md' FROM part""")
def markers(spark, sf):
    return A.markers(view(spark, sf, "v_source")).select("path", "line", "kind", "body")


@query("d4_heading_bullets", """
SELECT 'contracts/n' || n_nationkey || '.md' AS path, s.title, s.items FROM nation,
  LATERAL (VALUES ('invariants', 'balance of ' || n_name || ' is settled every day|names are unique'), ('do not', 'drop ' || n_name)) AS s(title, items)""")
def heading_bullets(spark, sf):
    docs = view(spark, sf, "v_source").where("path like 'contracts/%'")
    return docs.select("path", F.inline(A.heading_bullets("content"))).select("path", "title", F.array_join("items", "|").alias("items"))


@query("d5_authority_records", f"""WITH {_AUTH}
SELECT id, type, path, title, summary, level AS authority_level, array_to_string(tags, ',') AS tags, array_to_string(applies, ',') AS applies_to_paths FROM au""")
def authority_records(spark, sf):
    return _auth(spark, sf).select(
        "id", "type", "path", "title", "summary", "authority_level", F.array_join("tags", ",").alias("tags"),
        F.array_join("applies_to_paths", ",").alias("applies_to_paths"))


@query("d6_constraints", f"""WITH {_AUTH}
SELECT id, statement, source_record_id, scope, array_to_string(applies, ',') AS applies_to_paths, severity, array_to_string(refs, ',') AS validation_refs FROM cs""")
def constraints(spark, sf):
    return A.constraints(_auth(spark, sf)).select(
        "id", "statement", "source_record_id", "scope", F.array_join("applies_to_paths", ",").alias("applies_to_paths"), "severity",
        F.array_join("validation_refs", ",").alias("validation_refs"))


def _top_auth(tasks: str) -> str:
    return f"""
w AS (SELECT task_id, list_distinct(list_transform(list_filter(regexp_extract_all(task, '\\S+'), lambda x: length(x) > 2), lambda x: lower(x))) AS words FROM {tasks}),
h AS (SELECT *, lower(title || ' ' || summary || ' ' || array_to_string(tags, ' ')) AS hay FROM au),
o AS (SELECT task_id, h.*, len(list_filter(words, lambda x: contains(hay, x))) AS overlap FROM w CROSS JOIN h),
ra AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY level, overlap DESC, path, id) AS rank FROM o QUALIFY rank <= 12)"""


@query("d7_rank_authority", f"WITH {_AUTH}, {_top_auth('v_tasks')} SELECT task_id, id, overlap, rank FROM ra")
def rank_authority(spark, sf):
    return A.rank_authority(settle(_auth(spark, sf), "authority"), view(spark, sf, "v_tasks")).select("task_id", "id", "overlap", "rank")


@query("d7_rank_authority_work", f"WITH {_AUTH}, {_top_auth('v_work')} SELECT task_id, id, overlap, rank FROM ra")
def rank_authority_work(spark, sf):
    return A.rank_authority(settle(_auth(spark, sf), "authority"), view(spark, sf, "v_work")).select("task_id", "id", "overlap", "rank")


@query("d8_glob_join", """
SELECT path, pattern AS "glob" FROM (SELECT DISTINCT path FROM v_diff) d JOIN (
  SELECT 'src/s' || (p_size % 10) || '*.ts' AS pattern FROM part UNION SELECT 'tests/t' || p_partkey || '.py' FROM part UNION SELECT '*c' || (p_size % 3) || '?.yaml' FROM part) g
  ON (pattern LIKE 'src/%' AND path LIKE replace(pattern, '*', '%')) OR pattern = path OR (pattern LIKE '*%' AND path LIKE replace(replace(pattern, '*', '%'), '?', '_'))""")
def glob_join(spark, sf):
    part = table(spark, sf, "part")
    size = F.col("p_size")
    rules = part.select(F.concat(F.lit("src/s"), (size % 10).cast("string"), F.lit("*.ts")).alias("glob")).union(
        part.select(F.concat(F.lit("tests/t"), F.col("p_partkey").cast("string"), F.lit(".py")))).union(
        part.select(F.concat(F.lit("*c"), (size % 3).cast("string"), F.lit("?.yaml")))).distinct()
    paths = view(spark, sf, "v_diff").select(F.lit("main").alias("repo"), "path").distinct()
    return A.glob_join(paths, rules.withColumn("repo", F.lit("main"))).select("path", "glob")


_WORK = f"""{_AUTH}, {_top_auth('v_work')},
rc AS (SELECT ra.task_id, ra.rank, cs.* FROM ra JOIN cs ON cs.source_record_id = ra.id),
{_corpus("'code', 'config'", "v_source", "v_work").replace(" r AS (", " rf_ AS (").replace("r AS (SELECT", "rf AS (SELECT")}"""


def _work(spark, sf):
    """Tasks, files, edges, ranked files, and the rules of v_work on v_source."""
    files, tasks = stored_files(spark, sf), view(spark, sf, "v_work")
    auth, cons = context.rules_for_tasks(tasks, files)
    return tasks, files, auth, cons


_SCOPE = """
sc AS (SELECT v.task_id,
  coalesce((SELECT list_sort(list(path)) FROM rf WHERE rf.task_id = v.task_id AND rf.rank <= 6), []) AS allowed,
  coalesce((SELECT list_sort(list(path)) FROM rf WHERE rf.task_id = v.task_id AND rf.rank BETWEEN 7 AND 8), []) AS related,
  coalesce((SELECT list_sort(list_distinct(list(p))) FROM (SELECT split_part(path, ':', 1) AS p FROM ra WHERE ra.task_id = v.task_id AND level = 1
    UNION ALL SELECT unnest(applies) FROM rc WHERE rc.task_id = v.task_id AND severity = 'hard')), []) AS protected,
  (SELECT count(*) FROM rc WHERE rc.task_id = v.task_id AND severity = 'hard') AS hard FROM v_work v)"""


@query("d9_edit_scope", f"""WITH {_WORK}, {_SCOPE}
SELECT task_id, array_to_string(allowed, ',') AS allowed_paths, array_to_string(related, ',') AS related_paths, array_to_string(protected, ',') AS protected_paths,
  CASE WHEN len(protected) > 0 THEN 'Protected by ' || hard || ' hard constraints. ' ELSE '' END || 'Allowed paths derived from top-ranked relevant files.' AS rationale FROM sc""")
def edit_scope(spark, sf):
    tasks, files, auth, cons = _work(spark, sf)
    scope = A.edit_scope(tasks, ranking.rank_files(tasks, files), auth, cons)
    return scope.select("task_id", *[F.array_join(c, ",").alias(c) for c in ("allowed_paths", "related_paths", "protected_paths")], "rationale")


_PLAN = """
pt AS (SELECT task_id, path FROM (SELECT c_nationkey AS task_id, 'tests/test_c' || s_suppkey || '.py' AS path FROM supplier JOIN customer ON c_custkey = s_suppkey
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY 'tests/test_c' || s_suppkey || '.py') <= 6)
  UNION SELECT task_id, substr(unnest(refs), 6) FROM rc),
pl AS (SELECT v.task_id, coalesce((SELECT list_sort(list(path)) FROM pt WHERE pt.task_id = v.task_id), []) AS tests,
  coalesce((SELECT list_sort(list(source_record_id)) FROM rc WHERE rc.task_id = v.task_id AND source_record_id LIKE 'contract:%'), []) AS contracts,
  coalesce((SELECT list_sort(list(id)) FROM rc WHERE rc.task_id = v.task_id AND severity = 'hard'), []) AS invariants FROM v_work v)"""


def _plan(spark, sf):
    tasks, files, auth, cons = _work(spark, sf)
    tests = view(spark, sf, "v_source").where("path like 'tests/%'")
    # A test goes with the task whose package holds the module of the same number; six per task, as related tests are.
    number = F.regexp_extract("path", r"test_c(\d+)", 1)
    modules = view(spark, sf, "v_changes").select("task_id", F.col("pos").cast("string").alias("_n"))
    mapped = top_k(tests.withColumn("_n", number).join(modules, "_n").select("task_id", "path"), ["task_id"], ["path"], 6)
    return tasks, files, auth, cons, A.validation_plan(tasks, mapped, cons)


def _plan_out(plan):
    return plan.select(
        "task_id", F.array_join("tests", ",").alias("tests"), F.array_join("commands", ";").alias("commands"),
        F.array_join(F.array_sort("contract_checks"), ",").alias("contract_checks"),
        F.array_join(F.array_sort("invariants_to_verify"), ",").alias("invariants_to_verify"))


@query("d10_validation_plan", f"""WITH {_WORK}, {_PLAN}
SELECT task_id, array_to_string(tests, ',') AS tests, CASE WHEN len(tests) > 0 THEN 'pytest -q ' || array_to_string(tests, ' ') ELSE '' END AS commands,
  array_to_string(contracts, ',') AS contract_checks, array_to_string(invariants, ',') AS invariants_to_verify FROM pl""")
def validation_plan(spark, sf):
    return _plan_out(_plan(spark, sf)[-1])


_HITS = """
hi AS (SELECT DISTINCT rc.task_id, rc.id, rc.source_record_id, statement, severity, refs, v.pos, v.path FROM rc JOIN v_changes v ON v.task_id = rc.task_id
  AND (v.path = applies[1] OR (applies[1] LIKE '%/*' AND starts_with(v.path, left(applies[1], length(applies[1]) - 1)))))"""


@query("d11_validate_changes", f"""WITH {_WORK}, {_PLAN}, {_HITS},
m AS (SELECT task_id, tests, list_sort(list_distinct(list_concat(contracts, coalesce((SELECT list(source_record_id) FROM hi WHERE hi.task_id = pl.task_id AND source_record_id LIKE 'contract:%'), [])))) AS c,
  list_sort(list_distinct(list_concat(invariants, coalesce((SELECT list(id) FROM hi WHERE hi.task_id = pl.task_id AND severity = 'hard'), [])))) AS i FROM pl)
SELECT task_id, array_to_string(tests, ',') AS tests, CASE WHEN len(tests) > 0 THEN 'pytest -q ' || array_to_string(tests, ' ') ELSE '' END AS commands,
  array_to_string(c, ',') AS contract_checks, array_to_string(i, ',') AS invariants_to_verify FROM m""")
def validate_changes(spark, sf):
    _, _, _, cons, plan = _plan(spark, sf)
    return _plan_out(A.validate_changes(plan, cons, view(spark, sf, "v_changes")))


@query("d12_risk_report", f"""WITH {_WORK}, {_SCOPE}, {_PLAN}, {_HITS},
pr AS (SELECT v.task_id, v.path, min(e) AS entry FROM v_changes v JOIN (SELECT task_id, unnest(protected) AS e FROM sc) p ON p.task_id = v.task_id
  AND (v.path = e OR (e LIKE '%/*' AND starts_with(v.path, left(e, length(e) - 1)))) GROUP BY ALL),
hc AS (SELECT task_id, id, source_record_id, statement, severity, list(path ORDER BY pos) AS ps FROM hi GROUP BY ALL),
dr AS (SELECT ra.task_id, ra.id, list_sort(list(v.path)) AS ps FROM ra JOIN v_changes v ON v.task_id = ra.task_id
  AND ra.type = 'contract' AND starts_with(v.path, left(ra.applies[1], length(ra.applies[1]) - 1)) GROUP BY ALL)
SELECT task_id, 1 AS part, 'Change touches protected path: ' || path AS risk, 'Matches edit_scope.protected_paths entry ''' || entry || '''. Confirm with user or authority before proceeding.' AS why, 'hard' AS severity FROM pr
UNION ALL SELECT task_id, 2, 'Change intersects constraint ' || id || ': ' || statement, 'Affects ' || array_to_string(ps[:3], ', ') || CASE WHEN len(ps) > 3 THEN '…' ELSE '' END || '. Severity: ' || severity || '.', severity FROM hc
UNION ALL SELECT task_id, 3, 'No validation tests identified for this diff.', 'validation_plan.tests is empty; add targeted tests or confirm coverage manually.', 'guided' FROM pl WHERE len(tests) = 0 AND task_id IN (SELECT task_id FROM v_changes)
UNION ALL SELECT task_id, 4, 'Possible drift: implementation changed without updating ' || id || '.', 'Files ' || array_to_string(ps[:3], ', ') || CASE WHEN len(ps) > 3 THEN '…' ELSE '' END || ' are governed by ' || id || '; contract file was not touched.', 'advisory' FROM dr""")
def risk_report(spark, sf):
    tasks, files, auth, cons, plan = _plan(spark, sf)
    scope = settle(A.edit_scope(tasks, ranking.rank_files(tasks, files), auth, cons))
    return A.risk_report(view(spark, sf, "v_changes"), scope, cons, plan, auth).select("task_id", "part", "risk", "why", "severity")


@query("d13_initial_risks", f"""WITH {_WORK}, {_SCOPE}
SELECT task_id, 1 AS part, 'Repository contains protected paths.' AS risk, len(protected) || ' path(s) are covered by hard authority; call risk_report before finalizing.' AS why, 'guided' AS severity, 0 AS n_related FROM sc WHERE len(protected) > 0
UNION ALL SELECT task_id, 2, hard || ' hard constraint(s) in scope.', 'Hard constraints must not be violated; re-read each before editing.', 'hard', hard FROM sc WHERE hard > 0""")
def initial_risks(spark, sf):
    tasks, files, auth, cons = _work(spark, sf)
    scope = A.edit_scope(tasks, ranking.rank_files(tasks, files), auth, cons)
    return A.initial_risks(scope, cons).select("task_id", "part", "risk", "why", "severity", F.size("related_ids").cast("long").alias("n_related"))


@query("d14_scope_delta", f"""WITH {_WORK}, {_SCOPE}
SELECT task_id, array_to_string(list_filter(allowed, lambda p: NOT list_contains(old, p)), ',') AS added_allowed_paths, array_to_string(related, ',') AS added_related_paths,
  array_to_string(protected, ',') AS added_protected_paths
FROM sc JOIN (SELECT task_id, list(path) AS old FROM rf WHERE rank <= 3 GROUP BY task_id) USING (task_id)""")
def scope_delta(spark, sf):
    files, tasks = stored_files(spark, sf), view(spark, sf, "v_work")
    none = F.array().cast("array<string>")
    # The scope before: what a ranking of three files gave.
    before = ranking.rank_files(tasks, files, k=3)
    old = before.groupBy("task_id").agg(F.collect_list("path").alias("allowed_paths")).select(
        "task_id", "allowed_paths", none.alias("related_paths"), none.alias("protected_paths"))
    out = context.refresh(tasks, files, settle(graph.dependency_edges(files), "edges"), view(spark, sf, "v_changes"), old)["delta"]
    return out.join(old.select("task_id"), "task_id", "left_semi").select(
        "task_id", *[F.array_join(c, ",").alias(c) for c in out.columns if c != "task_id"])


@query("d15_subsystems", f"""
SELECT split_part(path, '/', 1) AS name, count(*) AS file_count, array_to_string(list_sort(list(path))[:5], ',') AS sample_files FROM v_files
WHERE {KIND} = 'code' GROUP BY 1 HAVING count(*) >= 3""")
def subsystems(spark, sf):
    return A.subsystems(files_of(spark, sf)).select("name", "file_count", F.array_join("sample_files", ",").alias("sample_files"))


@query("d16_contract_candidates", """
SELECT path, 'filename_hint' AS signals, row_number() OVER (ORDER BY path) AS rank FROM (SELECT replace(path, '/m', '/models_') AS path FROM v_files WHERE path LIKE '%/models/m%') QUALIFY rank <= 25""")
def contract_candidates(spark, sf):
    # The prose holds no interface code; model files are named for what they are.
    models = files_of(spark, sf).where("path like '%/models/%'").withColumn("path", F.replace("path", F.lit("/m"), F.lit("/models_")))
    return A.contract_candidates(models.withColumn("content", F.lower("content")), cap=25).select(
        "path", F.array_join("signals", ",").alias("signals"), "rank")


@query("d16_contract_candidates_whole", """
SELECT path, 'filename_hint' AS signals, row_number() OVER (ORDER BY path) AS rank FROM (SELECT replace(path, '/m', '/models_') AS path FROM v_files WHERE path LIKE '%/models/m%')""")
def contract_candidates_whole(spark, sf):
    models = files_of(spark, sf).where("path like '%/models/%'").withColumn("path", F.replace("path", F.lit("/m"), F.lit("/models_")))
    return A.contract_candidates(models.withColumn("content", F.lower("content"))).select("path", F.array_join("signals", ",").alias("signals"), "rank")


@query("d17_suggestions", """
WITH s AS (SELECT split_part(path, '/', 1) AS name, count(*) AS n FROM v_source WHERE path LIKE 'pkg%' OR path LIKE 'web/%' GROUP BY 1 HAVING count(*) >= 3)
SELECT 'docs/architecture/' || name || '.md' AS path, 'architecture' AS template_hint, 'How the `' || name || '/` subsystem is organized and what it owns' AS topic FROM s""")
def suggestions(spark, sf):
    files = stored_files(spark, sf)
    out = A.suggestions(A.subsystems(files), A.contract_candidates(files), A.existing_authority(files))
    return out.select("path", "template_hint", "topic")


@query("c7_authority_edges", f"""WITH {_AUTH},
im AS (SELECT 'implemented_by' AS edge_kind, au.id AS source, v.path AS target FROM au JOIN v_source v ON type <> 'architecture_note'
  AND (v.path = applies[1] OR (applies[1] LIKE '%/*' AND starts_with(v.path, left(applies[1], length(applies[1]) - 1)))))
SELECT * FROM im UNION ALL SELECT 'points_to', a.id, b.id FROM au a JOIN au b ON b.path = a.summary WHERE a.title LIKE 'See contract:%'""")
def authority_edges(spark, sf):
    files = stored_files(spark, sf)
    return A.authority_edges(settle(A.authority_records(files), "authority"), files, files.where("kind = 'test'")).select("edge_kind", "source", "target")


@query("c8_edge_targets", f"""
SELECT 'contract:contracts/n' || n_nationkey || '.md' AS source, 'pkg' || n_nationkey || '/c' || c_custkey || '.py' AS target FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def edge_targets(spark, sf):
    files = stored_files(spark, sf)
    auth = settle(A.authority_records(files), "authority")
    edges = A.authority_edges(auth, files, files.where("kind = 'test'"))
    sources = auth.where("type = 'contract'").select("repo", F.col("id").alias("source"))
    return A.edge_targets(edges, "implemented_by", sources).select("source", "target")


def _bundles(spark, sf):
    files, tasks = stored_files(spark, sf), view(spark, sf, "v_work")
    return context.bundles(tasks, files, settle(graph.dependency_edges(files), "edges"), index_ok=False, max_code=10, summary_chars=240)


@query("f10_bundles", f"""WITH {_WORK}, {_SCOPE}
SELECT task_id, (SELECT count(*) FROM ra WHERE ra.task_id = sc.task_id) AS n_authority, (SELECT count(*) FROM rc WHERE rc.task_id = sc.task_id) AS n_constraints,
  (SELECT count(*) FROM rf WHERE rf.task_id = sc.task_id AND rank <= 8) AS n_code, array_to_string(allowed, ',') AS allowed_paths, array_to_string(protected, ',') AS protected_paths,
  'lexical' AS ranker, 1 AS n_warnings FROM sc""")
def bundles(spark, sf):
    return _bundles(spark, sf).select(
        "task_id", F.size("authority").cast("long").alias("n_authority"), F.size("constraints").cast("long").alias("n_constraints"),
        F.size("relevant_code").cast("long").alias("n_code"), F.array_join("edit_scope.allowed_paths", ",").alias("allowed_paths"),
        F.array_join("edit_scope.protected_paths", ",").alias("protected_paths"), "ranker", F.size("warnings").alias("n_warnings"))


@query("f11_bundle_authority", f"""WITH {_AUTH}, {_top_auth('v_work')}
SELECT task_id, id, CASE WHEN type = 'contract' THEN left('---' || chr(10) || 'applies_to:', 15) ELSE summary END AS head FROM ra""")
def bundle_authority(spark, sf):
    rows = context.bundle_authority(_bundles(spark, sf)).select("task_id", F.inline("records"))
    head = F.when(F.col("type") == "contract", F.left("excerpt", F.lit(15))).otherwise(F.col("excerpt"))
    return rows.select("task_id", "id", head.alias("head"))


@query("f11_bundle_scope", f"""WITH {_WORK}, {_SCOPE}
SELECT task_id, array_to_string(allowed, ',') AS allowed_paths, array_to_string(related, ',') AS related_paths FROM sc""")
def bundle_scope(spark, sf):
    return context.bundle_scope(_bundles(spark, sf)).select(
        "task_id", *[F.array_join(c, ",").alias(c) for c in ("allowed_paths", "related_paths")])
