"""Hybrid ranking, thresholds and task context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, paths, scoring, text as T
from ..operators import graph, ranking, vectors
from ..operators.skew import spread
from . import context
from .queries_text import EDGES, KIND, toks
from ..session import settle
from .registry import files_of, query, r6, stored_files
from .views import view

_DOC_SCORE = """CASE WHEN path LIKE 'docs/adr/%' THEN 5 WHEN path LIKE '%/README.md' THEN 9 WHEN path LIKE '%/AGENTS.md' THEN 17
  WHEN path LIKE 'contracts/%' THEN 4 ELSE 0 END"""


def _corpus(kinds: str, files: str = "v_files", tasks: str = "v_tasks", emb: bool = False) -> str:
    score = "CASE WHEN {e} THEN greatest(0, e) + 0.05 * tanh(greatest(0, h) / 12.0) ELSE h END".format(e=str(emb).upper())
    return f"""
f AS (SELECT path, content, {KIND} AS kind, {_DOC_SCORE} AS ds, {toks('path')} AS pt, {toks('content')} AS ct,
    {toks("regexp_extract(path, '[^/]*$')")} AS nt FROM {files} WHERE {KIND} IN ({kinds})),
t AS (SELECT task_id, {toks('task')} AS tt FROM {tasks}),
x AS (SELECT task_id, f.path, kind, ds, content, tt, pt, ct, nt, len(list_intersect(tt, nt)) AS nn, len(list_intersect(tt, pt)) AS np,
    len(list_intersect(tt, ct)) AS nc, {"coalesce(v.score, 0)" if emb else "0.0"}::DOUBLE AS e
  FROM t CROSS JOIN f {"LEFT JOIN v_emb v USING (task_id, path)" if emb else ""}),
y AS (SELECT *, (CASE kind WHEN 'doc' THEN ds + 4 * np + nc WHEN 'config' THEN 0.5 * (6 * nn + 3 * np + nc) ELSE 6 * nn + 3 * np + nc END)::DOUBLE AS h,
    {str(emb).upper()} AND e >= 0.3 AS sim,
    CASE kind WHEN 'doc' THEN np > 0 OR nc >= 2 OR ds >= 12 ELSE nn > 0 OR np > 0 OR nc >= 2 END AS worthy FROM x),
z AS (SELECT *, {score} AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path) AS rank FROM z WHERE (sim OR worthy) AND score > 0)"""


_SHOWN = """list_sort(CASE WHEN kind = 'doc' THEN list_intersect(tt, list_concat(pt, ct)) WHEN nn > 0 THEN list_intersect(tt, nt)
  WHEN np > 0 THEN list_intersect(tt, pt) ELSE list_intersect(tt, ct) END)"""


def _rank_sql(kinds: str, k: int, emb: bool = False, files: str = "v_files", tasks: str = "v_tasks") -> str:
    default = ("High-value documentation for repository context" if "doc" in kinds else "Task tokens align with file name and content")
    return f"""WITH {_corpus(kinds, files, tasks, emb)}
SELECT task_id, path, rank, round(score, 6) AS score, h AS heuristic_score, round(e, 6) AS embedding_score,
  CASE WHEN sim AND len({_SHOWN}) > 0 THEN printf('Semantic similarity %.2f', e) || '; tokens: ' || array_to_string({_SHOWN}[:3], ', ')
    WHEN sim THEN printf('Semantic similarity %.2f', e)
    WHEN len({_SHOWN}) > 0 THEN 'Matches task tokens: ' || array_to_string({_SHOWN}[:3], ', ') ELSE '{default}' END AS reason
FROM r WHERE rank <= {k}"""


def _columns():
    return ["task_id", "path", "rank", r6("score"), "heuristic_score", r6("embedding_score"), "reason"]


@query("f1_rank_documents", _rank_sql("'doc'", 6))
def rank_documents(spark, sf):
    return ranking.rank_documents(view(spark, sf, "v_tasks"), files_of(spark, sf)).select(*_columns())


@query("f1_rank_documents_hybrid", _rank_sql("'doc'", 6, emb=True))
def rank_documents_hybrid(spark, sf):
    emb = view(spark, sf, "v_emb")
    return ranking.rank_documents(view(spark, sf, "v_tasks"), files_of(spark, sf), emb).select(*_columns())


@query("f1_rank_documents_source", _rank_sql("'doc'", 6, files="v_source", tasks="v_work"))
def rank_documents_source(spark, sf):
    return ranking.rank_documents(view(spark, sf, "v_work"), files_of(spark, sf, "v_source")).select(*_columns())


@query("f2_rank_files", _rank_sql("'code', 'config'", 8))
def rank_files(spark, sf):
    return ranking.rank_files(view(spark, sf, "v_tasks"), files_of(spark, sf)).select(*_columns())


@query("f2_rank_files_hybrid", _rank_sql("'code', 'config'", 8, emb=True))
def rank_files_hybrid(spark, sf):
    emb = view(spark, sf, "v_emb")
    return ranking.rank_files(view(spark, sf, "v_tasks"), files_of(spark, sf), emb, epsilon=0.0).select(*_columns())


@query("f3_blend", """
SELECT path, task_id, round(greatest(0, score) + 0.05 * tanh(length(path) / 12.0), 6) AS blended FROM v_emb""")
def blend(spark, sf):
    score = scoring.blend(F.length("path").cast("double"), "score", F.lit(K.DEFAULT_TIEBREAK))
    return view(spark, sf, "v_emb").select("path", "task_id", F.round(score, 6).alias("blended"))


@query("f4_resolve_thresholds", f"""
WITH l AS (SELECT key, max(CAST(t_value AS DOUBLE)) AS w FROM v_layers WHERE key = lower(key) GROUP BY key),
k AS (SELECT path, {KIND} AS kind, CASE WHEN path LIKE '%/api/%' THEN 'handler' WHEN path LIKE '%/README.md' THEN 'readme' ELSE 'other' END AS sub FROM v_files)
SELECT path, coalesce((SELECT w FROM l WHERE key = kind || '/' || sub), (SELECT w FROM l WHERE key = kind),
  (SELECT w FROM l WHERE key = '_default'), 0.3) AS qualify FROM k WHERE kind <> 'code' OR sub = 'handler'""")
def resolve_thresholds(spark, sf):
    values = view(spark, sf, "v_layers").where("key = lower(key)").groupBy("key").agg(
        F.max(F.col("t_value").cast("double")).alias("qualify")).withColumn("tiebreak", F.col("qualify"))
    files = files_of(spark, sf).where("kind <> 'code' or path like '%/api/%'")
    # Generated code is no handler; the oracle goes by the path, so only the path decides here as well.
    files = files.withColumn("subkind", F.when(F.col("path").contains("/api/"), "handler").otherwise(F.col("subkind")))
    return ranking.resolve_thresholds(files, values).select("path", "qualify")


@query("f5_merge_thresholds", """
WITH n AS (SELECT CASE WHEN source = 'env' THEN lower(key) ELSE key END AS key, source, TRY_CAST(q_value AS DOUBLE) AS q, TRY_CAST(t_value AS DOUBLE) AS t,
    CASE source WHEN 'default' THEN 0 WHEN 'file' THEN 1 WHEN 'learned' THEN 2 ELSE 3 END AS p FROM v_layers),
v AS (SELECT * FROM n WHERE key IN ('code', 'doc', 'config', 'test', '_default') OR (source <> 'env' AND split_part(key, '/', 1) IN ('code', 'doc', 'config', 'test') AND contains(key, '/')))
SELECT key, arg_max(q, p) FILTER (q IS NOT NULL) AS qualify, arg_max(t, p) FILTER (t IS NOT NULL) AS tiebreak FROM v GROUP BY key""")
def merge_thresholds(spark, sf):
    layers = view(spark, sf, "v_layers")
    return ranking.merge_thresholds(layers.withColumnsRenamed({"q_value": "qualify", "t_value": "tiebreak"}))


@query("f6_exploration", f"""WITH {_corpus("'code', 'config'", emb=True)},
p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY e DESC, path) AS n FROM z WHERE NOT sim AND NOT worthy AND e > 0)
SELECT task_id, path, round(e, 6) AS score, n AS rank, printf('Exploration probe (cosine %.2f below threshold %.2f)', e, 0.3::DOUBLE) AS reason FROM p WHERE n <= 2""")
def exploration(spark, sf):
    probes = ranking.exploration_probes(view(spark, sf, "v_tasks"), files_of(spark, sf), view(spark, sf, "v_emb"), epsilon=1.0)
    return probes.select("task_id", "path", r6("score"), "rank", "reason")


_STEM = """CASE WHEN path LIKE 'tests/test_%' THEN regexp_extract(path, 'test_(h-?\\d+)', 1) WHEN path LIKE '%.spec.ts' THEN regexp_extract(path, '/(w\\d+)\\.spec', 1)
  ELSE regexp_extract(path, '([^/]*)\\.[a-z]+$', 1) END"""


@query("f7_related_tests", f"""
WITH s AS (SELECT split_part(path, '/', 1) AS task_id, path AS seed, {_STEM} AS stem, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS dir, doc_id AS rank
  FROM v_files WHERE {KIND} = 'code'),
t AS (SELECT path AS test, {_STEM} AS stem FROM v_files WHERE {KIND} = 'test'),
p AS (SELECT task_id, test, sum(CASE WHEN s.stem = t.stem THEN 5 ELSE 0 END + CASE WHEN contains(test, dir) THEN 1 ELSE 0 END) AS score,
    list('Stem matches `' || seed || '`' ORDER BY rank) FILTER (s.stem = t.stem) AS why FROM s CROSS JOIN t GROUP BY task_id, test),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, test) AS n FROM p WHERE score > 0)
SELECT task_id, test AS path, score::DOUBLE AS score, n AS rank, coalesce(array_to_string(why, '; '), 'Likely associated test') AS reason FROM r WHERE n <= 6""")
def related_tests(spark, sf):
    # One task per top directory, seeded with all its code files.
    code = files_of(spark, sf).where("kind = 'code'").join(
        view(spark, sf, "v_files").select("path", "doc_id"), "path")
    seeds = code.select(paths.top_dir("path").alias("task_id"), "repo", "path", F.col("doc_id").cast("int").alias("rank"))
    tests = files_of(spark, sf).where("kind = 'test'")
    edges = graph.dependency_edges(files_of(spark, sf).where("kind = 'test'"))
    return graph.related_tests(tests, seeds, edges).select("task_id", "path", "score", "rank", "reason")


@query("f7_related_tests_imports", EDGES + """,
r AS (SELECT dst, src, row_number() OVER (PARTITION BY split_part(dst, '/', 1) ORDER BY src) AS n FROM e WHERE src LIKE 'tests/%'),
w AS (SELECT 'c' || c_custkey AS stem, 'pkg' || c_nationkey AS pkg, 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS seed, 'tests/test_c' || s_suppkey || '.py' AS test
  FROM customer JOIN supplier ON s_suppkey = c_custkey),
x AS (SELECT pkg AS task_id, test, 5 AS score FROM w UNION ALL SELECT split_part(dst, '/', 1), src, 6 FROM e WHERE src LIKE 'tests/%'),
y AS (SELECT task_id, test, sum(score) AS score FROM x GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, test) AS n FROM y)
SELECT task_id, test AS path, score::DOUBLE AS score, n AS rank FROM z WHERE n <= 6""")
def related_tests_imports(spark, sf):
    files = files_of(spark, sf, "v_source")
    changed = view(spark, sf, "v_changes")
    seeds = changed.select(paths.top_dir("path").alias("task_id"), "repo", "path", F.col("pos").cast("int").alias("rank"))
    tests = files.where("kind = 'test'")
    return graph.related_tests(tests, seeds, settle(graph.dependency_edges(files), "edges")).select("task_id", "path", "score", "rank")


def _context(spark, sf):
    files = stored_files(spark, sf)
    return context.task_context(view(spark, sf, "v_work"), files, settle(graph.dependency_edges(files), "edges"))


@query("f8_task_context", f"""WITH {_corpus("'doc', 'code', 'config'", "v_source", "v_work")},
d AS (SELECT task_id, count(*) AS n FROM (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path) AS i FROM r WHERE kind = 'doc') WHERE i <= 6 GROUP BY ALL),
c AS (SELECT task_id, count(*) AS n FROM (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path) AS i FROM r WHERE kind <> 'doc') WHERE i <= 8 GROUP BY ALL)
SELECT v.task_id, coalesce(d.n, 0) AS docs, coalesce(c.n, 0) AS files FROM v_work v LEFT JOIN d USING (task_id) LEFT JOIN c USING (task_id)""")
def task_context(spark, sf):
    ctx = _context(spark, sf)
    return ctx.select("task_id", F.col("metrics.docs_selected").alias("docs"), F.col("metrics.files_selected").alias("files"))


@query("f9_context_markdown")
def context_markdown(spark, sf):
    return _context(spark, sf).select("task_id", "summary", "context_markdown", F.col("metrics.output_bytes").alias("output_bytes"))


def embedded_scores(spark, sf, files, tasks):
    """Task × file scores from the bundled provider: whole texts, chunked, embedded and max-pooled per path.

    Chunks and vectors are stored tables, so that a core never has the Python workers of all the steps at once.
    """
    from ..operators import chunking

    cut = settle(chunking.chunk_files(files).select("repo", "path", "chunk_index", "kind", "embed_text"), "chunks")
    chunks = spread(settle(vectors.embed(cut, "embed_text").select(
        "repo", "path", "chunk_index", "kind", F.lit("repo").alias("namespace"), F.lit("chunk").alias("record_type"), "vector"), "vectors"), ["repo", "path"])
    asked = vectors.embed(tasks.select(F.col("task_id").alias("query_id"), "repo", "task"), "task")
    return vectors.path_scores(chunks, asked).select(F.col("query_id").alias("task_id"), "repo", "path", "score")


@query("f2_rank_files_embedded")
def rank_files_embedded(spark, sf):
    files, tasks = files_of(spark, sf), view(spark, sf, "v_tasks")
    emb = embedded_scores(spark, sf, files, tasks)
    return ranking.rank_files(tasks, files, emb).select(*_columns())


@query("b18_reason", f"""
WITH r AS (SELECT path, task_id, score, list_sort({toks('path')}) AS ov FROM v_emb)
SELECT path, task_id, CASE WHEN score >= 0.3 THEN printf('Semantic similarity %.2f', score) || '; tokens: ' || array_to_string(ov[:3], ', ')
  ELSE 'Matches task tokens: ' || array_to_string(ov[:3], ', ') END AS reason FROM r""")
def reason(spark, sf):
    overlap = F.array_sort(T.token_set("path"))
    return view(spark, sf, "v_emb").select("path", "task_id", T.reason(overlap, "score", F.lit(K.DEFAULT_THRESHOLD), "none").alias("reason"))
