"""Vector retrieval, index maintenance and branch lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import chunking, vectors
from ..sources import index_store
from .queries_text import _stored_index
from .registry import files_of, query
from .views import table, view

# One query per label: the direction of the label's mean vector.
QUERIES_SQL = """
m AS (SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
q AS (SELECT label AS query_id, list(round(m / n, 6) ORDER BY pos) AS qv FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS n FROM m) GROUP BY label),
s AS (SELECT query_id, c.*, round(list_dot_product(vector::DOUBLE[], qv), 6) AS score FROM q CROSS JOIN v_chunks c)"""


def label_queries(spark, sf) -> DataFrame:
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy("label")))
    unit = means.withColumn("x", F.round(F.col("m") / norm, 6))
    rows = unit.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("l"))
    return rows.select(F.col("label").cast("long").alias("query_id"), F.transform("l", lambda p: p["x"]).alias("vector"))


def chunks_of(spark, sf) -> DataFrame:
    """v_chunks with metadata and line ranges."""
    facts = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("even"), F.when(F.col("label") % 2 == 0, F.lit("yes")))
    return view(spark, sf, "v_chunks").withColumn("metadata", F.map_filter(facts, lambda _, v: v.isNotNull()))


@query("e1_embed")
def embed(spark, sf):
    vecs = vectors.embed(view(spark, sf, "v_files").select("path", "content"), "content")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vecs.select("path", F.round(F.sqrt(norm), 4).alias("norm"), F.size("vector").alias("dimension"))


@query("e2_score", f"WITH {QUERIES_SQL} SELECT query_id, path, chunk_index, score FROM s")
def score(spark, sf):
    return vectors.score(chunks_of(spark, sf), label_queries(spark, sf)).select("query_id", "path", "chunk_index", "score")


@query("e3_path_scores", f"WITH {QUERIES_SQL} SELECT query_id, path, max(score) AS score FROM s GROUP BY ALL")
def path_scores(spark, sf):
    return vectors.path_scores(chunks_of(spark, sf), label_queries(spark, sf)).select("query_id", "path", "score")


# The same paths in two repos: even vectors in one, odd ones in the other.
REPOS_SQL = f"""{QUERIES_SQL}, t AS (SELECT * REPLACE ('r' || vec_id % 2 AS repo) FROM s)"""


def two_repos(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("repo", F.concat(F.lit("r"), (F.col("vec_id") % 2).cast("string")))


@query("e3_path_scores_repos", f"WITH {REPOS_SQL} SELECT query_id, repo, path, max(score) AS score FROM t GROUP BY ALL")
def path_scores_repos(spark, sf):
    return vectors.path_scores(two_repos(chunks_of(spark, sf)), label_queries(spark, sf))


@query("e5_search_repos", f"""WITH {REPOS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, path, chunk_index) AS rank
FROM t WHERE repo = 'r' || query_id % 2) SELECT query_id, rank, repo, path, chunk_index, score FROM r WHERE rank <= 10""")
def search_repos(spark, sf):
    asked = label_queries(spark, sf).withColumn("repo", F.concat(F.lit("r"), (F.col("query_id") % 2).cast("string")))
    hits = vectors.search(two_repos(chunks_of(spark, sf)), asked, k=10, min_score=None)
    return hits.select("query_id", "rank", "repo", "path", "chunk_index", "score")


@query("e8_delete_paths_repos", """WITH c AS (SELECT * REPLACE ('r' || vec_id % 2 AS repo) FROM v_chunks)
SELECT repo, path, chunk_index FROM c WHERE (repo, path) NOT IN (SELECT repo, path FROM c WHERE label = 7)""")
def delete_paths_repos(spark, sf):
    chunks = two_repos(view(spark, sf, "v_chunks"))
    return vectors.delete_paths(chunks, chunks.where("label = 7").select("repo", "path").distinct()).select("repo", "path", "chunk_index")


@query("e10_diff_chunks_repos", """WITH c AS (SELECT path, vec_id % 2 AS side, min(chunk_index) AS chunk_index, min(content_hash) AS h FROM v_chunks GROUP BY ALL),
o AS (SELECT 'r' || side AS repo, path, 0 AS chunk_index, h FROM c), n AS (SELECT repo, path, chunk_index, CASE WHEN repo = 'r1' THEN h || 'x' ELSE h END AS h FROM o)
SELECT o.repo, o.path, CASE WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM o JOIN n USING (repo, path, chunk_index)""")
def diff_chunks_repos(spark, sf):
    old = two_repos(view(spark, sf, "v_chunks")).groupBy("repo", "path").agg(F.lit(0).alias("chunk_index"), F.min("content_hash").alias("content_hash"))
    new = old.withColumn("content_hash", F.when(F.col("repo") == "r1", F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return vectors.diff_chunks(old, new).select("repo", "path", "state")


@query("e4_filtered_score", f"""WITH {QUERIES_SQL}
SELECT query_id, path, chunk_index, score FROM s WHERE namespace = 'registry' AND record_type IN ('summary') AND label IN (5, 7)""")
def filtered_score(spark, sf):
    rows = vectors.score(chunks_of(spark, sf), label_queries(spark, sf), namespace="registry", record_types=["summary"],
                         filters={"label": ["5", "7"], "even": [None]})
    return rows.select("query_id", "path", "chunk_index", "score")


_TOP = """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk_index) AS rank FROM s WHERE {where})
SELECT query_id, rank, path, chunk_index, score FROM r WHERE rank <= {k}"""


@query("e5_search", f"WITH {QUERIES_SQL}" + _TOP.format(where="score >= 0.1", k=10))
def search(spark, sf):
    hits = vectors.search(chunks_of(spark, sf), label_queries(spark, sf), k=10, min_score=0.1)
    return hits.select("query_id", "rank", "path", "chunk_index", "score")


@query("e6_semantic_search", f"WITH {QUERIES_SQL}" + _TOP.format(where="kind = 'doc'", k=5))
def semantic_search(spark, sf):
    chunks = chunks_of(spark, sf).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2)).withColumn(
        "enclosing_symbol", F.lit(None).cast("string"))
    texts = view(spark, sf, "v_files").select("repo", "path", "content")
    hits = vectors.semantic_search(chunks, texts, label_queries(spark, sf), kind="doc", k=5)
    return hits.select("query_id", "rank", "path", "chunk_index", "score")


@query("e6_semantic_search_text")
def semantic_search_text(spark, sf):
    files = files_of(spark, sf)
    chunks = vectors.embed(chunking.chunk_files(files), "embed_text").withColumn("namespace", F.lit("default")).withColumn(
        "record_type", F.lit("chunk"))
    asked = vectors.embed(view(spark, sf, "v_tasks").select(F.col("task_id").alias("query_id"), "task"), "task")
    return vectors.semantic_search(chunks, files, asked, kind="doc", k=5)


def _updates(spark, sf):
    return view(spark, sf, "v_chunks").where("label = 3").withColumn("content_hash", F.concat("content_hash", F.lit("u")))


@query("e7_upsert", "SELECT path, chunk_index, CASE WHEN label = 3 THEN content_hash || 'u' ELSE content_hash END AS content_hash FROM v_chunks")
def upsert(spark, sf):
    return vectors.upsert(view(spark, sf, "v_chunks"), _updates(spark, sf)).select("path", "chunk_index", "content_hash")


@query("e7_upsert_index", "SELECT path, chunk_index, CASE WHEN label = 3 THEN content_hash || 'u' ELSE content_hash END AS content_hash FROM v_chunks")
def upsert_index(spark, sf):
    out = _stored_index(spark, sf)
    index_store.upsert_index(spark, out, _updates(spark, sf))
    return index_store.load_index(spark, out).select("path", "chunk_index", "content_hash")


def _gone(spark, sf):
    return view(spark, sf, "v_chunks").where("label = 7").select("repo", "path").distinct()


@query("e8_delete_paths", "SELECT path, chunk_index FROM v_chunks WHERE path NOT IN (SELECT path FROM v_chunks WHERE label = 7)")
def delete_paths(spark, sf):
    return vectors.delete_paths(view(spark, sf, "v_chunks"), _gone(spark, sf)).select("path", "chunk_index")


@query("e8_delete_from_index", "SELECT path, chunk_index FROM v_chunks WHERE path NOT IN (SELECT path FROM v_chunks WHERE label = 7)")
def delete_from_index(spark, sf):
    out = _stored_index(spark, sf)
    index_store.delete_from_index(spark, out, _gone(spark, sf))
    return index_store.load_index(spark, out).select("path", "chunk_index")


@query("e8_deleted_count", "SELECT count(*) AS removed FROM v_chunks WHERE path IN (SELECT path FROM v_chunks WHERE label = 7)")
def deleted_count(spark, sf):
    return vectors.deleted_count(view(spark, sf, "v_chunks"), _gone(spark, sf))


@query("e9_append_chunks", "SELECT path, chunk_index FROM v_chunks UNION ALL SELECT path, chunk_index + 5 FROM v_chunks WHERE label = 5")
def append_chunks(spark, sf):
    chunks = view(spark, sf, "v_chunks")
    more = chunks.where("label = 5").withColumn("chunk_index", F.col("chunk_index") + 5)
    return vectors.append_chunks(chunks, more, 64).select("path", "chunk_index")


_DIFF = """SELECT coalesce(o.path, n.path) AS path, coalesce(o.chunk_index, n.chunk_index) AS chunk_index,
  CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS state
FROM v_chunks o FULL JOIN v_chunks_new n ON o.path = n.path AND o.chunk_index = n.chunk_index"""


@query("e10_diff_chunks", _DIFF)
def diff_chunks(spark, sf):
    return vectors.diff_chunks(view(spark, sf, "v_chunks"), view(spark, sf, "v_chunks_new")).select("path", "chunk_index", "state")


@query("e10_diff_counts", f"""SELECT count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'changed') AS changed,
  count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'removed') AS removed FROM ({_DIFF})""")
def diff_counts(spark, sf):
    return vectors.diff_counts(view(spark, sf, "v_chunks"), view(spark, sf, "v_chunks_new"))


@query("e10_incremental_index", """
SELECT n.path, n.chunk_index, o.vector IS NOT NULL AS reused, round(o.vector[1]::DOUBLE, 6) AS first_value
FROM v_chunks_new n LEFT JOIN v_chunks o ON o.path = n.path AND o.chunk_index = n.chunk_index AND o.content_hash = n.content_hash""")
def incremental_index(spark, sf):
    old = view(spark, sf, "v_chunks")
    built = vectors.incremental_index(old, view(spark, sf, "v_chunks_new"))
    kept = old.select(*vectors.KEY, "content_hash", F.lit(True).alias("reused"))
    marked = built.join(kept, [*vectors.KEY, "content_hash"], "left").fillna(False, ["reused"])
    first = F.when(F.col("reused"), F.round(F.get("vector", F.lit(0)).cast("double"), 6))
    return marked.select("path", "chunk_index", "reused", first.alias("first_value"))


@query("e11_compatible", "SELECT count(*) > 0 AS compatible FROM v_chunks")
def compatible(spark, sf):
    meta = index_store.load_meta(spark, _stored_index(spark, sf))
    return index_store.compatible(meta, "m1", chunking.ChunkSettings().as_dict())


_REPLACED = """
SELECT 'old' AS origin, path, chunk_index FROM v_chunks WHERE path NOT IN (SELECT 'f' || CAST(floor(doc_id / 10) AS BIGINT) || '.py' FROM v_files WHERE doc_id % 10 = 3)
UNION ALL SELECT DISTINCT 'new', 'f' || CAST(floor(doc_id / 10) AS BIGINT) || '.py', 0 FROM v_files WHERE doc_id % 10 = 3 AND content <> ''"""


def _handlers(spark, sf):
    # The handlers' texts become the new content of the indexed file with the same number.
    source = view(spark, sf, "v_files").where("path like '%/api/%'")
    number = F.floor(F.col("doc_id") / 10).cast("string")
    return source.select("repo", F.concat(F.lit("f"), number, F.lit(".py")).alias("path"), F.lit("code").alias("kind"), "content")


def _origins(chunks):
    origin = F.when(F.col("vec_id").isNull(), "new").otherwise("old")
    return chunks.select(origin.alias("origin"), "path", "chunk_index").where("origin = 'old' or chunk_index = 0")


@query("e12_replace_files", _REPLACED)
def replace_files(spark, sf):
    return _origins(vectors.replace_files(view(spark, sf, "v_chunks"), _handlers(spark, sf)))


@query("e12_replace_in_index", _REPLACED)
def replace_in_index(spark, sf):
    out = _stored_index(spark, sf)
    index_store.replace_in_index(spark, out, _handlers(spark, sf))
    return _origins(index_store.load_index(spark, out))


@query("e13_overlay", """
WITH c AS (SELECT DISTINCT path FROM v_chunks WHERE label = 3), d AS (SELECT DISTINCT path FROM v_chunks WHERE label = 7 AND path NOT IN (SELECT path FROM c)),
k AS (SELECT count(*) <= 300 AS ok FROM (SELECT path FROM c UNION SELECT path FROM d))
SELECT path, chunk_index, content_hash FROM v_chunks, k WHERE NOT ok OR path NOT IN (SELECT path FROM c UNION SELECT path FROM d)
UNION ALL SELECT path, chunk_index, content_hash || 'o' FROM v_chunks, k WHERE ok AND path IN (SELECT path FROM c)""")
def overlay(spark, sf):
    return _overlay(spark, sf, 300)


@query("e13_overlay_whole", """
SELECT path, chunk_index, CASE WHEN path IN (SELECT path FROM v_chunks WHERE label = 3) THEN content_hash || 'o' ELSE content_hash END AS content_hash
FROM v_chunks WHERE path IN (SELECT path FROM v_chunks WHERE label = 3) OR path NOT IN (SELECT path FROM v_chunks WHERE label = 7)""")
def overlay_whole(spark, sf):
    return _overlay(spark, sf, None)


def _overlay(spark, sf, cap):
    base = view(spark, sf, "v_chunks")
    changed = base.where("label = 3").select("repo", "path").distinct()
    deleted = _gone(spark, sf).join(changed, ["repo", "path"], "left_anti")
    fresh = base.join(changed, ["repo", "path"], "left_semi").withColumn("content_hash", F.concat("content_hash", F.lit("o")))
    return vectors.overlay(base, fresh, changed, deleted, cap=cap).select("path", "chunk_index", "content_hash")


@query("e14_classify_delta", """
SELECT DISTINCT d.path, CASE WHEN f.path IS NULL THEN 'deleted' ELSE 'changed' END AS state
FROM v_diff d LEFT JOIN (SELECT DISTINCT path FROM v_diff WHERE status = ' M') f USING (path) WHERE NOT d.path LIKE '%.sh'""")
def classify_delta(spark, sf):
    diff = view(spark, sf, "v_diff").withColumn("repo", F.lit("main"))
    return vectors.classify_delta(diff, diff.where("status = ' M'")).select("path", "state")


_BRANCHES = """
WITH o AS (SELECT * FROM v_branches WHERE NOT merged AND age_days <= 30 AND commits_ahead > 0),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY seq) AS n FROM o) WHERE n = 1),
b AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY repo ORDER BY age_days, seq) AS rank FROM u) WHERE rank <= 25)"""


@query("e15_advisory_branches_whole", _BRANCHES.replace(" WHERE rank <= 25", "") + "SELECT repo, branch, sha, rank FROM b")
def advisory_branches_whole(spark, sf):
    return vectors.advisory_branches(view(spark, sf, "v_branches")).select("repo", "branch", "sha", "rank")


@query("e15_advisory_branches", _BRANCHES + "SELECT repo, branch, sha, rank FROM b")
def advisory_branches(spark, sf):
    return vectors.advisory_branches(view(spark, sf, "v_branches"), k=25).select("repo", "branch", "sha", "rank")


def _advisory(spark, sf, k=25, max_files=60):
    """Ten neighbouring chunks, two files, are open on the branch with that number."""
    branches = view(spark, sf, "v_branches")
    numbered = chunks_of(spark, sf).drop("repo").withColumn("seq", F.floor(F.col("vec_id") / 10).cast("long"))
    chunks = numbered.join(branches.select("seq", "repo", "branch"), "seq").drop("seq")
    return vectors.advisory_chunks(chunks, vectors.advisory_branches(branches, k=k), max_files=max_files)


_ADVISORY = _BRANCHES + """,
x AS (SELECT b.repo, b.branch, b.commits_ahead, c.path, c.chunk_index, c.vec_id FROM b JOIN v_chunks c ON CAST(floor(c.vec_id / 10) AS BIGINT) = b.seq),
k AS (SELECT *, dense_rank() OVER (PARTITION BY repo, branch ORDER BY path) AS n FROM x)"""


@query("e16_advisory_chunks", _ADVISORY + """
SELECT repo, branch, path, chunk_index, 'advisory' AS namespace, CAST(commits_ahead AS VARCHAR) AS commits_ahead FROM k WHERE n <= 60""")
def advisory_chunks(spark, sf):
    return _advisory(spark, sf).select("repo", "branch", "path", "chunk_index", "namespace",
                                       F.element_at("metadata", F.lit("commits_ahead")).alias("commits_ahead"))


@query("e16_advisory_chunks_whole", _ADVISORY.replace(" WHERE rank <= 25", "") + """
SELECT repo, branch, path, chunk_index, 'advisory' AS namespace, CAST(commits_ahead AS VARCHAR) AS commits_ahead FROM k""")
def advisory_chunks_whole(spark, sf):
    return _advisory(spark, sf, None, None).select("repo", "branch", "path", "chunk_index", "namespace",
                                                   F.element_at("metadata", F.lit("commits_ahead")).alias("commits_ahead"))


@query("e16_advisory_search", _ADVISORY + f""",
{QUERIES_SQL},
h AS (SELECT DISTINCT query_id, s.path, s.chunk_index, s.score FROM s JOIN k USING (vec_id) WHERE n <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk_index) AS rank FROM h)
SELECT query_id, path, chunk_index, score, rank FROM r WHERE rank <= 10""")
def advisory_search(spark, sf):
    # The same chunk may be open on several branches; the lane is searched once per distinct chunk.
    lane = _advisory(spark, sf).dropDuplicates(["path", "chunk_index"])
    return vectors.advisory_search(lane, label_queries(spark, sf)).select("query_id", "path", "chunk_index", "score", "rank")


_FRESH = """SELECT repo, min_by(sha, seq) AS old_sha, max_by(sha, seq) AS new_sha, max(changed_files) % 400 AS changed_files, bool_or(seq % 90 = 0) AS odd FROM v_branches GROUP BY repo"""


@query("e17_freshness", f"""
SELECT repo, CASE WHEN repo = 'repo3' THEN 'no_base' WHEN repo LIKE 'repo1%' THEN 'no_index' WHEN odd THEN 'current' WHEN changed_files > 200 THEN 'stale_large' ELSE 'stale' END AS status,
  changed_files FROM ({_FRESH})""")
def freshness(spark, sf):
    states = view(spark, sf, "v_branches").groupBy("repo").agg(
        F.min_by("sha", "seq").alias("old_sha"), F.max_by("sha", "seq").alias("new_sha"),
        (F.max("changed_files") % 400).alias("changed_files"), F.bool_or(F.col("seq") % 90 == 0).alias("odd"))
    head = states.select("repo", F.when(F.col("repo") != "repo3", F.col("new_sha")).alias("base_sha"), "changed_files")
    built = states.where("repo not like 'repo1%'").select(
        "repo", F.lit("origin-main").alias("built_from"), F.when(F.col("odd"), F.col("new_sha")).otherwise(F.lit("none")).alias("base_sha"))
    return vectors.freshness(built, head).select("repo", "status", "changed_files")


@query("e18_namespaces", "SELECT DISTINCT namespace FROM v_chunks")
def namespaces(spark, sf):
    return vectors.namespaces(view(spark, sf, "v_chunks"))


@query("e18_record_types", "SELECT DISTINCT record_type FROM v_chunks")
def record_types(spark, sf):
    return vectors.record_types(view(spark, sf, "v_chunks"))


@query("e18_get_records", "SELECT content_hash AS id, path FROM v_chunks WHERE content_hash IN (SELECT 'h' || doc_id FROM labels)")
def get_records(spark, sf):
    records = view(spark, sf, "v_chunks").select(F.col("content_hash").alias("id"), "path")
    ids = table(spark, sf, "labels").select(F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("id"))
    return vectors.get_records(records, ids).select("id", "path")
