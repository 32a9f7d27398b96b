import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailhead.functions import paths, text as T
from trailhead.operators import impact, ranking, vectors
from trailhead.plans import queries_rank
from trailhead.plans.registry import files_of
from trailhead.plans.views import view

CHUNK = "repo string, path string, chunk_index long, kind string, namespace string, record_type string, metadata map<string,string>, content_hash string, vector array<float>"


def chunks(spark, n=200, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        v = v / np.linalg.norm(v) if i % 10 else np.eye(dim)[0]   # a tenth are copies of one vector
        rows.append(("r", f"f{i // 4}.py", i % 4, "code", "repo", "chunk", {"i": str(i)}, f"h{i}", [float(np.float32(x)) for x in v]))
    return spark.createDataFrame(rows, CHUNK), rows


def asked(spark, n, dim=8):
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)], "query_id long, vector array<double>")


def brute(rows, queries, k, floor):
    out = set()
    for q in queries.collect():
        scored = [(-round(float(np.dot(np.array(r[8]), np.array(q.vector))), 6), r[1], r[2]) for r in rows]
        for s, p, c in [x for x in sorted(scored) if -x[0] >= floor][:k]:
            out.add((q.query_id, p, c, round(-s, 5)))
    return out


@pytest.mark.parametrize("limit", [4096, 3])
def test_search_is_exact_by_broadcast_and_by_cells(spark, monkeypatch, limit):
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", limit)
    monkeypatch.setattr(vectors, "CELL_ROWS", 60)
    table, rows = chunks(spark)
    queries = asked(spark, 8)
    got = {(r.query_id, r.path, r.chunk_index, round(r.score, 5)) for r in vectors.search(table.repartition(5), queries, k=7).collect()}
    assert got == brute(rows, queries, 7, 0.0)
    pooled = {(r.query_id, r.path): r.score for r in vectors.path_scores(table, queries).collect()}
    assert len(pooled) == 8 * 50
    q0 = np.array(queries.first().vector)
    assert math.isclose(pooled[0, "f3.py"], max(np.dot(np.array(r[8]), q0) for r in rows if r[1] == "f3.py"), abs_tol=1e-5)


def test_equal_paths_of_two_repos_stay_apart(spark):
    table, rows = chunks(spark, 40)
    both = table.unionByName(table.withColumn("repo", F.lit("other")))
    queries = asked(spark, 3)
    assert vectors.path_scores(both, queries).count() == 2 * 3 * 10
    gone = spark.createDataFrame([("r", "f1.py")], "repo string, path string")
    assert vectors.delete_paths(both, gone).count() == 76
    assert {r.state for r in vectors.diff_chunks(both, both).collect()} == {"unchanged"}
    here = vectors.search(both, queries.withColumn("repo", F.lit("other")), k=4, min_score=None).collect()
    assert len(here) == 12 and {r.repo for r in here} == {"other"}


def test_search_edges(spark):
    table, _ = chunks(spark, 20)
    queries = asked(spark, 2)
    assert vectors.search(table, queries, k=0).count() == 0
    assert vectors.search(table, queries.limit(0), k=3).count() == 0
    assert vectors.search(table, queries, k=3, kind="nonsense", min_score=None).count() == 6
    assert vectors.search(table, queries, k=3, kind="doc").count() == 0
    assert {r.path for r in vectors.score(table, queries, filters={"i": ["4"]}).collect()} == {"f1.py"}
    assert vectors.score(table, queries, filters={"gone": ["x"]}).count() == 0
    assert vectors.score(table, queries, filters={"gone": ["x", None]}).count() == 40


def test_search_keeps_k_rows_per_task_before_the_shuffle(spark):
    table, _ = chunks(spark)
    plan = vectors.search(table, asked(spark, 4), k=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_incremental_equals_rebuild(spark):
    files = paths.classify(spark.createDataFrame([("r", f"a{i}.md", f"text number {i} " * 30) for i in range(6)], "repo string, path string, content string"))
    from trailhead.operators import chunking

    full = vectors.embed(chunking.chunk_files(files), "embed_text")
    old = full.withColumn("content_hash", F.when(F.col("path") == "a2.md", "stale").otherwise(F.col("content_hash")))
    again = vectors.incremental_index(old, chunking.chunk_files(files))
    key = lambda df: {(r.path, r.chunk_index): [round(x, 5) for x in r.vector] for r in df.collect()}
    assert key(again) == key(full)
    assert all(math.isclose(sum(x * x for x in v), 1.0, abs_tol=1e-4) for v in key(full).values())


def test_wrong_dimension_fails(spark):
    table, _ = chunks(spark, 4)
    with pytest.raises(Exception, match="dimension"):
        vectors.append_chunks(table, table, 9).collect()


def test_overlay_cap(spark):
    base = spark.createDataFrame([("r", p, 0, "old") for p in "abc"], "repo string, path string, chunk_index int, content_hash string")
    changed = base.where("path = 'a'").select("repo", "path")
    deleted = base.where("path = 'b'").select("repo", "path")
    fresh = spark.createDataFrame([("r", "a", 0, "new")], base.schema)
    got = {(r.path, r.content_hash) for r in vectors.overlay(base, fresh, changed, deleted).collect()}
    assert got == {("a", "new"), ("c", "old")}
    kept = {(r.path, r.content_hash) for r in vectors.overlay(base, fresh, changed, deleted, cap=1).collect()}
    assert kept == {("a", "old"), ("b", "old"), ("c", "old")}


def clustered(spark, n=3000, dim=12, clusters=25):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, dim))
    v = np.round(v / np.linalg.norm(v, axis=1)[:, None] * 256) / 256      # products are exact in any order
    rows = [("r", f"f{i // 4}.py", i % 4, "code", "repo", "chunk", {}, f"h{i}", [float(np.float32(x)) for x in v[i]]) for i in range(n)]
    q = np.round(centres[:20] / np.linalg.norm(centres[:20], axis=1)[:, None] * 256) / 256
    asked = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)], "query_id long, vector array<double>")
    return spark.createDataFrame(rows, CHUNK).repartition(2), rows, asked


@pytest.mark.parametrize("limit", [4096, 7])
def test_tiles_leave_out_what_their_bounds_exclude(spark, monkeypatch, limit):
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", limit)
    monkeypatch.setattr(vectors, "CELL_ROWS", 1000)
    tile = 32 * 20 * 40     # bytes of 40 chunks and 20 queries
    table, rows, queries = clustered(spark)
    got = {(r.query_id, r.path, r.chunk_index, round(r.score, 5)) for r in vectors.search(table, queries, k=5, tile_bytes=tile).collect()}
    assert got == brute(rows, queries, 5, 0.0)
    counted = vectors.search_tiles(table, queries, k=5, tile_bytes=tile).first()
    assert counted.tiles > 500 and counted.skipped / counted.tiles > 0.25, counted


def test_tiles_stay_below_their_bytes(monkeypatch):
    import tracemalloc

    import pandas as pd

    monkeypatch.setattr(vectors, "SLAB_ROWS", 2048)
    rng = np.random.default_rng(18)
    v = rng.normal(size=(20_000, 16)).astype(np.float32)
    pdf = pd.DataFrame({"repo": "r", "path": [f"p{i}" for i in range(len(v))], "chunk_index": 0, "kind": "code", "namespace": "n", "record_type": "c", "vector": list(v)})
    q = rng.normal(size=(4000, 16))
    top = vectors._TopK(vectors._Asked(np.arange(4000), q, np.array([None] * 4000)), 3, -np.inf, tile_bytes=4 << 20)
    monkeypatch.setattr(top, "_settle", lambda: (top.rows.clear(), setattr(top, "held", 0)))      # measure the tiles, not the kept rows
    tracemalloc.start()
    list(top.add(pdf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 20_000 * 4000 * 8 > 100 * (4 << 20) and peak < 3 * (4 << 20) + 2 * vectors.PAIR_ROWS * 100, peak


# ---- ranking ---------------------------------------------------------------------------------------------------------


def test_salted_ranking_equals_broadcast(spark, sf, monkeypatch):
    tasks, files = view(spark, sf, "v_tasks"), files_of(spark, sf)
    emb = view(spark, sf, "v_emb")
    run = lambda: (sorted(map(tuple, ranking.rank_files(tasks, files, emb, epsilon=0.0).select("task_id", "path", "rank").collect())),
                   sorted(map(tuple, ranking.rank_documents(tasks, files).select("task_id", "path", "rank").collect())))
    small = run()
    monkeypatch.setattr(impact, "MAX_BROADCAST_TERMS", 0)
    monkeypatch.setattr(ranking, "MAX_BROADCAST_TASKS", 0)
    assert run() == small and small[0] and small[1]


def test_ranking_never_crosses_tasks_and_files(spark, sf):
    ranked = ranking.rank_files(view(spark, sf, "v_tasks"), files_of(spark, sf))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_source_passage_ranks(spark, sf):
    """A task quoted word for word in a document must find it or something that shares as many words."""
    tasks, files = view(spark, sf, "v_tasks"), files_of(spark, sf)
    top = ranking.rank_files(tasks, files).where("rank = 1")
    texts = {r.path: r.content for r in files.select("path", "content").collect()}
    asked_for = {r.task_id: r.task for r in tasks.collect()}
    for r in top.collect():
        quoted = [p for p, c in texts.items() if asked_for[r.task_id] in c and p.endswith((".py", ".js", ".json")) and "tests/" not in p]
        assert not quoted or r.heuristic_score >= 10


def test_high_value_documents_rank_without_evidence(spark):
    names = ["AGENTS.md"] + [f"d{i}/AGENTS.md" for i in range(9)] + ["x/plain.md"]
    files = paths.classify(spark.createDataFrame([("r", n, "nothing here") for n in names], "repo string, path string, content string"))
    tasks = spark.createDataFrame([(1, "r", "unrelated words"), (2, "other", "nothing here")], "task_id int, repo string, task string")
    got = ranking.rank_documents(tasks, files).orderBy("rank").collect()
    assert [r.path for r in got] == ["AGENTS.md"] + [f"d{i}/AGENTS.md" for i in range(5)]
    assert {r.task_id for r in got} == {1} and got[0].reason == "High-value documentation for repository context"


def test_hybrid_prefers_similarity(spark):
    files = paths.classify(spark.createDataFrame(
        [("r", "src/auth/login.py", "login code"), ("r", "src/billing/invoice.py", "totals")], "repo string, path string, content string"))
    tasks = spark.createDataFrame([(1, "r", "fix login")], "task_id int, repo string, task string")
    emb = spark.createDataFrame([(1, "r", "src/auth/login.py", 0.1), (1, "r", "src/billing/invoice.py", 0.85)], "task_id int, repo string, path string, score double")
    assert [r.path for r in ranking.rank_files(tasks, files, emb, epsilon=0.0).orderBy("rank").collect()] == ["src/billing/invoice.py", "src/auth/login.py"]
    assert [r.path for r in ranking.rank_files(tasks, files).collect()] == ["src/auth/login.py"]
    low = emb.withColumn("score", F.lit(0.2))
    probes = ranking.rank_files(tasks, files, low, epsilon=1.0).orderBy("rank").collect()
    assert [(r.path, round(r.score, 3)) for r in probes][-1] == ("src/billing/invoice.py", 0.2)
    assert probes[-1].reason == "Exploration probe (cosine 0.20 below threshold 0.30)"


def test_exploration_is_reproducible(spark):
    tasks = spark.range(2000).withColumnRenamed("id", "task_id")
    a = {r.task_id for r in ranking.explored_tasks(tasks, 0.05, 3).collect()}
    assert a == {r.task_id for r in ranking.explored_tasks(tasks.repartition(7), 0.05, 3).collect()} and 50 < len(a) < 160


def test_exploration_probes_form_no_pair_without_a_similarity(spark, monkeypatch):
    words = "login token invoice totals retry queue".split()
    files = paths.classify(spark.createDataFrame(
        [("r", f"src/{words[i % 6]}/f{i}.py", f"{words[(i + 1) % 6]} {words[(i * 5) % 6]} code") for i in range(40)] + [("r", "docs/a.md", "login")],
        "repo string, path string, content string"))
    tasks = spark.createDataFrame([(t, "r", f"fix {words[t % 6]} and {words[(t + 2) % 6]}") for t in range(6)], "task_id int, repo string, task string")
    scores = [(t, "r", f"src/{words[i % 6]}/f{i}.py", (i * 7 + t) % 50 / 100 - 0.05) for t in range(6) for i in range(0, 40, 2)]
    emb = spark.createDataFrame(scores + scores[:3] + [(1, "r", "docs/a.md", 0.2), (1, "r", "gone.py", 0.2), (2, "r", "src/token/f1.py", None)],
                                "task_id int, repo string, path string, score double")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    want = rows(ranking.explore(ranking._best_files(tasks, files, emb, 1, None)[1], tasks, files, 1.0))

    def fail(*_, **__):
        raise AssertionError("pairs without a similarity were formed")

    monkeypatch.setattr(ranking.impact, "best_pairs", fail)
    assert want and rows(ranking.exploration_probes(tasks, files, emb, 1.0)) == want


def test_threshold_fallbacks(spark):
    layers = spark.createDataFrame([
        ("default", "code", "0.3", "0.05"), ("file", "code", "bad", "0.1"), ("learned", "code/handler", "0.2", None), ("env", "DOC", "0.6", None),
        ("env", "code/handler", "0.9", None), ("file", "nope", "0.1", None), ("file", "_default/x", "0.1", None)],
        "source string, key string, qualify string, tiebreak string")
    merged = {r.key: (r.qualify, r.tiebreak) for r in ranking.merge_thresholds(layers).collect()}
    assert merged == {"code": (0.3, 0.1), "code/handler": (0.2, None), "doc": (0.6, None)}
    df = spark.createDataFrame([("code", "handler"), ("code", "x"), ("test", "")], "kind string, subkind string")
    got = {(r.kind, r.subkind): (r.qualify, r.tiebreak) for r in ranking.resolve_thresholds(df, ranking.merge_thresholds(layers)).collect()}
    assert got == {("code", "handler"): (0.2, 0.1), ("code", "x"): (0.3, 0.1), ("test", ""): (0.3, 0.05)}


# ---- bounds ----------------------------------------------------------------------------------------------------------


def expected_ranking(tasks, files, emb, kinds, k):
    """All pairs of tasks and files, scored one by one in Python."""
    import re

    from trailhead.functions import constants as K

    toks = lambda s: {t for t in (x.lower() for x in re.findall("[A-Za-z0-9]+", s)) if len(t) > 1 and t not in K.STOPWORDS}
    scores = {(r.task_id, r.path): r.score for r in emb.collect()} if emb is not None else None
    corpus = [(f, toks(f.path.rsplit("/", 1)[-1]), toks(f.path), toks(f.content)) for f in files.collect() if f.kind in kinds]
    out = []
    for t in tasks.collect():
        rows = []
        for f, name, path, content in corpus:
            if f.repo != t.repo:
                continue
            nn, np_, nc = (len(toks(t.task) & s) for s in (name, path, content))
            doc = f.kind == "doc"
            h = f.doc_score + 4.0 * np_ + nc if doc else (6.0 * nn + 3.0 * np_ + nc) * (0.5 if f.kind == "config" else 1.0)
            e = None if scores is None else scores.get((t.task_id, f.path), 0.0)
            score = h if e is None else max(0.0, e) + 0.05 * math.tanh(max(0.0, h) / 12.0)
            worthy = np_ > 0 or nc >= 2 or (doc and f.doc_score >= 12) or (not doc and nn > 0)
            if score > 0 and (worthy or (e is not None and e >= 0.3)):
                rows.append((-score, f.path))
        out += [(t.task_id, p, i + 1, round(-s, 9)) for i, (s, p) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def skewed_corpus(spark, n=1500):
    """One word in every file, some in many files, some in few, some in names; two repos."""
    rng = np.random.default_rng(12)
    common = [f"word{i}" for i in range(12)]
    rows = []
    for i in range(n):
        body = ["everywhere", *[w for j, w in enumerate(common) if rng.random() < 0.9 / (j + 1)], f"rare{rng.integers(0, n // 3)}"]
        name = f"rare{i % 97}" if i % 50 == 0 else f"f{i:05d}"
        ending = ("py", "md", "yaml")[i % 3]
        rows.append(("big" if i % 5 else "small", f"{'docs/' if ending == 'md' else 'src/'}d{i % 7}/{name}_{i}.{ending}", " ".join(body)))
    rows += [("big", f"pkg{i}/AGENTS.md", "everywhere word3") for i in range(9)]
    files = paths.classify(spark.createDataFrame(rows, "repo string, path string, content string"))
    asked = ["everywhere rare7", "everywhere word0", "word1 word2 word5 everywhere", "rare3 rare9 rare15 word0", "everywhere", "no such thing", "word0 word1 word2 word3 word4 word5 word6 word7"]
    asked += [f"rare{int(rng.integers(0, n // 3))} everywhere word{int(rng.integers(0, 12))}" for _ in range(33)]
    tasks = spark.createDataFrame([(i, "small" if i % 8 == 7 else "big", a) for i, a in enumerate(asked)], "task_id int, repo string, task string")
    emb = spark.createDataFrame(
        [(int(rng.integers(0, 5)) * 8 + int(rng.integers(0, 7)), "big", rows[int(rng.integers(0, n))][1], float(s)) for s in rng.uniform(-0.2, 0.9, 300)],
        "task_id int, repo string, path string, score double").dropDuplicates(["task_id", "path"])
    return tasks, files, emb


@pytest.mark.parametrize("hybrid", [False, True])
def test_bounded_ranking_equals_all_pairs(spark, monkeypatch, hybrid):
    monkeypatch.setattr(impact, "DIRECT_PAIRS", 0)
    monkeypatch.setattr(impact, "SEED_PAIRS", 16)
    monkeypatch.setattr(impact, "BLOCK_FILES", 16)
    tasks, files, emb = skewed_corpus(spark)
    scores = emb if hybrid else None
    for rank, kinds, k in ((ranking.rank_files, {"code", "config"}, 8), (ranking.rank_documents, {"doc"}, 6)):
        more = {"epsilon": 0.0} if rank is ranking.rank_files else {}
        got = sorted((r.task_id, r.path, r.rank, round(r.score, 9)) for r in rank(tasks, files, scores, **more).collect())
        assert got == expected_ranking(tasks, files, scores, kinds, k)


def test_a_token_of_every_file_forms_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(impact, "DIRECT_PAIRS", 0)
    monkeypatch.setattr(impact, "SEED_PAIRS", 32)
    rows = [("r", f"src/m{i:05d}.py", f"everywhere topic{i % 400}") for i in range(4000)]
    files = paths.classify(spark.createDataFrame(rows, "repo string, path string, content string"))
    tasks = spark.createDataFrame([(i, "r", f"everywhere topic{i}") for i in range(100)], "task_id int, repo string, task string")
    report = {}
    got = {}
    for r in ranking.rank_files(tasks, files, report=report).collect():
        got.setdefault(r.task_id, []).append(r.path)
    assert got == {i: [f"src/m{j:05d}.py" for j in range(i, 4000, 400)][:8] for i in range(100)}
    formed = sum(report.values())
    assert 0 < formed < 0.05 * 100 * 4000, report


def test_vector_scores_of_all_files_form_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = "login token invoice totals retry queue".split()
    files = paths.classify(spark.createDataFrame(
        [("r", f"src/{words[i % 6]}/f{i}.py", f"{words[(i + 1) % 6]} {words[(i * 5) % 6]} code") for i in range(300)], "repo string, path string, content string"))
    tasks = spark.createDataFrame([(i, "r", f"{words[i]} {words[i + 1]}") for i in range(5)], "task_id int, repo string, task string")
    emb = spark.createDataFrame([(t, "r", f"src/{words[i % 6]}/f{i}.py", float(x)) for t in range(5) for i, x in enumerate(rng.uniform(-0.5, 1, 300))],
                                "task_id int, repo string, path string, score double")
    met = []
    best = impact.best_pairs

    def watched(postings, wanted, judge, k, given=None, *args, **more):
        met.append(given.count())
        return best(postings, wanted, judge, k, given, *args, **more)

    monkeypatch.setattr(impact, "best_pairs", watched)
    got = sorted((r.task_id, r.path, r.rank, round(r.score, 9)) for r in ranking.rank_files(tasks, files, emb, epsilon=0.0).collect())
    assert got == expected_ranking(tasks, files, emb, {"code", "config"}, 8)
    assert 5 * 8 <= met[0] < 5 * 60
    # Probes of a ranking are those that all pairs give.
    judged = ranking._best_files(tasks, files, emb, 8, None)[1]
    want = sorted((r.task_id, r.path) for r in ranking.explore(judged, tasks, files, 1.0).collect())
    probes = ranking.rank_files(tasks, files, emb, epsilon=1.0).where("reason like 'Exploration%'").collect()
    assert sorted((r.task_id, r.path) for r in probes) == want and want


def test_embedded_scores_run_one_python_step_at_a_time(spark, sf):
    files = files_of(spark, sf).limit(40)
    scores = queries_rank.embedded_scores(spark, sf, files, view(spark, sf, "v_tasks").limit(3))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InPandas") + plan.count("EvalPython") == 1
    assert scores.count() == 3 * 40


def test_a_kind_is_not_worked_out_for_each_scored_pair(spark, monkeypatch):
    files = paths.classify(spark.createDataFrame([("r", "a/x.py", "retry jitter"), ("r", "b/y.md", "retry jitter"), ("r", "c/z.json", "{}")], "repo string, path string, content string"))
    tasks = spark.createDataFrame([(1, "r", "add retry jitter")], "task_id long, repo string, task string")
    emb = files.select(F.lit(1).cast("long").alias("task_id"), "repo", "path", F.lit(0.5).alias("score")).localCheckpoint()
    plans, stored = {}, ranking.settle

    def keep(df, label="settled"):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(ranking, "settle", keep)
    got = ranking.rank_files(tasks, files, emb, epsilon=0.0)
    assert [(r.path, r.embedding_score) for r in got.orderBy("rank").collect()] == [("a/x.py", 0.5), ("c/z.json", 0.5)]
    assert "CASE WHEN" not in plans["scores"] and "RLIKE" not in plans["scores"]


def test_shared_words_are_counted_by_sets_as_one_by_one(spark):
    facts = ("code", None, 0.0, 0.3, 0.05)
    rows = [("r", "a", *facts, "x", 0, 0, 1), ("r", "a", *facts, "x", 0, 0, 1), ("r", "a", *facts, "x", 1, 1, 0), ("r", "a", *facts, "y", 0, 1, 0),
            ("r", "a", *facts, "z", 0, 0, 1), ("r", "b", *facts, "q", 0, 0, 1)]
    held = spark.createDataFrame(rows, "repo string, path string, kind string, subkind string, doc_score double, qualify double, tiebreak double, "
                                       "token string, n_name int, n_path int, n_content int")
    pairs = impact._by_file(held).withColumn("tokens", F.array(F.lit("x"), F.lit("y"), F.lit("w")))
    got = {r.path: (r.n_name, r.n_path, r.n_content) for r in impact._summed(pairs, ["path"]).collect()}
    assert got == {"a": (1.0, 2.0, 2.0), "b": (0.0, 0.0, 0.0)}
