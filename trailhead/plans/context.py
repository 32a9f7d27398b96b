"""Task context and ground-truth bundles: the operators composed into one nested row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..operators import authority as A, feedback, graph, ranking
from ..operators.skew import union_all
from ..session import settle

_ITEM = ["rank", "path", "reason", "score", "snippet", "heuristic_score", "embedding_score", "kind", "subkind"]
_ITEM_TYPE = ("array<struct<rank:int,path:string,reason:string,score:double,snippet:string,heuristic_score:double,"
              "embedding_score:double,kind:string,subkind:string>>")


def _shaped(df: DataFrame) -> DataFrame:
    types = {"snippet": "string", "heuristic_score": "double", "embedding_score": "double", "kind": "string", "subkind": "string"}
    for name, kind in types.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0.0) if kind == "double" else F.lit(None).cast("string"))
    return df.select("task_id", "repo", *_ITEM)


def rank_sections(
    tasks: DataFrame, files: DataFrame, edges: DataFrame, emb: DataFrame | None = None, thresholds: DataFrame | None = None,
    epsilon: float = 0.0,
) -> dict[str, DataFrame]:
    """The four ranked lists of every task. Related tests and neighbours start from the ranked files, settled once."""
    ranked = settle(_shaped(ranking.rank_files(tasks, files, emb, thresholds=thresholds, epsilon=epsilon)), "ranked")
    seeds = ranked.select("task_id", "repo", "path", "rank")
    tests = graph.related_tests(files.where(F.col("kind") == "test"), seeds, edges)
    kinds = files.select("repo", "path", "kind", "subkind")
    return {
        "docs": _shaped(ranking.rank_documents(tasks, files, emb, thresholds=thresholds)),
        "files": ranked,
        "tests": _shaped(tests.join(kinds, ["repo", "path"], "left")),
        "neighbors": _shaped(graph.expand_neighbors(edges, seeds)),
    }


def _listed(df: DataFrame, name: str) -> DataFrame:
    """A ranked list as one sorted array per task; at most a handful of rows each."""
    return df.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(*_ITEM))).cast(_ITEM_TYPE).alias(name))


def _section(title: str, items: str) -> Column:
    line = F.transform(items, lambda i: F.concat(
        F.lit("- `"), i["path"], F.lit("`: "), i["reason"],
        F.when(F.coalesce(i["snippet"], F.lit("")) != "", F.concat(F.lit("\n  Snippet: "), i["snippet"])).otherwise("")))
    body = F.when(F.size(items) == 0, F.lit("- None")).otherwise(F.array_join(line, "\n"))
    return F.concat(F.lit(f"## {title}\n"), body)


def context_markdown(ctx: DataFrame) -> DataFrame:
    """Add ``context_markdown``, the lists as text for a prompt."""
    text = F.concat_ws(
        "\n", F.lit("## Summary"), "summary", F.lit(""), _section("Relevant Docs", "docs"), F.lit(""),
        _section("Relevant Files", "files"), F.lit(""), _section("Related Tests", "tests"), F.lit(""),
        _section("Graph Neighbors", "neighbors"))
    return ctx.withColumn("context_markdown", F.trim(text))


def task_context(tasks: DataFrame, files: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """One row per task: the four lists, a summary sentence, the text form and its metrics."""
    return nest_context(tasks, rank_sections(tasks, files, edges, **options))


def nest_context(tasks: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    out = tasks.select("task_id", "repo", "task")
    for name, rows in sections.items():
        out = out.join(_listed(rows, name), "task_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(_ITEM_TYPE)))
    n = {name: F.size(name).cast("string") for name in sections}
    summary = F.concat(
        F.lit("Identified "), n["docs"], F.lit(" docs, "), n["files"], F.lit(" files, "), n["tests"], F.lit(" tests, and "),
        n["neighbors"], F.lit(" graph neighbors that look relevant to '"), "task", F.lit("'."))
    out = context_markdown(out.withColumn("summary", summary))
    return out.withColumn("metrics", F.struct(
        F.size("files").alias("files_selected"), F.size("docs").alias("docs_selected"), F.size("tests").alias("tests_selected"),
        F.size("neighbors").alias("neighbors_selected"), F.octet_length("context_markdown").alias("output_bytes")))


def emitted_events(tasks: DataFrame, sections: dict[str, DataFrame], ranker: str = "lexical") -> DataFrame:
    """The ``bundle_emitted`` log rows of a batch of tasks."""
    parts = [sections[name].withColumn("section", F.lit(i)) for i, name in enumerate(("files", "docs", "tests"))]
    return feedback.bundle_events(union_all(parts), tasks, ranker)


def rules_for_tasks(tasks: DataFrame, files: DataFrame, k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(ranked authority records, their constraints) per task; settled, as every later step reads them."""
    ranked = settle(A.rank_authority(settle(A.authority_records(files), "authority"), tasks, k), "ranked-authority")
    return ranked, settle(A.constraints(ranked), "constraints")


def bundles(
    tasks: DataFrame, files: DataFrame, edges: DataFrame, emb: DataFrame | None = None, index_ok: bool | None = None,
    max_code: int | None = None, summary_chars: int | None = None, **options,
) -> DataFrame:
    """Ground-truth bundle per task: authority, constraints, code, examples, edit scope, validation plan and risks."""
    auth, cons = rules_for_tasks(tasks, files)
    sections = rank_sections(tasks, files, edges, emb, **options)
    scope = A.edit_scope(tasks, sections["files"], auth, cons)
    plan = A.validation_plan(tasks, sections["tests"], cons)
    risks = A.initial_risks(scope, cons)
    order = F.struct("rank", "ord", "item")
    auth_list = auth.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "id", "type", "authority_level", "path", "title", "summary", "text", "tags", "related_ids"))).alias("authority"))
    cons_list = cons.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        order.alias("order"), "id", "statement", "source_record_id", "scope", "applies_to_paths", "severity",
        "validation_refs"))).alias("constraints"))
    risk_list = risks.groupBy("task_id").agg(F.array_sort(F.collect_list(
        F.struct("part", "risk", "why", "severity", "related_ids"))).alias("risk_notes"))
    ctx = nest_context(tasks, sections)
    out = ctx
    for part in (auth_list, cons_list, risk_list,
                 scope.select("task_id", F.struct("allowed_paths", "related_paths", "protected_paths", "rationale").alias("edit_scope")),
                 plan.select("task_id", F.struct("commands", "tests", "contract_checks", "invariants_to_verify").alias("validation_plan"))):
        out = out.join(part, "task_id", "left")
    ranker = F.lit("embeddings" if emb is not None else "lexical")
    degraded = emb is None and index_ok is False
    warning = F.array(F.lit("retrieval fell back to lexical: no usable vector index")) if degraded else F.array().cast("array<string>")
    ref = lambda items: F.transform(items, lambda i: F.struct(i["path"].alias("path"), i["reason"].alias("reason"),
                                                              i["score"].alias("score"), i["snippet"].alias("snippet")))
    return out.select(
        "task_id", "repo", (F.col("task") if summary_chars is None else F.left("task", F.lit(summary_chars))).alias("task_summary"), F.col("task").alias("task_raw"),
        "authority", "constraints", ref(F.col("files") if max_code is None else F.slice("files", 1, max_code)).alias("relevant_code"),
        ref(F.filter("docs", lambda d: d["path"].startswith("examples/"))).alias("examples"),
        "edit_scope", "validation_plan", "risk_notes", ranker.alias("ranker"), warning.alias("warnings"), "metrics")


def bundle_authority(bundle: DataFrame, full: bool = False) -> DataFrame:
    """Authority records and constraints only; record text in full or as an excerpt."""
    shown = F.transform("authority", lambda r: F.struct(
        r["id"].alias("id"), r["type"].alias("type"), r["authority_level"].alias("authority_level"), r["path"].alias("path"),
        r["title"].alias("title"), r["summary"].alias("summary"),
        (r["text"] if full else A.excerpt(r["text"])).alias("excerpt"), r["tags"].alias("tags"), r["related_ids"].alias("related_ids")))
    return bundle.select("task_id", "task_summary", shown.alias("records"), "constraints")


def bundle_scope(bundle: DataFrame) -> DataFrame:
    return bundle.select("task_id", "task_summary", "edit_scope.*")


def refresh(tasks: DataFrame, files: DataFrame, edges: DataFrame, changes: DataFrame, old: DataFrame) -> dict[str, DataFrame]:
    """Scope after a change set: the new scope, what each list gained, and the impact of the changed files."""
    auth, cons = rules_for_tasks(tasks, files)
    ranked = ranking.rank_files(tasks, files)
    scope = A.edit_scope(tasks, ranked, auth, cons)
    return {"scope": scope, "delta": A.scope_delta(old, scope), "impact": graph.impact(edges, changes, files)}
