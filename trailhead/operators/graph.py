"""Import graph: extraction, resolution by equi-join, neighbours and change impact."""

from __future__ import annotations

import ast
import posixpath
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K, paths, text as T
from ..session import bound_batches, settle
from .contains import contains_join
from .skew import salted_join, shuffled, top_k, union_all


def _dotted(path: Column) -> Column:
    """Dotted module name of a Python path; a package is named by its directory."""
    segments = F.split(F.regexp_replace(path, r"\.py$", ""), "/")
    return F.array_join(
        F.when(F.element_at(segments, -1) == "__init__", F.slice(segments, 1, F.size(segments) - 1)).otherwise(segments),
        ".",
    )


def module_map(files: DataFrame) -> DataFrame:
    """(repo, module, path) of Python files; of several paths for one module the last in path order counts."""
    python = files.where(F.col("path").endswith(".py")).select("repo", "path", _dotted(F.col("path")).alias("module"))
    return python.groupBy("repo", "module").agg(F.max("path").alias("path"))


# ---- extraction -------------------------------------------------------------------------------------------------------

def _resolved(level: int, dotted: str, folder: str) -> str:
    """Module name of a relative import: ``level`` dots seen from a file in ``folder``. The root is as high as it goes."""
    if not level:
        return dotted
    climbed = posixpath.normpath("/".join(["", folder, *[".."] * (level - 1), *dotted.split(".")]))
    return climbed.strip("/").replace("/", ".")


def _from_tree(tree: ast.AST) -> Iterator[tuple[int, str]]:
    """(level, module) of all that is imported: modules, and names that may be modules."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((0, alias.name) for alias in node.names)
        elif isinstance(node, ast.ImportFrom):
            names = [None, *[a.name for a in node.names if a.name != "*"]]
            yield from ((node.level, ".".join(filter(None, (node.module, name)))) for name in names)


def _import_tokens(text: str) -> Iterator[list[str]]:
    """Tokens of each import statement of text that does not parse; brackets and backslashes are the tokenizer's business."""
    lines = text.splitlines(keepends=True)
    for i, line in enumerate(lines):
        if line.split(None, 1)[:1] not in (["import"], ["from"]):
            continue
        found: list[str] = []
        try:
            for token in tokenize.generate_tokens(iter([line.lstrip(), *lines[i + 1:]]).__next__):
                if token.type in (tokenize.NEWLINE, tokenize.ENDMARKER):
                    break
                if token.type in (tokenize.NAME, tokenize.OP):
                    found.append(token.string)
        except (tokenize.TokenError, SyntaxError):
            pass        # an open bracket: what came before it broke still counts
        yield found


def _from_text(text: str) -> Iterator[tuple[int, str]]:
    for head, *rest in _import_tokens(text):
        where = rest.index("import") if head == "from" and "import" in rest else 0
        if head == "from" and not where:
            continue
        listed = " ".join(t for t in rest[where + (head == "from"):] if t not in "()").split(",")
        items = ["".join(item.split(" as ")[0].split()) for item in listed] if head == "import" else [(item.split() or [""])[0] for item in listed]
        source = "".join(rest[:where])
        module = source.lstrip(".")
        level = len(source) - len(module)
        if head == "from":
            yield level, module
        yield from ((level, ".".join(filter(None, (module, item)))) for item in items if item.replace(".", "_").isidentifier())


def _candidates(path: str, text: str) -> set[str]:
    try:
        found = list(_from_tree(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        found = list(_from_text(text))
    folder = posixpath.dirname(path)     # a module's package, or the package itself
    return {_resolved(level, name, folder) for level, name in found} - {""}


def python_imports(files: DataFrame) -> DataFrame:
    """(repo, path, candidate): every module name a Python file may import. Resolution is a join with the module map."""
    source = F.coalesce(F.nullif(F.col("import_source"), F.lit("")), F.col("content")) if "import_source" in files.columns \
        else F.col("content")
    python = files.where(F.col("path").endswith(".py")).select("repo", "path", source.alias("source"))
    bound_batches(files.sparkSession)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.repo, r.path, c) for r in pdf.itertuples(index=False) for c in _candidates(r.path, r.source or "")]
            yield pd.DataFrame(rows, columns=["repo", "path", "candidate"])

    return python.mapInPandas(extract, "repo string, path string, candidate string")


def ts_specifiers(df: DataFrame, text: str = "content") -> DataFrame:
    """Add ``specifier``: one row per import, export-from or require in ``text``."""
    pattern = F.lit("(?U)" + K.TS_IMPORT)
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("b")
    )
    found = F.transform(pairs, lambda p: F.coalesce(F.nullif(p["a"], F.lit("")), p["b"]))
    return df.withColumn("specifier", F.explode(found)).where("specifier <> ''")


def _resolved_path(path: Column, specifier: Column, normalize: bool) -> Column:
    joined = F.filter(
        F.split(F.concat(F.regexp_extract(path, "^(.*/)[^/]*$", 1), specifier), "/"), lambda p: (p != "") & (p != ".")
    )
    if normalize:
        empty = F.array().cast("array<string>")
        joined = F.aggregate(
            joined, empty,
            lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."),
                                  F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, p)),
        )
    return F.array_join(joined, "/")


def ts_imports(files: DataFrame, normalize: bool = False) -> DataFrame:
    """(repo, src, dst) of relative script imports. ``..`` segments are only collapsed with ``normalize``."""
    scripts = files.where(F.col("path").rlike(r"\.(ts|tsx|js|jsx)$")).select("repo", "path", "content")
    wanted = (
        ts_specifiers(scripts).where(F.col("specifier").startswith("."))
        .select("repo", F.col("path").alias("src"), _resolved_path(F.col("path"), F.col("specifier"), normalize).alias("target"))
    )
    endings = [e for ext in K.CODE_EXTENSIONS for e in (ext, "/index" + ext)]
    # A path says itself under which few targets it is tried, so no target is repeated for each ending.
    tries = F.array(
        F.struct(F.lit(0).alias("attempt"), F.col("path").alias("target")),
        *[F.when(F.col("path").endswith(e), F.struct(F.lit(n).alias("attempt"), F.expr(f"left(path, length(path) - {len(e)})").alias("target")))
          for n, e in enumerate(endings, 1)])
    known = files.select("repo", F.col("path").alias("dst"), F.inline(F.array_compact(tries)))
    return (
        wanted.join(shuffled(known), ["repo", "target"])
        .groupBy("repo", "src", "target").agg(F.min_by("dst", "attempt").alias("dst"))
        .select("repo", "src", "dst").distinct()
    )


def dependency_edges(files: DataFrame, normalize: bool = False) -> DataFrame:
    """Distinct (repo, src, dst) import edges of code and test files, without self-edges."""
    sources = files.where(F.col("kind").isin("code", "test"))
    modules = module_map(files).select("repo", F.col("module").alias("candidate"), F.col("path").alias("dst"))
    python = python_imports(sources).join(shuffled(modules), ["repo", "candidate"]).select("repo", F.col("path").alias("src"), "dst")
    scripts = ts_imports_from(sources, files, normalize)
    return python.unionByName(scripts).where("src <> dst").distinct()


def ts_imports_from(sources: DataFrame, files: DataFrame, normalize: bool = False) -> DataFrame:
    """Script imports of ``sources`` resolved against all ``files``."""
    keep = sources.select("repo", F.col("path").alias("src"))
    return ts_imports(files, normalize).join(shuffled(keep), ["repo", "src"], "left_semi")


# ---- queries on the graph ----------------------------------------------------------------------------------------------


def expand_neighbors(edges: DataFrame, seeds: DataFrame, k: int = 8) -> DataFrame:
    """Files imported by (4.0) or referencing (4.5) a task's seeds, best ``k`` per task.

    ``seeds`` is (task_id, repo, path, rank). A path keeps its best score; of equal ones the first seed counts.
    """
    start = seeds.select("task_id", "repo", F.col("path").alias("seed"), F.col("rank").alias("seed_rank"))
    # A hub has very many edges: those are dealt by their other end, and the few seeds go to each part.
    imported = salted_join(edges.withColumnRenamed("src", "seed"), start, ["repo", "seed"], ["dst"]).select(
        "task_id", "repo", F.col("dst").alias("path"), F.lit(4.0).alias("score"), "seed_rank",
        F.concat(F.lit("Imported by `"), "seed", F.lit("`")).alias("reason"),
    )
    referencing = salted_join(edges.withColumnRenamed("dst", "seed"), start, ["repo", "seed"], ["src"]).select(
        "task_id", "repo", F.col("src").alias("path"), F.lit(4.5).alias("score"), "seed_rank",
        F.concat(F.lit("References `"), "seed", F.lit("`")).alias("reason"),
    )
    best = (
        imported.unionByName(referencing).groupBy("task_id", "repo", "path")
        .agg(F.max(F.struct("score", (-F.col("seed_rank")).alias("order"), "reason")).alias("b"))
        .select("task_id", "repo", "path", "b.score", "b.reason")
    )
    fresh = best.join(shuffled(seeds.select("task_id", "repo", "path")), ["task_id", "repo", "path"], "left_anti")
    return top_k(fresh, ["task_id"], [F.col("score").desc(), "path"], k)


def _capped(pairs: DataFrame, value: str, name: str, cap: int | None) -> DataFrame:
    """Distinct values per changed node, sorted: all, or the first ``cap``, never more than which reach one task."""
    kept = pairs if cap is None else top_k(pairs, ["repo", "changed"], [F.col(value)], cap, "_n")
    return kept.groupBy("repo", "changed").agg(F.array_sort(F.collect_list(value)).alias(name))


def impact_pairs(edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct direct callers, callers of those, and imports of each changed node."""
    e = settle(edges.select("repo", "src", "dst").distinct(), "edges")        # read for both hops and for imports
    start = changed.select("repo", F.col("path").alias("changed")).distinct()
    callers_of = e.withColumnsRenamed({"src": "caller", "dst": "called"})
    # A hub's edges are dealt by their other end, so no task holds all of them; changed nodes and first hops go to each part.
    direct = settle(salted_join(callers_of, start.withColumnRenamed("changed", "called"), ["repo", "called"], ["caller"]).select(
        "repo", F.col("called").alias("changed"), "caller"), "callers")
    hop = direct.withColumnRenamed("caller", "called")
    second = (
        salted_join(callers_of, hop, ["repo", "called"], ["caller"]).select("repo", "changed", "caller")
        .where("caller <> changed").distinct()
        .join(shuffled(direct), ["repo", "changed", "caller"], "left_anti")
    )
    imports = salted_join(e.withColumnRenamed("src", "changed"), start, ["repo", "changed"], ["dst"]).select("repo", "changed", F.col("dst").alias("import"))
    return direct, second, imports


def in_pieces(pairs: DataFrame, keys: list[str], value: str, piece_rows: int = 10_000) -> DataFrame:
    """(keys…, piece, values): the sorted values of each key in numbered pieces of at most ``piece_rows``.

    Rows are sorted by range, so a key with very many values spreads over tasks; only its pieces are numbered in one place.
    """
    ordered = pairs.select(*keys, value).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    runs = ordered.withColumn("_run", F.floor(F.monotonically_increasing_id() / piece_rows)).groupBy(*keys, "_run").agg(
        F.array_sort(F.collect_list(value)).alias("values"))
    return runs.withColumn("piece", F.row_number().over(W.partitionBy(*keys).orderBy("_run"))).select(*keys, "piece", "values")


def impact_lists(edges: DataFrame, changed: DataFrame, piece_rows: int = 10_000) -> DataFrame:
    """(repo, changed, list, piece, values): the lists of :func:`impact` whole, hubs included, in numbered pieces of bounded length."""
    direct, second, imports = impact_pairs(edges, changed)
    named = [(direct, "caller", "direct_callers"), (second, "caller", "indirect_callers"), (imports, "import", "imports")]
    rows = union_all([p.select("repo", "changed", F.lit(n).alias("list"), F.col(v).alias("value")) for p, v, n in named])
    return in_pieces(rows, ["repo", "changed", "list"], "value", piece_rows)


def impact(edges: DataFrame, changed: DataFrame, files: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Per changed node: direct and indirect callers and imports, each sorted and, with ``cap``, cut there.

    Where hubs make whole lists too long for a row, read :func:`impact_lists`, which has them in pieces.
    """
    direct, second, imports = impact_pairs(edges, changed)
    out = changed.select("repo", F.col("path").alias("changed")).distinct()
    for pairs, value, name in ((direct, "caller", "direct_callers"), (second, "caller", "indirect_callers"),
                               (imports, "import", "imports")):
        out = out.join(shuffled(_capped(pairs, value, name, cap)), ["repo", "changed"], "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if files is None:
        return out
    known = files.select("repo", F.col("path").alias("changed"), F.lit(True).alias("in_index")).distinct()
    return out.join(known, ["repo", "changed"], "left").fillna(False, ["in_index"])


def impact_summary(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Per repo: how many nodes changed and how many other nodes call them within two hops."""
    direct, second, _ = impact_pairs(edges, changed)
    start = changed.select("repo", "path").distinct()
    callers = direct.unionByName(second).select("repo", F.col("caller").alias("path")).distinct().join(
        start, ["repo", "path"], "left_anti")
    counts = start.groupBy("repo").agg(F.count("*").alias("changed_count"))
    unique = callers.groupBy("repo").agg(F.count("*").alias("unique_callers"))
    return counts.join(unique, "repo", "left").fillna(0, ["unique_callers"])


def related_tests(tests: DataFrame, seeds: DataFrame, edges: DataFrame, k: int = 6) -> DataFrame:
    """Tests that go with a task's seeds: same stem +5, imports the seed +6, seed's directory name in the test path +1.

    ``seeds`` is (task_id, repo, path, rank). The directory rule is a substring test, joined on the rarest part of the
    name (:func:`contains.contains_join`). A seed at the root names the empty directory, which every test path contains.
    """
    t = settle(tests.select("repo", F.col("path").alias("test")), "tests")       # both are read several times
    s = settle(seeds.select("task_id", "repo", F.col("path").alias("seed"), F.col("rank").alias("seed_rank")), "seeds")
    t_stem = t.withColumn("stem", paths.test_stem("test")).where("stem <> ''")
    s_stem = s.withColumn("stem", paths.test_stem("seed"))
    same = s_stem.join(shuffled(t_stem), ["repo", "stem"]).select(
        "task_id", "repo", "test", F.lit(5.0).alias("score"),
        F.struct("seed_rank", F.lit(0).alias("part"), F.concat(F.lit("Stem matches `"), "seed", F.lit("`")).alias("text")).alias("why"),
    )
    test_edges = edges.join(shuffled(t), (edges.repo == t.repo) & (edges.src == t.test)).select(edges.repo, "test", F.col("dst").alias("seed"))
    imports = s.join(shuffled(test_edges), ["repo", "seed"]).select(
        "task_id", "repo", "test", F.lit(6.0).alias("score"),
        F.struct("seed_rank", F.lit(1).alias("part"), F.concat(F.lit("Imports `"), "seed", F.lit("`")).alias("text")).alias("why"),
    )
    named = s.select("task_id", "repo", paths.parent_name("seed").alias("dir")).groupBy("task_id", "repo", "dir").agg(
        F.count("*").alias("times"))
    near = contains_join(t, named, ["repo"], "test", "dir", ["test"]).select("repo", "dir", "test")
    beside = named.join(shuffled(near), ["repo", "dir"]).select(
        "task_id", "repo", "test", F.col("times").cast("double").alias("score"),
        F.lit(None).cast("struct<seed_rank:int,part:int,text:string>").alias("why"),
    )
    hits = [h.withColumn("why", F.col("why").cast("struct<seed_rank:int,part:int,text:string>")) for h in (same, imports, beside)]
    scored = union_all(hits).groupBy("task_id", "repo", "test").agg(
        F.sum("score").alias("score"), F.array_sort(F.collect_list("why")).alias("why"))
    best = top_k(scored, ["task_id"], [F.col("score").desc(), "test"], k)
    text = F.array_join(F.array_distinct(F.transform("why", lambda w: w["text"])), "; ")
    return best.select(
        "task_id", "repo", F.col("test").alias("path"), "score", "rank",
        F.when(F.size("why") > 0, text).otherwise(F.lit("Likely associated test")).alias("reason"),
    )
