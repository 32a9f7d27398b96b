import pytest
from pyspark.sql import functions as F

from trailhead.functions import paths
from trailhead.operators import chunking, graph, symbols

FILES = "repo string, path string, content string"


def corpus(spark, **contents):
    return paths.classify(spark.createDataFrame([("r", p, c) for p, c in contents.items()], FILES))


def test_symbols(spark):
    src = "class Outer:\n    class Inner:\n        async def m(self):\n            return 1\n\ndef f():\n    def g():\n        pass\n"
    got = [(r.qualified_name, r.kind, r.start_line, r.end_line) for r in symbols.symbol_spans(corpus(spark, **{"a.py": src, "b.py": "def (", "c.ts": "x"})).collect()]
    assert got == [("Outer", "class", 1, 4), ("Outer.Inner", "class", 2, 4), ("Outer.Inner.m", "async_method", 3, 4), ("f", "function", 6, 8)]


def test_chunks_cover_every_line_and_overlap(spark):
    prose = "\n".join(f"line {i} " + "word " * 20 + ("." if i % 5 == 0 else "") for i in range(200))
    rows = sorted(chunking.chunk_files(corpus(spark, **{"a.md": prose})).collect(), key=lambda r: r.chunk_index)
    assert len(rows) > 5 and rows[0].start_line == 1 and rows[-1].end_line == 200
    for a, b in zip(rows, rows[1:]):
        assert a.start_line < b.start_line <= a.end_line + 1
        assert b.start_line <= a.end_line   # some overlap for lines of this size
    flat = chunking.chunk_files(corpus(spark, **{"a.md": prose}), chunking.ChunkSettings(overlap_tokens=0)).orderBy("chunk_index").collect()
    assert "\n".join(r.text for r in flat) == prose


def test_chunk_boundaries(spark):
    tail = "\n".join(["word " * 100] * 5 + ["short"])
    rows = chunking.chunk_files(corpus(spark, **{"a.md": tail}), chunking.ChunkSettings(overlap_tokens=0)).orderBy("chunk_index").collect()
    assert rows[-1].end_line == 6 and rows[-1].text.endswith("short")   # a tiny tail joins its predecessor
    code = "x = 1\n" * 250 + "def top():\n    return 1\n" + "y = 2\n" * 250
    cut = chunking.chunk_files(corpus(spark, **{"a.py": code}), chunking.ChunkSettings(400, 1200, 0, 40)).orderBy("chunk_index").collect()
    assert cut[0].end_line == 250 and cut[1].text.startswith("def top()")
    assert chunking.chunk_files(corpus(spark, **{"e.md": ""})).count() == 0


def test_python_imports(spark):
    files = corpus(spark, **{
        "pkg/__init__.py": "from . import a\n", "pkg/a.py": "from .b import (\n  x,\n  y,\n)\nimport os.path as p, pkg.c\nfrom pkg import *\n",
        "pkg/sub/d.py": "from ..b import z\nfrom ...far import q\n", "pkg/bad.py": "def (:\nfrom .b import (m, # c\n n)\nimport pkg.a, \n",
    })
    got = {}
    for r in graph.python_imports(files).collect():
        got.setdefault(r.path, set()).add(r.candidate)
    assert got["pkg/__init__.py"] == {"pkg", "pkg.a"}
    assert got["pkg/a.py"] == {"pkg.b", "pkg.b.x", "pkg.b.y", "os.path", "pkg.c", "pkg"}
    assert got["pkg/sub/d.py"] == {"pkg.b", "pkg.b.z", "far", "far.q"}
    assert got["pkg/bad.py"] == {"pkg.b", "pkg.b.m", "pkg.b.n", "pkg.a"}


def test_edges(spark):
    files = corpus(spark, **{
        "pkg/__init__.py": "", "pkg/a.py": "from . import b\nimport pkg.a\n", "pkg/b.py": "", "tests/test_a.py": "from pkg.a import f",
        "web/x.ts": "import {a} from './y';\nimport z from \"./lib\"\nexport * from '../up'\nconst q = require( './w.js' )\n",
        "web/y.tsx": "", "web/lib/index.js": "", "web/w.js": "", "up.ts": "",
    })
    plain = {(r.src, r.dst) for r in graph.dependency_edges(files).collect()}
    assert plain == {("pkg/a.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/b.py"), ("tests/test_a.py", "pkg/a.py"),
                     ("web/x.ts", "web/y.tsx"), ("web/x.ts", "web/lib/index.js"), ("web/x.ts", "web/w.js")}
    assert ("web/x.ts", "up.ts") in {(r.src, r.dst) for r in graph.dependency_edges(files, normalize=True).collect()}


def test_neighbours_and_impact(spark):
    edges = spark.createDataFrame([("r", "a", "n"), ("r", "n", "a"), ("r", "m", "b"), ("r", "k", "m"), ("r", "a", "b")], "repo string, src string, dst string")
    seeds = spark.createDataFrame([(1, "r", "a", 1), (1, "r", "b", 2)], "task_id int, repo string, path string, rank int")
    got = [(r.path, r.score, r.reason) for r in graph.expand_neighbors(edges, seeds).orderBy("rank").collect()]
    assert got == [("m", 4.5, "References `b`"), ("n", 4.5, "References `a`")]
    changed = spark.createDataFrame([("r", "b")], "repo string, path string")
    row = graph.impact(edges, changed).first()
    assert row.direct_callers == ["a", "m"] and row.indirect_callers == ["k", "n"] and row.imports == []
    assert graph.impact_summary(edges, changed).first().unique_callers == 4


def test_related_tests_with_a_root_seed(spark):
    tests = spark.createDataFrame([("r", "tests/test_a.py"), ("r", "x/capital.test.ts")], "repo string, path string")
    seeds = spark.createDataFrame([(1, "r", "a.py", 1), (1, "r", "api/b.py", 2)], "task_id int, repo string, path string, rank int")
    edges = spark.createDataFrame([("r", "x/capital.test.ts", "api/b.py")], "repo string, src string, dst string")
    got = [(r.path, r.score, r.reason) for r in graph.related_tests(tests, seeds, edges).orderBy("rank").collect()]
    assert got == [("x/capital.test.ts", 8.0, "Imports `api/b.py`"),
                   ("tests/test_a.py", 6.0, "Stem matches `a.py`")]


def test_line_facts_of_overlapping_spans_equal_a_search(spark):
    import random

    rng = random.Random(2)
    n = 60
    spans = sorted((a, min(n + 2, a + rng.randint(0, 25)), rng.choice(["a", "a.b", "c"]) + str(i % 4), i) for i, a in enumerate(rng.randint(1, n) for _ in range(40)))
    given = [{"qualified_name": q, "kind": "function", "start_line": a, "end_line": b} for a, b, q, _ in spans]
    body = "\n".join("" if i % 9 == 0 else f"x = {i}" for i in range(n))
    df = spark.createDataFrame([("r", "a.py", "code", body, given), ("r", "b.md", "doc", "One.\n\ntwo", [])],
                               f"repo string, path string, kind string, content string, symbols array<{symbols.SYMBOL}>")
    got = {r.path: r for r in chunking.with_line_facts(df).collect()}
    lines = body.split("\n")
    for i in range(n):
        around = [(a - b, a, q) for a, b, q, _ in spans if a <= i + 1 <= b]
        assert got["a.py"].enclosing[i] == (max(around)[2] if around else None)
        starts = [3 if "." in q else 5 for a, _, q, _ in spans if a == i + 1]
        assert got["a.py"].priorities[i] == max([*starts, 2 if i and lines[i - 1] == "" else 1])
    assert got["b.md"].priorities == [1, 2, 4] and got["b.md"].enclosing == [None] * 3


def test_line_facts_of_a_long_file_cost_its_lines():
    import time

    def cost(n):
        spans = [(10 * i + 1, 10 * i + 9, f"f{i}", 5) for i in range(n // 10)] + [(1, n, "All", 5)]
        start = time.perf_counter()
        before, innermost = chunking.lay_out(spans, n)
        assert before.sum() == n + 4 * (n // 10) and innermost[9] == len(spans) - 1 and innermost[10] == 1
        return time.perf_counter() - start

    cost(1000)
    small, large = min(cost(20_000) for _ in range(5)), min(cost(200_000) for _ in range(3))
    assert large < 25 * small       # ten times the lines and symbols; all lines for each symbol would be a hundred


def test_a_hub_is_spread_over_tasks_and_pieces(spark):
    """One node with 200,000 callers among nodes with five: no partition of the joined or listed rows holds the hub."""
    n = 200_000
    hub = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("caller"), "id").alias("src"), F.lit("hub").alias("dst"))
    rest = spark.range(50_000).select(F.lit("r").alias("repo"), F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("t"), F.col("id") % 10_000).alias("dst"))
    edges = hub.unionByName(rest).unionByName(spark.createDataFrame([("r", "hub", "leaf")], "repo string, src string, dst string"))
    changed = spark.createDataFrame([("r", "hub"), ("r", "leaf"), ("r", "t5")], "repo string, path string")
    pieces = graph.impact_lists(edges, changed, piece_rows=5000)
    rows = pieces.select("changed", "list", "piece", F.size("values").alias("n"), F.get("values", F.lit(0)).alias("first")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.piece):
        got.setdefault((r.changed, r.list), []).append(r)
    assert {k: sum(r.n for r in v) for k, v in got.items()} == {
        ("hub", "direct_callers"): n, ("hub", "imports"): 1, ("leaf", "direct_callers"): 1, ("leaf", "indirect_callers"): n, ("t5", "direct_callers"): 5}
    assert max(r.n for r in rows) <= 5000
    for v in got.values():
        assert [r.piece for r in v] == list(range(1, len(v) + 1)) and [r.first for r in v] == sorted(r.first for r in v)
    direct, second, _ = graph.impact_pairs(edges, changed)
    spread = salted_parts(second)
    assert max(spread) < 10 * sorted(spread)[len(spread) // 2]


def salted_parts(df):
    counts = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return counts or [0]


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_repeated_sides_of_salted_joins_and_node_lists_are_not_sent_through_the_driver(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "d", "b")], "repo string, src string, dst string")
    seeds = spark.createDataFrame([(1, "r", "b", 1)], "task_id long, repo string, path string, rank int")
    near = graph.expand_neighbors(edges, seeds)
    assert sorted((r.path, r.score) for r in near.collect()) == [("a", 4.5), ("c", 4.0), ("d", 4.5)]
    held = graph.impact(edges, seeds.select("repo", "path"))
    assert [(r.direct_callers, r.indirect_callers, r.imports) for r in held.collect()] == [(["a", "d"], [], ["c"])]
    assert broadcasts(near) == 0 and broadcasts(held) == 0


SCRIPTS = {
    "web/x.ts": "import a from './y'\nimport b from '../lib'\nimport c from './y'\nconst d = require('./y.js')\n", "web/y.js": "", "web/y.ts": "import x from './x.ts'",
    "web/y.js.ts": "", "lib.tsx": "", "lib/index.js": "", "web/y/index.js": "import z from '..'", "web/index.ts": "import q from '.'",
}


def test_script_imports_take_the_first_ending_and_send_no_paths_to_all(spark):
    rows = graph.ts_imports(corpus(spark, **SCRIPTS))
    got = sorted((r.src, r.dst) for r in rows.collect())
    assert got == [("web/index.ts", "web/index.ts"), ("web/x.ts", "web/y.js"), ("web/y.ts", "web/x.ts")]
    assert broadcasts(rows) == 0


def test_normalized_script_imports_send_no_paths_to_all(spark):
    rows = graph.ts_imports(corpus(spark, **SCRIPTS), normalize=True)
    got = sorted((r.src, r.dst) for r in rows.collect())
    assert got == [("web/index.ts", "web/index.ts"), ("web/x.ts", "lib/index.js"), ("web/x.ts", "web/y.js"), ("web/y.ts", "web/x.ts"), ("web/y/index.js", "web/index.ts")]
    assert broadcasts(rows) == 0


def test_dependency_edges_send_no_modules_or_sources_to_all(spark):
    files = corpus(spark, **SCRIPTS, **{"pkg/__init__.py": "", "pkg/a.py": "from . import b\n", "pkg/b.py": "import pkg.a, pkg.b", "notes.md": "import pkg.a"})
    rows = graph.dependency_edges(files)
    assert sorted((r.src, r.dst) for r in rows.collect()) == [
        ("pkg/a.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/b.py"), ("pkg/b.py", "pkg/a.py"), ("web/x.ts", "web/y.js"), ("web/y.ts", "web/x.ts")]
    assert broadcasts(rows) == 0


def test_related_tests_send_only_bounded_needles_to_all(spark):
    tests = spark.createDataFrame([("r", "tests/test_a.py"), ("r", "x/api/b.test.ts")], "repo string, path string")
    seeds = spark.createDataFrame([(1, "r", "lib/a.py", 1), (1, "r", "api/b.py", 2)], "task_id int, repo string, path string, rank int")
    edges = spark.createDataFrame([("r", "x/api/b.test.ts", "lib/a.py")], "repo string, src string, dst string")
    rows = graph.related_tests(tests, seeds, edges)
    assert [(r.path, r.score) for r in rows.orderBy("rank").collect()] == [("x/api/b.test.ts", 12.0), ("tests/test_a.py", 5.0)]
    assert broadcasts(rows) <= 1        # the directory names of contains_join, at most MAX_BROADCAST_NEEDLES
