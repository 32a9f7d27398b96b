"""One automaton for many globs, against the shell's own matching."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from trailhead.operators import authority, glob_automaton

PIECES = ["*", "**", "?", "/", "a", "b", ".py", "src", "[ab]", "[!a]", "[", "]x", "é", "-", "(", "+", "\\"]


def drawn(rng, pieces, most=6):
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, most)))


def test_automaton_equals_shell_matching():
    rng = random.Random(3)
    globs = [g for g in (drawn(rng, [p for p in PIECES if "[" not in p]) for _ in range(400))]
    automaton = glob_automaton.GlobSet(globs)
    for _ in range(500):
        path = drawn(rng, ["a", "b", ".py", "src", "/", "é", "-", "(", "+", "\\", "]x", "x"], 8)
        assert [globs[i] for i in automaton.find(path)] == [g for g in globs if fnmatch.fnmatchcase(path, g)], path


def test_automaton_with_little_memory(monkeypatch):
    monkeypatch.setattr(glob_automaton, "MAX_STATES", 3)
    globs = ["*a*b*", "**/*.py", "src/*", "?b", "", "*"]
    automaton = glob_automaton.GlobSet(globs)
    for path in ["aab", "src/x/a.py", "src/", "xb", "", "b/a.py", "ab" * 40]:
        assert [globs[i] for i in automaton.find(path)] == [g for g in globs if fnmatch.fnmatchcase(path, g)], path
        assert len(automaton.places) <= 3


@pytest.mark.parametrize("limits", [{}, {"MAX_BROADCAST_GLOBS": 0}, {"MAX_BROADCAST_GLOBS": 0, "MAX_POSITIONS": 40, "PIECE_PATHS": 30}])
def test_glob_join_equals_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(glob_automaton, name, value)
    rng = random.Random(4)
    paths = [(rng.choice("xyz"), drawn(rng, ["src/", "a", "b", ".py", "docs/", "é"], 5), i) for i in range(200)] + [("x", None, 900)]
    rules = [(rng.choice("xyz"), g, f"rule{i}") for i, g in enumerate(["**/*.py", "*", "src/*", "a", "src/a", "*[ab].py", "[!a]*", "**", "?", "*.p?", "src/**/b", "é*"] * 6)]
    rules += [("x", None, "none"), ("x", "*.py", "once"), ("x", "*.py", "twice")]
    targets = spark.createDataFrame(paths, "repo string, path string, pos int")
    table = spark.createDataFrame(rules, "repo string, glob string, id string")
    got = sorted((r.repo, r.path, r.pos, r.glob, r.id) for r in authority.glob_join(targets, table).collect())
    want = sorted((a, p, i, g, n) for a, p, i in paths for b, g, n in rules if a == b and p is not None and g is not None and fnmatch.fnmatchcase(p, g))
    assert got == want and len(got) > 1000


def test_compared_pairs_grow_with_matches(spark):
    """300 patterns without a directory and 6,000 paths: only matches come out of the automaton, before any check."""
    rules = spark.createDataFrame([("r", f"**/*.kind{i}.md", f"c{i}") for i in range(300)], "repo string, glob string, id string")
    paths = spark.range(6000).select(F.lit("r").alias("repo"), F.concat(F.lit("a/b/f"), "id", F.lit(".kind"), F.col("id") % 1000, F.lit(".md")).alias("path"))
    joined = authority.glob_join(paths, rules)
    assert joined.count() == 6 * 300
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "RLIKE" not in plan.split("Generate")[-1]
    found = [len(glob_automaton.GlobSet([f"**/*.kind{i}.md" for i in range(300)]).find(f"a/b/f{i}.kind{i % 1000}.md")) for i in range(2000)]
    assert sum(found) == 2 * 300


def test_empty_sides(spark):
    targets = spark.createDataFrame([("r", "a.py")], "repo string, path string")
    rules = spark.createDataFrame([("r", "*.py")], "repo string, glob string")
    assert authority.glob_join(targets.limit(0), rules).count() == 0
    assert authority.glob_join(targets, rules.limit(0)).count() == 0
    assert authority.glob_join(targets, rules.withColumn("repo", F.lit("other"))).count() == 0
