import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from trailhead.functions import globs, paths, scoring, text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_estimate_rounds_half_to_even(spark):
    rows = [("",), (" ",), ("a b c d e",), ("a " * 15,), ("x",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(T.est_tokens("t").alias("n")).collect()]
    assert got == [0, 1, 6, 20, 1]


def test_tokens_are_ascii_without_stopwords(spark):
    assert one(spark, "Étion and the RETRY_jitter x 42", T.tokens("v")) == ["tion", "retry", "jitter", "42"]


def test_lines_break_like_the_source_language(spark):
    text = "a\r\nb\x0bc\x85d e\n\nf\n"
    assert one(spark, text, T.lines("v")) == text.splitlines()
    assert one(spark, text, T.lines_with_ends("v")) == text.splitlines(keepends=True)
    assert one(spark, "", T.lines("v")) == []
    assert one(spark, "\n", T.lines("v")) == [""]


BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))


def test_snippet_cuts_only_texts_that_hold_a_token(spark):
    """As line by line, on texts of all kinds of line ends and blanks; a text without a token is not cut into lines."""
    texts = ["", " ", None, "a", "\u00a0\n\u2003x \u3000\r\nRetry", "one\u2028two retry\x85", "\x1c\x1cfirst\x0bretrying\t", "no\r\rRETRY \u00e9 ", "x" * 400 + "\nretry" * 2,
             " \u200a\n", "\u00c9tat\nK\u212aey retr\ny"]
    words = [["retry"], ["none", "two"], [], None, ["x", "key"]]
    df = spark.createDataFrame([(t, w) for t in texts for w in words], "v string, w array<string>")

    def plain(text, tokens):
        if text is None:
            return None
        bare = [b for b in (x.strip(BLANKS) for x in re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", text)) if b]
        hit = [b for b in bare if any(t in b.lower() for t in tokens or [])]
        return (hit or bare or [None])[0] and (hit or bare)[0][:160]

    assert [r.s for r in df.select(T.snippet("v", "w").alias("s")).collect()] == [plain(t, w) for t in texts for w in words]


def test_snippet_prefers_a_hit_then_the_first_line(spark):
    text = "\n  First line \n second RETRY here\n"
    assert one(spark, text, T.snippet("v", F.array(F.lit("retry")))) == "second RETRY here"
    assert one(spark, text, T.snippet("v", F.array(F.lit("none")))) == "First line"
    assert one(spark, " \n ", T.snippet("v", F.array(F.lit("x")))) is None


@pytest.mark.parametrize("prompt, wanted", [("", False), ("hi", False), ("please Fix it", True), ("suffix", False),
                                            ("éadd", False), ("x" * 41, True), ("x" * 40, False)])
def test_substantive(spark, prompt, wanted):
    assert one(spark, prompt, T.is_substantive("v")) is wanted


def test_kind_and_subkind(spark):
    cases = [
        ("README.md", "", "doc", "readme"), ("AGENTS.md", "", "doc", "agent_contract"), ("docs/adr/1.md", "", "doc", "architecture"),
        ("src/__tests__/a.ts", "", "test", ""), ("src/a.test.ts", "", "test", ""), ("vite.config.ts", "", "config", "build"),
        (".github/x.yml", "", "config", "ci"), (".eslintrc.json", "", "config", "lint"), ("a/b.txt", "", "other", ""),
        ("src/x.py", "# DO NOT EDIT\n", "code", "generated"), ("src/__init__.py", "x", "code", "scaffold"),
        ("src/API/x.py", "", "code", "handler"), ("x.py", "from fastapi import A", "code", "handler"),
        ("x.py", "import click\n", "code", "cli"), ("x.py", "import pydantic\n", "code", "model"), ("x.py", "y = 1", "code", "util"),
        ("x.py", "class Ä:\n  pass", "code", "other"), ("x.py", "", "code", "other"),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "path string, content string")
    got = [(r.kind, r.subkind) for r in paths.classify(rows).collect()]
    assert got == [c[2:] for c in cases]


def test_doc_score_and_stems(spark):
    rows = spark.createDataFrame([("AGENTS.md",), ("docs/x.md",), ("a/b/c/d/x.md",), ("a/architecture.md",)], "p string")
    assert [r.s for r in rows.select(paths.doc_score("p").alias("s")).collect()] == [20.0, 5.0, 2.0, 14.0]
    stems = spark.createDataFrame([("t/test_a.py",), ("b.test.ts",), ("c_spec.ts",), ("Test-D.py",)], "p string")
    assert [r.s for r in stems.select(paths.test_stem("p").alias("s")).collect()] == ["a", "b", "c", "d"]


def test_miss_kind(spark):
    rows = spark.createDataFrame([("a.yaml",), ("x.md",), ("a.spec.ts",), ("my_test.py",), ("api/x.py",), ("plain",)], "p string")
    got = [r.k for r in rows.select(paths.miss_kind("p").alias("k")).collect()]
    assert got == ["config/other", "doc/other", "test", "test", "code/handler", "code/other"]


def test_globs_match_like_the_shell(spark):
    patterns = ["contracts/**", "**/*.contract.md", "src/*.py", "a?c", "[ab]x", "[!ab]x", "a[b", "x+(y).md", "*", "a.b", "[*]x"]
    names = ["contracts/a/b.md", "x.contract.md", "d/x.contract.md", "src/a/b.py", "abc", "a/c", "ax", "cx", "a[b", "x+(y).md", "a.b", "aXb", "*x"]
    pairs = spark.createDataFrame([(n, p) for n in names for p in patterns], "path string, glob string")
    for r in pairs.select("path", "glob", globs.glob_match("path", "glob").alias("hit")).collect():
        assert r.hit == fnmatch.fnmatchcase(r.path, r.glob), (r.path, r.glob)


def test_blend_and_reason(spark):
    df = spark.createDataFrame([(12.0, None), (12.0, 0.5), (0.0, -0.2)], "h double, e double")
    got = [round(r.s, 4) for r in df.select(scoring.blend("h", "e", F.lit(0.05)).alias("s")).collect()]
    assert got == [12.0, 0.5381, 0.0]
    why = spark.createDataFrame([(["a", "b", "c", "d"], 0.5), ([], 0.5), (["a"], None), ([], 0.1)], "o array<string>, e double")
    assert [r.r for r in why.select(T.reason("o", "e", F.lit(0.3), "dflt").alias("r")).collect()] == [
        "Semantic similarity 0.50; tokens: a, b, c", "Semantic similarity 0.50", "Matches task tokens: a", "dflt"]


# ---- scans of long texts ---------------------------------------------------------------------------------------------


def expected_bullets(text):
    import re

    from trailhead.functions import constants as K

    out, current = [], None
    for line in text.splitlines():
        heading = re.match(r"^#{2,4}\s+(.+?)\s*$", line)
        if heading:
            title = heading[1].strip().lower().rstrip(":")
            current = (title, []) if title in K.CONSTRAINT_HEADINGS else None
            out += [current] if current else []
            continue
        bullet = re.match(r"^\s*(?:[-*+]|\d+\.)\s+(.+?)\s*$", line)
        if current is None:
            continue
        if bullet:
            current[1].append(bullet[1].strip())
        elif line[:1] in (" ", "\t") and line.strip() and current[1]:
            current[1][-1] += " " + line.strip()
    return out


def expected_imports(text):
    import re

    from trailhead.functions import constants as K

    out, depth, slash, left = [], 0, False, 0
    for line in text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []:
        delta, ends = line.count("(") - line.count(")"), line.rstrip().endswith("\\")
        if (depth > 0 or slash) and left > 0:
            out.append(line)
            depth, slash, left = depth + delta, ends, left - 1
        elif re.match(r"[ \t]*(?:import|from)[ \t]", line):
            out.append(line.lstrip())
            depth, slash, left = delta, ends, K.MAX_CONTINUATION_LINES
        else:
            depth, slash, left = 0, False, 0
    return "\n".join(out)


def test_bullets_and_imports_equal_a_line_by_line_reading(spark):
    import random

    from trailhead.functions import constants as K
    from trailhead.operators.authority import heading_bullets
    from trailhead.sources.files import import_lines

    rng = random.Random(1)
    title = sorted(K.CONSTRAINT_HEADINGS)[0]
    prose = [f"## {title.title()}:", f"### {title}", "## Other", "# Top", "- one", "* two  ", "  more", "\tmore", "   - nested", "3. third", "", "plain", "#### " + title.upper()]
    code = ["import a", "from b import (", "  x,", ")", "from c import d, \\", "    e", "y = 1", "    import f", "", "(", "importer = 2", "from g import h"]
    texts = ["\n".join(rng.choice(prose) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    sources = ["\n".join(rng.choice(code) for _ in range(rng.randint(0, 700))) for _ in range(60)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", heading_bullets("t").alias("b")).collect()
    assert {r.i: [(s.title, s["items"]) for s in r.b] for r in got} == {i: expected_bullets(t) for i, t in enumerate(texts)}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(sources)], "i int, t string").select("i", import_lines("t").alias("b")).collect()
    assert {r.i: r.b for r in got} == {i: expected_imports(t) for i, t in enumerate(sources)}


def test_long_texts_cost_their_lines(spark):
    import time

    from trailhead.functions import constants as K
    from trailhead.operators.authority import heading_bullets
    from trailhead.sources.files import import_lines

    title = sorted(K.CONSTRAINT_HEADINGS)[0]

    def cost(n, column, text):
        df = spark.createDataFrame([(text(n),)], "t string").select(column("t").alias("c"))
        start = time.perf_counter()
        size = df.first().c
        return time.perf_counter() - start, size

    for column, text, count in (
        (heading_bullets, lambda n: f"## {title}\n" + "- item\n  more\n" * (n // 2), lambda c: 2 * len(c[0]["items"])),
        (import_lines, lambda n: "import a\n" * n, lambda c: len(c.split("\n"))),
    ):
        cost(2000, column, text)
        (small, a), (large, b) = cost(20_000, column, text), cost(100_000, column, text)
        assert (count(a), count(b)) == (20_000, 100_000)
        assert large < 12 * small + 2       # five times the lines
