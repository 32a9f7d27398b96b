from pyspark.sql import functions as F

from trailhead.functions import paths
from trailhead.operators import authority as A
from trailhead.plans import context
from trailhead.session import settle

FILES = "repo string, path string, content string"
CONTRACT = ("---\napplies_to:\n  - 'src/*.py'\n- web/**\nseverity: Advisory\nvalidated_by: tests/test_c.py\n---\n# Pay\n\nRules of pay.\n\n"
            "## Invariants\n- totals\n  add up\n* second\n\n## Other\n- ignored\n#### Do Not\n1. delete rows\n")


def corpus(spark, **contents):
    return paths.classify(spark.createDataFrame([("r", p, c) for p, c in contents.items()], FILES))


def test_front_matter_and_bullets(spark):
    row = spark.createDataFrame([(CONTRACT,)], "t string").select(A.front_matter("t").alias("f"), A.heading_bullets("t").alias("b")).first()
    assert row.f.data["applies_to"]["items"] == ["'src/*.py'", "web/**"] and row.f.data["severity"]["scalar"]
    assert row.f.body.startswith("# Pay")
    assert [(s.title, list(s["items"])) for s in row.b] == [("invariants", ["totals add up", "second"]), ("do not", ["delete rows"])]
    plain = spark.createDataFrame([("no block",)], "t string").select(A.front_matter("t").alias("f")).first()
    assert plain.f.data == {} and plain.f.body == "no block"


def test_markers(spark):
    text = "# invariant: a\n// DO NOT : b -->\n  * Important:c\n<!-- See contract: x.md -->\nnot CONTRACT: d\n;; CONTRACT:\n-- CONTRACT: e"
    got = [(r.line, r.kind, r.body) for r in A.markers(corpus(spark, **{"a.py": text})).orderBy("line").collect()]
    assert got == [(1, "invariant", "a"), (2, "do_not", "b"), (3, "important", "c"), (4, "see_contract", "x.md"), (7, "contract", "e")]


def test_records_and_constraints(spark):
    files = corpus(spark, **{"contracts/pay.md": CONTRACT, "src/a.py": "# INVARIANT: keep\n", "root.contract.md": "x", "docs/adr/1.md": "\n# Title\nbody"})
    auth = A.authority_records(files)
    rows = {r.id: r for r in auth.collect()}
    assert set(rows) == {"contract:contracts/pay.md", "invariant:src/a.py#L1", "architecture_note:docs/adr/1.md"}
    assert (rows["architecture_note:docs/adr/1.md"].title, rows["architecture_note:docs/adr/1.md"].summary) == ("Title", "body")
    assert rows["contract:contracts/pay.md"].applies_to_paths == ["src/*.py", "web/**"]
    cons = {r.statement: r for r in A.constraints(auth).collect()}
    assert set(cons) == {"totals add up", "second", "delete rows", "keep"}
    assert cons["second"].severity == "advisory" and cons["second"].validation_refs == ["test:tests/test_c.py"]
    assert cons["keep"].severity == "hard" and cons["keep"].scope == "path"


def test_scope_plan_and_risk(spark):
    files = corpus(spark, **{"contracts/pay.md": CONTRACT.replace("Advisory", "hard"), "src/a.py": "pay totals code", "src/__init__.py": "pay totals code"})
    tasks = spark.createDataFrame([(1, "r", "pay totals")], "task_id int, repo string, task string")
    auth, cons = context.rules_for_tasks(tasks, files)
    ranked = spark.createDataFrame([(1, "src/__init__.py", 1), (1, "src/a.py", 2)], "task_id int, path string, rank int")
    scope = A.edit_scope(tasks, ranked, auth, cons)
    row = scope.first()
    assert (row.allowed_paths, row.related_paths) == (["src/a.py"], ["src/__init__.py"])
    assert row.protected_paths == ["contracts/pay.md", "src/*.py", "web/**"] and row.rationale.startswith("Protected by 3 hard")
    plan = A.validation_plan(tasks, spark.createDataFrame([], "task_id int, path string"), cons)
    assert plan.first().commands == ["pytest -q tests/test_c.py"] and plan.first().contract_checks == ["contract:contracts/pay.md"] * 3
    changes = spark.createDataFrame([(1, 0, "src/a.py"), (1, 1, "web/x/y.ts"), (1, 2, "other.md")], "task_id int, pos int, path string")
    notes = A.risk_report(changes, scope, cons, plan, auth).collect()
    assert sorted((n.part, n.severity) for n in notes) == [(1, "hard")] * 2 + [(2, "hard")] * 3 + [(4, "advisory")]
    assert any(n.why == "Affects src/a.py, web/x/y.ts. Severity: hard." for n in notes)
    touched = changes.union(spark.createDataFrame([(1, 3, "contracts/pay.md")], changes.schema))
    assert not [n for n in A.risk_report(touched, scope, cons, plan, auth).collect() if n.part == 4]
    checked = A.validate_changes(plan, cons, changes).first()
    assert checked.contract_checks == ["contract:contracts/pay.md"] and len(checked.invariants_to_verify) == 3


def test_an_inline_contract_always_reports_drift(spark):
    files = corpus(spark, **{"src/a.py": "# CONTRACT: stable output\n"})
    tasks = spark.createDataFrame([(1, "r", "stable output")], "task_id int, repo string, task string")
    auth, cons = context.rules_for_tasks(tasks, files)
    scope = A.edit_scope(tasks, spark.createDataFrame([], "task_id int, path string, rank int"), auth, cons)
    plan = A.validation_plan(tasks, spark.createDataFrame([(1, "tests/t.py")], "task_id int, path string"), cons)
    changes = spark.createDataFrame([(1, 0, "src/a.py")], "task_id int, pos int, path string")
    assert [n.part for n in A.risk_report(changes, scope, cons, plan, auth).orderBy("part").collect()] == [1, 2, 4]


def test_rank_authority_equals_brute_force(spark):
    files = corpus(spark, **{f"src/m{i}.py": f"# {'INVARIANT' if i % 2 else 'IMPORTANT'}: rule {'alpha beta gamma delta'.split()[i % 4]} x{i}\n" for i in range(40)})
    tasks = spark.createDataFrame([(1, "r", "Alpha gam x3 of"), (2, "r", "zz")], "task_id int, repo string, task string")
    auth = A.authority_records(files)
    rows = auth.collect()
    got = {(r.task_id, r["rank"]): r.id for r in A.rank_authority(auth, tasks, 9).collect()}
    for task_id, words in ((1, {"alpha", "gam"}), (2, set())):
        words = {w for w in words if len(w) > 2}
        order = sorted(rows, key=lambda r: (r.authority_level, -sum(w in f"{r.title} {r.summary} {' '.join(r.tags)}".lower() for w in words), r.path))
        assert [got[task_id, i + 1] for i in range(9)] == [r.id for r in order[:9]]


def test_few_of_the_records_that_hold_the_same_words_meet_the_tasks(spark, monkeypatch):
    """Every record holds `rule`, and one of three further words: no task meets more than the first of each kind."""
    seen = {}
    monkeypatch.setattr(A, "settle", lambda df, label="settled": seen.setdefault(label, settle(df, label)))
    files = corpus(spark, **{f"src/m{i:03}.py": f"# {'INVARIANT' if i % 2 else 'IMPORTANT'}: rule {'alpha beta gamma'.split()[i % 3]}\n" for i in range(200)})
    tasks = spark.createDataFrame([(t, "r", f"rule {'alpha beta gamma delta'.split()[t % 4]}") for t in range(8)], "task_id int, repo string, task string")
    auth = A.authority_records(files.unionByName(files.where("path = 'src/m001.py'")))
    got = A.rank_authority(auth, tasks, 4).collect()
    assert seen["candidates"].count() <= 8 * 4 * 4, seen["candidates"].count()
    rows = {r.id: r for r in auth.collect()}
    held = lambda r, task: sum(w in f"{r.title} {r.summary} {' '.join(r.tags)}".lower() for w in task.split()) * (1 + r.path.startswith("src/m001.py"))
    for t in tasks.collect():
        order = sorted(rows.values(), key=lambda r: (r.authority_level, -held(r, t.task), r.path))
        want = [r.id for r in order[:1] if "m001" in r.path] + [r.id for r in order]     # an id that two records bear takes two ranks
        assert {(r["rank"], r.id) for r in got if r.task_id == t.task_id} == {(i + 1, x) for i, x in enumerate(want[:4])}


def test_marker_words_leave_out_no_line(spark):
    lines = ["# Invariant : a", "-- do not: b", "contract: c", "x contract: d", "see CONTRACT: e -->", "important:", "nothing"]
    df = spark.createDataFrame([("\n".join(lines),)], "content string")
    rows = lambda **o: [(r.line, r.word, r.body) for r in A.marker_lines(df, **o).orderBy("line").collect()]
    assert rows() == rows(words=["invariant", "contract", "do not", "important"]) == [
        (1, "Invariant", "a"), (2, "do not", "b"), (3, "contract", "c"), (5, "see CONTRACT", "e")]


def test_bundle_excerpts_and_examples(spark):
    files = corpus(spark, **{"contracts/long.md": "x" * 900, "examples/pay.md": "pay totals example", "src/a.py": "pay totals"})
    tasks = spark.createDataFrame([(1, "r", "pay totals")], "task_id int, repo string, task string")
    edges = spark.createDataFrame([], "repo string, src string, dst string")
    bundle = context.bundles(tasks, files, edges, index_ok=False)
    row = bundle.first()
    assert [e.path for e in row.examples] == ["examples/pay.md"] and row.ranker == "lexical" and len(row.warnings) == 1
    records = context.bundle_authority(bundle).first().records
    assert {len(r.excerpt) for r in records if r.id.startswith("contract:")} == {800}
    full = context.bundle_authority(bundle, full=True).first().records
    assert {len(r.excerpt) for r in full if r.id.startswith("contract:")} == {900}


def test_context_text(spark):
    files = corpus(spark, **{"src/pay.py": "line\npay totals\n"})
    tasks = spark.createDataFrame([(1, "r", "pay totals")], "task_id int, repo string, task string")
    row = context.task_context(tasks, files, spark.createDataFrame([], "repo string, src string, dst string")).first()
    assert row.context_markdown == (
        "## Summary\nIdentified 0 docs, 1 files, 0 tests, and 0 graph neighbors that look relevant to 'pay totals'.\n\n"
        "## Relevant Docs\n- None\n\n## Relevant Files\n- `src/pay.py`: Matches task tokens: pay\n  Snippet: pay totals\n\n"
        "## Related Tests\n- None\n\n## Graph Neighbors\n- None")
    assert row.metrics.output_bytes == len(row.context_markdown)


def test_proposals(spark):
    files = corpus(spark, **{f"svc/m{i}.py": "class A(BaseModel):\n  pass\n" for i in range(4)}, **{"contracts/svc-contract.md": "x", "docs/architecture/x.md": "y"})
    out = A.suggestions(A.subsystems(files), A.contract_candidates(files), A.existing_authority(files))
    assert [(r.path, r.template_hint) for r in out.collect()] == [("docs/architecture/svc.md", "architecture")]
    assert A.contract_candidates(files, cap=2).select(F.array_join("signals", ",").alias("s")).distinct().first().s == "pydantic_model"
