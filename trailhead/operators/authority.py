"""Authority rules: discovery, constraints, edit scope, validation plans and risk notes, per task and per change set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, globs, paths, text as T
from ..session import settle
from . import glob_automaton
from .contains import contains_join
from .skew import numbered, salted_join, top_k, union_all

_NO_STRINGS = "array<string>"
_AUTH = ["repo", "id", "type", "path", "title", "summary", "text", "authority_level", "tags", "related_ids",
         "applies_to_paths", "ord"]


def _strings(*values: Column) -> Column:
    return F.array(*values) if values else F.array().cast(_NO_STRINGS)


# ---- parsing ---------------------------------------------------------------------------------------------------------


def authority_type(path: Column | str) -> Column:
    """struct(type, level) by path convention, null for ordinary files."""
    out = F.lit(None).cast("struct<type:string,level:int>")
    for name, level, patterns in reversed(K.AUTHORITY_GLOBS):
        hit = F.lit(False)
        for glob in patterns:
            hit = hit | globs.glob_match(path, F.lit(glob))
        out = F.when(hit, F.struct(F.lit(name).alias("type"), F.lit(level).alias("level"))).otherwise(out)
    return out


_FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"


def front_matter(text: Column | str) -> Column:
    """struct(data, body): the leading ``---`` block as key -> struct(scalar, items), and the text after it."""
    text = T.as_col(text)
    block = F.regexp_extract(text, _FRONT, 1)
    value = "struct<scalar:boolean,items:array<string>>"
    start = F.struct(F.create_map().cast(f"map<string,{value}>").alias("data"), F.lit(None).cast("string").alias("key"))

    def put(data, key, scalar, items):
        entry = F.create_map(key, F.struct(scalar.alias("scalar"), items.alias("items")))
        return F.map_concat(F.map_filter(data, lambda k, _: k != key), entry)

    def step(acc, line):
        bare = T.strip(line)
        item = bare.startswith("-") & acc["key"].isNotNull()
        key = T.strip(F.regexp_extract(line, "^([^:]*):", 1))
        rest = T.strip(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
        listed = F.element_at(acc["data"], acc["key"])["items"]
        grown = put(acc["data"], acc["key"], F.lit(False), F.array_append(listed, T.strip(F.substring(bare, F.lit(2), F.length(bare)))))
        return (
            F.when(item, F.struct(grown.alias("data"), acc["key"].alias("key")))
            .when(line.contains(":") & (rest == ""),
                  F.struct(put(acc["data"], key, F.lit(False), _strings()).alias("data"), key.alias("key")))
            .when(line.contains(":"),
                  F.struct(put(acc["data"], key, F.lit(True), _strings(rest)).alias("data"),
                           F.lit(None).cast("string").alias("key")))
            .otherwise(acc)
        )

    kept = F.filter(T.lines(block), lambda ln: T.strip(ln) != "")
    return F.struct(
        F.aggregate(kept, start, step, lambda acc: acc["data"]).alias("data"),
        F.regexp_replace(text, _FRONT, "").alias("body"),
    )


def _listed(front: Column, key: str) -> Column:
    """A front matter value as a list, quotes and blanks taken off."""
    items = F.coalesce(F.element_at(front["data"], key)["items"], _strings())
    present = F.filter(items, lambda v: T.strip(v) != "")
    return F.transform(present, lambda v: F.regexp_replace(T.strip(v), "^[\"']+|[\"']+$", ""))


def heading_bullets(text: Column | str) -> Column:
    """array<struct<title, items>>: the bullets under constraint headings; an indented line continues its bullet.

    Lines are classified once. Headings cut the text into sections and bullets cut those into items, as slices between their positions,
    so every line is read a fixed number of times.
    """
    def classified(line: Column, i: Column) -> Column:
        heading = F.regexp_extract(line, r"(?U)^#{2,4}\s+(.+?)\s*$", 1)
        bullet = F.regexp_extract(line, r"(?U)^\s*(?:[-*+]|\d+\.)\s+(.+?)\s*$", 1)
        return F.struct(
            i.alias("at"), (heading != "").alias("heads"), F.regexp_replace(F.lower(T.strip(heading)), ":+$", "").alias("title"),
            (bullet != "").alias("begins"), (line.rlike("^[ \t]") & (T.strip(line) != "")).alias("continues"),
            F.when(bullet != "", T.strip(bullet)).otherwise(T.strip(line)).alias("text"))

    def between(marks: Column, k: Column, end: Column) -> Column:
        """The position behind the k-th mark's stretch: the next mark, or the end."""
        return F.coalesce(F.get(marks, k + 1)["at"], end)

    def items(rows: Column, first: Column, end: Column) -> Column:
        def item(marks: Column, mark: Column, k: Column) -> Column:
            more = F.slice(rows, mark["at"] - first + 2, between(marks, k, end) - mark["at"] - 1)
            return F.array_join(F.transform(F.concat(F.array(mark), F.filter(more, lambda r: r["continues"])), lambda r: r["text"]), " ")

        return T.let(F.filter(rows, lambda r: r["begins"]), lambda marks: F.transform(marks, lambda mark, k: item(marks, mark, k)))

    def section(rows: Column, heads: Column, head: Column, k: Column) -> Column:
        first, end = head["at"] + 1, between(heads, k, F.size(rows))
        return F.struct(head["title"].alias("title"), F.slice(rows, first + 1, end - first).alias("rows"), first.alias("first"), end.alias("end"))

    def sections(rows: Column) -> Column:
        return T.let(F.filter(rows, lambda r: r["heads"]), lambda heads: F.filter(
            F.transform(heads, lambda head, k: section(rows, heads, head, k)), lambda s: s["title"].isin(K.CONSTRAINT_HEADINGS)))

    found = T.let(F.transform(T.lines(text), classified), sections)
    return F.transform(found, lambda s: F.struct(s["title"].alias("title"), items(s["rows"], s["first"], s["end"]).alias("items")))


def marker_lines(df: DataFrame, pattern: str = K.MARKER_LINE, text: str = "content", words: list[str] | None = None) -> DataFrame:
    """Lines that, without their comment prefix, match ``pattern``: adds line, word (group 1) and body (group 2).

    Where every match holds one of some lower-case ``words``, in any case, lines without them need no patterns.
    """
    numbered = df.select("*", F.posexplode(T.lines(text)).alias("_pos", "_raw"))
    if words:
        low = F.lower("_raw")
        numbered = numbered.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]))
    # As generated columns the bare line and its groups are computed once, however many steps read them.
    bare = numbered.withColumn("_bare", F.explode(F.array(T.strip(F.regexp_replace("_raw", "(?U)" + K.COMMENT_PREFIX, "")))))
    groups = F.struct(F.regexp_extract("_bare", pattern, 1).alias("word"), T.strip(F.regexp_extract("_bare", pattern, 2)).alias("body"))
    hits = bare.where(F.col("_bare").rlike(pattern)).withColumn("_groups", F.explode(F.array(groups)))
    return hits.select(*df.columns, (F.col("_pos") + 1).alias("line"), "_groups.word", "_groups.body")


def markers(files: DataFrame) -> DataFrame:
    """(repo, path, line, kind, body) of inline authority markers."""
    kinds = F.create_map(*[F.lit(x) for word, facts in K.MARKERS.items() for x in (word, facts[0])])
    found = marker_lines(files.select("repo", "path", "content"), words=list(K.MARKERS))
    return found.select("repo", "path", "line", F.element_at(kinds, F.lower("word")).alias("kind"), "body").where("body <> ''")


# ---- records and constraints ------------------------------------------------------------------------------------------


def authority_records(files: DataFrame) -> DataFrame:
    """Whole-file records by convention, and one record per inline marker."""
    typed = files.withColumn("_a", authority_type("path")).where("_a is not null")
    body = F.filter(F.transform(T.lines("content"), T.strip), lambda ln: ln != "")
    first = F.get(body, F.lit(0))
    plain = F.get(F.filter(body, lambda ln: ~ln.startswith("#")), F.lit(0))
    headline = T.strip(F.regexp_replace(first, "^#+", ""))
    name = paths.name("path")
    title = F.when(first.startswith("#"), F.coalesce(F.nullif(headline, F.lit("")), name)).otherwise(
        F.coalesce(F.left(first, F.lit(120)), name))
    ruled = F.col("_a.type").isin("contract", "invariant")
    whole = typed.select(
        "repo", F.concat("_a.type", F.lit(":"), "path").alias("id"), F.col("_a.type").alias("type"), "path",
        title.alias("title"), F.coalesce(F.left(plain, F.lit(240)), name).alias("summary"),
        F.col("content").alias("text"), F.col("_a.level").alias("authority_level"),
        _strings(F.col("_a.type")).alias("tags"), _strings().alias("related_ids"),
        F.when(ruled, _listed(front_matter("content"), "applies_to")).otherwise(_strings()).alias("applies_to_paths"),
        F.struct(F.lit(0).alias("stage"), F.col("path").alias("path"), F.lit(0).alias("line")).alias("ord"),
    )

    def fact(i):
        pairs = [F.lit(x) for facts in K.MARKERS.values() for x in (facts[0], facts[i])]
        return F.element_at(F.create_map(*pairs), F.col("kind"))

    found = markers(files).withColumn("type", fact(1)).withColumn("level", fact(2)).withColumn("prefix", fact(3))
    inline = found.select(
        "repo", F.concat("type", F.lit(":"), "path", F.lit("#L"), F.col("line").cast("string")).alias("id"), "type",
        F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("path"),
        F.concat("prefix", F.lit(": "), F.left("body", F.lit(100))).alias("title"),
        F.left("body", F.lit(240)).alias("summary"), F.col("body").alias("text"), F.col("level").alias("authority_level"),
        _strings(F.col("type"), F.lit("inline")).alias("tags"), _strings().alias("related_ids"),
        _strings(F.col("path")).alias("applies_to_paths"),
        F.struct(F.lit(1).alias("stage"), F.col("path").alias("path"), F.col("line").alias("line")).alias("ord"),
    )
    return whole.unionByName(inline)


def constraints(auth: DataFrame) -> DataFrame:
    """Rules stated by authority records, one per statement; keeps task_id where ``auth`` is ranked per task."""
    carried = [c for c in ("task_id", "rank") if c in auth.columns]
    hard = F.when(F.col("authority_level") == 1, "hard").otherwise("guided")
    inline = auth.where(F.array_contains("tags", "inline")).select(
        *carried, "repo", F.col("id").alias("source_record_id"),
        F.coalesce(F.nullif("text", F.lit("")), F.nullif("summary", F.lit("")), F.col("title")).alias("statement"),
        F.lit("path").alias("scope"), "applies_to_paths", hard.alias("severity"),
        F.filter("related_ids", lambda r: r.startswith("test:")).alias("validation_refs"), "ord", F.lit(0).alias("item"),
    )
    ruled = auth.where(F.col("type").isin("contract", "invariant") & ~F.array_contains("tags", "inline"))
    ruled = ruled.withColumn("_f", front_matter("text"))
    stated = F.flatten(F.transform(heading_bullets(F.col("_f.body")), lambda s: s["items"]))
    fallback = _strings(F.coalesce(F.nullif("summary", F.lit("")), F.col("title")))
    own = _listed(F.col("_f"), "applies_to")
    severity = F.when(F.element_at("_f.data", "severity")["scalar"],
                      F.lower(T.strip(F.get(F.element_at("_f.data", "severity")["items"], F.lit(0)))))
    listed = ruled.select(
        *carried, "repo", F.col("id").alias("source_record_id"),
        F.posexplode(F.when(F.size(stated) > 0, stated).otherwise(fallback)).alias("item", "statement"),
        F.when(F.size(own) > 0, own).otherwise(F.col("applies_to_paths")).alias("applies_to_paths"),
        F.when(severity.isin(K.SEVERITIES), severity).otherwise(hard).alias("severity"),
        F.transform(_listed(F.col("_f"), "validated_by"), lambda p: F.concat(F.lit("test:"), p)).alias("validation_refs"),
        "ord",
    ).withColumn("statement", T.strip("statement")).where("statement <> ''").withColumn(
        "scope", F.when(F.size("applies_to_paths") > 0, "subsystem").otherwise("global"))
    key = F.concat("source_record_id", F.lit("|"), "statement")
    rows = inline.unionByName(listed).withColumn("id", F.concat(F.lit("const:"), F.left(F.sha2(key, 256), F.lit(12))))
    by = [c for c in ("task_id",) if c in auth.columns] + ["repo", "id"]
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("ord", "item")).alias("_c")).select(*by, "_c.*")


# ---- matching --------------------------------------------------------------------------------------------------------


def glob_join(targets: DataFrame, rules: DataFrame, by: list[str] = ("repo",)) -> DataFrame:
    """Pairs of ``targets`` (by…, path) and ``rules`` (by…, glob, …) that match.

    Exact rules are an equi-join on the path. Patterns go through one automaton per key (:mod:`glob_automaton`), so what is compared grows
    with the matches and not with patterns times paths, whatever the patterns begin with.
    """
    by = list(by)
    exact = globs.is_exact("glob")
    same = salted_join(targets, rules.where(exact).withColumn("path", F.col("glob")), [*by, "path"], spread_by=["path"])
    matched = glob_automaton.matches(targets, rules.where(~exact), by)
    columns = [*targets.columns, *[c for c in rules.columns if c not in by]]
    return same.select(*columns).unionByName(matched.select(*columns))


def rank_authority(auth: DataFrame, tasks: DataFrame, k: int = 12) -> DataFrame:
    """Best ``k`` records per task: by level, then by how many task words occur in title, summary or tags, then by path.

    A word is looked up by its rarest part (:func:`contains.contains_join`), so hardly more records than those that hold it are
    compared. Records that hold the same words score alike for every task, so of those only the first ``k`` of the repo meet the tasks.
    Records without any hit fill up from the first ``k`` of the repo.
    """
    haystack = F.lower(F.concat_ws(" ", "title", "summary", F.array_join("tags", " ")))
    task_words = tasks.select(
        "task_id", "repo",
        F.explode(F.array_distinct(F.transform(F.filter(T.words("task"), lambda w: F.length(w) > 2), F.lower))).alias("_word"))
    held = settle(contains_join(
        auth.select("repo", "id", haystack.alias("_hay")), task_words, ["repo"], "_hay", "_word", ["id"]).select("repo", "_word", "id"), "held")
    keys = auth.select("repo", "id", "authority_level", "path")
    alike = _first_alike(held, keys, k)
    hits = task_words.join(held.join(alike, ["repo", "id"], "left_semi"), ["repo", "_word"]).groupBy("task_id", "repo", "id").agg(
        F.count("*").alias("overlap"))
    first = top_k(keys, ["repo"], ["authority_level", "path", "id"], k, "_n")
    padding = first.select("repo", "id").join(tasks.select("task_id", "repo"), "repo").select(
        "task_id", "repo", "id", F.lit(0).cast("long").alias("overlap"))
    candidates = settle(hits.unionByName(padding).groupBy("task_id", "repo", "id").agg(F.max("overlap").alias("overlap")), "candidates")
    best = top_k(candidates.join(keys, ["repo", "id"]), ["task_id"],
                 ["authority_level", F.col("overlap").desc(), "path", "id"], k)
    return settle(best.select("task_id", "repo", "id", "overlap", "rank"), "best").join(auth, ["repo", "id"])


def _first_alike(held: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(repo, id) of the first ``k`` records, by level, path and id, of those that hold the same words. An id that several records bear goes
    by its first one, and holds the words of all.

    Settled, so that Spark knows how few they are.
    """
    place = F.struct("authority_level", "path")
    rows = held.select("repo", "id", "_word", F.lit(None).cast(keys.select(place.alias("_at")).schema["_at"].dataType).alias("_at")).unionByName(
        keys.select("repo", "id", F.lit(None).cast("string").alias("_word"), place.alias("_at")))
    records = rows.groupBy("repo", "id").agg(F.array_sort(F.collect_list("_word")).alias("_words"), F.min("_at").alias("_at"))
    first = top_k(records.where(F.size("_words") > 0), ["repo", "_words"], ["_at", "id"], k, "_n")
    return settle(first.select("repo", "id"), "alike")


def authority_edges(auth: DataFrame, files: DataFrame, tests: DataFrame) -> DataFrame:
    """(repo, edge_kind, source, target): implemented_by and enforced_by from path rules, points_to from cross-references."""
    ruled = auth.where(F.col("type").isin("contract", "invariant"))
    rules = ruled.select("repo", F.col("id").alias("source"), F.explode("applies_to_paths").alias("glob"))
    hits = glob_join(files.select("repo", "path"), rules).select("repo", "source", F.col("path").alias("target")).distinct()
    implemented = hits.select("repo", F.lit("implemented_by").alias("edge_kind"), "source", "target")
    tested = hits.join(tests.select("repo", F.col("path").alias("target")), ["repo", "target"], "left_semi")
    enforced = tested.select("repo", F.lit("enforced_by").alias("edge_kind"), "source", "target")
    by_path = auth.groupBy("repo", F.split_part("path", F.lit(":"), F.lit(1)).alias("_at")).agg(F.max_by("id", "ord").alias("target"))
    refs = auth.where(F.array_contains("tags", "inline") & F.col("title").startswith("See contract:")).select(
        "repo", F.col("id").alias("source"), T.strip("text").alias("_at"))
    points = refs.join(by_path, ["repo", "_at"]).select("repo", F.lit("points_to").alias("edge_kind"), "source", "target")
    return union_all([implemented, enforced, points])


def edge_targets(edges: DataFrame, edge_kind: str, sources: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_kind") == edge_kind).join(sources.select("repo", "source"), ["repo", "source"], "left_semi")


def edge_sources(edges: DataFrame, edge_kind: str, targets: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_kind") == edge_kind).join(targets.select("repo", "target"), ["repo", "target"], "left_semi")


# ---- scope, validation and risk ---------------------------------------------------------------------------------------


def _or_empty(name: str) -> Column:
    return F.coalesce(name, F.array().cast(_NO_STRINGS)).alias(name)


def edit_scope(tasks: DataFrame, ranked: DataFrame, auth: DataFrame, cons: DataFrame, first: int = 6) -> DataFrame:
    """Allowed, related and protected paths per task. All inputs carry task_id and hold a few rows per task."""
    order = F.struct(paths.is_dunder("path").cast("int").alias("d"), F.col("rank").alias("r"))
    listed = ranked.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("path").alias("p")))).alias("l"))
    plain = F.filter("l", lambda x: x["o"]["d"] == 0)
    dunder = F.filter("l", lambda x: x["o"]["d"] == 1)
    names = lambda c: F.transform(c, lambda x: x["p"])
    rest = F.slice(plain, F.lit(first + 1), F.greatest(F.size(plain), F.lit(1)))
    files = listed.select(
        "task_id", F.array_sort(F.array_distinct(names(F.slice(plain, 1, first)))).alias("allowed_paths"),
        F.array_sort(F.array_distinct(names(F.concat(rest, dunder)))).alias("related_paths"),
    )
    hard_files = auth.where("authority_level = 1").select("task_id", F.split_part("path", F.lit(":"), F.lit(1)).alias("p"))
    hard_rules = cons.where("severity = 'hard'")
    guarded = hard_files.unionByName(hard_rules.select("task_id", F.explode("applies_to_paths").alias("p")))
    protected = guarded.groupBy("task_id").agg(F.array_sort(F.collect_set("p")).alias("protected_paths"))
    rules = hard_rules.groupBy("task_id").agg(F.count("*").alias("hard_constraints"))
    out = tasks.select("task_id").join(files, "task_id", "left").join(protected, "task_id", "left").join(rules, "task_id", "left")
    n = F.coalesce("hard_constraints", F.lit(0).cast("long"))
    out = out.select("task_id", _or_empty("allowed_paths"), _or_empty("related_paths"), _or_empty("protected_paths"),
                     n.alias("hard_constraints"))
    lead = F.when(F.size("protected_paths") > 0,
                  F.concat(F.lit("Protected by "), F.col("hard_constraints").cast("string"), F.lit(" hard constraints.")))
    return out.withColumn("rationale", F.concat_ws(" ", lead, F.lit("Allowed paths derived from top-ranked relevant files.")))


def _pytest(tests: Column) -> Column:
    return F.concat(F.lit("pytest -q "), F.array_join(tests, " "))


def validation_plan(tasks: DataFrame, tests: DataFrame, cons: DataFrame) -> DataFrame:
    """Tests, commands, contract checks and invariants per task."""
    refs = cons.select("task_id", F.explode("validation_refs").alias("ref")).where(F.col("ref").startswith("test:"))
    wanted = tests.select("task_id", "path").unionByName(
        refs.select("task_id", F.substring("ref", F.lit(6), F.length("ref")).alias("path")))
    named = wanted.groupBy("task_id").agg(F.array_sort(F.collect_set("path")).alias("tests"))
    order = F.struct(*[c for c in ("rank", "ord", "item") if c in cons.columns])
    ids = cons.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("source_record_id").startswith("contract:"),
                                           F.struct(order.alias("o"), F.col("source_record_id").alias("v"))))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("severity") == "hard",
                                           F.struct(order.alias("o"), F.col("id").alias("v"))))).alias("i"),
    ).select("task_id", F.transform("c", lambda x: x["v"]).alias("contract_checks"),
             F.transform("i", lambda x: x["v"]).alias("invariants_to_verify"))
    out = tasks.select("task_id").join(named, "task_id", "left").join(ids, "task_id", "left").select(
        "task_id", _or_empty("tests"), _or_empty("contract_checks"), _or_empty("invariants_to_verify"))
    runnable = F.exists("tests", lambda t: t.startswith("tests/") | t.endswith(".py"))
    return out.withColumn("commands", F.when(runnable, _strings(_pytest(F.col("tests")))).otherwise(_strings()))


def _constraint_hits(cons: DataFrame, changes: DataFrame) -> DataFrame:
    rules = cons.select("task_id", "id", F.explode("applies_to_paths").alias("glob"))
    return glob_join(changes.select("task_id", "pos", "path"), rules, ["task_id"]).select(
        "task_id", "id", "pos", "path").distinct()


def validate_changes(plan: DataFrame, cons: DataFrame, changes: DataFrame) -> DataFrame:
    """Validation plan for a change set: adds what the constraints on the changed paths ask for. ``changes`` is
    (task_id, pos, path)."""
    matched = cons.join(_constraint_hits(cons, changes).select("task_id", "id").distinct(), ["task_id", "id"], "left_semi")
    refs = matched.select("task_id", F.explode("validation_refs").alias("ref")).where(F.col("ref").startswith("test:"))
    more_tests = refs.groupBy("task_id").agg(F.collect_set(F.substring("ref", F.lit(6), F.length("ref"))).alias("_t"))
    more_ids = matched.groupBy("task_id").agg(
        F.collect_set(F.when(F.col("source_record_id").startswith("contract:"), F.col("source_record_id"))).alias("_c"),
        F.collect_set(F.when(F.col("severity") == "hard", F.col("id"))).alias("_i"),
    )
    out = plan.join(more_tests, "task_id", "left").join(more_ids, "task_id", "left")

    def merged(name, extra):
        return F.array_sort(F.array_union(name, F.coalesce(extra, F.array().cast(_NO_STRINGS))))

    out = out.withColumn("tests", merged("tests", "_t")).withColumn("contract_checks", merged("contract_checks", "_c"))
    out = out.withColumn("invariants_to_verify", merged("invariants_to_verify", "_i")).drop("_t", "_c", "_i")
    has = F.exists("commands", lambda c: c.startswith("pytest"))
    return out.withColumn("commands", F.when((F.size("tests") > 0) & ~has, F.array_append("commands", _pytest(F.col("tests"))))
                          .otherwise(F.col("commands")))


def _first_three(hits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the first three paths as text, with an ellipsis when there are more; counts are combined on the map side."""
    sizes = hits.groupBy(*keys).agg(F.count("*").alias("n"))
    shown = top_k(hits, keys, [order], 3, "_n").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_n"), F.col("path").alias("p")))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["p"]), ", ")
    return shown.join(sizes, keys).select(*keys, F.concat(text, F.when(F.col("n") > 3, "…").otherwise("")).alias("shown"))


def _note(rows: DataFrame, part: int, risk: Column, why: Column, severity: Column, related: Column) -> DataFrame:
    return rows.select("task_id", F.lit(part).alias("part"), risk.alias("risk"), why.alias("why"),
                       severity.alias("severity"), related.alias("related_ids"))


def risk_report(changes: DataFrame, scope: DataFrame, cons: DataFrame, plan: DataFrame, auth: DataFrame) -> DataFrame:
    """Risk notes of each task's change set: protected paths, constraints, missing tests and contract drift."""
    c = changes.select("task_id", "pos", "path")
    guarded = scope.select("task_id", F.posexplode("protected_paths").alias("at", "entry"))
    by_glob = glob_join(c, guarded.withColumn("glob", F.col("entry")), ["task_id"]).select("task_id", "pos", "path", "at", "entry")
    above = c.withColumn("dir", F.explode(F.array_append(globs.ancestors("path"), F.col("path")))).where("dir <> ''")
    by_dir = above.join(guarded.withColumn("dir", F.regexp_replace("entry", "/+$", "")), ["task_id", "dir"]).select(
        "task_id", "pos", "path", "at", "entry")
    touched = by_glob.unionByName(by_dir).groupBy("task_id", "pos", "path").agg(F.min_by("entry", "at").alias("entry"))
    none = F.array().cast(_NO_STRINGS)
    protected = _note(
        touched, 1, F.concat(F.lit("Change touches protected path: "), "path"),
        F.concat(F.lit("Matches edit_scope.protected_paths entry '"), "entry",
                 F.lit("'. Confirm with user or authority before proceeding.")),
        F.lit("hard"), none)
    hit = _first_three(_constraint_hits(cons, changes), ["task_id", "id"], "pos").join(cons, ["task_id", "id"])
    violated = _note(
        hit, 2, F.concat(F.lit("Change intersects constraint "), "id", F.lit(": "), "statement"),
        F.concat(F.lit("Affects "), "shown", F.lit(". Severity: "), "severity", F.lit(".")),
        F.col("severity"), _strings(F.col("id"), F.col("source_record_id")))
    changed_tasks = c.select("task_id").distinct()
    untested = plan.where(F.size("tests") == 0).join(changed_tasks, "task_id", "left_semi")
    missing = _note(
        untested, 3, F.lit("No validation tests identified for this diff."),
        F.lit("validation_plan.tests is empty; add targeted tests or confirm coverage manually."), F.lit("guided"), none)
    contracts = auth.where("type = 'contract'").join(c.select("task_id", "path").distinct(), ["task_id", "path"], "left_anti")
    rules = contracts.select("task_id", "id", F.explode("applies_to_paths").alias("glob"))
    drifted = glob_join(c.select("task_id", "path").distinct(), rules, ["task_id"]).select("task_id", "id", "path").distinct()
    drift = _note(
        _first_three(drifted, ["task_id", "id"], "path"), 4,
        F.concat(F.lit("Possible drift: implementation changed without updating "), "id", F.lit(".")),
        F.concat(F.lit("Files "), "shown", F.lit(" are governed by "), "id", F.lit("; contract file was not touched.")),
        F.lit("advisory"), _strings(F.col("id")))
    return union_all([protected, violated, missing, drift])


def initial_risks(scope: DataFrame, cons: DataFrame) -> DataFrame:
    """Notes that a fresh bundle starts with."""
    guarded = scope.where(F.size("protected_paths") > 0)
    none = F.array().cast(_NO_STRINGS)
    paths_note = _note(
        guarded, 1, F.lit("Repository contains protected paths."),
        F.concat(F.size("protected_paths").cast("string"),
                 F.lit(" path(s) are covered by hard authority; call risk_report before finalizing.")),
        F.lit("guided"), none)
    hard = cons.where("severity = 'hard'").groupBy("task_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    rules_note = _note(
        hard, 2, F.concat(F.col("n").cast("string"), F.lit(" hard constraint(s) in scope.")),
        F.lit("Hard constraints must not be violated; re-read each before editing."), F.lit("hard"), F.col("ids"))
    return paths_note.unionByName(rules_note)


def scope_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths each scope list gained per task."""
    names = ["allowed_paths", "related_paths", "protected_paths"]
    before = old.select("task_id", *[F.col(n).alias(f"_{n}") for n in names])
    both = new.select("task_id", *names).join(before, "task_id", "left")
    empty = F.array().cast(_NO_STRINGS)
    return both.select("task_id", *[
        F.array_sort(F.array_except(n, F.coalesce(f"_{n}", empty))).alias(f"added_{n}") for n in names])


def excerpt(text: Column | str, max_chars: int = 800) -> Column:
    text = T.as_col(text)
    cut = F.concat(T.rstrip(F.left(text, F.lit(max_chars - 1))), F.lit("…"))
    return F.when(F.length(text) <= max_chars, text).otherwise(cut)


# ---- proposals ---------------------------------------------------------------------------------------------------------


def subsystems(files: DataFrame, min_files: int = 3, samples: int = 5) -> DataFrame:
    code = files.where((F.col("kind") == "code") & F.col("path").contains("/")).select(
        "repo", paths.top_dir("path").alias("name"), "path").where(~F.col("name").isin(K.SUBSYSTEM_EXCLUDED))
    sizes = code.groupBy("repo", "name").agg(F.count("*").alias("file_count")).where(F.col("file_count") >= min_files)
    shown = top_k(code, ["repo", "name"], ["path"], samples, "_n").groupBy("repo", "name").agg(
        F.array_sort(F.collect_list("path")).alias("sample_files"))
    return sizes.join(shown, ["repo", "name"])


def contract_candidates(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Code and config files that look like contracts, with the signals seen, code first; all of them, or the first ``cap`` per repo."""
    low = F.lower(paths.name("path"))
    hint = F.lit(False)
    for word in K.SCHEMA_NAME_HINTS:
        hint = hint | low.contains(word)
    signals = F.array_compact(F.array(
        F.when(hint, F.lit("filename_hint")),
        *[F.when(F.col("content").rlike("(?U)" + pattern), F.lit(label)) for label, pattern in K.CONTRACT_SIGNALS],
    ))
    seen = files.where(F.col("kind").isin("code", "config")).select("repo", "path", "kind", signals.alias("signals"))
    order = [F.when(F.col("kind") == "code", 0).otherwise(1), "path"]
    ranked = numbered(seen.where(F.size("signals") > 0), ["repo"], order) if cap is None else top_k(
        seen.where(F.size("signals") > 0), ["repo"], order, cap)
    return ranked.select("repo", "path", "signals", "rank")


def existing_authority(files: DataFrame) -> DataFrame:
    """(repo, area, stem) of authored notes directly under contracts/ and docs/architecture/."""
    area = F.when(F.col("path").rlike(r"^contracts/[^/]+\.md$"), "contract").when(
        F.col("path").rlike(r"^docs/architecture/[^/]+\.md$"), "architecture")
    noted = files.withColumn("area", area).where(F.col("area").isNotNull())
    return noted.where(~paths.name("path").isin("README.md", "example.md")).select("repo", "area", paths.stem("path").alias("stem"))


def suggestions(subs: DataFrame, candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Files worth writing: a note per subsystem and a contract per top directory of candidates, unless present."""
    notes = existing.where("area = 'architecture'").select("repo", F.col("stem").alias("name"))
    arch = subs.join(notes, ["repo", "name"], "left_anti").select(
        "repo", F.concat(F.lit("docs/architecture/"), "name", F.lit(".md")).alias("path"),
        F.concat(F.lit("How the `"), "name", F.lit("/` subsystem is organized and what it owns")).alias("topic"),
        F.concat(F.lit("Detected "), F.col("file_count").cast("string"), F.lit(" code files under `"), "name",
                 F.lit("/`. Capture the boundary, key entry points, and intended consumers so agents working here have "
                       "ground truth.")).alias("rationale"),
        F.lit("architecture").alias("template_hint"))
    taken = existing.where("area = 'contract'").select("repo", F.regexp_replace("stem", "-contract$", "").alias("top"))
    grouped = candidates.withColumn("top", paths.top_dir("path")).join(taken, ["repo", "top"], "left_anti")
    sized = _first_three(grouped.select("repo", "top", "path", "rank"), ["repo", "top"], "rank")
    counted = sized.join(grouped.groupBy("repo", "top").agg(F.count("*").alias("n")), ["repo", "top"])
    contracts = counted.select(
        "repo", F.concat(F.lit("contracts/"), "top", F.lit(".md")).alias("path"),
        F.concat(F.lit("Hard invariants for `"), "top", F.lit("/` (routes, schemas, models)")).alias("topic"),
        F.concat(F.lit("Detected "), F.col("n").cast("string"), F.lit(" contract-bearing file(s): "), "shown",
                 F.lit(". Spell out the invariants these encode so agents cannot silently break them.")).alias("rationale"),
        F.lit("contract").alias("template_hint"))
    return arch.unionByName(contracts)
