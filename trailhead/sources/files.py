"""Source trees as ``files`` frames keyed by (repo, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import constants as K, globs, paths, text as T
from ..operators.skew import salted_join


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


BLOCK_LINES = 256


def import_lines(text: Column | str) -> Column:
    """Import statements of a Python file, bracketed and backslash continuations included.

    A fold over the lines holds the open bracket depth, whether a backslash is pending and how many more lines the running statement
    may take. It goes through blocks of lines: kept lines are gathered in the block and joined at its end, so what a step copies
    stays small in long files.
    """
    def state(depth, slash, left) -> list[Column]:
        return [depth.cast("int").alias("depth"), slash.alias("slash"), left.cast("int").alias("left")]

    def step(acc: Column, line: Column) -> Column:
        running = ((acc["depth"] > 0) | acc["slash"]) & (acc["left"] > 0)
        opens = line.rlike(r"^[ \t]*(?:import|from)[ \t]")
        delta = _count(line, "(") - _count(line, ")")
        slash = T.rstrip(line).endswith("\\")
        kept = F.when(running, line).when(opens, T.lstrip(line))
        return F.struct(
            F.when(kept.isNotNull(), F.array_append(acc["out"], kept)).otherwise(acc["out"]).alias("out"),
            *state(F.when(running, acc["depth"] + delta).when(opens, delta).otherwise(F.lit(0)), F.when(running | opens, slash).otherwise(F.lit(False)),
                   F.when(running, acc["left"] - 1).when(opens, F.lit(K.MAX_CONTINUATION_LINES)).otherwise(F.lit(0))))

    none = F.array().cast("array<string>")

    def block(acc: Column, lines: Column) -> Column:
        begun = F.struct(none.alias("out"), *state(acc["depth"], acc["slash"], acc["left"]))
        return T.let(F.aggregate(lines, begun, step), lambda done: F.struct(
            F.when(F.size(done["out"]) > 0, F.array_append(acc["out"], F.array_join(done["out"], "\n"))).otherwise(acc["out"]).alias("out"),
            *state(done["depth"], done["slash"], done["left"])))

    start = F.struct(none.alias("out"), *state(F.lit(0), F.lit(False), F.lit(0)))
    whole = T.let(T.lines(text), lambda ls: F.transform(
        F.when(F.size(ls) > 0, F.sequence(F.lit(1), F.size(ls), F.lit(BLOCK_LINES))).otherwise(F.array().cast("array<int>")),
        lambda i: F.slice(ls, i, F.lit(BLOCK_LINES))))
    return F.aggregate(whole, start, block, lambda acc: F.array_join(acc["out"], "\n"))


def cut_content(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Cut ``content`` and keep the import lines of longer Python files from the uncut text; without a limit nothing is cut."""
    if max_chars is None:
        return files.withColumn("import_source", F.lit(""))
    long_python = (paths.extension("path") == ".py") & (F.length("content") > max_chars)
    return files.withColumn(
        "import_source", F.when(long_python, import_lines("content")).otherwise(F.lit(""))
    ).withColumn("content", F.left("content", F.lit(max_chars)))


def supported_paths(files: DataFrame, ignored_dirs: list[str] | None = None) -> DataFrame:
    return files.where(paths.is_supported("path", ignored_dirs))


def drop_virtualenvs(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Drop files below a directory that holds ``pyvenv.cfg``; ``markers`` is (repo, dir)."""
    above = files.select("repo", "path", F.explode(globs.ancestors("path")).alias("dir")).where("dir <> ''")
    inside = above.join(markers.select("repo", "dir").distinct(), ["repo", "dir"]).select("repo", "path").distinct()
    return files.join(inside, ["repo", "path"], "left_anti")


def _located(df: DataFrame, root: str) -> DataFrame:
    """Split the file URL into the repo (first directory below ``root``) and the path inside it."""
    rest = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^file:/+", "/")
    rest = F.substring(rest, F.lit(len(root.rstrip("/")) + 2), F.length(rest))
    return df.withColumn("repo", F.split_part(rest, F.lit("/"), F.lit(1))).withColumn(
        "path", F.regexp_replace(rest, "^[^/]*/", "")
    )


def read_files(
    spark: SparkSession, root: str, max_chars: int | None = None, ignored_dirs: list[str] | None = None
) -> DataFrame:
    """Read every supported text file below ``root``/<repo>/ and classify it.

    Texts are whole unless ``max_chars`` is given. Invalid UTF-8 bytes are dropped. Directory names are filtered before any content is decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = supported_paths(_located(raw.load(root).select("content", "_metadata"), root), ignored_dirs)
    decoded = F.col("content").cast("string")
    clean = F.when(F.is_valid_utf8(decoded), decoded).otherwise(
        F.replace(F.make_valid_utf8(decoded), F.lit("\ufffd"), F.lit(""))
    )
    marks = _located(raw.option("pathGlobFilter", "pyvenv.cfg").load(root).select("_metadata"), root)
    marks = marks.select("repo", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).where("dir <> ''")
    files = found.select("repo", "path", clean.alias("content"))
    return paths.classify(cut_content(drop_virtualenvs(files, marks), max_chars))


def dedupe_content(files: DataFrame) -> DataFrame:
    """One row per distinct content: its hash, a representative path and how many paths share it."""
    firsts = (
        files.groupBy(F.sha2("content", 256).alias("content_sha"))
        .agg(F.min(F.struct("repo", "path")).alias("first"), F.count("*").alias("copies"))
        .select("content_sha", F.col("first.repo").alias("repo"), F.col("first.path").alias("path"), "copies")
    )
    # Texts are only fetched for the representatives; they do not travel through the aggregation.
    texts = files.select("repo", "path", "content").withColumn("content_sha", F.sha2("content", 256))
    found = firsts.join(texts, ["repo", "path", "content_sha"]).dropDuplicates(["content_sha"])
    return found.select("content_sha", "content", "repo", "path", "copies")


def reattach_content(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Give per-content results back to every path; widely copied content is spread by salting."""
    keyed = files.select("repo", "path", F.sha2("content", 256).alias("content_sha"))
    return salted_join(keyed, processed, ["content_sha"], spread_by=["repo", "path"])
