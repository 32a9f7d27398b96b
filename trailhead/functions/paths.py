"""Path and file classification as ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import as_col


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def parts(path: Column | str) -> Column:
    return F.filter(F.split(as_col(path), "/"), lambda p: (p != "") & (p != "."))


def name(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), "([^/]*)/*$", 1)


def extension(path: Column | str) -> Column:
    """Lower-case last suffix with its dot; a leading dot is no suffix, nor is a trailing one."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    n = name(path)
    return F.when(extension(path) != "", F.regexp_replace(n, r"\.[^.]+$", "")).otherwise(n)


def parent_name(path: Column | str) -> Column:
    """Name of the directory that holds the file, empty at the root."""
    return F.coalesce(F.get(parts(path), F.size(parts(path)) - 2), F.lit(""))


def is_supported(path: Column | str, ignored_dirs: list[str] | None = None) -> Column:
    ignored = K.IGNORED_DIRS if ignored_dirs is None else ignored_dirs
    return extension(path).isin(K.SUPPORTED_EXTENSIONS) & ~F.arrays_overlap(
        parts(path), F.array(*[F.lit(d) for d in ignored])
    )


def kind(path: Column | str) -> Column:
    path = as_col(path)
    ext, lowered = extension(path), F.lower(path)
    low_parts = parts(lowered)
    is_test = _any([F.array_contains(low_parts, d) for d in K.TEST_DIRS] + [lowered.contains(m) for m in K.TEST_MARKERS])
    return (
        F.when(ext.isin(K.DOC_EXTENSIONS), "doc")
        .when(is_test, "test")
        .when(F.lower(name(path)).contains(".config.") & ext.isin(K.CODE_EXTENSIONS), "config")
        .when(ext.isin(K.CODE_EXTENSIONS), "code")
        .when(ext.isin(K.CONFIG_EXTENSIONS), "config")
        .otherwise("other")
    )


def _in_dirs(low_parts: Column, dirs: list[str]) -> Column:
    return F.arrays_overlap(low_parts, F.array(*[F.lit(d) for d in dirs]))


def _imports(modules: str) -> str:
    return rf"(?imU)^\s*(?:from|import)\s+(?:{modules})\b"


def subkind(kind_col: Column | str, path: Column | str, content: Column | str, head_chars: int | None = None) -> Column:
    """Refinement of code, doc and config files; empty for the other kinds. Texts are read whole unless ``head_chars`` is given."""
    k, path, content = as_col(kind_col), as_col(path), F.coalesce(as_col(content), F.lit(""))
    low_name, low_parts = F.lower(name(path)), parts(F.lower(path))
    head = content if head_chars is None else F.left(content, F.lit(head_chars))
    has_text = content != ""
    code = (
        F.when(head.rlike("(?iU)" + K.GENERATED_MARKER), "generated")
        .when(name(path).isin(K.SCAFFOLD_NAMES), "scaffold")
        .when(_in_dirs(low_parts, K.HANDLER_DIRS), "handler")
        .when(_in_dirs(low_parts, K.MODEL_DIRS), "model")
        .when(_in_dirs(low_parts, K.CLI_DIRS), "cli")
        .when(_in_dirs(low_parts, K.UTIL_DIRS), "util")
        .when(head.rlike(_imports(K.WEB_IMPORTS)), "handler")
        .when(head.rlike(_imports(K.CLI_IMPORTS)), "cli")
        .when(head.rlike(_imports(K.MODEL_IMPORTS)), "model")
        .when(has_text & ~head.rlike("(?mU)" + K.CLASS_DEFINITION), "util")
        .otherwise("other")
    )
    doc = (
        F.when(low_name.isin(K.AGENT_CONTRACT_NAMES), "agent_contract")
        .when(_in_dirs(low_parts, K.ARCHITECTURE_DIRS) | low_name.isin(K.ARCHITECTURE_NAMES), "architecture")
        .when(low_name.startswith("readme."), "readme")
        .otherwise("other")
    )
    config = (
        F.when(low_name.isin(K.BUILD_FILES), "build")
        .when(_in_dirs(low_parts, K.CI_DIRS), "ci")
        .when(
            low_name.isin(K.LINT_FILES) | low_name.startswith(".eslintrc.") | low_name.startswith(".prettierrc."), "lint"
        )
        .otherwise("other")
    )
    return F.when(k == "code", code).when(k == "doc", doc).when(k == "config", config).otherwise("")


def full_kind(kind_col: Column | str, subkind_col: Column | str) -> Column:
    k, s = as_col(kind_col), as_col(subkind_col)
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(k, F.lit("/"), s)).otherwise(k)


def parent_kind(full: Column | str) -> Column:
    return F.split_part(as_col(full), F.lit("/"), F.lit(1))


def miss_kind(path: Column | str) -> Column:
    """Full kind guessed from the path alone, for paths no bundle carried."""
    path = as_col(path)
    ext, file_name = extension(path), name(path)
    k = (
        F.when(ext.isin(K.CONFIG_EXTENSIONS), "config")
        .when(ext.isin(K.DOC_EXTENSIONS), "doc")
        .when(_any([path.contains(m) for m in K.TEST_MARKERS]), "test")
        .when(file_name.contains("test_") | file_name.contains("_test"), "test")
        .otherwise("code")
    )
    return full_kind(k, subkind(k, path, F.lit("")))


def doc_score(path: Column | str) -> Column:
    path = as_col(path)
    p = parts(path)
    depth = F.size(p) - 1
    base = F.lit(K.DOC_PRIORITY_DEFAULT)
    for known, score in K.DOC_PRIORITY.items():
        base = F.when(F.lower(name(path)) == known, F.lit(score)).otherwise(base)
    place = (
        F.when(depth == 0, F.lit(6.0))
        .when(F.lower(F.get(p, F.lit(0))) == "docs", F.lit(3.0))
        .otherwise(F.greatest(F.lit(0.0), F.lit(3.0) - depth))
    )
    bonus = F.when(_any([F.lower(path).contains(w) for w in K.DOC_BONUS_WORDS]), F.lit(2.0)).otherwise(F.lit(0.0))
    return base + place + bonus


def test_stem(path: Column | str) -> Column:
    """Lower-case stem without one of each test prefix and suffix, taken off in order."""
    out = F.lower(stem(path))
    for pattern in ["^test_", "^test-", r"\.test$", r"\.spec$", "_test$", "-test$", "_spec$", "-spec$"]:
        out = F.regexp_replace(out, pattern, "")
    return out


def top_dir(path: Column | str) -> Column:
    return F.split_part(as_col(path), F.lit("/"), F.lit(1))


def is_dunder(path: Column | str) -> Column:
    """Package boilerplate such as ``__init__.py``."""
    return name(path).startswith("__") & name(path).endswith(".py")


def classify(files, path: str = "path", content: str = "content", head_chars: int | None = None):
    """Add ext, kind, subkind and doc_score to a ``files`` frame."""
    return (
        files.withColumn("ext", extension(path))
        .withColumn("kind", kind(path))
        .withColumn("subkind", subkind("kind", path, content, head_chars))
        .withColumn("doc_score", F.when(F.col("kind") == "doc", doc_score(path)).otherwise(F.lit(0.0)))
    )
