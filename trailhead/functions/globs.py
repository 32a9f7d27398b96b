"""Shell globs as anchored regular expressions; ``*`` also crosses ``/`` and case matters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_col


def glob_regex(glob: Column | str) -> Column:
    out = as_col(glob)
    out = F.regexp_replace(out, r"([\\.^$+{}()|&])", r"\\$1")    # && in brackets would be an intersection
    out = F.regexp_replace(out, r"\[(?![!^]?\]?[^\]]*\])", r"\\[")   # an unclosed bracket is a plain character
    out = F.regexp_replace(out, r"(?<!\\)\[!", "[^")
    out = F.regexp_replace(out, r"\*(?![^\[]*\])", ".*")
    out = F.regexp_replace(out, r"\?(?![^\[]*\])", ".")
    return F.concat(F.lit(r"(?s)\A(?:"), out, F.lit(r")\z"))


def glob_match(path: Column | str, glob: Column | str) -> Column:
    return F.regexp_like(as_col(path), glob_regex(glob))


def is_exact(glob: Column | str) -> Column:
    return ~as_col(glob).rlike(r"[*?\[]")


def literal_dir(glob: Column | str) -> Column:
    """Directory that every match lies under: the part before the last ``/`` ahead of the first wildcard, else empty."""
    return F.regexp_extract(F.regexp_extract(as_col(glob), r"^([^*?\[]*)", 1), "^(.*)/[^/]*$", 1)


def ancestors(path: Column | str) -> Column:
    """All directories above a path, plus the empty one."""
    p = F.split(as_col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))
