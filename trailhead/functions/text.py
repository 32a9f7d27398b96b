"""Text expressions. Each function takes and returns a ``Column``; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K

# Line ends and white space as the data's producers define them, spelled out so that no engine default matters.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ANY_IN_LINE = r"[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
NO_SPACE = r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body reads it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end opens no further line, empty text has no lines."""
    text = as_col(text)
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def lines_with_ends(text: Column | str) -> Column:
    """Lines that keep their ends, so joining them gives the text back."""
    return F.regexp_extract_all(as_col(text), F.lit(f"(?s)(.*?(?:{LINE_BREAK})|.+$)"), F.lit(0))


def lstrip(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), f"^{SPACE}+", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), f"{SPACE}+\\z", "")


def strip(c: Column | str) -> Column:
    return rstrip(lstrip(c))


def words(text: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(as_col(text), f"{SPACE}+"), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    """Lower-case ASCII alphanumeric runs, without stopwords and single characters, in text order."""
    raw = F.transform(F.regexp_extract_all(as_col(text), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(K.STOPWORDS))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def est_tokens(text: Column | str) -> Column:
    """Words times 1.3, rounded half to even, at least 1; 0 for empty text."""
    text = as_col(text)
    scaled = F.bround(F.size(words(text)) * F.lit(1.3)).cast("int")
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), scaled))


def content_hash(text: Column | str) -> Column:
    return F.left(F.sha2(as_col(text), 256), F.lit(16))


def module_of(path: Column | str) -> Column:
    """Parent directory, empty at the root."""
    return F.regexp_replace(F.regexp_extract(as_col(path), "^(.*)/[^/]*$", 1), "/+$", "")


def _header(path: Column, kind: Column, extra: list[Column], body: Column) -> Column:
    module = module_of(path)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("file: "), path),
        F.concat(F.lit("kind: "), kind),
        F.when(module != "", F.concat(F.lit("module: "), module)),
        *extra,
        F.lit(""),
        body,
    )


def enriched_text(path, kind, content, max_chars: int | None = None) -> Column:
    """Text handed to the embedder for a whole file, cut only where ``max_chars`` is given."""
    body = as_col(content) if max_chars is None else F.left(as_col(content), F.lit(max_chars))
    return _header(as_col(path), as_col(kind), [], F.coalesce(body, F.lit("")))


def enriched_chunk_text(path, kind, text, symbol, start_line, end_line) -> Column:
    symbol = as_col(symbol)
    where = F.concat(F.lit("lines: "), as_col(start_line).cast("string"), F.lit("-"), as_col(end_line).cast("string"))
    named = F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit("symbol: "), symbol))
    return _header(as_col(path), as_col(kind), [named, where], as_col(text))


def snippet(content, overlap, max_chars: int = 160) -> Column:
    """First non-blank line holding one of the overlap tokens, else the first non-blank line; null for blank text."""
    text, overlap = as_col(content), as_col(overlap)

    def holds(where: Column) -> Column:
        return let(F.lower(where), lambda low: F.coalesce(F.exists(overlap, lambda t: F.contains(low, t)), F.lit(False)))

    # All line ends are white space, so the first non-blank line begins at the first other character. Only texts that hold a token are cut.
    first = F.nullif(rstrip(F.regexp_extract(text, rf"\A{SPACE}*+({ANY_IN_LINE}+)", 1)), F.lit(""))
    none = F.lit(None).cast("string")
    hit = F.aggregate(lines(text), none, lambda acc, line: F.when(acc.isNotNull(), acc).when(holds(line) & line.rlike(NO_SPACE), line))
    return F.left(F.when(holds(text), F.coalesce(strip(hit), first)).otherwise(first), F.lit(max_chars))


def is_substantive(prompt: Column | str) -> Column:
    text = strip(prompt)
    action = f"(?iU)\\b({'|'.join(K.ACTION_WORDS)})\\b"
    return (F.length(text) > K.SUBSTANTIVE_MIN_CHARS) | text.rlike(action)


def reason(overlap, embedding, threshold, default: str) -> Column:
    """Why a path was ranked. ``embedding`` is null when vector evidence is off."""
    overlap, embedding = as_col(overlap), as_col(embedding)
    shown = F.array_join(F.slice(overlap, 1, 3), ", ")
    similar = F.coalesce(embedding >= as_col(threshold), F.lit(False))
    semantic = F.format_string("Semantic similarity %.2f", embedding)
    return (
        F.when(similar & (F.size(overlap) > 0), F.concat(semantic, F.lit("; tokens: "), shown))
        .when(similar, semantic)
        .when(F.size(overlap) > 0, F.concat(F.lit("Matches task tokens: "), shown))
        .otherwise(F.lit(default))
    )
