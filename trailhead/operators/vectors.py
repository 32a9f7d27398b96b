"""Vector retrieval over a ``chunks`` table keyed by (repo, path, chunk_index).

Scores are exact: every query meets every chunk that passes the filters, or a proof that it can't be among its best. Products are computed
in tiles of neighbouring chunks, of at most ``TILE_BYTES`` whatever the batch and the number of queries. A tile's centroid and radius
bound all its scores (q·c + |q| r), so a search leaves out the queries whose k-th score is above the bound. Each task keeps only its
best ``k`` rows per query, so what is shuffled does not grow with the chunk table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K, paths, text as T
from ..session import bound_batches
from .skew import numbered, fits, top_k, union_all

SCORE_DIGITS = 6               # vectors are single precision: further digits are noise
MAX_BROADCAST_QUERIES = 4096   # a block of queries: 16 MB of doubles at 512 dimensions
CELL_ROWS = 50_000             # chunk rows per cell when queries are too many to broadcast
SLAB_ROWS = 8_192              # chunk rows that are laid out as a matrix at a time
TILE_BYTES = 32 << 20          # scores of one tile, with the copies made of them
PAIR_ROWS = 200_000            # (query, chunk) rows handed on at a time where all pairs are asked for

KEY = ["repo", "path", "chunk_index"]
_ENTRY = [*KEY, "kind", "namespace", "record_type"]
_OUT = "query_id long, repo string, path string, chunk_index long, kind string, namespace string, record_type string, score double"


def filter_chunks(
    chunks: DataFrame,
    namespace: str | None = None,
    record_types: list[str] | None = None,
    filters: dict[str, list[str | None]] | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Keep matching entries. Metadata filters are conjunctive; a missing key matches only where ``None`` is listed."""
    if namespace is not None:
        chunks = chunks.where(F.col("namespace") == namespace)
    if record_types:
        chunks = chunks.where(F.col("record_type").isin(record_types))
    if kind in K.KNOWN_KINDS:   # an unknown kind filters nothing
        chunks = chunks.where(F.col("kind") == kind)
    for key, allowed in (filters or {}).items():
        value = F.element_at("metadata", F.lit(key))
        listed = value.isin([v for v in allowed if v is not None])
        chunks = chunks.where(F.when(value.isNull(), F.lit(None in allowed)).otherwise(listed))
    return chunks


class _Asked:
    """A block of queries inside a task."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, repos: np.ndarray):
        self.ids, self.matrix, self.repos = ids, matrix, repos
        self.bound_to_repo = repos != None  # noqa: E711
        self.norms = np.sqrt((matrix * matrix).sum(1))

    def scores(self, block: np.ndarray, repos: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Scores of chunks (rows) and live queries; minus infinity where a query asks for another repo."""
        out = block @ self.matrix[live].T
        np.round(out, SCORE_DIGITS, out=out)
        if self.bound_to_repo[live].any():
            out[(repos[:, None] != self.repos[live][None, :]) & self.bound_to_repo[live][None, :]] = -np.inf
        return out


def _tiles(pdf: pd.DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of at most ``rows`` chunks that lie near each other: those with the same nearest leader."""
    rows = max(1, rows)
    for at in range(0, len(pdf), SLAB_ROWS):
        block = np.stack(pdf["vector"].iloc[at:at + SLAB_ROWS].to_numpy()).astype(np.float64)
        n = len(block)
        if n <= rows:
            yield np.arange(at, at + n), block
            continue
        leaders = block[np.linspace(0, n - 1, -(-n // rows)).astype(int)]
        nearest = np.concatenate([(block[i:i + 1024] @ leaders.T - 0.5 * (leaders * leaders).sum(1)).argmax(1) for i in range(0, n, 1024)])
        order = np.argsort(nearest, kind="stable")
        ends = [*(np.flatnonzero(np.diff(nearest[order])) + 1), n]
        start = 0
        for end in ends:
            for i in range(start, end, rows):
                mine = order[i:min(i + rows, end)]
                yield mine + at, block[mine]
            start = end


class _AllPairs:
    """Hands on the scores of all pairs, tile by tile."""

    def __init__(self, asked: _Asked, tile_bytes: int = TILE_BYTES):
        self.asked, self.tile_rows = asked, min(PAIR_ROWS, tile_bytes // 16) // max(1, len(asked.ids))

    def add(self, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        asked, everything = self.asked, np.arange(len(self.asked.ids))
        entries, repos = pdf[_ENTRY], pdf["repo"].to_numpy()
        for mine, block in _tiles(pdf, self.tile_rows):
            scores = asked.scores(block, repos[mine], everything)
            at, q = np.nonzero(scores > -np.inf)
            out = entries.iloc[mine[at]].reset_index(drop=True)
            out.insert(0, "query_id", asked.ids[q])
            out["score"] = scores[at, q]
            yield out

    def finish(self) -> Iterator[pd.DataFrame]:
        return iter(())


class _PathBest(_AllPairs):
    """The best score of each path of a tile; the rest is a grouping. Rows without a query, repo or path have none."""

    def add(self, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        asked = self.asked
        everything = np.flatnonzero(pd.notna(asked.ids))
        number = pdf.groupby(["repo", "path"], sort=False).ngroup().to_numpy()
        pdf, number = pdf[number >= 0], number[number >= 0]
        entries, repos = pdf[["repo", "path"]], pdf["repo"].to_numpy()
        for mine, block in _tiles(pdf, self.tile_rows):
            mine, scores = mine[order := np.argsort(number[mine], kind="stable")], asked.scores(block, repos[mine], everything)[order]
            starts = np.flatnonzero(np.diff(number[mine], prepend=-1))
            best = np.fmax.reduceat(scores, starts, axis=0)
            at, q = np.nonzero(best > -np.inf)
            out = entries.iloc[mine[starts[at]]].reset_index(drop=True)
            out.insert(0, "query_id", asked.ids[everything[q]])
            out["score"] = best[at, q]
            yield out


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = rows.sort_values(["query_id", "score", *KEY], ascending=[True, False, True, True, True])
    return ordered.groupby("query_id", sort=False).head(k)


class _TopK:
    """The best ``k`` chunks of each query so far; tiles are left out for queries whose k-th score their bound stays below."""

    def __init__(self, asked: _Asked, k: int, floor: float, tile_bytes: int = TILE_BYTES):
        self.asked, self.k, self.floor, self.tile_rows = asked, k, floor, tile_bytes // (32 * max(1, len(asked.ids)))
        self.top = np.empty((0, len(asked.ids)))        # best scores of each query, k at most
        self.kth = np.full(len(asked.ids), -np.inf)
        self.rows: list[pd.DataFrame] = []
        self.held = self.tiles = self.skipped = 0

    def add(self, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        asked, k = self.asked, self.k
        entries, repos = pdf[_ENTRY], pdf["repo"].to_numpy()
        for mine, block in _tiles(pdf, self.tile_rows):
            centre = block.mean(0)
            radius = np.sqrt(((block - centre) ** 2).sum(1).max())
            # Two units of the last digit cover rounding; ties with the k-th score are decided by key, so they stay.
            bound = asked.matrix @ centre + asked.norms * radius + 2 * 10.0 ** -SCORE_DIGITS
            live = np.flatnonzero((bound >= self.kth) & (bound >= self.floor))
            self.tiles += len(asked.ids)
            self.skipped += len(asked.ids) - len(live)
            if not len(live):
                continue
            scores = asked.scores(block, repos[mine], live)
            best = scores if len(mine) <= k else np.partition(scores, len(mine) - k, axis=0)[len(mine) - k:]
            before = self.top
            merged = np.full((len(before) + len(best), len(asked.ids)), -np.inf)
            merged[:len(before)] = before
            merged[len(before):, live] = best
            self.top = merged if len(merged) <= k else np.partition(merged, len(merged) - k, axis=0)[len(merged) - k:]
            if len(self.top) == k:
                self.kth = self.top.min(0)
            at, q = np.nonzero((scores >= self.kth[live]) & (scores >= self.floor) & (scores > -np.inf))
            out = entries.iloc[mine[at]].reset_index(drop=True)
            out.insert(0, "query_id", asked.ids[live[q]])
            out["score"] = scores[at, q]
            self.rows.append(out)
            self.held += len(out)
            if self.held > max(PAIR_ROWS, 2 * k * len(asked.ids)):
                self._settle()
        return iter(())

    def _settle(self) -> None:
        self.rows = [_best(pd.concat(self.rows), self.k)]
        self.held = len(self.rows[0])

    def finish(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            self._settle()
            yield self.rows[0]


class _TileCount(_TopK):
    """How many (query, tile) pairs there were and how many of them the bounds left out."""

    def finish(self) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"tiles": [self.tiles], "skipped": [self.skipped]})


def _unpack(queries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    repos = queries["repo"].astype(object).where(queries["repo"].notna(), None).to_numpy()
    return queries["query_id"].to_numpy(), np.stack(queries["vector"].to_numpy()).astype(np.float64), repos


def _meet(chunks: DataFrame, queries: DataFrame, collector: Callable, shape: str = _OUT) -> DataFrame:
    """Let every chunk meet every query once. ``collector(asked)`` is made for each block of queries in a task; its ``add`` takes batches
    of chunks and its ``finish`` ends the task, both give back frames of ``shape``.

    A query with a ``repo`` meets that repo's chunks only.

    Up to ``MAX_BROADCAST_QUERIES`` queries are broadcast and the chunks stay where they are. Beyond that both sides are
    cut into bounded cells and each pair of cells becomes one group, so neither side is ever whole in one place.
    """
    entries = chunks.select(*_ENTRY, "vector")
    repo = F.col("repo") if "repo" in queries.columns else F.lit(None).cast("string").alias("repo")
    asked = queries.select("query_id", "vector", repo)
    if fits(asked, MAX_BROADCAST_QUERIES):
        rows = asked.toPandas()
        if rows.empty:
            return chunks.sparkSession.createDataFrame([], shape)
        held = chunks.sparkSession.sparkContext.broadcast(_unpack(rows))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gathered = collector(_Asked(*held.value))
            for pdf in batches:
                if not pdf.empty:
                    yield from gathered.add(pdf)
            yield from gathered.finish()

        return entries.mapInPandas(scan, shape)

    cells = -(-entries.count() // CELL_ROWS)
    blocks = -(-asked.count() // MAX_BROADCAST_QUERIES)
    left = entries.withColumn("cell", F.pmod(F.xxhash64(*KEY), F.lit(cells))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))

    def pair(chunk_cell: pd.DataFrame, query_block: pd.DataFrame) -> pd.DataFrame:
        if chunk_cell.empty or query_block.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in shape.split(", ")])
        gathered = collector(_Asked(*_unpack(query_block)))
        return pd.concat([*gathered.add(chunk_cell), *gathered.finish()] or [pd.DataFrame(columns=[c.split()[0] for c in shape.split(", ")])])

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(pair, shape)


def score(chunks: DataFrame, queries: DataFrame, **filters) -> DataFrame:
    """Cosine of every query with every matching chunk (vectors are L2-normalised)."""
    return _meet(filter_chunks(chunks, **filters), queries, _AllPairs)


def search(
    chunks: DataFrame, queries: DataFrame, k: int = 10, min_score: float | None = 0.0, tile_bytes: int = TILE_BYTES, **filters
) -> DataFrame:
    """Best ``k`` matching chunks per query with at least ``min_score``; equal scores order by (repo, path, chunk_index)."""
    floor = -np.inf if min_score is None else float(min_score)
    if k <= 0:
        return score(chunks.limit(0), queries).withColumn("rank", F.lit(1))

    partial = _meet(filter_chunks(chunks, **filters), queries, lambda asked: _TopK(asked, k, floor, tile_bytes))
    return top_k(partial, ["query_id"], [F.col("score").desc(), *KEY], k)


def search_tiles(
    chunks: DataFrame, queries: DataFrame, k: int = 10, min_score: float | None = 0.0, tile_bytes: int = TILE_BYTES, **filters
) -> DataFrame:
    """One row (tiles, skipped): the (query, tile) pairs of such a :func:`search`, and those that bounds left out."""
    floor = -np.inf if min_score is None else float(min_score)
    counts = _meet(filter_chunks(chunks, **filters), queries, lambda asked: _TileCount(asked, k, floor, tile_bytes), "tiles long, skipped long")
    return counts.agg(F.sum("tiles").alias("tiles"), F.sum("skipped").alias("skipped"))


def path_scores(chunks: DataFrame, queries: DataFrame, **filters) -> DataFrame:
    """Best chunk score of each path of a repo for each query."""
    partial = _meet(filter_chunks(chunks, **filters), queries, _PathBest, "query_id long, repo string, path string, score double")
    return partial.groupBy("query_id", "repo", "path").agg(F.max("score").alias("score"))


def semantic_search(
    chunks: DataFrame, files: DataFrame, queries: DataFrame, kind: str | None = None, k: int = 10, snippet_chars: int = 500
) -> DataFrame:
    """Chunk hits with their line range, symbol and the text of those lines."""
    hits = search(chunks, queries, k, min_score=None, kind=kind)
    where = chunks.select(*KEY, "start_line", "end_line", "enclosing_symbol")
    body = files.select("repo", "path", "content")
    found = hits.join(where, KEY).join(body, ["repo", "path"], "left")
    start = F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1)))
    end = F.greatest(start - 1, F.coalesce("end_line", "start_line", F.lit(1)))
    text = F.array_join(F.slice(T.lines_with_ends("content"), start, end - start + 1), "")
    return found.select(
        "query_id", "rank", *KEY, "score", start.alias("start_line"),
        F.coalesce("end_line", "start_line", F.lit(1)).alias("end_line"), "enclosing_symbol",
        F.left(F.coalesce(text, F.lit("")), F.lit(snippet_chars)).alias("snippet"),
    )


# ---- embedding -------------------------------------------------------------------------------------------------------


class HashingProvider:
    """Bundled embedding provider: signed feature hashing of tokens, normalised. Needs no model and is deterministic.

    Any object with ``dimension``, ``model_name`` and ``encode_texts(list[str]) -> (n, dimension) array`` can replace it.
    """

    model_name = "token-hashing-v1"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            for token in re.findall("[a-z0-9]+", text.lower()):
                h = zlib.crc32(token.encode())
                out[row, (h >> 1) % self.dimension] += 1.0 if h & 1 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def embed(df: DataFrame, text_col: str, provider=None, out: str = "vector") -> DataFrame:
    """Add an L2-normalised vector of ``text_col``; the provider travels once per worker."""
    provider = provider or HashingProvider()
    bound_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(provider.encode_texts(texts.fillna("").tolist()), dtype=np.float32)))

    return df.withColumn(out, encode(F.col(text_col)))


# ---- maintenance -----------------------------------------------------------------------------------------------------


def upsert(chunks: DataFrame, updates: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Replace the entries with the same key and add the others."""
    return chunks.join(updates, list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def delete_paths(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone.select("repo", "path"), ["repo", "path"], "left_anti")


def deleted_count(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone.select("repo", "path"), ["repo", "path"], "left_semi").agg(F.count("*").alias("removed"))


def append_chunks(chunks: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """Add rows; a vector of another length fails the job."""
    right = F.size("vector") == dimension
    checked = new.where(F.assert_true(right, F.lit(f"vector is not of dimension {dimension}")).isNull())
    return chunks.unionByName(checked, allowMissingColumns=True)


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Class of each (repo, path, chunk_index): unchanged, changed, new or removed."""
    o = old.select(*KEY, F.col("content_hash").alias("old_hash"))
    n = new.select(*KEY, F.col("content_hash").alias("new_hash"))
    state = (
        F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    )
    return o.join(n, KEY, "full_outer").withColumn("state", state)


def diff_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    states = ["unchanged", "changed", "new", "removed"]
    return diff_chunks(old, new).agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def incremental_index(old: DataFrame, new_chunks: DataFrame, provider=None, text_col: str = "embed_text") -> DataFrame:
    """New chunk table that reuses the vectors of unchanged chunks and embeds only the others."""
    keys = [*KEY, "content_hash"]
    reusable = old.select(*keys, "vector")
    reused = new_chunks.join(reusable, keys)
    fresh = embed(new_chunks.join(reusable, keys, "left_anti"), text_col, provider)
    return reused.unionByName(fresh)


def replace_files(chunks: DataFrame, files: DataFrame, provider=None) -> DataFrame:
    """Cut and embed ``files`` again and put their rows in place of the stored ones."""
    from .chunking import chunk_files

    fresh = embed(chunk_files(files), "embed_text", provider).withColumn("record_type", F.lit("chunk"))
    if "namespace" in chunks.columns:
        fresh = fresh.withColumn("namespace", F.lit("default"))
    kept = delete_paths(chunks, files)
    return kept.unionByName(fresh.select(*[c for c in kept.columns if c in fresh.columns]), allowMissingColumns=True)


def overlay(base: DataFrame, delta_chunks: DataFrame, changed: DataFrame, deleted: DataFrame, cap: int | None = None) -> DataFrame:
    """Base without the changed and deleted files, plus the changed files' chunks.

    With ``cap`` a repo with more touched files keeps its base, to be rebuilt instead.
    """
    touched = union_all([changed.select("repo", "path"), deleted.select("repo", "path")]).distinct()
    if cap is None:
        return base.join(touched, ["repo", "path"], "left_anti").unionByName(delta_chunks, allowMissingColumns=True)
    allowed = touched.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("repo")
    drop = touched.join(allowed, "repo", "left_semi")
    fresh = delta_chunks.join(allowed, "repo", "left_semi")
    return base.join(drop, ["repo", "path"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def classify_delta(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Supported candidate paths: changed where the tree holds them, else deleted."""
    here = files.select("repo", "path", F.lit(True).alias("here")).distinct()
    wanted = candidates.select("repo", "path").distinct().where(paths.is_supported("path"))
    return wanted.join(here, ["repo", "path"], "left").select(
        "repo", "path", F.when(F.col("here"), "changed").otherwise("deleted").alias("state"))


# ---- branches --------------------------------------------------------------------------------------------------------


def advisory_branches(branches: DataFrame, base: str = "main", max_age_days: int = 30, k: int | None = None) -> DataFrame:
    """Open branches worth indexing per repo, newest first: recent, ahead, not merged, one per commit; all, or the first ``k``."""
    open_ones = branches.where(
        (F.col("branch") != base) & ~F.col("branch").endswith("/HEAD") & ~F.col("merged")
        & (F.col("age_days") <= max_age_days) & (F.col("commits_ahead") > 0)
    )
    single = top_k(open_ones, ["repo", "sha"], ["seq"], 1, "_n").drop("_n")
    order = ["age_days", "seq"]
    return numbered(single, ["repo"], order) if k is None else top_k(single, ["repo"], order, k)


def advisory_chunks(chunks: DataFrame, branches: DataFrame, max_files: int | None = None) -> DataFrame:
    """Chunks of the changed files per branch (with ``max_files``, the first in path order), tagged with where they come from.

    ``chunks`` carries (repo, branch, path, …); ``branches`` comes from :func:`advisory_branches`.
    """
    supported = chunks.select("repo", "branch", "path").distinct().where(paths.is_supported("path"))
    kept = supported if max_files is None else top_k(supported, ["repo", "branch"], ["path"], max_files, "_n").drop("_n")
    facts = branches.select("repo", "branch", "commits_ahead", "age_days")
    tags = F.create_map(
        F.lit("branch"), F.col("branch"), F.lit("commits_ahead"), F.col("commits_ahead").cast("string"),
        F.lit("last_commit_age_days"), F.col("age_days").cast("string"), F.lit("merge_status"), F.lit("open"),
    )
    joined = chunks.join(kept, ["repo", "branch", "path"], "left_semi").join(facts, ["repo", "branch"])
    present = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in chunks.columns else None
    return joined.withColumn("namespace", F.lit("advisory")).withColumn(
        "metadata", tags if present is None else F.map_concat(present, tags))


def advisory_search(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Search in-flight work only; its hits never mix with the main results."""
    return search(chunks, queries, k, min_score=None, namespace="advisory")


def freshness(index_state: DataFrame, head_state: DataFrame, cap: int = 200) -> DataFrame:
    """Per repo, whether the stored index still matches the base: no_base, no_index, current, stale or stale_large."""
    i = index_state.select("repo", "built_from", F.col("base_sha").alias("indexed_sha"))
    state = (
        F.when(F.col("base_sha").isNull(), "no_base")
        .when(F.col("built_from").isNull() & F.col("indexed_sha").isNull(), "no_index")
        .when((F.col("built_from") == "origin-main") & (F.col("indexed_sha") == F.col("base_sha")), "current")
        .when(F.col("changed_files") > cap, "stale_large").otherwise("stale")
    )
    return head_state.join(i, "repo", "left").withColumn("status", state)


def namespaces(chunks: DataFrame) -> DataFrame:
    return chunks.select("namespace").distinct()


def record_types(chunks: DataFrame) -> DataFrame:
    return chunks.where("record_type <> ''").select("record_type").distinct()


def get_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_semi")
