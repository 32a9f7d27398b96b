"""Versioned vector index tables.

``<path>/chunks/<folder>/bucket=<n>`` holds Parquet files that are written once and never changed; files of one path lie in one bucket, by hash.
``<path>/manifest/version=<n>`` is one small file: per bucket the folder it lies in, with the index's settings. Writing that file is the commit, so an
update is seen whole or not at all, readers keep the version they began with, and a failed update leaves the last version in place. An update
reads and writes the buckets of the paths it touches; the others are taken over by name.

Old versions stay until :func:`vacuum`. Of two writers that begin with the same version the second fails with :class:`IndexConflictError`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from ..operators import vectors

INDEX_VERSION = 2
BUCKETS = 64

_MANIFEST = ("bucket int, folder string, entries long, files long, buckets int, columns string, schema_version int, model_name string, "
             "dimension int, chunk_config string, source_meta string, created_at timestamp")
_SETTINGS = ["buckets", "columns", "schema_version", "model_name", "dimension", "chunk_config", "source_meta"]


class IndexVersionError(RuntimeError):
    """The stored index has another schema version."""


class IndexConflictError(RuntimeError):
    """Another writer has committed a version in between."""


def index_summary(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("entry_count"), F.countDistinct("path").alias("file_count"))


# ---- versions --------------------------------------------------------------------------------------------------------


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{path}/manifest")


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The last committed version; null where there is no index."""
    try:
        return _manifests(spark, path).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list[Row]:
    """One row per bucket of a version, the last one unless given."""
    version = latest_version(spark, path) if version is None else version
    rows = [] if version is None else _manifests(spark, path).where(F.col("version") == version).orderBy("bucket").collect()
    if not rows:
        raise FileNotFoundError(f"no index version {version} at {path}")
    return rows


def _commit(spark: SparkSession, path: str, base: int | None, buckets: dict[int, tuple], settings: dict) -> int:
    if latest_version(spark, path) != base:
        raise IndexConflictError(f"the index at {path} has moved on from version {base}")
    version = 0 if base is None else base + 1
    held = [(b, *buckets.get(b, (None, 0, 0)), *[settings[s] for s in _SETTINGS]) for b in range(settings["buckets"])]
    shape = _MANIFEST.removesuffix(", created_at timestamp")
    table = spark.createDataFrame(held, shape).withColumn("created_at", F.current_timestamp())
    try:
        table.coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise IndexConflictError(f"version {version} of the index at {path} was written by another writer") from e
        raise
    return version


def _keys(columns: list[str]) -> list[str]:
    return [c for c in ("repo", "path") if c in columns]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int) -> dict[int, tuple]:
    """Write rows into a new folder; (folder, entries, files) of each bucket that got any."""
    folder, keys = uuid.uuid4().hex, _keys(rows.columns)
    out = f"{path}/chunks/{folder}"
    # By range, so that a large bucket is spread over several files.
    rows.withColumn("bucket", _bucket(keys, buckets)).repartitionByRange("bucket", *keys).write.partitionBy("bucket").parquet(out)
    shape = StructType.fromJson(json.loads(rows.schema.json())).add("bucket", IntegerType())
    files = F.struct(*keys)
    sizes = rows.sparkSession.read.schema(shape).parquet(out).groupBy("bucket").agg(F.count("*").alias("entries"), F.countDistinct(files).alias("files"))
    return {r.bucket: (folder, r.entries, r.files) for r in sizes.collect()}      # one row a bucket


def _read(spark: SparkSession, path: str, rows: list[Row]) -> DataFrame:
    shape = StructType.fromJson(json.loads(rows[0].columns)) if rows else None
    places = [f"{path}/chunks/{r.folder}/bucket={r.bucket}" for r in rows if r.entries]
    return spark.read.schema(shape).parquet(*places) if places else spark.createDataFrame([], shape)


# ---- the whole index -------------------------------------------------------------------------------------------------


def save_index(chunks: DataFrame, path: str, model_name: str, dimension: int, chunk_config: dict | None = None,
               source_meta: dict | None = None, version: int = INDEX_VERSION, buckets: int = BUCKETS) -> int:
    """Write a table of chunks as the index's next version, which it returns. ``version`` is the schema version. ``chunks`` may come from the same index."""
    spark = chunks.sparkSession
    base = latest_version(spark, path)
    settings = {
        "buckets": buckets, "columns": chunks.schema.json(), "schema_version": version, "model_name": model_name, "dimension": dimension,
        "chunk_config": json.dumps(chunk_config or {}, sort_keys=True), "source_meta": json.dumps(source_meta or {}, sort_keys=True)}
    return _commit(spark, path, base, _write(chunks, path, buckets), settings)


def load_meta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row: settings, entry_count, file_count, version and created_at."""
    version = latest_version(spark, path) if version is None else version
    facts = ["schema_version", "model_name", "dimension", "chunk_config", "source_meta", "created_at", "version"]
    return _manifests(spark, path).where(F.col("version") == version).groupBy(*facts).agg(
        F.sum("entries").alias("entry_count"), F.sum("files").alias("file_count"))


def load_index(spark: SparkSession, path: str, expect_version: int = INDEX_VERSION, version: int | None = None) -> DataFrame:
    """Chunks of a stored index, of its last version unless given; refuses one written with another schema version."""
    rows = manifest(spark, path, version)
    if rows[0].schema_version != expect_version:
        raise IndexVersionError(f"index at {path} has schema version {rows[0].schema_version}, expected {expect_version}")
    return _read(spark, path, rows)


def compatible(meta: DataFrame, model_name: str, chunk_config: dict) -> DataFrame:
    """Whether stored vectors may be reused: same model and the same, recorded, chunk settings."""
    wanted = json.dumps(chunk_config, sort_keys=True)
    return meta.select(
        ((F.col("model_name") == model_name) & (F.col("chunk_config") != "{}") & (F.col("chunk_config") == wanted))
        .alias("compatible")
    )


# ---- updates ---------------------------------------------------------------------------------------------------------


def update_index(spark: SparkSession, path: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Commit a version in which the buckets of the ``touched`` (repo, path) rows hold ``change`` of what they held.

    ``change`` must leave other paths' rows as they are and may add rows of touched paths only.
    """
    rows = manifest(spark, path)
    settings = {s: rows[0][s] for s in _SETTINGS}
    shape = StructType.fromJson(json.loads(settings["columns"]))
    keys = _keys(shape.names)
    hit = {r.b for r in touched.select(_bucket(keys, settings["buckets"]).alias("b")).distinct().collect()}       # a number of buckets
    held = {r.bucket: (r.folder, r.entries, r.files) for r in rows if r.entries}
    if not hit:
        return rows[0].version
    changed = change(_read(spark, path, [r for r in rows if r.bucket in hit]))
    written = _write(changed.select(*[F.col(f.name).cast(f.dataType) for f in shape]), path, settings["buckets"])
    if strange := sorted(set(written) - hit):
        raise ValueError(f"the change added rows of paths that were not named as touched (buckets {strange[:5]})")
    kept = {b: v for b, v in held.items() if b not in hit}
    return _commit(spark, path, rows[0].version, kept | written, settings)


def upsert_index(spark: SparkSession, path: str, updates: DataFrame) -> int:
    """Replace the entries with the same key and add the others."""
    return update_index(spark, path, updates, lambda part: vectors.upsert(part, updates))


def delete_from_index(spark: SparkSession, path: str, gone: DataFrame) -> int:
    """Remove all entries of (repo, path) rows."""
    return update_index(spark, path, gone, lambda part: vectors.delete_paths(part, gone))


def replace_in_index(spark: SparkSession, path: str, files: DataFrame, **options) -> int:
    """Chunk and embed the given files anew and put them in place of their old entries; see :func:`vectors.replace_files`."""
    return update_index(spark, path, files, lambda part: vectors.replace_files(part, files, **options))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions and the folders that none of those refers to; returns the folders' names.

    Folders of updates that failed or are still being written count as unreferenced: run it when no writer is active.
    """
    table = _manifests(spark, path).select("version", "folder").distinct().collect()
    kept = sorted({r.version for r in table})[-keep:]
    needed = {r.folder for r in table if r.version in kept}
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{path}/chunks")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [hadoop.Path(f"{path}/manifest/version={v}") for v in sorted({r.version for r in table} - set(kept))]
    loose = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName() not in needed) if fs.exists(root) else []
    for place in [*old, *[hadoop.Path(root, name) for name in loose]]:
        fs.delete(place, True)
    return loose
