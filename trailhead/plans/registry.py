"""Named queries over the given tables, each with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K, paths
from ..operators.skew import spread
from ..session import scratch_root, settle
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = views.with_views(oracle)
        return fn

    return register


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder on the shared storage for a query that writes and reads back."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, sf_dir: str, view: str = "v_files") -> DataFrame:
    """A view's files, classified. Small inputs arrive as a few scan partitions and are spread before the text work."""
    rows = views.view(spark, sf_dir, view).select("repo", "path", "content")
    return paths.classify(rows if view == "v_files" else spread(rows, ["path"]), head_chars=K.HEADER_SAMPLE_CHARS)   # v_files reads spread documents


def stored_files(spark: SparkSession, sf_dir: str, view: str = "v_source") -> DataFrame:
    """The classified files as a stored table, for plans that read them in several steps."""
    return settle(files_of(spark, sf_dir, view), "files")


def r6(name: str):
    return F.round(name, 6).alias(name)
