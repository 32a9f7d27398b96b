"""Generic retrieval records built from files and authority rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, text as T


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def file_records(files: DataFrame, namespace: str = "repo") -> DataFrame:
    """One record per classified file; absent facts are left out of the metadata map."""
    module = T.module_of("path")
    facts = F.create_map(
        F.lit("path"), F.col("path"),
        F.lit("extension"), F.col("ext"),
        F.lit("kind"), F.col("kind"),
        F.lit("language"), _lookup(F.col("ext"), K.LANGUAGES, ""),
        F.lit("doc_score"), F.when(F.col("doc_score") != 0, F.col("doc_score").cast("string")),
        F.lit("module"), F.when(module != "", module),
    )
    return files.select(
        "repo",
        F.col("path").alias("id"),
        T.enriched_text("path", "kind", "content").alias("text"),
        _lookup(F.col("kind"), K.RECORD_TYPES, K.RECORD_TYPE_DEFAULT).alias("record_type"),
        F.lit(namespace).alias("namespace"),
        F.map_filter(facts, lambda _, v: v.isNotNull()).alias("metadata"),
        F.lit(None).cast("string").alias("parent_id"),
    )


def authority_to_records(auth: DataFrame) -> DataFrame:
    tag_line = F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", ")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("title: "), "title"), F.concat(F.lit("type: "), "type"), tag_line, F.lit(""), F.col("text")
    )
    facts = F.create_map(
        F.lit("path"), F.col("path"),
        F.lit("title"), F.col("title"),
        F.lit("summary"), F.col("summary"),
        F.lit("authority_level"), F.col("authority_level").cast("string"),
        F.lit("authority_type"), F.col("type"),
        F.lit("tags"), F.to_json("tags"),
        F.lit("related_ids"), F.to_json("related_ids"),
        F.lit("applies_to_paths"), F.to_json("applies_to_paths"),
    )
    return auth.select(
        "repo", "id", text.alias("text"), F.col("type").alias("record_type"),
        F.lit(K.AUTHORITY_NAMESPACE).alias("namespace"), facts.alias("metadata"),
        F.lit(None).cast("string").alias("parent_id"),
    )
