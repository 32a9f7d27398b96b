"""One query per operator over its whole table, and the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, line_dedup, mixing, pii, product_codes, quality, spelling, substrings, suffix_dedup, topk, url_rules, weighted_minhash,
               whitening)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_line_labels")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, field, keep=["doc_id"]).select("row.doc_id", "*").drop("row")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op2_url_rules", """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, rh || rp AS rule, coalesce(action, 'allow') AS verdict
FROM (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS nth
  FROM parts p LEFT JOIN rules r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
WHERE nth = 1""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.apply_rules(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op6_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(rows, rows.where("id % 20 = 0"), k=20, scale=64.0)


@query("op7_source_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def byte_bpe_50k() -> str:
    """Where the public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, byte_bpe_50k(), keep=["doc_id"], decoded="decoded")
    return done.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup(docs, short=True)
    return done.select("row.doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_weighted_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weighted_minhash.classes(docs).select(F.col("doc").alias("doc_id"), "class_id", "n_links", F.col("first").alias("kept"))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.extract(docs, keep=["doc_id"])

    def written(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("row.doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = suffix_dedup.dedup(docs, length=200, keep="none", columns=["doc_id"])
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["hi"] - r["lo"])
    return done.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_substrings")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substrings.dedup(docs, window=13, columns=["doc_id"])
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["hi"] - r["lo"])
    return done.select("row.doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, "embedding", components=16, scale=64.0, offset=1_000_000)
    done = whitening.transform(rows, model, "embedding", keep=["vec_id"])
    explained = F.lit(model.explained.tolist()).cast("array<double>")
    return done.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


@query("op12_product_codes", """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT r, vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v),
links AS (
  SELECT a.r, b.r AS other, b.vec_id AS other_id
  FROM u a JOIN u b ON a.r <> b.r AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reached(r, other) AS (SELECT r, other FROM links UNION SELECT reached.r, links.other FROM reached JOIN links ON reached.other = links.r),
component AS (SELECT reached.r, min(u.vec_id) AS least FROM reached JOIN u ON u.r = reached.other GROUP BY reached.r),
degree AS (SELECT r, count(*) AS n FROM links GROUP BY r),
judged AS (
  SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(least, v.vec_id)) AS component_id
  FROM v LEFT JOIN degree USING (r) LEFT JOIN component USING (r)
  UNION ALL
  SELECT vec_id, 0, vec_id FROM embeddings
  WHERE vec_id IS NULL OR embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
    OR len(list_filter(embedding, lambda x: x <> 0)) = 0)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM judged""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return product_codes.classes(rows, threshold=0.95, keep=["vec_id"]).select("row.vec_id", "n_links", "component_id", "kept")


# The checksum goes through the text's half bytes: its table holds the sixteen remainders of the CRC-32 polynomial (fixed values).
@query("op13_spelling", """
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
halves AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c) & 15, unicode(c) >> 4]
         ELSE [(192 + (unicode(c) >> 6)) & 15, (192 + (unicode(c) >> 6)) >> 4, (128 + (unicode(c) & 63)) & 15, (128 + (unicode(c) & 63)) >> 4] END)) AS h
  FROM runs),
checked AS (
  SELECT run, n, doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(h, lambda b: b::BIGINT)), lambda c, b: xor(c >> 4,
    [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
     3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, b) & 15) + 1])), 4294967295) AS crc
  FROM halves),
words AS (
  SELECT word, sum(n) AS n FROM (
    SELECT n, CASE WHEN doc_id IS NOT NULL AND crc % 31 = 0
      THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM checked)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, place, steps) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT chain.word, formed.form, steps + 1 FROM chain JOIN formed ON chain.place = formed.word WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(place, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN ends USING (word)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), least_letters=7, least_count=2, slip_every=31)
    return spelling.group(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")
