"""URL filters as a sort-merge range join.

A rule is a host and a path prefix; it fits its host and every subdomain. Written backwards by labels and closed with a dot,
a host becomes a key whose prefixes are exactly its parent domains: ``blog.example.net`` → ``net.example.blog.``. So a rule's
hosts are one interval of keys, and intervals of different rules are nested or apart. All keys and the intervals' two ends are
sorted together; going through them in order, the rules active at a key are a stack that an interval's start pushes to and its
end pops from. A second sweep of the same kind, over (rule host, url path), finds the longest path among a host's rules.

Only DataFrame functions are used. The sort is a range partitioning whose last key is a hash of the row, so equal keys can
lie in several partitions; each partition begins with the stack its predecessors left, of which there is one row a partition.

Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule. Of rules that fit, the longest
host plus path wins, then the longer host; of equal rules ``block`` wins. A null or empty rule host fits nothing. An empty rule
path fits every path. Repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import settle
from .common import packed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "\u0000"      # between host key and path in the second sweep


def url_host(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, ASCII lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def enclosing(points: DataFrame, key: str, prefixes: DataFrame) -> DataFrame:
    """``points`` with ``stack``: all strings of ``prefixes(prefix)`` that begin the point's key, shortest first.

    Points must have a unique ``uid`` and no columns ``at``, ``kind``, ``stack``, ``part``. The result is a stored table.
    """
    p = prefixes.select("prefix").where("prefix <> ''").distinct()
    shorter = p.select("prefix", F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("n")).select(
        "prefix", F.substring("prefix", F.lit(1), F.col("n")).alias("outer"))
    chains = (shorter.join(p.select(F.col("prefix").alias("outer")), "outer").groupBy("prefix")
              .agg(F.sort_array(F.collect_list("outer")).alias("chain")))   # at most one a character of the prefix
    start = F.col("prefix").cast("binary")
    # The byte FF ends no UTF-8 text: prefix + FF sorts behind everything that the prefix begins.
    ends = chains.select(F.explode(F.array(
        F.struct(start.alias("at"), F.lit(0).alias("kind"), F.col("chain").alias("stack")),
        F.struct(F.concat(start, F.unhex(F.lit("FF"))).alias("at"), F.lit(2).alias("kind"),
                 F.slice("chain", 1, F.size("chain") - 1).alias("stack")))).alias("e")).select("e.*")
    both = points.withColumns({"at": F.col(key).cast("binary"), "kind": F.lit(1)}).unionByName(ends, allowMissingColumns=True)
    spread = both.repartitionByRange("at", "kind", F.xxhash64("uid")).withColumn("part", F.spark_partition_id())
    laid = settle(spread, "sweep")
    left = laid.where("kind <> 1").groupBy("part").agg(F.max_by("stack", F.struct("at", "kind")).alias("stack"))
    # One row a partition: the stack that the partitions before it leave.
    carried = laid.select("part").distinct().join(left, "part", "left").select(
        "part", F.last("stack", True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = W.partitionBy("part").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = laid.withColumn("stack", F.last("stack", True).over(inside)).where("kind = 1").join(carried, "part")
    empty = F.array().cast("array<string>")
    return settle(swept.select(*points.columns, F.coalesce("stack", "carried", empty).alias("stack")), "swept")


def apply_rules(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``urls`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, else null), ``verdict``.

    ``rules`` has ``host``, ``path`` (beginning with ``/``) and ``action`` (``allow`` or ``block``). Input columns stay; the four
    new ones take the place of input columns of the same names.
    """
    r = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
         .where("host <> ''").groupBy("host", "path").agg(F.max("action").alias("action"))       # block sorts behind allow
         .withColumn("hk", host_key(F.col("host"))))
    points = packed(urls, host=url_host(F.col(url)), path=url_path(F.col(url))).withColumns({
        "key": host_key(F.col("host")), "uid": F.monotonically_increasing_id()})
    hosts = enclosing(points, "key", r.select(F.col("hk").alias("prefix")))
    nested = hosts.select("uid", "path", F.explode("stack").alias("hk")).select(
        F.concat("uid", F.lit("/"), "hk").alias("uid"), F.col("uid").alias("page"), "hk",
        F.concat("hk", F.lit(SPLIT), "path").alias("key"))
    paths = enclosing(nested, "key", r.select(F.concat("hk", F.lit(SPLIT), "path").alias("prefix")))
    hit = paths.where(F.size("stack") > 0).select("page", "hk", F.element_at("stack", -1).alias("prefix"))
    best = hit.groupBy("page").agg(F.max(F.struct(F.length("prefix").alias("n"), F.length("hk").alias("h"), "prefix")).alias("b"))
    named = r.select(F.concat("hk", F.lit(SPLIT), "path").alias("prefix"), F.concat("host", "path").alias("rule"), "action")
    decided = best.select("page", "b.prefix").join(named, "prefix").select(F.col("page").alias("uid"), "rule", "action")
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return hosts.join(decided, "uid", "left").select(
        *[F.col("row").getField(c).alias(c) for c in keep], "host", "path", "rule",
        F.coalesce("action", F.lit(default)).alias("verdict"))
