"""Joins, percentiles and offsets that keep hot keys spread over many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

SALTS = 16


def shuffled(side: DataFrame) -> DataFrame:
    """A join side that grows with the input: it is dealt by key with the other side, never sent whole through the driver.

    Spark may take such a side for small, since it goes by the bytes of a compressed file.
    """
    return side.hint("merge")


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join where one key may hold a large share of ``big``.

    Rows of ``big`` get a salt from the hash of ``spread_by``; each row of ``small`` is repeated once per salt. ``how``
    may be any join type whose result keeps or filters rows of ``big`` only. Both sides are shuffled: Spark plans by the size of ``small`` before
    its rows are repeated, and would send ``salts`` times a table it takes for small through the driver.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(shuffled(right), [*keys, "_salt"], how).drop("_salt")


def exact_percentiles(df: DataFrame, keys: list[str], values: list[str], width: int = 4096) -> DataFrame:
    """Truncated median, lower-rank p95, maximum and count for each key and value column; nulls are left out.

    Values are integers. They are first counted per distinct value (combined on the map side), then ranked by running
    counts: over blocks of ``width`` neighbouring values, and inside a block. No task sees more than one block or one
    row per block, however many rows a key has.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("long").alias("v")) for v in values])
    hist = (
        df.select(*keys, F.explode(pairs).alias("_p"))
        .select(*keys, "_p.metric", "_p.v")
        .where("v is not null")
        .groupBy(*keys, "metric", "v")
        .agg(F.count("*").alias("c"))
        .withColumn("block", F.floor(F.col("v") / F.lit(width)))
    )
    group = [*keys, "metric"]
    by_block = W.partitionBy(*group).orderBy("block")
    blocks = (
        hist.groupBy(*group, "block").agg(F.sum("c").alias("block_n"))
        .withColumn("before", F.sum("block_n").over(by_block.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("n", F.sum("block_n").over(W.partitionBy(*group)))
        .fillna(0, ["before"])
    )
    in_block = W.partitionBy(*group, "block").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = hist.join(blocks, [*group, "block"]).withColumn("upto", F.col("before") + F.sum("c").over(in_block))

    def at(index):  # value at a 0-based position of the sorted list
        return F.min(F.when(F.col("upto") > index, F.col("v")))

    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    p95 = F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(0.95)) - 1)
    out = ranked.groupBy(*group).agg(
        at(low).alias("lo"), at(high).alias("hi"), at(p95).alias("p95"), F.max("v").alias("max"), F.max("n").alias("n")
    )
    middle = (F.col("lo") + F.col("hi")) / 2
    return out.select(
        *group, F.when(middle >= 0, F.floor(middle)).otherwise(F.ceil(middle)).cast("long").alias("p50"), "p95", "max", "n"
    )


def dense_offsets(df: DataFrame, name: str = "seq") -> DataFrame:
    """Number the rows of a scan 0, 1, 2, … in scan order, without moving them.

    One counting pass gives the size of each input partition; the running total over that small table becomes the
    partition's base offset.
    """
    local = F.monotonically_increasing_id()
    part = F.shiftright(local, 33).cast("int")
    numbered = df.withColumn("_part", part).withColumn("_pos", local.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)   # one row per input partition
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return numbered.join(base, "_part").withColumn(name, F.col("_base") + F.col("_pos")).drop("_part", "_pos", "_base", "_n")


def log_offsets(df: DataFrame, name: str = "seq") -> DataFrame:
    """Number the lines of text files 0, 1, 2, … in the order of file names and of lines in a file.

    ``df`` is (value, file, block): file and block start of each line. Splits may be read in any order; inside one the reading order is
    the file's. The table of splits gives each its offset.
    """
    lines = df.withColumn("_at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)   # one row per split
    base = splits.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return lines.join(base, ["file", "block"]).withColumn(name, F.col("_base") + F.col("_at") - F.col("_first")).drop(
        "file", "block", "_at", "_first", "_base")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark keeps at most ``k`` rows per key and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def numbered(df: DataFrame, keys: list[str], order: list, rank: str = "rank") -> DataFrame:
    """All rows of a key, numbered in order."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether a frame has at most ``max_rows`` rows, reading no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Spread a scan that has fewer partitions than the cluster has cores; larger inputs stay where they are.

    Only for frames without a shuffle of their own: asking those for their partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *columns) if columns else df.repartition(cores)
