"""Sharding: a two-pass external shuffle.

Pass 1 scatters whole records with seeded hashes into (shard, bucket) cells small enough for a task's memory; pass 2
shuffles each cell (Spark's `shuffle` is a Fisher-Yates shuffle), gives the rows gapless slots and writes them. The shard of
a key is found by rendezvous hashing, so that one more shard takes rows only into itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.llm.tables import partitions, read
from nivalis.session import new_path

SHARDS = 16


def rendezvous(key: Column, n: int, seed: int = 0) -> Column:
    """Shard 0..n-1 whose seeded hash with `key` is largest; a null key has a shard like any other."""
    scores = F.array(*[F.xxhash64(key, F.lit(seed), F.lit(s)) for s in range(n)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def external_shuffle(df: DataFrame, key: str, n_shards: int = SHARDS, seed: int = 17, bucket_bytes: int = 16 << 20, row_bytes: Column | None = None) -> DataFrame:
    """`df` with `shard` and `slot` (0, 1, ... within the shard, in shuffled order).

    `row_bytes` estimates a row's size (64 if not given); buckets get about `bucket_bytes`. Existing columns named
    `shard` or `slot` are replaced. An empty table stays empty; null and repeated keys are kept, equal rows each get
    a slot of their own. `df` must give the same rows in the same partitions when it is read again, as files do; the order
    is a function of them, `seed` and the numbers of buckets and partitions.

    A key's rows are all in its shard, but a row's bucket depends on all columns and on its place in `df`: so no bucket is
    large because a key is null or a row often repeated."""
    df = df.drop("shard", "slot")
    shard = rendezvous(F.col(f"`{key}`"), n_shards, seed)
    sizes = df.groupBy(shard.alias("shard")).agg(F.sum(row_bytes if row_bytes is not None else F.lit(64).cast("long")).alias("s")).collect()  # a row a shard
    of_shard = {r["shard"]: max(1, math.ceil((r["s"] or 0) / bucket_bytes)) for r in sizes}
    buckets = F.element_at(F.array(*[F.lit(of_shard.get(i, 1)) for i in range(n_shards)]), F.col("shard") + 1)
    named = {c: f"c{i}" for i, c in enumerate(df.columns)}
    names = [F.col(f"`{c}`") for c in named]
    placed = df.select(shard.alias("shard"), F.xxhash64(*names, F.monotonically_increasing_id(), F.lit(seed + 1)).alias("at"), *[x.alias(a) for x, a in zip(names, named.values(), strict=True)])
    placed = placed.select("shard", F.pmod("at", buckets).cast("int").alias("bucket"), F.struct("at", *named.values()).alias("row"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    gathered = placed.repartition(max(sum(of_shard.values()), partitions(df.sparkSession)), "shard", "bucket").groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    # a task draws in the order of its cells, which is made the same each time
    drawn = gathered.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    out = drawn.join(offsets, ["shard", "bucket"]).select("shard", "base", F.posexplode("rows").alias("at", "row"))
    return out.select(*[F.col(f"row.{a}").alias(c) for c, a in named.items()], "shard", (F.col("base") + F.col("at")).alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Writes what `external_shuffle` returned: a folder for each shard. Tasks write the cells they hold, so that no shard is
    one task's; rows are in slot order within a file, and `slot` orders them over files."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records are shuffled and written; the digest is of what is read from the shards."""
    size = lambda text: (F.octet_length(text) + 1).cast("long")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    path = new_path(spark)
    write_shards(external_shuffle(docs, "doc_id", row_bytes=size("text")), path)
    out = spark.read.schema("doc_id long, text binary, slot long, shard int").parquet(path)
    return out.select("doc_id", size("text").alias("size"), F.crc32("text").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", rendezvous(F.col("doc_id"), SHARDS + 1, 17).alias("grown_shard"))
