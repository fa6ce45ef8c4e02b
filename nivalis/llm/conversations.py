"""Prefix trie of conversations: which of them begin alike, and what sharing those beginnings saves.

A turn's digest is that of its role and text. A prefix is known by its depth and two sums of 64-bit hashes of (place, digest) over its
turns, so that no conversation, however long, is one task's; that all rows of a node agree in the last turn's digest and in
the parent is checked, so by induction no two prefixes are ever taken for one. Totals of subtrees come from
tree contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm.contraction import subtree_sums
from nivalis.llm.tables import WORD, partitions, read, small_batches, written
from nivalis.operators.ranking import row_numbers, running_sums

FAMILY, HEADS = 20, 4  # conversations of a family share the first turns of its first; up to HEADS - 1 of them
HOT = 10_000  # conversations or nodes at most that are sent to all tasks
ENDS_BITS = 12  # conversations of 4096 consecutive ids are listed together
ROOT = "0:0:0"


def _large(n_rows: int) -> int:
    """More rows than this are a hot key; there can be HOT such keys at most."""
    return max(64, n_rows // HOT)


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text, at, n): turns from 0, by turn (null first), role and text; n: turns of the conversation.

    Null roles and texts are empty. Rows of a null conv_id belong to no conversation and are left out; repeated rows are turns
    of their own."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *text)
    return row_numbers(turns, [F.col("turn").asc_nulls_first(), "role", "text"], ["conv_id"], "at", "n").drop("turn")


def with_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rebuilt, members) of `in_order` turns: conversations with the first turns of their family's first conversation.

    rebuilt: conv_id, depth (from 1), last (is it the last turn), role, text. members: conv_id, length."""
    convs = turns.filter("at = 0").select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    sizes = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("of_first"))
    convs = convs.join(sizes, "first", "left").withColumn("taken", F.least("h", F.coalesce("of_first", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("of_first"))
    large = _large(convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    about = convs.select("conv_id", "h", "taken", "length", F.col("n").alias("of_conv"))
    own = turns.filter(F.col("n") <= large).join(about.drop("of_conv"), "conv_id")
    hot = turns.filter(F.col("n") > large).join(F.broadcast(about.filter(F.col("of_conv") > large).drop("of_conv")), "conv_id")  # HOT rows at most
    own = own.unionByName(hot).filter("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "length", "role", "text")
    heads = turns.filter(F.col("at") < HEADS - 1).select(F.col("conv_id").alias("first"), "at", "role", "text")
    shared = convs.join(heads, "first").filter("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "length", "role", "text")
    return own.unionByName(shared).withColumn("last", F.col("depth") == F.col("length")).drop("length"), convs.select("conv_id", "length")


def _same(name: str) -> Column:
    clash = F.raise_error(F.lit("two prefixes have the same hashes"))
    return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(clash.cast("string")).alias(name)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's lists, in order and joined by commas, from rows sorted by node; holds a batch and one digest's state."""
    node = state = None
    out = lambda: pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != node:
                if state:
                    yield out()
                node, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        yield out()


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): conv_ids ascending, comma-joined."""
    spark = ends.sparkSession
    small_batches(spark)
    lists = ends.groupBy("node", F.shiftright("conv_id", ENDS_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return lists.repartition(partitions(spark), "node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(_digests, "node string, ends_sha256 string")


def trie(rebuilt: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations' turns (conv_id, depth, last, role, text) and all conversations (conv_id, length).

    nodes: node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ends: node, conv_id of the
    conversations that end there. Without conversations there is no root either. Empty roles and texts are turns like others."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rebuilt.select("conv_id", "depth", "last", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    lanes = {k: F.xxhash64("depth", "digest", F.lit(k)).cast("decimal(20,0)") for k in ("a", "b")}
    summed = running_sums(rows.withColumn("place", F.col("depth") - 1), "conv_id", "place", lanes)
    name = lambda depth, *sums: F.concat_ws(":", depth.cast("string"), *[x.cast("decimal(38,0)").cast("string") for x in sums])
    here = name(F.col("depth"), F.col("a"), F.col("b"))
    before = name(F.col("depth") - 1, *[F.col(k) - x for k, x in lanes.items()])
    summed = written(summed.select("conv_id", "depth", "last", "digest", "words", here.alias("node"), F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(before).alias("up")))
    nodes = summed.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("words").alias("words"), _same("digest"), _same("up")).drop("digest")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("string").alias("up"))
    nodes = written(nodes.select("node", "conv_id", F.col("depth").cast("long").alias("depth"), "n_convs", "words", "up").unionAll(root))
    kids = nodes.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # children learn their parent's conversation; parents of very many are sent to all tasks, for they are few
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = _large(nodes.count())
    hot = parents.filter(F.col("n_children") > large).drop("n_children")  # HOT rows at most
    tried = nodes.join(F.broadcast(hot), "up", "left")
    rest = tried.filter("parent_conv_id is null").drop("parent_conv_id").join(parents.filter(F.col("n_children") <= large).drop("n_children"), "up", "left")
    nodes = written(tried.filter("parent_conv_id is not null").unionByName(rest))
    own = nodes.select("node", "up", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_sums(own, ["n_leaves", "saved_tokens"], "node", "up")
    ends = summed.filter("last").select("node", "conv_id").unionAll(members.filter("length = 0").select(F.lit(ROOT), "conv_id"))
    return nodes.drop("words", "up").join(totals, "node"), ends


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    nodes, ends = trie(*with_heads(in_order(read(spark, sf_dir, "conversations"))))
    out = nodes.join(ends_digest(ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
