"""Mixing sources to target weights: a low-discrepancy source schedule.

Each source's documents, in seeded random order, form a line of words cut into blocks of equal length: BLOCK words, and less for a
source whose target is below PARTS blocks, so that small sources come near their targets too. Slot t of the schedule takes the
golden-ratio point frac(t * phi) through the cumulative numbers of blocks that the targets want to a source; the k-th slot of
a source takes that source's k-th block, and after the last block starts again, twice at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.llm.tables import WORD, read, unused, written

PHI = 0.6180339887498949
BLOCK = 64  # words, at most
PARTS = 16  # a target is that many blocks at least, if it has the words
CELLS = 4096  # of the unit interval, for finding a point's source by an equality join
FEW = 100_000  # sources; up to here (some MB) they are broadcast


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """One row per source: sid (from 1, by code point, null last), source, source_size, target, len (words of a block).

    Targets share `share` times all words by weight; none is above `most` times its source's size, and what is beyond
    is shared again among the others. The windows here are over one row per source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    by = by.withColumn("sid", F.row_number().over(order)).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(every)["level"]
    out = by.select("sid", "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * rest).alias("target"))
    return out.withColumn("len", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / PARTS))).cast("long"))


def with_sources(df: DataFrame, sources: DataFrame, n_sources: int, salts: int = 64) -> DataFrame:
    """Adds each row's source columns. Many sources aren't broadcast; the hot one's rows are then spread over salts."""
    if n_sources <= FEW:
        small = F.broadcast(sources.withColumnRenamed("source", "s"))
        return df.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    spread = sources.withColumnRenamed("source", "s").withColumn("salt_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return salted.join(spread, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("salt_s"))).drop("s", "salt", "salt_s")


def prefix_sums(df: DataFrame, group: str, chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """Sum of `value` before each row of its group, in the order of (chunk, order). A group's chunks are separate tasks' work."""
    sums = df.groupBy(group, chunk).agg(F.sum(value).alias("_v"))
    before = W.partitionBy(group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(group, chunk, F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(sums, [group, chunk]).withColumn(name, F.col("_in") + F.col("_base")).drop("_in", "_base")


def schedule(spark: SparkSession, sources: DataFrame, few: bool) -> DataFrame:
    """Slots (t, sid, block, lap): lap is 0 for a block's first use and 1 for its second."""
    wanted = F.col("target") / F.col("len")
    total = sources.agg(F.coalesce(F.sum(wanted), F.lit(0.0))).first()[0]
    n = math.ceil(total)
    ends = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    spans = sources.filter("target > 0").withColumn("hi", F.sum(wanted).over(ends) / F.lit(max(total, 1e-9))).withColumn("lo", F.col("hi") - wanted / F.lit(max(total, 1e-9)))
    last = F.max("hi").over(W.partitionBy())
    spans = spans.withColumn("hi", F.when(F.col("hi") == last, F.lit(2.0)).otherwise(F.col("hi"))).withColumn("lo", F.when(F.col("sid") == F.min("sid").over(W.partitionBy()), F.lit(-1.0)).otherwise(F.lag("hi").over(W.orderBy("sid"))))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.greatest(F.floor(F.col("lo") * CELLS), F.lit(0)), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    step = 1 << 20
    x = F.pmod(F.floor(F.col("id") / step) * F.lit((step * PHI) % 1.0) + F.pmod(F.col("id"), F.lit(step)) * F.lit(PHI), F.lit(1.0))
    points = spark.range(n).select(F.col("id").alias("t"), x.alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    hit = points.join(cells, "cell").filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    hit = hit.select("t", "sid", F.floor(F.col("t") / 65536).alias("chunk"))
    ranked = written(prefix_sums(hit, "sid", "chunk", ["t"], F.lit(1).cast("long"), "k").select("t", "sid", "k"))
    # points fall to a source some times more or less than it wants; no more are taken, and what lacks comes last
    wants = sources.filter("target > 0").select("sid", "len", F.ceil(F.col("source_size") / F.col("len")).alias("blocks"), F.round(wanted).cast("long").alias("wants"))
    lacking = wants.join(ranked.groupBy("sid").agg(F.count("*").alias("had")), "sid", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).filter("had < wants")
    late = lacking.select("sid", F.explode(F.sequence(F.col("had"), F.col("wants") - 1)).alias("k"), "had").select((F.lit(n) + (F.col("k") - F.col("had")) * F.lit(1 << 32) + F.col("sid")).alias("t"), "sid", "k")
    kept = ranked.unionByName(late).join(F.broadcast(wants) if few else wants, "sid").filter("k < wants")
    return kept.select("t", "sid", F.pmod(F.col("k"), F.col("blocks")).alias("block"), F.floor(F.col("k") / F.col("blocks")).alias("lap")).filter("lap < 2")


def lines(sized: DataFrame, n_rows: int, seed: int = 5) -> DataFrame:
    """Rows with `start`: where the row's words begin on its source's line, in seeded random order."""
    chunks = 1 << max(0, math.ceil(math.log2(max(1, n_rows / 1024))))
    h = sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("chunk", F.pmod("h", F.lit(chunks)))
    return prefix_sums(h, "sid", "chunk", ["h", "doc_id", "size"], F.col("size"), "start").drop("h", "chunk")


def mix(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) for `docs` with doc_id, source, size.

    documents: doc_id, source, size, source_size, target, taken. pieces, the mix itself: slot t, doc_id, the first word
    and the number of words. A null source is a source; rows of no words take part with taken = 0; repeated rows are
    rows of their own; an empty table gives empty results."""
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", F.col("size").cast("long").alias("size")))
    stats = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    sources = written(targets(sized, block=block).coalesce(1))
    n_sources = sources.count()
    # sums of rows that are equal in doc_id and size may fall on either; written once so that they stay as they fell
    lined = written(lines(with_sources(sized, sources, n_sources), stats["n"]))
    slots = schedule(spark, sources, n_sources <= FEW)
    ids = F.sequence(F.floor(F.col("start") / F.col("len")), F.floor((F.col("start") + F.col("size") - 1) / F.col("len")))
    cut = lined.filter("size > 0").select("sid", "doc_id", "start", "size", "len", F.explode(ids).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * F.col("len"))
    cut = cut.withColumn("first", first - F.col("start")).withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("len")) - first)
    pieces = cut.join(slots, ["sid", "block"])
    took = pieces.groupBy(F.col("sid").alias("k_sid"), F.col("doc_id").alias("k_id"), F.col("start").alias("k_start")).agg(F.sum("words").alias("taken"))
    same = (F.col("sid") == F.col("k_sid")) & F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("start") == F.col("k_start")) & (F.col("size") > 0)
    whole = lined.join(took, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return whole, pieces.select("t", "doc_id", "first", "words")


def mixed(docs: DataFrame) -> DataFrame:
    """`docs`, with all their columns, each row as often as the mix takes its words: once if any are taken, and again if
    more than half of a second time. Rows of no words are left out; rows of equal id and text are taken alike."""
    key, often, copy = unused(docs, "key", "times", "copy")
    rows = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    taken = mix(rows.select(F.col(key).alias("doc_id"), "source", n_words(F.col("text")).alias("size")))[0]
    times = F.when(F.col("taken") > 1.5 * F.col("size"), 2).when(F.col("taken") > 0, 1).otherwise(0)
    times = taken.select(F.col("doc_id").alias(key), times.alias(often)).groupBy(key).agg(F.max(often).alias(often)).filter(F.col(often) > 0)
    # merged at every size: a small table's broadcast would hide what the documents' shuffle takes
    out = rows.join(written(times).hint("merge"), key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs)[0].select("doc_id", "size", "source_size", "target", "taken")
