"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs of up to 12 characters without white space. A rolling polynomial hash is taken of every K tokens, and
of each W consecutive hashes the smallest is kept, the rightmost where several are smallest, with its position: two
texts that share K + W - 1 tokens in a row share a kept hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from nivalis.llm.tables import let, partitions, read, unused

K, W = 5, 8
TOKEN = r"[^\x20\x09-\x0D]{1,12}"
PRIME = (1 << 31) - 1
BASE = 1_000_003
HALF = 1 << 31  # a kept value is hash * HALF + (HALF - 1 - position)
FIRST = -(1 << 63)


def _shifted(a: Column, b: Column, shift: int, f) -> Column:
    """f(a[i], b[i + shift]) for all i that have both."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), f)


def _roll(width: int):
    power = pow(BASE, width, PRIME)
    return lambda a, b: F.pmod(a * F.lit(power) + b, F.lit(PRIME))


def grams(tokens: Column) -> Column:
    """Rolling hashes of K tokens; of fewer tokens, but not none, one hash of all."""
    hashes = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))

    def rolled(h):
        pairs = lambda g: let(_shifted(g, g, 1, _roll(1)), lambda two: _shifted(_shifted(two, two, 2, _roll(2)), g, 4, _roll(1)))
        short = F.when(F.size(h) > 0, F.array(F.pmod(F.xxhash64(h), F.lit(PRIME)))).otherwise(F.slice(h, 1, 0))
        return F.when(F.size(h) >= K, pairs(h)).otherwise(short)

    return let(hashes, rolled)


def winnow(text: Column) -> Column:
    """Kept values of a text, by position: hash * 2^31 + (2^31 - 1 - position). Null or blank: none."""
    placed = F.transform(grams(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)), lambda g, i: g * F.lit(HALF) + (F.lit(HALF - 1) - i))

    def smallest(v):
        low = v
        for shift in (1, 2, 4):
            low = let(low, lambda x: _shifted(x, x, shift, lambda a, b: F.least(a, b)))
        return F.when(F.size(v) > W, F.array_distinct(low)).when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v)

    return let(placed, smallest)


RANGE_BYTES = 64 << 20


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, 31)))


def shown(kept: Column) -> Column:
    """The fingerprint as text: hash (hexadecimal) and position of each kept value."""
    return F.concat_ws(",", F.transform(kept, lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 31))), F.lit(":"), (F.lit(HALF - 1) - F.pmod(v, F.lit(HALF))).cast("string"))))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of all distinct hashes of two fingerprints; 1 where both have none."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(docs: DataFrame, id_col: str, values: dict[str, str], prepare=None) -> DataFrame:
    """`docs` with, for each name: column in `values`, that column of the next row in ascending id; after the last: the first.

    Ids are cut into ranges that are windows of their own; each range's first row is also put at the end of the range
    before it. Null ids come first; rows of equal id are ordered by a hash. `prepare(rows, is_own)` adds columns after `values`
    are known, and names the columns (a dict) of which the next row's values are then taken too. There are as many ranges
    as RANGE_BYTES of `values` need. Other columns stay as they are; columns named in `values` are added."""
    spark = docs.sparkSession
    k, part, copy, to = unused(docs, "key", "part", "copy", "to")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST))
    size = docs.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in values.values()), F.lit(64)))).first()[0] or 0
    n = max(2 * partitions(spark), math.ceil(size / RANGE_BYTES))
    got = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted({int(x) for x in got})
    keyed = docs.withColumn(k, key)
    keyed = keyed.withColumn(part, F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(k))) if bounds else F.lit(0))
    firsts = {r["p"]: r["k"] for r in keyed.groupBy(F.col(part).alias("p")).agg(F.min(k).alias("k")).collect()} or {0: 0}  # a row for each range
    parts = sorted(firsts)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    first_of = F.element_at(F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(parts[-1] + 1)]), F.col(part) + 1)
    before_of = F.element_at(F.array(*[F.lit(before.get(p)).cast("int") for p in range(parts[-1] + 1)]), F.col(part) + 1)
    own = F.struct(F.col(part).alias("p"), F.lit(0).alias("copy"))
    again = F.struct(before_of.alias("p"), F.lit(1).alias("copy"))
    dealt = keyed.withColumn(to, F.explode(F.when(F.col(k) == first_of, F.array(own, again)).otherwise(F.array(own)))).withColumn(copy, F.col(f"{to}.copy")).withColumn(to, F.col(f"{to}.p"))
    order = Win.partitionBy(to).orderBy(copy, k, F.xxhash64(*[F.col(c) for c in values.values()]))
    out = dealt.select("*", *[F.lead(c).over(order).alias(name) for name, c in values.items()])
    if prepare:
        out, more = prepare(out, F.col(copy) == 0)
        out = out.select("*", *[F.lead(c).over(order).alias(name) for name, c in more.items()])
    return out.filter(F.col(copy) == 0).drop(k, part, copy, to)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def prepare(df, is_own):
        n = F.char_length("text")
        q = F.floor(n / 4).cast("int")
        df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - q), F.substring(F.col("next_text"), F.lit(1), q)))
        return df.select("*", winnow(F.col("text")).alias("own"), F.when(is_own, winnow(F.col("edited"))).alias("of_edited")), {"of_next": "own"}

    df = with_next(docs, "doc_id", {"next_text": "text"}, prepare)
    return df.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"), shown(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(hashes(F.col("own")), hashes(F.col("of_edited"))).alias("near_edited"), likeness(hashes(F.col("own")), hashes(F.col("of_next"))).alias("near_next"),
    )
