"""Numbers of rows in an order, running sums and exact quantiles, without a task that holds all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.session import written

ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number
FEW = 50_000  # rows of a table that is sent to all tasks
CHUNK = 4096


def _unused(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def row_numbers(df: DataFrame, order: list[str | Column], group: list[str] = (), name: str = "row_number", count: str | None = None) -> DataFrame:
    """`df` with `name`: 0, 1, ... of each row in its group (or in all), in the order of `order`; `count`: rows of its group.

    Rows are dealt by ranges of (group, order) and sorted there; what is done in one place has a row for each partition and
    group only. So a group of any size is many tasks' work. Rows that are equal in `order` come in any order, the same each time
    the result is used, for it is written. Null groups are a group; an empty table stays empty."""
    group, columns = list(group), df.columns
    tie, at, part, first, n, base = _unused(df, "_tie", "_at", "_part", "_first", "_n", "_base")
    keys = [F.col(f"`{g}`") for g in group] + [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
    placed = written(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, ROW_BITS))
    runs = written(placed.groupBy(*[f"`{g}`" for g in group], part).agg(F.min(at).alias(first), F.count("*").alias(n)))
    of_group = W.partitionBy(*[f"`{g}`" for g in group])
    before = of_group.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    named = {g: f"_g{i}_{at}" for i, g in enumerate(group)}
    runs = runs.select(*[F.col(f"`{g}`").alias(a) for g, a in named.items()], F.col(part).alias(f"_p{at}"), F.col(first), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base), F.sum(n).over(of_group).alias(n))
    runs = F.broadcast(runs) if runs.count() <= FEW else runs
    same = F.col(part) == F.col(f"_p{at}")
    for g, a in named.items():
        same &= F.col(f"`{g}`").eqNullSafe(F.col(a))
    out = placed.join(runs, same)
    more = [F.col(n).alias(count)] if count else []
    return out.select(*[F.col(f"`{c}`") for c in columns if c not in (name, count)], (F.col(at) - F.col(first) + F.col(base)).alias(name), *more)


def running_sums(df: DataFrame, group: str, place: str, values: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """`df` with the sum of each value over its group's rows up to `place` (0, 1, ...), this one included.

    A task sums `chunk` places of a group; chunks' sums are added up by themselves."""
    (part,) = _unused(df, "_chunk")
    sums = {k: f"_{k}_before" for k in values}
    df = df.withColumn(part, F.floor(F.col(place) / chunk))
    totals = df.groupBy(group, part).agg(*[F.sum(v).alias(sums[k]) for k, v in values.items()])
    before = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(group, part, *[F.sum(s).over(before).alias(s) for s in sums.values()])
    within = W.partitionBy(group, part).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    out = df.select("*", *[F.sum(v).over(within).alias(k) for k, v in values.items()]).join(totals, [group, part])
    for k, s in sums.items():
        out = out.withColumn(k, F.col(k) + F.coalesce(F.col(s), F.lit(0)))
    return out.drop(part, *sums.values())


def contiguous_folds(df: DataFrame, order: list[str | Column], k: int, name: str = "fold") -> DataFrame:
    """`df` with `name` 0..k-1: rows in order are cut into k runs, the first ones a row longer where k doesn't divide their number.
    Fewer rows than folds is an error."""
    at, n = _unused(df, "_number", "_rows")
    out = row_numbers(df, order, name=at, count=n)
    if (rows := out.count()) < k:
        raise ValueError(f"{rows} rows are fewer than {k} folds")
    size, longer = F.floor(F.col(n) / k), F.pmod(n, F.lit(k))
    edge = longer * (size + 1)
    fold = F.when(F.col(at) < edge, F.floor(F.col(at) / (size + 1))).otherwise(longer + F.floor((F.col(at) - edge) / size))
    return out.withColumn(name, fold.cast("int")).drop(at, n)


def exact_quantiles(df: DataFrame, value: str, shares: list[float], group: list[str] = (), few: int = 100_000, cells: int = 1024) -> DataFrame:
    """(group, quantiles): the exact quantiles of `value` (an array, linear between neighbours), as `percentile` has them.

    A group of up to `few` values is sorted in one task. In larger ones, of which there are N / `few` at most, the interval that
    holds a rank is cut into `cells` parts, each part's values are counted in partial aggregates, and the part with the rank
    is the next interval, until `few` values or a single one are left. So memory doesn't depend on how many values there are. NULL and NaN
    count for nothing; a group without values has NULL; null groups are a group; an empty table has no groups."""
    group = list(group)
    names = [f"_g{i}" for i in range(len(group))]
    x = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{g}`").alias(a) for g, a in zip(group, names, strict=True)], F.nanvl(x, F.lit(None).cast("double")).alias("_x"))
    key = F.struct(*names) if names else F.lit(0)
    rows = rows.select(key.alias("_key"), "_x")
    sizes = written(rows.groupBy("_key").agg(F.count("_x").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")))
    few = max(few, (sizes.agg(F.sum("n")).first()[0] or 0) // 10_000)  # large groups are 10,000 at most, and broadcast
    large = sizes.filter(F.col("n") > few)
    small = rows.join(F.broadcast(large.select("_key")), "_key", "left_anti") if (some := not large.isEmpty()) else rows
    out = small.groupBy("_key").agg(F.percentile("_x", F.array(*map(F.lit, shares))).alias("quantiles"))
    if some:
        place = [(F.col("n") - 1) * F.lit(float(q)) for q in shares]
        ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
        state = written(large.select("_key", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), "low", "high"))
        values = rows.filter("_x is not null")
        while not (wide := state.filter((F.col("inside") > few) & (F.col("low") < F.col("high")))).isEmpty():
            cell = F.least(F.floor((F.col("_x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * cells), F.lit(cells - 1))
            held = values.join(F.broadcast(wide), "_key").filter("_x between low and high")
            parts = held.groupBy("_key", "rank", "before", cell.alias("cell")).agg(F.count("*").alias("inside"), F.min("_x").alias("low"), F.max("_x").alias("high"))
            w = W.partitionBy("_key", "rank").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # `cells` rows
            parts = parts.withColumn("before", F.col("before") + F.coalesce(F.sum("inside").over(w), F.lit(0))).filter("before <= rank and rank < before + inside")
            done = state.filter((F.col("inside") <= few) | (F.col("low") == F.col("high")))
            state = written(done.unionByName(parts.drop("cell")))
        left = state.filter("low < high")
        last = values.join(F.broadcast(left), "_key").filter("_x between low and high").groupBy("_key", "rank", "before").agg(F.sort_array(F.collect_list("_x")).alias("v"))
        found = state.filter("low = high").select("_key", "rank", F.col("low").alias("v")).unionAll(last.select("_key", "rank", F.element_at("v", (F.col("rank") - F.col("before") + 1).cast("int"))))
        found = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("v")).join(large.select("_key", "n"), "_key")
        at = lambda p: F.col("v")[F.floor(p)] + (F.col("v")[F.ceil(p)] - F.col("v")[F.floor(p)]) * (p - F.floor(p))
        out = out.unionByName(found.select("_key", F.array(*map(at, place)).alias("quantiles")))
    return out.select(*[F.col(f"_key.{a}").alias(g) for g, a in zip(group, names, strict=True)], "quantiles")
