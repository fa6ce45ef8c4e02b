"""Row numbers and running sums against plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from nivalis.operators.ranking import row_numbers, running_sums


def test_row_numbers_equal_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), i) for i in range(500)] + [("a", 7, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    out = row_numbers(df, ["x", "id"], ["g"], "n", "of").collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"g", "x", "id", "n", "of"}
    for _, part in itertools.groupby(sorted(out, key=lambda r: (str(r.g), r.n)), key=lambda r: r.g):
        part = list(part)
        assert [r.n for r in part] == list(range(len(part))) and all(r.of == len(part) for r in part)
        keys = [(r.x is not None, r.x or 0, r.id) for r in part]
        assert keys == sorted(keys)
    whole = row_numbers(df, ["id"]).collect()
    assert [r.id for r in sorted(whole, key=lambda r: r.row_number)] == sorted(r[2] for r in rows)


def test_no_window_holds_all_rows(spark, capsys):
    df = spark.range(1000).selectExpr("id", "id % 3 AS _at", "1 AS _part")  # names that it would use itself
    out = row_numbers(df, ["id"])
    out.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan.split("Scan parquet")[0] and "SinglePartition" not in plan.split("BroadcastExchange")[0]
    assert [tuple(r) for r in out.orderBy("id").limit(3).collect()] == [(0, 0, 1, 0), (1, 1, 1, 1), (2, 2, 1, 2)]
    assert row_numbers(df.limit(0), ["id"], ["_at"], "n", "of").count() == 0


def test_running_sums(spark):
    rows = [(g, p, p * 3 + g) for g in range(2) for p in range(50)]
    out = running_sums(spark.createDataFrame(rows, "g int, p int, v int"), "g", "p", {"a": F.col("v")}, 8)
    got = {(r.g, r.p): r.a for r in out.collect()}
    assert got == {(g, p): sum(x * 3 + g for x in range(p + 1)) for g, p, _ in rows}
