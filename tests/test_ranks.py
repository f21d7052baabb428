"""Running numbers against sorting in Python."""

import random

from annolith.operators import ranks
from pyspark.sql import functions as F


def table(spark, n=3000):
    r = random.Random(5)
    rows = [(r.choice(["a"] * 3 + ["b", "c", None]), r.choice([None, *range(40)]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, k int, id long").repartition(7)


def test_numbers_run_in_order(spark):
    rows, df = table(spark)
    got = ranks.numbered(df, ["k", "id"], "no").collect()
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
    assert [tuple(x)[:3] for x in sorted(got, key=lambda x: x.no)] == want
    assert sorted(x.no for x in got) == list(range(1, len(rows) + 1))
    down = ranks.numbered(df, [F.desc("id")], "no", 0).collect()
    assert all(x.no == len(rows) - 1 - x.id for x in down)


def test_ties_are_dealt_and_agree_in_reruns(spark):
    """One order value for all rows: every number once, the same rows in every run, more than one range."""
    _, df = table(spark)
    same = df.withColumn("k", F.lit(1))
    a, b = ({x.id: x.no for x in ranks.numbered(d, ["k"], "no").collect()} for d in (same, same.repartition(5)))
    assert a == b
    assert sorted(a.values()) == list(range(1, 3001))


def test_numbers_within_groups(spark):
    rows, df = table(spark)
    got = ranks.numbered_within(df, "g", ["id"], "no", 0, "n").collect()
    assert len(got) == len(rows)
    for g in ("a", "b", "c", None):
        ids = [x[2] for x in rows if x[0] == g]
        assert {x.id: (x.no, x.n) for x in got if x.g == g} == {v: (k, len(ids)) for k, v in enumerate(ids)}


def test_empty_tables_and_maps(spark):
    empty = spark.createDataFrame([], "g string, k int, m map<string,int>")
    assert ranks.numbered(empty, ["k"], "no").columns == ["g", "k", "m", "no"]
    assert ranks.numbered(empty, ["k"], "no").count() == 0
    assert ranks.numbered_within(empty, "g", ["k"], "no").count() == 0
    one = spark.createDataFrame([("x", 1, {"a": 1})], "g string, k int, m map<string,int>")
    assert ranks.numbered(one, ["k"], "no", 5).first().no == 5


def test_a_large_group_is_not_brought_to_one_task(spark):
    """Numbers within a group were joined by the group alone, so one task read all of it."""
    from annolith.operators import ranks

    rows = spark.range(1000).selectExpr("IF(id % 10 = 0, NULL, 'most') g", "id")
    out = ranks.numbered_within(rows, "g", ["id"], "n", 1, "size")
    assert "_range" in out._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[1].split("\n", 1)[0]
    got = {(r.g, r.id): (r.n, r["size"]) for r in out.collect()}
    assert got[(None, 990)] == (100, 100) and got[("most", 1)] == (1, 900) and got[("most", 999)] == (900, 900)
