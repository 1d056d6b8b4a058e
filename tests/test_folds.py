"""Greedy groups over many partitions against a plain loop."""

import random

import pytest

from lectern.operators import folds


def loop(rows, reach, between=0, moving=True):
    """Rows are (key, order, number): the groups of each key, one row after the other."""
    out, at = [], {}
    for key, order, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n, group, opened, begin, here = at.get(key, (0, -1, 0, 0, 0))
        start, end = (here, here + x) if moving else (x, x)
        if group < 0 or end > begin + reach:
            group, opened, begin = group + 1, n, start
        out.append((key, order, n, group, opened, begin))
        at[key] = (n + 1, group, opened, begin, here + x + between)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_groups(spark, seed, monkeypatch):
    """One key with most rows, some that end at a partition's border, and many small ones."""
    rng = random.Random(seed)
    rows = [(rng.choice(["big"] * 12 + ["mid", "mid", None, "", *map(str, range(40))]), i, rng.choice([0, 1, 3, 7, 20, 90])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, x long").selectExpr("*", "1 AS row", "'z' AS `a``b`")
    reach, between = rng.choice([(40, 2), (40, 0), (5, 1), (3000, 2)])
    got = folds.grouped(df, ["k"], ["i"], reach, length="x", between=between, partitions=rng.choice([1, 7, 16])).drop("a`b")
    assert sorted(map(tuple, got.select("k", "i", "row", "group", "opened", "begin").collect()), key=repr) == sorted(loop(rows, reach, between), key=repr)
    place, times = {}, []
    for k, i, x in rows:
        place[k] = place.get(k, -500) + rng.choice([0, 0, x])
        times.append((k, i, place[k]))
    got = folds.grouped(spark.createDataFrame(times, "k string, i long, x long"), ["k"], ["i"], reach, place="x", partitions=9)
    assert sorted(map(tuple, got.select("k", "i", "row", "group", "opened", "begin").collect()), key=repr) == sorted(loop(times, reach, 0, False), key=repr)


def test_one_huge_key_takes_many_tasks(spark):
    """Two million unbroken events of one client: no partition holds more than a few times its share."""
    df = spark.range(0, 2_000_000, 1, 16).selectExpr("'client' AS k", "id", "id * 1000 + id % 7 AS us")
    got = folds.grouped(df, ["k"], ["id"], 59_999_999, place="us", partitions=32)
    parts = [r.n for r in got.selectExpr("spark_partition_id() AS p").groupBy("p").agg({"p": "count"}).withColumnRenamed("count(p)", "n").collect()]
    assert len(parts) == 32 and max(parts) < 3 * 2_000_000 / 32
    want, bound, start = [], -1, 0
    for i in range(0, 2_000_000):
        us = i * 1000 + i % 7
        if us > bound:
            bound = us + 59_999_999
            want.append((i, us))
    assert [tuple(r) for r in got.where("row = opened").select("id", "begin").orderBy("id").collect()] == want
    assert got.selectExpr("max(group)").first()[0] == len(want) - 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, i long, x long")
    assert folds.grouped(df, ["k"], ["i"], 5, length="x").collect() == []


def test_places_whose_sum_passes_64_bits(spark):
    """Times in microseconds add up to more than a long holds; only their differences count."""
    rows = [("k", i, 4 * 10**18 + i * 3) for i in range(40)]
    got = folds.grouped(spark.createDataFrame(rows, "k string, i long, x long"), ["k"], ["i"], 7, place="x", partitions=4)
    assert sorted(map(tuple, got.select("k", "i", "row", "group", "opened", "begin").collect())) == sorted(loop(rows, 7, 0, False))
