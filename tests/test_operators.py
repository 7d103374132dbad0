"""Operators against plain versions and their stated rules."""

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkhaul.functions import geo
from sparkhaul.functions.text import normal
from sparkhaul.operators import relational as rel
from sparkhaul.operators import routes, stitching
from sparkhaul.sources import sinks
from sparkhaul.streaming import rules


def test_counts_leave_other_nulls(spark):
    left = spark.createDataFrame([(1, None), (2, 5)], "k long, own long")
    right = spark.createDataFrame([(1, 1), (1, 2)], "k long, x long")
    assert sorted(map(tuple, rel.count_per(left, right, "k", F.count("*").alias("n")).collect())) == [(1, None, 2), (2, 5, 0)]


def test_missing_rows_tell_null_from_empty(spark):
    backup = spark.createDataFrame([(1, None), (2, "a|b"), (3, "")], "k long, s string")
    table = spark.createDataFrame([(1, ""), (3, "")], "k long, s string")
    assert sorted(r.k for r in rel.missing_rows(backup, table, ["k", "s"]).collect()) == [1, 2]
    pairs = spark.createDataFrame([("a", "b|c")], "x string, y string"), spark.createDataFrame([("a|b", "c")], "x string, y string")
    assert rel.missing_rows(*pairs, ["x", "y"]).count() == 1


def test_normal_strips_marks_of_any_letter(spark):
    df = spark.createDataFrame([("São  Škoda\tÝ Ấ ",)], "s string")
    assert df.select(normal("s")).first()[0] == "sao skoda y a"


def test_grids_at_any_latitude(spark):
    rng = random.Random(1)
    points = [(k, rng.choice([0.0, 45.0, -60.0, 75.0, 89.9]) + rng.uniform(0, 0.02), rng.uniform(0, 0.1)) for k in range(160)]
    df = spark.createDataFrame(points, "k long, lat double, lng double")
    found = {(r.k, r.r_k) for r in geo.within(df, df, 600.0, []).collect()}

    def far(a, b):
        return 111320 * np.hypot(b[1] - a[1], (b[2] - a[2]) * np.cos(np.radians(a[1])))

    assert found == {(a[0], b[0]) for a in points for b in points if far(a, b) <= 600}
    near = {r.k: r.r_t for r in geo.nearest(df, spark.createDataFrame([(x[0] + 1000, x[1], x[2]) for x in points[:9]], "t long, lat double, lng double"), "k", "t").collect()}
    assert near == {a[0]: min(points[:9], key=lambda b: (far(a, b), b[0]))[0] + 1000 for a in points}


def test_rows_numbered_without_one_task(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 501).alias("x")).repartition(6)
    got = sorted((r.n, r.x) for r in rel.numbered(df, "n", "x").collect())
    assert [n for n, _ in got] == list(range(1, 501)) and [x for _, x in got] == sorted(x for _, x in got)


def test_shortest_paths_of_few_stops():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        x = rng.random((n, 2))
        seconds = np.hypot(*(x[:, None] - x).transpose(2, 0, 1))
        for start, end in ((False, False), (True, False), (True, True)) if n > 1 else ((False, False),):
            order = routes.shortest_path(seconds, start, end)
            every = [np.array(p) for p in itertools.permutations(range(n)) if (not start or p[0] == 0) and (not end or p[-1] == n - 1)]
            best = min(routes.path_cost(p, seconds) for p in every)
            assert sorted(order) == list(range(n)) and routes.path_cost(order, seconds) <= 1.1 * best + 1e-9
            assert (not start or order[0] == 0) and (not end or order[-1] == n - 1)


def test_chains_and_groups(spark):
    lines = [("a", 1, 0.0, 0.0, 0.0, 1.0), ("a", 2, 0.0, 2.0, 0.0, 1.0), ("a", 3, 0.0, 2.0, 0.0, 3.0), ("a", 4, 5.0, 0.0, 5.0, 1.0), ("b", 5, 0.0, 0.0, 0.0, 1.0), ("b", 6, 0.0, 1.0, 0.0, 2.0), ("b", 7, 0.0, 1.0, 1.0, 1.0)]
    found = sorted((r.name, tuple(r.segs)) for r in stitching.stitched(spark.createDataFrame(lines, "name string, seg long, from_lat double, from_lng double, to_lat double, to_lng double")).collect())
    assert found == [("a", (1, 2, 3)), ("a", (4,)), ("b", (5,)), ("b", (6,)), ("b", (7,))]  # three meet: no chain
    stops = spark.createDataFrame([(1, k, k, 0.0, x) for k, x in enumerate([0.0, 0.00005, 0.01, 0.0])], "route long, stop long, seq long, lat double, lng double")
    groups = {c: [r.grp for r in routes.anchored_groups(stops, "seq", 10.0, c).orderBy("stop").collect()] for c in (False, True)}
    assert groups == {False: [0, 0, 1, 0], True: [0, 0, 1, 2]}


def test_stateful_rules_row_by_row():
    rng = np.random.default_rng(3)
    ts = pd.to_datetime(np.sort(rng.integers(0, 5 * 86400, 200)), unit="s")
    rows = pd.DataFrame({"ts": ts.astype("datetime64[ns]"), "id": range(200), "metres": rng.random(200) * 150})
    accepted: list = []
    for t, i in zip(rows.ts.astype("int64") / 1e9, rows.id, strict=True):
        if sum(t - 86400 < a for a, _ in accepted) < 7:
            accepted.append((t, i))
    step, state, out = rules.rolling_cap(7), ([],), []
    for part in (rows[:50], rows[50:51], rows[51:]):  # micro-batches
        got, state = step(part, state)
        out += [i for (i,) in got]
    assert out == [i for _, i in accepted]
    armed, fired = True, []
    for i, m in zip(rows.id, rows.metres, strict=True):
        if armed and m <= 40:
            fired.append(i)
            armed = False
        armed = armed or m > 100
    first, state = rules.alerts()(rows[:77], (True,))
    second, _ = rules.alerts()(rows[77:], state)
    assert [i for (i,) in first + second] == fired
    at = pd.DataFrame({"ts": pd.to_datetime([0, 10, 11, 12, 13], unit="s").astype("datetime64[ns]"), "id": range(5), "x": [0.0, 3.0, 90.0, 5000.0, 5001.0], "y": [0.0] * 5})
    assert [w for _, w in rules.follow()(at, (0.0, 0.0, -1.0, 0.0, 0.0, -1.0))[0]] == ["moves", "stays", "moves", "waits", "moves"]


def test_backups_and_decisions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    sinks.backup({"t": df}, f"{tmp_path}/b")
    assert sorted(map(tuple, sinks.verified_backup(spark, f"{tmp_path}/b", "t", "k long, s string").collect())) == [(1, "a"), (2, None)]
    spark.createDataFrame([('{"k":3}',)], "value string").write.mode("append").option("compression", "gzip").text(f"{tmp_path}/b/t")
    try:
        sinks.verified_backup(spark, f"{tmp_path}/b", "t", "k long, s string")
    except ValueError:
        pass
    else:
        raise AssertionError("a changed backup was read")
