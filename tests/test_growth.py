"""Queries over crowded tables: the rows of the SQL, and no step that makes far more rows than there are."""

import os
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from growth import crowded, most_rows
from oracle import connect, rows
from pyspark.sql import functions as F

from sparkhaul.functions import geo
from sparkhaul.operators import evidence, places, routes
from sparkhaul.plans import catalog
from sparkhaul.plans import views as v
from sparkhaul.streaming import rules


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return crowded(tmp_path_factory.mktemp("crowded"), 40)  # 6,000 customers, 400 suppliers, 40,000 events


def test_gaps_are_rounded_like_the_sql(spark, tmp_path):
    """Two hours and 0.4 ms by the clock, rounded to two hours and 1 ms; two hours and 0.6 ms, rounded to two hours."""
    con = duckdb.connect()
    at = [(1, "2024-01-02 00:00:00.000200"), (1, "2024-01-02 02:00:00.000600"), (2, "2024-01-02 00:00:00.000700"), (2, "2024-01-02 02:00:00.001300"), (3, "2024-01-02 00:00:00"), (3, "2024-01-02 02:00:00")]
    told = ", ".join(f"({k}::BIGINT, TIMESTAMP '{ts}', {user}::BIGINT, 'click', 1e0, '{{\"k\": 1}}')" for k, (user, ts) in enumerate(at))
    con.execute(f"COPY (SELECT * FROM (VALUES {told}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("w04_click_before", "st10_click_pairs"):
        expected = connect(str(tmp_path)).execute(catalog.ORACLE[name])
        names = [d[0] for d in expected.description]
        found = catalog.QUERIES[name](spark, str(tmp_path))
        assert rows(found.columns, found.collect()) == rows(names, expected.fetchall())


@pytest.mark.parametrize("name, times", [("a11_review_work_list", 6), ("j23_census_by_street", 12), ("j22_census_number_band", 6), ("j30_street_lookup", 6), ("j34_complement_street_rescue", 6)])
def test_rows_grow_with_the_input(spark, folder, name, times):
    """No step makes more rows than `times` those of the larger table the query reads."""
    size = 40_000 if name.startswith("a11") else 6_000
    expected = connect(folder).execute(catalog.ORACLE[name])
    names = [d[0] for d in expected.description]
    found = {}
    most = most_rows(spark, lambda: found.update(rows=catalog.QUERIES[name](spark, folder).collect()))
    assert rows(list(found["rows"][0].asDict()), found["rows"]) == rows(names, expected.fetchall())
    assert most <= times * size, most


def test_row_before_across_micro_batches(spark, tmp_path, monkeypatch):
    """A key's first row of a micro-batch follows its last row of the ones before, also if the key was missing in between."""
    monkeypatch.setattr(rules, "FILES_PER_TRIGGER", 1)
    os.mkdir(tmp_path / "x.parquet")
    for k, part in enumerate([[("a", 1, 1), ("a", 3, 2), ("b", 2, 3)], [("b", 5, 4)], [("a", 7, 5), ("c", 7, 6)]]):
        path = tmp_path / "x.parquet" / f"part-{k}.parquet"
        pd.DataFrame([(key, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h), i) for key, h, i in part], columns=["key", "ts", "id"]).to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1e9 + k, 1e9 + k))
    found = rules.with_row_before(rules.event_stream(spark, str(tmp_path), "x"), ["key"], "before").collect()
    assert {r.id: r.id_before for r in found} == {1: None, 2: 1, 3: None, 4: 3, 5: 2, 6: None}


def test_rows_of_one_key_meet_the_next_end_only(spark, tmp_path):
    """40,000 rows of one key, none ended in time: seconds, not the square of the rows."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 'a' AS key, TIMESTAMP '2024-01-01' + to_seconds(k * 100) AS ts, k AS id, true AS starts, k % 2 = 9 OR k = 39_999 AS ends FROM range(40_000) t(k)) TO '{tmp_path}/x.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT 'a' AS key, TIMESTAMP '2024-01-01' + to_seconds(k * 100) AS ts, k AS id, k % 2 = 0 AS starts, k % 2 = 1 AS ends FROM range(40_000) t(k)) TO '{tmp_path}/y.parquet' (FORMAT parquet)")
    begun = time.monotonic()
    late = rules.written(rules.unfollowed(rules.event_stream(spark, str(tmp_path), "x"), ["key"], "key string, id long", 10), "late").count()
    held = rules.written(rules.unfollowed(rules.event_stream(spark, str(tmp_path), "y"), ["key"], "key string, id long", 10), "held").count()
    assert late > 39_000 and held > 19_000
    assert time.monotonic() - begun < 30


def test_crowded_targets_meet_few_points(spark):
    rng = np.random.default_rng(4)
    place = lambda n: [(k, float(y), float(x)) for k, (y, x) in enumerate(rng.random((n, 2)) * 0.005)]
    points, targets = place(1000), place(1000)
    found, schema = {}, "lat double, lng double"
    near = lambda: geo.nearest(spark.createDataFrame(points, f"k long, {schema}"), spark.createDataFrame(targets, f"t long, {schema}"), "k", "t").collect()
    most = most_rows(spark, lambda: found.update({r.k: r.r_t for r in near()}))
    at = np.array(targets)
    far = lambda p: np.hypot(at[:, 1] - p[1], (at[:, 2] - p[2]) * np.cos(np.radians(p[1])))
    assert found == {p[0]: int(np.argmin(far(p))) for p in points}
    assert most <= 40_000, most  # all pairs are 1,000,000


def test_closest_of_far_points(spark):
    """Points far from all targets, near them and among them; none meets all targets."""
    rng = np.random.default_rng(6)
    targets = [(k % 2, k, float(round(y, 3)), float(round(x, 3))) for k, (y, x) in enumerate(rng.random((4000, 2)))]
    points = [(k % 3, float(y), float(x)) for k, (y, x) in enumerate(np.concatenate([rng.random((100, 2)) + 30, rng.random((100, 2)), rng.random((100, 2)) * 2 - [3, 0.5]]))]
    df, schema = spark.createDataFrame(points, "k long, lat double, lng double"), "k long, t long, lat double, lng double"
    found = {}
    most = most_rows(spark, lambda: found.update({r[:3]: r.t for r in geo.closest(df, spark.createDataFrame(targets, schema), ["k"], "t").collect()}))
    far = lambda p: min(((t[2] - p[1]) ** 2 + (t[3] - p[2]) ** 2, t[1]) for t in targets if t[0] == p[0])[1]
    assert found == {p: far(p) for p in points if p[0] < 2}
    assert most <= 40_000, most  # all pairs of a key are 400,000


@pytest.mark.parametrize("columns, most", [(0, 800_000), (7, 60_000)])
def test_neighbours_are_counted_without_pairs(spark, columns, most):
    """2,000 doors in a square kilometre, at any longitude or in a few columns, some at one position."""
    rng = np.random.default_rng(10)
    doors = [(k, float(round(y, 4)) * 0.01 - 9.5, (float(x) if not columns else round(float(x) * columns) / columns) * 0.01 - 35.7) for k, (y, x) in enumerate(rng.random((2000, 2)))]
    doors += [(2000 + k, *doors[k][1:]) for k in range(50)]
    df = spark.createDataFrame(doors, "k long, lat double, lng double")
    found = {}
    rows = most_rows(spark, lambda: found.update({(r.lat, r.lng): r.near for r in geo.near_counts(df, 500.0).collect()}))
    at = np.array(doors)
    expected = {p[1:]: int((111320 * np.hypot(at[:, 1] - p[1], (at[:, 2] - p[2]) * np.cos(np.radians(p[1]))) <= 500).sum()) for p in doors}
    assert found == expected
    assert rows <= most, rows  # pairs are some 2,000,000


def test_points_meet_a_line_once(spark):
    rng = np.random.default_rng(5)
    points = [(k, float(y), float(x)) for k, (y, x) in enumerate(rng.random((1000, 2)) * 0.003)]
    lines = [(k, i, float(y), float(x)) for k in range(20) for i, (y, x) in enumerate(rng.random((3, 2)) * 0.003)]
    df, vertices = spark.createDataFrame(points, "k long, lat double, lng double"), spark.createDataFrame(lines, "seg long, i long, lat double, lng double")
    found = []
    most = most_rows(spark, lambda: found.extend(places.near_segments(df, vertices, "k", 300.0).collect()))
    assert len(found) == len({(r.k, r.seg) for r in found}) > 10_000
    assert most <= 20_000, most  # 1,000 points and 20 lines


def _metres_to_line(points, line):
    """Of each point (lat, lng) from the nearest edge of a line of vertices, in the plane at the point; edges with a missing end do not count."""
    far = np.full(len(points), np.inf)
    for (y1, x1), (y2, x2) in zip(line[:-1], line[1:], strict=True):
        if not np.isnan([y1, x1, y2, x2]).any():
            scale = 111320 * np.cos(np.radians(points[:, 0]))
            ax, ay, bx, by = (x1 - points[:, 1]) * scale, (y1 - points[:, 0]) * 111320, (x2 - points[:, 1]) * scale, (y2 - points[:, 0]) * 111320
            length = (bx - ax) ** 2 + (by - ay) ** 2
            t = np.clip(-(ax * (bx - ax) + ay * (by - ay)) / np.where(length == 0, 1, length), 0, 1)
            far = np.minimum(far, np.hypot(ax + t * (bx - ax), ay + t * (by - ay)))
    return far


@pytest.mark.parametrize("lat0", [-9.5, 0.0, 67.0])
def test_lines_of_all_shapes(spark, lat0):
    """Lines of short and of long edges, of many in a cell, without length, with a missing vertex; against each point and edge."""
    rng = np.random.default_rng(14)
    at = np.array([lat0, -35.7])
    steps = [(rng.normal(0, size, (n, 2))) for size, n in [(0.001, 3), (0.0001, 30), (0.02, 2), (0.0, 2), (0.0005, 9)] * 8]
    lines = [at + rng.random(2) * 0.03 + np.cumsum(s, 0) for s in steps]
    lines[4][4] = np.nan
    points = np.concatenate([at + rng.random((600, 2)) * 0.04 - 0.005, np.concatenate(lines[:3])])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)] + [(-1, None, -35.7)], "k long, lat double, lng double")
    vertices = spark.createDataFrame([(k, i, *(None if np.isnan(c) else float(c) for c in v)) for k, line in enumerate(lines) for i, v in enumerate(line)], "seg long, i long, lat double, lng double")
    for metres, cell in ((300.0, None), (20.0, 40.0)):
        found = {(r.k, r.seg): r.metres for r in places.near_segments(df, vertices, "k", metres, cell).collect()}
        expected = {(k, s): m for s, line in enumerate(lines) for k, m in enumerate(_metres_to_line(points, line)) if m <= metres}
        assert found.keys() == expected.keys() and len(found) > 50
        assert max(abs(found[p] - expected[p]) for p in found) < 1e-6


def test_few_points_meet_a_line_in_vain(spark):
    """Lines of three edges over 25 square kilometres: pairs made are no more than twice those found."""
    rng = np.random.default_rng(15)
    points = [(k, float(y), float(x)) for k, (y, x) in enumerate(rng.random((3000, 2)) * 0.045)]
    lines = [(k, i, float(y) + 0.0008 * i, float(x) + 0.001 * i) for k, (y, x) in enumerate(rng.random((300, 2)) * 0.045) for i in range(4)]
    df, vertices = spark.createDataFrame(points, "k long, lat double, lng double"), spark.createDataFrame(lines, "seg long, i long, lat double, lng double")
    found = {}
    most = most_rows(spark, lambda: found.update({(r.k, r.seg): r.metres for r in places.near_segments(df, vertices, "k", 300.0).collect()}))
    assert 15_000 < len(found) and most <= 2 * len(found), (most, len(found))


@pytest.mark.parametrize("name", ["j20_points_near_lines", "j21_lines_in_the_same_street"])
def test_distances_are_worked_out_once(spark, folder, name):
    """The rows of the SQL; the cosine of a distance is not in its formula as often as the formula's parts come."""
    expected = connect(folder).execute(catalog.ORACLE[name])
    names = [d[0] for d in expected.description]
    found = catalog.QUERIES[name](spark, folder)
    assert rows(found.columns, found.collect()) == rows(names, expected.fetchall())
    assert max(line.count("COS(") for line in found._jdf.queryExecution().executedPlan().toString().splitlines()) <= 4


def test_visits_of_a_long_route_take_seconds():
    class Frame(pd.DataFrame):  # what the operator asks of a DataFrame, for one route
        select = lambda self, *_: self
        groupBy = lambda self, *_: self
        applyInPandas = lambda self, run, _: run(pd.DataFrame(self))

    n = 400
    stops = {"route": 1, "stop": range(n), "seq": range(n), "carrier": range(n), "address_key": [str(k) for k in range(n)], "lat": [k % 200 / 100 for k in range(n)], "lng": 0.0}
    begun = time.monotonic()
    assert routes.visits(Frame(stops)).visit.tolist() == [k % 200 for k in range(n)]
    assert time.monotonic() - begun < 1


@pytest.mark.parametrize("name", ["a28_isolated_stops", "a28_far_from_district"])
def test_routes_of_the_whole_job(name):
    """Routes grow with the stops here, in the SQL as in the query; both are compared with each other in test_catalog."""
    assert "c_custkey % 60 AS route" in catalog.ORACLE[name] and "c_custkey / 60" not in catalog.ORACLE[name].split("AS seq")[0]


def test_stops_meet_centres_not_each_other(spark):
    """Groups of odd and even size, with ties and missing positions, against each stop's others one by one; 3,000 rows are some 2,000,000 pairs."""
    rng = np.random.default_rng(12)
    stops, stop = [], 0
    for group, n in enumerate([1001, 1000, 999, 3, 4, 5, 6]):
        for y, x in rng.normal(0, 0.03, (n, 2)).round(3):
            stop += 1
            stops.append((group, stop, None if stop % 50 == 7 else float(y) - 9.5, None if stop % 70 == 9 else float(x) - 35.7))
    df = spark.createDataFrame(stops, "route long, stop long, lat double, lng double")
    found = {}
    most = most_rows(spark, lambda: found.update({r.stop: r.others for r in evidence.far_from_others(df, ["route"], least=3).collect()}))

    def metres(lat, lng, lat0, lng0):
        a = np.sin(np.radians(lat0 - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lat0)) * np.sin(np.radians(lng0 - lng) / 2) ** 2
        return 2 * 6371000 * np.arcsin(np.fmin(1, np.sqrt(a)))  # as in the SQL, a missing position is as far as can be

    expected = {}
    for group in range(7):
        own = [s for s in stops if s[0] == group]
        at = np.array([s[2:] for s in own], float)
        for k, (_, stop, *_) in enumerate(own):
            others = np.delete(at, k, 0)
            if len(others) >= 3:
                mid = np.nanmedian(others, 0)
                if metres(*at[k], *mid) > 5000 and np.median(metres(others[:, 0], others[:, 1], *mid)) <= 6000:
                    expected[stop] = len(others)
    assert found == expected and 100 < len(found) < 2900
    assert most <= 100_000, most


def test_addresses_are_taken_apart_in_all_tasks(spark):
    """A table of one file is read in one task; its lines are taken apart in as many as a shuffle has."""
    one = spark.range(400).selectExpr("id", "concat('Rua ', id, ', 12') AS address").coalesce(1)
    sizes = [r.n for r in v.addressed(one).select(F.spark_partition_id().alias("p"), "parts").groupBy("p").agg(F.count("parts.street").alias("n")).collect()]
    assert sorted(sizes) == [100] * 4


def test_sightings_meet_no_spots(spark):
    """4,000 sightings of 200 spots, most of them near each other: driver-days are counted without a row for each spot around."""
    rng = np.random.default_rng(9)
    marks = [(str(k % 2), int(d), int(y), -10.9 + int(a) / 10000, -37.05 + int(x) / 10000, k) for k, (d, y, a, x) in enumerate(zip(rng.integers(0, 40, 4000), rng.integers(0, 30, 4000), rng.integers(0, 33, 4000), rng.integers(0, 3, 4000), strict=True))]
    df = spark.createDataFrame(marks, "place string, driver long, d long, lat double, lng double, id long").selectExpr("*", "date_add(DATE '2024-01-01', CAST(d AS INT)) AS day", "timestamp_seconds(id) AS happened")
    found = {}
    most = most_rows(spark, lambda: found.update({r.place: (r.lat, r.lng, r.seen) for r in evidence.named_places(df).collect()}))
    for place in "01":
        own = [m for m in marks if m[0] == place]
        rated = {}
        for m in own:
            lat, lng = m[3:5]
            if (lat, lng) not in rated:
                rated[lat, lng] = len({o[1:3] for o in own if 111320 * np.hypot(o[3] - lat, (o[4] - lng) * np.cos(np.radians(lat))) <= 120})
        best = max(own, key=lambda m: (rated[m[3:5]], m[5]))
        assert found[place] == (*best[3:5], rated[best[3:5]])
    assert most <= 25_000, most  # sightings and spots around them are some 170,000


def test_readings_of_many_documents(spark):
    """Lines of 3,000 documents against the rules written plainly; Spark does the work, not a function for each document."""
    rng = np.random.default_rng(8)
    lines = [(int(d), int(r), f"Rua {'|©é²'[k % 4] * int(r)} {k % 3}", f"door {k % 2}", ("", "ap1", "ap2")[int(u)]) for k, (d, r, u) in enumerate(rng.integers(0, (3000, 3, 3), (12_000, 3)))]
    linked = routes.linked_readings(spark.createDataFrame(lines, "document long, reading long, line string, door string, unit string"))
    assert "Pandas" not in linked._jdf.queryExecution().executedPlan().toString()
    found = Counter(map(tuple, linked.collect()))
    doors, expected = {}, Counter()
    for d, r, line, door, unit in lines:
        doors.setdefault((d, door), {}).setdefault(unit, []).append((r, line))
    for (d, _), units in doors.items():
        named = [u for u in units if u]
        if "" in units and len(named) == 1 and not {r for r, _ in units[""]} & {r for r, _ in units[named[0]]}:
            units[named[0]] += units.pop("")
        for g in units.values():
            best = min((sum(not (c.isalnum() or c.isspace() or c in "_,.-/") for c in line), -len(line), line) for _, line in g)[2]
            expected[d, best, len({r for r, _ in g})] += max(Counter(r for r, _ in g).values())
    assert found == expected
