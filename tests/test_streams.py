"""Streams: the same rows however the input falls into files and micro-batches, and the rules case by case."""

import os
from collections import Counter

import pandas as pd
import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from sparkhaul.plans import catalog
from sparkhaul.streaming import rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=[1, 2, 8])
def folder(request, tmp_path_factory):
    """The events in files of following times, with the oldest first; and their number."""
    top = tmp_path_factory.mktemp(f"events{request.param}")
    os.mkdir(top / "events.parquet")
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values("ts")
    for k in range(request.param):
        part = events.iloc[k * len(events) // request.param : (k + 1) * len(events) // request.param]
        path = top / "events.parquet" / f"part-{k}.parquet"
        part.to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1e9 + k, 1e9 + k))
    return str(top)


@pytest.mark.parametrize("name", ["st04_days_in_bounds", "st05_held_then_sent", "st08_rolling_cap", "st09_expired_places", "st11_followed_positions", "st13_idle_alerts"])
def test_any_split_into_files(spark, monkeypatch, folder, name):
    monkeypatch.setattr(rules, "FILES_PER_TRIGGER", 1)
    expected = connect(SF).execute(catalog.ORACLE[name])
    names = [d[0] for d in expected.description]
    found = catalog.QUERIES[name](spark, folder)
    got = rows(found.columns, found.collect())
    assert got == rows(names, expected.fetchall()) and got


def follow(*readings):
    """readings: seconds, metres east."""
    frame = pd.DataFrame({"ts": pd.to_datetime([int(s * 1e9) for s, _ in readings]), "id": range(len(readings)), "x": [float(x) for _, x in readings], "y": 0.0})
    return [what for _, what in rules.follow()(frame, (0.0, 0.0, -1.0, 0.0, 0.0, -1.0))[0]]


def test_following():
    assert follow((0, 0), (1, 4), (2, 6)) == ["moves", "stays", "moves"]
    assert follow((0, 0), (10, 10_000), (12, 10_090)) == ["moves", "waits", "moves"]  # a second reading not too fast since the suspect
    assert follow((0, 0), (10, 10_000), (11, 10_090)) == ["moves", "waits", "waits"]  # 90 m/s since the suspect
    assert follow((0, 0), (0.1, 20)) == ["moves", "moves"]  # a second is the least time counted
    assert follow((0, 0), (10, 10_000), (20, 0), (30, 10_000)) == ["moves", "waits", "stays", "waits"]  # staying clears the suspect
    assert follow((0, 0), (100, 3), (101, 503)) == ["moves", "stays", "moves"]  # and keeps the time of the last move
    assert follow((0, 0), (10, 10_000), (10, 10_010)) == ["moves", "waits", "waits"]  # at the suspect's own time


def test_held_rows_go_without_another_row(spark, tmp_path):
    """A timer releases what is held when another key's rows bring the watermark on; an end beyond the deadline is no end."""
    hours = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    parts = [
        [("a", 0, 1, True, False), ("b", 0, 2, True, False), ("c", 0, 3, True, False), ("d", 1, 4, True, False)],
        [("b", 3, 5, False, True), ("c", 12, 6, False, True), ("d", 0.5, 7, False, True)],  # d's end is before its start
        [("z", 40, 8, True, False)],
    ]
    os.mkdir(tmp_path / "x.parquet")
    for k, part in enumerate(parts):
        path = tmp_path / "x.parquet" / f"part-{k}.parquet"
        pd.DataFrame([(key, hours(h), i, s, e) for key, h, i, s, e in part], columns=["key", "ts", "id", "starts", "ends"]).to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema("key string, ts timestamp_ntz, id long, starts boolean, ends boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "x.parquet"))
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    found = rules.written(rules.unfollowed(stream, ["key"], "key string, id long", 10 * 3600, "4 hours"), "timers").collect()
    assert Counter(map(tuple, found)) == Counter([("a", 1), ("c", 3), ("d", 4)])


def test_batches_whole_or_not(spark, tmp_path):
    os.mkdir(tmp_path / "x.parquet")
    parts = [[(1, 10, False, 3), (2, 20, False, 1), (3, 30, True, 2)], [(1, 11, False, 3), (1, 10, False, 3)], [(3, 31, False, 2), (1, 12, False, 3), (4, 40, False, 2), (2, 20, False, 1)]]
    for k, part in enumerate(parts):
        path = tmp_path / "x.parquet" / f"part-{k}.parquet"
        pd.DataFrame(part, columns=["request", "id", "bad", "size"]).to_parquet(path, index=False)
        os.utime(path, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema("request long, id long, bad boolean, size long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "x.parquet"))
    found = rules.written(rules.whole_or_not(stream, ["request"], "request long, id long"), "batches").collect()
    assert Counter(map(tuple, found)) == Counter([(1, 10), (1, 11), (1, 12), (2, 20)])
