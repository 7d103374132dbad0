"""First fit in rounds against the one-by-one rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkhaul.functions.geo import EARTH_M, nearest
from sparkhaul.operators import merging


def metres(a, b):
    (lat1, lng1), (lat2, lng2) = (map(math.radians, x) for x in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("reach", [30.0, 150.0, 2000.0])
def test_first_fit(spark, reach):
    rng = random.Random(5)
    points = []
    for group in "ab":  # the same ids in both groups
        points += [(group, k, rng.randint(0, 5), -9.5 + rng.gauss(0, 0.002), -35.7 + rng.gauss(0, 0.002)) for k in range(150)]
        points += [(group, 150 + k, k % 3, -9.6 + 0.0003 * k, -35.7) for k in range(60)]  # a chain, each near the next
        points += [(group, 300 + k, 9 - k % 4, -9.7, -35.7) for k in range(50)]  # one place
    expected = {}
    for group in "ab":
        heads = []
        for _, k, _, lat, lng in sorted((p for p in points if p[0] == group), key=lambda p: (p[2], p[1])):
            first = next((i for i, at in heads if metres(at, (lat, lng)) <= reach), None)
            if first is None:
                heads.append((k, (lat, lng)))
            expected[group, k] = k if first is None else first
    df = spark.createDataFrame(points, "route string, stop long, seq long, lat double, lng double").repartition(3)
    found = {(r.route, r.stop): r.head for r in merging.first_fit(df, ["route"], "stop", ["seq"], reach).collect()}
    assert found == expected


def test_nearest_of_equal_keys(spark):
    rng = random.Random(6)
    at = lambda: (-9.5 + rng.gauss(0, 0.05), -35.7 + rng.gauss(0, 0.05))
    points, targets = [(k, k % 3, *at()) for k in range(80)], [(k, k % 2, *at()) for k in range(40)]
    df, to = spark.createDataFrame(points, "stop long, driver long, lat double, lng double"), spark.createDataFrame(targets, "seg long, driver long, lat double, lng double")
    found = {r.stop: r.metres for r in nearest(df, to, "stop", "seg", keys=("driver",)).collect()}
    flat = lambda a, b: 111320.0 * math.hypot(b[0] - a[0], (b[1] - a[1]) * math.cos(math.radians(a[0])))
    expected = {k: min(flat((la, ln), (y, x)) for _, e, y, x in targets if e == d) for k, d, la, ln in points if d < 2}
    assert found.keys() == expected.keys() and all(math.isclose(found[k], expected[k], rel_tol=1e-9) for k in expected)
    close = nearest(df, to, "stop", "seg", most_m=1000.0, keys=("driver",)).agg(F.max("metres")).first()[0]
    assert close <= 1000.0 and {k for k, m in expected.items() if m <= 1000.0}
