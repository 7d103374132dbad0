"""Order statistics by selection against sorting, with one key that holds most rows."""

import math
import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from sparkhaul.operators import ranks


def groups():
    rng = random.Random(4)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 1e-9 * rng.random(), 5.0, 1e12 * rng.random()])) for _ in range(9000)]
    rows += [(f"k{k % 60}", float(rng.randint(-3, 3))) for k in range(900)] + [("one", 7.5), ("two", 1.0), ("two", 2.0), ("none", None), ("same", 3.0), ("hot", None)] + [("same", 3.0)] * 300
    return rows


@pytest.mark.parametrize(("few", "bins"), [(50_000, 1024), (40, 16), (1, 2)])
def test_against_sorting(spark, few, bins):
    rows = groups() if bins > 2 else groups()[:400] + groups()[9000:]
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    places = [(k, p) for k in {k for k, _ in rows} for p in {-1, 0, len(values[k]) // 3, len(values[k]) - 1, len(values[k])}]
    found = ranks.values_at(df, ["key"], "v", spark.createDataFrame(places, "key string, place long"), few, bins).collect()
    assert {(r.key, r.place): r.v for r in found} == {(k, p): sorted(values[k])[p] for k, p in places if 0 <= p < len(values[k])}
    assert len(found) == len({(r.key, r.place) for r in found})


def test_medians_and_places(spark):
    rows = groups()
    df = spark.createDataFrame([(k, v, None if v is None else -2 * v) for k, v in rows], "key string, v double, w double")
    found = {r.key: r for r in ranks.medians(df, ["key"], ["v", "w"], few=100).collect()}
    values = defaultdict(list)
    for k, v in rows:
        values[k] += [] if v is None else [v]
    assert set(found) == set(values) and found["none"].v is None and found["none"].n == 1
    assert all(math.isclose(found[k].v, median(x)) and math.isclose(found[k].w, -2 * median(x)) for k, x in values.items() if x)
    p90 = {r.key: r.v for r in ranks.value_at(df, ["key"], "v", F.ceil(F.col("n") * 0.9) - 1, few=100).collect()}
    assert p90 == {k: sorted(x)[math.ceil(len(x) * 0.9) - 1] for k, x in values.items() if x}
