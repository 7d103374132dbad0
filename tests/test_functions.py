import math
import random
import re

from pyspark.sql import functions as F

from sparkhaul.functions import geo, text
from sparkhaul.operators import relational as rel


def test_text_functions(spark):
    df = spark.createDataFrame([("  São  JOSÉ\tda Laje ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.normal("t")).collect()] == ["sao jose da laje", None, ""]
    pairs = spark.createDataFrame([("casa", "caso"), ("pedra", "pedro"), ("x", "x"), ("pedro", "pedra1")], "a string, b string")
    assert [r[0] for r in pairs.select(text.almost_equal(F.col("a"), F.col("b"))).collect()] == [False, True, True, False]
    codes = spark.createDataFrame([("ffffffffffffffff",), ("0x1",), ("",)], "h string")
    assert [r[0] for r in codes.select(text.hex_to_decimal("h")).collect()] == ["18446744073709551615", None, None]


def test_within_equals_all_pairs(spark):
    points = [(k % 2, k, -9.5 + (k * 37 % 101) / 20000, -35.7 + (k * 53 % 97) / 20000) for k in range(120)]
    df = spark.createDataFrame(points, "key int, id int, lat double, lng double")
    found = {(r.id, r.r_id) for r in geo.within(df, df, 90.0, ["key"]).collect()}

    def metres(a, b):
        return 111320 * math.hypot(b[2] - a[2], (b[3] - a[3]) * math.cos(math.radians(a[2])))

    assert found == {(a[1], b[1]) for a in points for b in points if a[0] == b[0] and metres(a, b) <= 90}


def test_segment_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.001, -0.001, 0.001, 0.001), (0.0, 0.0, 0.001, 0.0, 0.001, 0.0), (0.0, 0.0, 0.003, 0.004, 0.006, 0.008)], "a double, b double, c double, d double, e double, f double")
    assert [round(r[0], 2) for r in df.select(geo.segment_distance("a", "b", "c", "d", "e", "f")).collect()] == [111.32, 111.32, 556.6]


def test_replayed_merge_changes_nothing(spark):
    old = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n long")
    new = spark.createDataFrame([("a", 2), ("c", 5)], "k string, n long")
    once = rel.merge_greatest(old, new, ["k"], ["n"])
    assert sorted(map(tuple, once.collect())) == [("a", 3), ("b", 1), ("c", 5)]
    assert sorted(map(tuple, rel.merge_greatest(once, new, ["k"], ["n"]).collect())) == sorted(map(tuple, once.collect()))


def test_fuzzy_best_sees_every_name(spark):
    known = ["rua das laranjeiras", "avenida jorge arruda", "avenida jorge arrufa", "rua 39 de novembro", "praca do sol", "rua sete"]
    wrong = ["xya das laranjeiras", "avenida jorge arrula", "rua 38 de novembro", "raca dosol", "rua set", "praca do sol"]
    names, candidates = spark.createDataFrame([(w,) for w in wrong], "name string"), spark.createDataFrame([(k,) for k in known], "candidate string")
    found = sorted(map(tuple, rel.fuzzy_best(names, candidates).collect()))
    assert found == [("raca dosol", "praca do sol", 2), ("xya das laranjeiras", "rua das laranjeiras", 2)]


def test_fuzzy_best_equals_all_pairs(spark):
    rng = random.Random(3)
    known = sorted({"".join(rng.choice("abcd1") for _ in range(rng.randint(6, 24))) for _ in range(60)})
    wrong = [*known[:10], *("".join(c for c in k if rng.random() > 0.12) + rng.choice(["", "a", "bc"]) for k in known)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
        return row[-1]

    expected = set()
    for w in set(wrong):
        (first, best), (second, _) = sorted((edits(w, k), k) for k in known if k != w)[:2]
        if len(w) >= 8 and 100 * first <= 35 * len(w) and second - first >= 3 and re.findall("[0-9]+", w) == re.findall("[0-9]+", best):
            expected.add((w, best, first))
    names, candidates = spark.createDataFrame([(w,) for w in wrong], "name string"), spark.createDataFrame([(k,) for k in known], "candidate string")
    assert len(expected) >= 10 and {tuple(r) for r in rel.fuzzy_best(names, candidates).collect()} == expected
