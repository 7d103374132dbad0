"""The index against scans, and what its queries read."""

import random

from growth import most_rows
from sparkhaul.operators import trigrams


def test_pieces_of_words(spark):
    rng = random.Random(3)
    words = [("ab"[k % 2], "".join(rng.choice("abcé1") for _ in range(rng.randint(1, 7))), k % 40, k % 5 == 0) for k in range(400)]
    entries = spark.createDataFrame([*words, ("a", None, 1, False), ("a", "", 2, False), words[0], words[0]], "kind string, word string, key long, whole boolean")
    asked = [(k, p, w) for k in "abz" for p in {w[i : i + n] for _, w, _, _ in words[:60] for n in (1, 2, 3, 5) for i in (0, 1)} | {"zzz", "é1zz", ""} for w in (False, True)]
    found = trigrams.find(trigrams.build(entries), spark.createDataFrame(asked, "kind string, piece string, whole boolean")).collect()
    expected = {(k, p, whole, key) for k, p, whole in asked if p for kind, w, key, only in words if kind == k and (w == p if whole else p in w and not only)}
    by_whole = {(k, p, whole, key) for k, p, whole in asked if whole and p for kind, w, key, _ in words if kind == k and w == p}
    assert {tuple(r) for r in found} == expected | by_whole and len(found) == len({tuple(r) for r in found})


def test_a_query_reads_its_buckets_only(spark):
    texts = spark.range(5000).selectExpr("id AS key", "'name' AS kind", "concat('w', id % 700, 'x') AS word", "false AS whole")
    index = trigrams.build(texts)
    asked = spark.createDataFrame([("name", "699", False)], "kind string, piece string, whole boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = trigrams.find(index, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 3 and all("Bucketed: true" in line for line in scans)  # counts, grams, holders; never the texts
    lines = plan.splitlines()
    for k, line in enumerate(lines):  # no table of the index is shuffled: only filters and projections lie between a scan and its join
        if "FileScan" in line:
            above = next(x for x in reversed(lines[:k]) if "Exchange" in x or "Join" in x or "Sort " in x)
            assert "Exchange" not in above, plan
    assert sorted(r.key % 700 for r in trigrams.find(index, asked).collect()) == [699] * 7


def test_rules_of_the_search(spark):
    stops = spark.createDataFrame([(1, "rua das flores 12 apto 3b", "centro", "49000001", ["BR123456X"], [40, 7]), (2, "avenida 40", "flores", "49000999", [], [2]), (3, "", "", None, None, [12])], "stop long, text string, district string, cep string, codes array<string>, numbers array<long>")
    said = {"flores": {1, 2}, "flor 12": {1}, "12": {1, 3}, "#12": {3}, "40": {1, 2}, "#40": {1}, "345": set(), "3456": {1}, "br12": {1}, "br": set(), "49000": {1, 2}, "00099": {2}, "4900": set(), "3b": {1}, "#": set(), "": set(), "lore ua": {1}, "ua centro 7": {1}, "nada": set(), "##": set()}
    queries = spark.createDataFrame(list(enumerate(said)), "query long, said string")
    found: dict = {}
    for r in trigrams.found_by_all(trigrams.build(trigrams.stop_entries(stops)), trigrams.stop_queries(queries)).collect():
        found.setdefault(r.query, set()).add(r.key)
    assert {s: found.get(k, set()) for k, s in enumerate(said)} == said


def test_equal_queries_and_frequent_words(spark):
    """300 queries of two words, one of which every row has: no step makes a row for each query and row."""
    texts = spark.range(2000).selectExpr("id AS key", "'name' AS kind", "explode(array('every', concat('n', id % 100))) AS word", "false AS whole")
    queries = spark.range(300).selectExpr("id AS query", "explode(array('every', concat('n', 50 + id % 3))) AS word").selectExpr("query", "word", "'name' AS kind", "word AS piece", "false AS whole")
    found = {}
    most = most_rows(spark, lambda: found.update(rows=trigrams.found_by_all(trigrams.build(texts), queries).collect()))
    assert {(r.query, r.key) for r in found["rows"]} == {(q, k) for q in range(300) for k in range(2000) if k % 100 == 50 + q % 3} and len(found["rows"]) == 6000
    assert most <= 12_000, most  # 300 x 2,000 are 600,000
