"""Queries over names and free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address as a
from ..functions import text as t
from ..operators import relational as rel
from ..operators import trigrams as tri
from ..scratch import settled
from ..session import load
from . import views as v

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _norm(column: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({column})), '\\s+', ' ', 'g'))"


def _words(column: str) -> str:
    return f"list_filter(string_split({_norm(column)}, ' '), lambda w: w <> '')"


@query("f04_substring_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' ORDER BY p_partkey LIMIT 80")
def _(spark, sf):
    return load(spark, sf, "part").where(F.col("p_name").ilike("%RING%")).orderBy("p_partkey").limit(80).select("p_partkey", "p_name")


@query("f06_word_search", "SELECT p_partkey FROM part WHERE list_bool_and(list_transform(['red', 'eco'], lambda w: contains(lower(p_name), w) OR contains(lower(p_type), w)))")
def _(spark, sf):
    wanted = F.array(F.lit("red"), F.lit("eco"))
    return load(spark, sf, "part").where(F.forall(wanted, lambda w: F.contains(F.lower("p_name"), w) | F.contains(F.lower("p_type"), w))).select("p_partkey")


_SAID = (
    "CASE s_suppkey % 8 WHEN 0 THEN 'Flôres, ' || (s_suppkey % 500) WHEN 1 THEN '#' || (s_suppkey % 25) WHEN 2 THEN 'cen Dez 4900' || (s_suppkey % 3) WHEN 3 THEN 'br' || (s_suppkey * 7 % 1000)"
    " WHEN 4 THEN CAST(1000 + s_suppkey % 9000 AS VARCHAR) WHEN 5 THEN 'CARLOS-padaria' WHEN 6 THEN 'bloco x # casa' ELSE 'à ' || (s_suppkey % 100) END"
)
_PLAIN = "trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^a-z0-9{}]', ' ', 'g'), ' +', ' ', 'g'))"


@query("f06_stops_found", f"""WITH {v.STOPS}, q AS (SELECT s_suppkey AS query, {_PLAIN.format(_SAID, '# ')} AS said FROM supplier),
s AS (SELECT stop, {_PLAIN.format('address', ' ')} || ' ' || {_PLAIN.format('district', ' ')} AS t, CAST(cep AS VARCHAR) AS cep, 'br' || (stop * 37) || 'x' AS code, seq, carrier FROM stops),
w AS (SELECT query, word, regexp_replace(word, '^#', '') AS piece FROM (SELECT query, unnest(string_split(said, ' ')) AS word FROM q) WHERE regexp_replace(word, '^#', '') <> ''),
hit AS (SELECT DISTINCT query, word, stop FROM w, s WHERE CASE WHEN regexp_full_match(piece, '[0-9]+')
  THEN (NOT starts_with(word, '#') AND list_contains(regexp_extract_all(t, '[0-9]+'), piece)) OR piece = CAST(seq AS VARCHAR) OR piece = CAST(carrier AS VARCHAR) OR (length(piece) >= 4 AND contains(code, piece)) OR (length(piece) >= 5 AND contains(cep, piece))
  ELSE contains(t, piece) OR (regexp_matches(piece, '[0-9]') AND contains(code, piece)) END)
SELECT query, stop AS key FROM hit JOIN (SELECT query, count(DISTINCT word) AS n FROM w GROUP BY query) USING (query) GROUP BY query, stop, n HAVING count(*) = n""")
def _(spark, sf):
    s = v.stops(spark, sf).select("stop", a.plain("address").alias("text"), a.plain("district").alias("district"), F.col("cep").cast("string").alias("cep"), F.expr("array('BR' || (stop * 37) || 'X')").alias("codes"), F.array("seq", "carrier").alias("numbers"))
    said = F.regexp_replace(t.normal(F.expr(_SAID.replace("VARCHAR", "STRING"))), "[^a-z0-9# ]", " ")
    asked = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("query"), said.alias("said"))
    return tri.found_by_all(tri.build(tri.stop_entries(settled(s, "searched"))), tri.stop_queries(asked))


@query("f04_indexed_search", "WITH q AS (SELECT DISTINCT substr(unnest(string_split(p_name, ' ')), 2, 3) AS piece FROM part) SELECT piece, p_partkey AS key FROM q JOIN part ON contains(p_name, piece) WHERE piece <> ''")
def _(spark, sf):
    names = load(spark, sf, "part").select(F.lit("name").alias("kind"), F.explode(F.split("p_name", " ")).alias("word"), F.col("p_partkey").alias("key"), F.lit(False).alias("whole"))
    asked = names.select("kind", F.substring("word", 2, 3).alias("piece"), "whole").distinct()
    return tri.find(tri.build(names), asked).select("piece", "key")


@query("x01_normal_text", f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(t.normal("text")).alias("digest"))


@query("x03_coordinates_in_text", r"SELECT page_id, regexp_extract(url, '([0-9]+)', 1) AS first_number, len(regexp_extract_all(html, '-?[0-9]+[.][0-9]+')) AS decimals FROM pages")
def _(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.regexp_extract("url", "([0-9]+)", 1).alias("first_number"), F.size(F.regexp_extract_all("html", F.lit("-?[0-9]+[.][0-9]+"), F.lit(0))).cast("long").alias("decimals"))


@query("x08_letter_share", "SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS letters, length(coalesce(text, '')) AS chars FROM documents")
def _(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return load(spark, sf, "documents").select("doc_id", F.length(F.regexp_replace(text, "[^A-Za-z]", "")).cast("long").alias("letters"), F.length(text).cast("long").alias("chars"))


@query("x09_street_words", f"SELECT p_partkey, list_sort(list_distinct({_words('p_name')})) AS keys FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.array_sort(F.array_distinct(t.words("p_name"))).alias("keys"))


@query("x12_edit_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS edits FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark, sf):
    n = load(spark, sf, "nation")
    b = n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("name_b"))
    return n.join(b, "n_regionkey").where("n_nationkey < b").select(F.col("n_nationkey").alias("a"), "b", F.levenshtein("n_name", "name_b").cast("long").alias("edits"))


_PII = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


@query("x29_secret_scan", f"SELECT doc_id, len(regexp_extract_all(text, '{_PII}')) AS addresses FROM documents WHERE regexp_matches(text, '{_PII}')")
def _(spark, sf):
    found = load(spark, sf, "documents").where(F.col("text").rlike(_PII))
    return found.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(_PII), F.lit(0))).cast("long").alias("addresses"))


@query("k05_hex_to_decimal", "SELECT doc_id, CAST(('0x' || left(md5(coalesce(text, '')), 16))::UBIGINT AS VARCHAR) AS code FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", t.hex_to_decimal(F.left(F.md5(F.coalesce("text", F.lit(""))), F.lit(16))).alias("code"))


_NEAR = "levenshtein(a.name, b.name) <= 0.35 * length(a.name) AND a.name <> b.name"


@query("j24_fuzzy_best_match", f"""WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part),
d AS (SELECT a.name, b.name AS candidate, levenshtein(a.name, b.name) AS edits, row_number() OVER (PARTITION BY a.name ORDER BY levenshtein(a.name, b.name), b.name) AS r FROM n a JOIN n b ON {_NEAR} WHERE length(a.name) >= 8)
SELECT a.name, a.candidate, a.edits, b.edits - a.edits AS margin FROM d a LEFT JOIN d b ON a.name = b.name AND b.r = 2 WHERE a.r = 1""")
def _(spark, sf):
    names = load(spark, sf, "part").selectExpr("p_name || ' ' || lower(p_type) AS name").distinct()
    two = rel.fuzzy_two(names, names.withColumnRenamed("name", "candidate"), 0)
    near = two.where(F.col("edits") * 100 <= F.length("name") * 35)
    second = F.when(F.col("second") * 100 <= F.length("name") * 35, F.col("second"))
    return near.select("name", "candidate", "edits", (second - F.col("edits")).alias("margin"))


@query("j24_fuzzy_best_of_all", """WITH n AS (SELECT DISTINCT p_name AS name FROM part),
d AS (SELECT a.name, b.name AS candidate, levenshtein(a.name, b.name) AS edits, row_number() OVER (PARTITION BY a.name ORDER BY levenshtein(a.name, b.name), b.name) AS r FROM n a JOIN n b ON a.name <> b.name)
SELECT a.name, a.candidate, a.edits FROM d a LEFT JOIN d b ON a.name = b.name AND b.r = 2 WHERE a.r = 1 AND length(a.name) >= 8 AND a.edits <= 0.35 * length(a.name) AND coalesce(b.edits - a.edits, 3) >= 3
AND array_to_string(regexp_extract_all(a.name, '[0-9]+'), ' ') = array_to_string(regexp_extract_all(a.candidate, '[0-9]+'), ' ')""")
def _(spark, sf):
    names = load(spark, sf, "part")
    return rel.fuzzy_best(names.select(F.col("p_name").alias("name")), names.select(F.col("p_name").alias("candidate")))


@query("j24_door_must_exist", f"""WITH {v.STOPS}, n AS (SELECT DISTINCT lower(street) || ' ' || lower(district) AS name FROM stops), q AS (SELECT stop, number, cep, lower(replace(street, 'e', 'ee')) || ' ' || lower(district) AS name FROM stops),
c AS (SELECT DISTINCT name FROM q), d AS (SELECT c.name, n.name AS candidate, levenshtein(c.name, n.name) AS edits, row_number() OVER (PARTITION BY c.name ORDER BY levenshtein(c.name, n.name), n.name) AS r FROM c JOIN n ON c.name <> n.name),
b AS (SELECT x.name, x.candidate, x.edits FROM d x LEFT JOIN d y ON x.name = y.name AND y.r = 2 WHERE x.r = 1 AND length(x.name) >= 8 AND x.edits <= 0.35 * length(x.name) AND coalesce(y.edits - x.edits, 3) >= 3
  AND array_to_string(regexp_extract_all(x.name, '[0-9]+'), ' ') = array_to_string(regexp_extract_all(x.candidate, '[0-9]+'), ' '))
SELECT q.stop, b.candidate FROM q JOIN b USING (name) WHERE EXISTS (SELECT 1 FROM stops s WHERE lower(s.street) || ' ' || lower(s.district) = b.candidate AND s.number = q.number AND s.cep = q.cep)""")
def _(spark, sf):
    s = v.stops(spark, sf)
    known = s.selectExpr("lower(street) || ' ' || lower(district) AS candidate", "number", "cep").distinct()
    q = s.selectExpr("stop", "number", "cep", "lower(replace(street, 'e', 'ee')) || ' ' || lower(district) AS name")
    best = rel.fuzzy_best(q.select("name"), known.select("candidate"))
    return q.join(best, "name").join(known, ["candidate", "number", "cep"], "left_semi").select("stop", "candidate")


_NAMES = f"n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part), w AS (SELECT name, {_words('name')} AS w FROM n)"


def _names(spark, sf):
    return load(spark, sf, "part").selectExpr("p_name || ' ' || lower(p_type) AS name").distinct().select("name", t.words("name").alias("w"))


@query("j25_token_containment", f"""WITH {_NAMES} SELECT a.name AS a, b.name AS b FROM w a JOIN w b ON a.name <> b.name
AND list_bool_and(list_transform(a.w, lambda x: list_bool_or(list_transform(b.w, lambda y: x = y OR (length(x) >= 5 AND levenshtein(x, y) <= 1)))))""")
def _(spark, sf):
    w = _names(spark, sf)
    # every word of a is almost a word of b, so one is enough to meet: the longest, by itself and without any one character
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    asked = w.select(F.col("name").alias("a"), F.col("w").alias("w_a"), F.explode(t.one_edit_marks(longest)).alias("mark"))
    held = w.select(F.col("name").alias("b"), F.col("w").alias("w_b"), F.explode("w").alias("word"))
    held = held.select("b", "w_b", F.explode(t.one_edit_marks("word")).alias("mark")).distinct()
    near = asked.join(held, "mark").where("a <> b").select("a", "b", "w_a", "w_b").distinct()
    return near.where(t.fits_into(F.col("w_a"), F.col("w_b"))).select("a", "b")


_SHARE = "len(list_filter(a.w, lambda x: list_contains(b.w, x))) / len(a.w) >= 0.6"


def _overlapping(spark, sf):
    """Ordered pairs of different names of which the second holds 60 % of the first's words; they meet by a word they share."""
    w = _names(spark, sf)
    each = w.select("name", "w", F.explode(F.array_distinct("w")).alias("word"))
    other = each.select(F.col("name").alias("b"), F.col("w").alias("w_b"), "word")
    asked = each.select(F.col("name").alias("a"), F.col("w").alias("w_a"), "word")
    near = asked.join(other, "word").where("a <> b").select("a", "b", "w_a", "w_b").distinct()
    return near.where(t.overlap(F.col("w_a"), F.col("w_b")) >= 0.6).select("a", "b")


@query("j26_token_overlap", f"WITH {_NAMES} SELECT a.name AS a, b.name AS b FROM w a JOIN w b ON a.name <> b.name AND {_SHARE}")
def _(spark, sf):
    return _overlapping(spark, sf)


@query("j26_token_overlap_both_ways", f"WITH {_NAMES} SELECT a.name AS a, b.name AS b FROM w a JOIN w b ON a.name < b.name AND {_SHARE} AND {_SHARE.replace('a.w', 'c.w').replace('b.w', 'a.w').replace('c.w', 'b.w')}")
def _(spark, sf):
    pairs = _overlapping(spark, sf)
    return pairs.where("a < b").join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


@query("t03_latest_with_floor", "WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT o_orderkey FROM r WHERE r <= 500 OR o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY")
def _(spark, sf):
    o = load(spark, sf, "orders")
    newest = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    recent = o.join(F.broadcast(newest), F.col("o_orderdate") >= F.col("since")).select("o_orderkey")  # one row
    top = o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(500).select("o_orderkey")
    return recent.unionByName(top).distinct()


@query("t06_natural_order", "SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS number FROM part")
def _(spark, sf):
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    return load(spark, sf, "part").select("p_brand", number.alias("number")).distinct().orderBy(F.regexp_replace("p_brand", "[0-9]+", ""), "number")


@query("u03_unseen_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    return load(spark, sf, "customer").join(load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("snk08_rekey", f"SELECT new_key, count(*) AS rows FROM (SELECT p_name AS old_key, array_to_string(list_sort({_words('p_name')}), ' ') AS new_key FROM part) WHERE old_key <> new_key GROUP BY new_key")
def _(spark, sf):
    keyed = load(spark, sf, "part").select(F.col("p_name").alias("old_key"), F.array_join(F.array_sort(t.words("p_name")), " ").alias("new_key"))
    return keyed.where("old_key <> new_key").groupBy("new_key").agg(F.count("*").alias("rows"))


@query("k08_ordered_digest", "SELECT n_regionkey, sha256(string_agg(n_name, '|' ORDER BY n_name)) AS digest FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    return load(spark, sf, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "|"), 256).alias("digest"))
