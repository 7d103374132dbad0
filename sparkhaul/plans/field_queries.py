"""Queries over single fields: texts, keys, dates, arrays, JSON, filters and access."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import address as a
from ..functions import text as t
from ..operators import relational as rel
from ..session import load
from . import views as v
from .registry import registry

QUERIES, query = registry()

# filters and access


@query("f01_key_membership", f"WITH {v.EVIDENCE} SELECT id FROM evidence WHERE place IN (SELECT CAST(p_partkey % 100 AS VARCHAR) FROM part WHERE p_size <= 3)")
def _(spark, sf):
    keys = load(spark, sf, "part").where("p_size <= 3").selectExpr("CAST(p_partkey % 100 AS STRING) AS place").distinct()
    return v.evidence(spark, sf).join(keys, "place", "left_semi").select("id")


_GUARD = "SELECT {0} AS asked, place, count(*) AS n FROM evidence WHERE place IN (SELECT place FROM keys WHERE k < {0}) AND (SELECT count(*) FROM keys WHERE k < {0}) <= 50 GROUP BY place"


@query("f02_argument_guard", f"WITH {v.EVIDENCE}, keys AS (SELECT k, CAST(k AS VARCHAR) AS place FROM range(80) t(k)) {_GUARD.format(40)} UNION ALL {_GUARD.format(60)}")
def _(spark, sf):
    out = None
    for asked in (40, 60):
        keys = spark.range(asked).selectExpr("CAST(id AS STRING) AS place")
        found = rel.answered(v.evidence(spark, sf), keys, "place", 50).groupBy("place").agg(F.count("*").alias("n")).select(F.lit(asked).alias("asked"), "place", "n")
        out = found if out is None else out.unionByName(found)
    return out


@query("f03_active_principal", f"WITH {v.ROUTES} SELECT route, 8 AS who FROM routes WHERE driver = 8 AND 8 % 7 <> 0 UNION ALL SELECT route, 7 FROM routes WHERE driver = 7 AND 7 % 7 <> 0")
def _(spark, sf):
    r = v.routes(spark, sf)
    active = {8: 8 % 7 != 0, 7: 7 % 7 != 0}  # worked out once for each caller, so it is a constant of the plan
    seen = [r.where((F.col("driver") == who) & F.lit(ok)).select("route", F.lit(who).alias("who")) for who, ok in active.items()]
    return seen[0].unionByName(seen[1])


@query("f05_accents_do_not_matter", "SELECT doc_id FROM documents WHERE regexp_matches(strip_accents(text), '(?i)\\bevolucao|cion\\b|eau')")
def _(spark, sf):
    bare = F.regexp_replace(F.translate("text", t.ACCENTED, t.PLAIN), r"\p{M}", "")
    return load(spark, sf, "documents").where(bare.rlike(r"(?i)\bevolucao|cion\b|eau")).select("doc_id")


@query("f07_key_search", f"""WITH {v.STOPS}, k AS (SELECT stop, CAST(cep AS VARCHAR) || '|' || number AS code_key, lower(street) || '|' || number AS street_key FROM stops)
SELECT 'code' AS how, stop FROM k WHERE starts_with(code_key, '49001') UNION ALL SELECT 'word', stop FROM k WHERE contains(street_key, 'mangueiras') AND contains(street_key, 'av') UNION ALL SELECT 'exact', stop FROM k WHERE street_key = 'rua das flores|64'""")
def _(spark, sf):
    k = v.stops(spark, sf).selectExpr("stop", "CAST(cep AS STRING) || '|' || number AS code_key", "lower(street) || '|' || number AS street_key")
    asked = F.array(F.lit("mangueiras"), F.lit("av"))
    ways = {"code": F.col("code_key").startswith("49001"), "word": F.forall(asked, lambda w: F.contains(F.col("street_key"), w)), "exact": F.col("street_key") == "rua das flores|64"}
    out = [k.where(c).select(F.lit(n).alias("how"), "stop") for n, c in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("f08_changes", f"WITH {v.EVIDENCE}, l AS (SELECT *, lag(CASE WHEN id % 4 <> 0 THEN kind END) OVER (PARTITION BY place ORDER BY happened, id) AS before FROM evidence) SELECT id FROM l WHERE before IS DISTINCT FROM CASE WHEN id % 4 <> 0 THEN kind END")
def _(spark, sf):
    said = F.when(F.col("id") % 4 != 0, F.col("kind"))
    e = v.evidence(spark, sf).withColumn("said", said)
    return e.withColumn("before", F.lag("said").over(Window.partitionBy("place").orderBy("happened", "id"))).where(~F.col("before").eqNullSafe(F.col("said"))).select("id")


@query("f10_can_be_undone", f"WITH {v.EVIDENCE} SELECT id FROM evidence WHERE driver % 10 = 3 AND happened >= (SELECT max(happened) FROM evidence) - INTERVAL 1 DAY")
def _(spark, sf):
    e = v.evidence(spark, sf)
    since = e.agg((F.max("happened") - F.expr("INTERVAL 1 DAY")).alias("since"))  # one row
    return e.where("driver % 10 = 3").join(F.broadcast(since), F.col("happened") >= F.col("since")).select("id")


@query("f13_cut_and_rounded", f"WITH {v.STOPS} SELECT stop, left(address, 20) AS address, round(lat + 1e-8, 5) AS lat FROM stops")
def _(spark, sf):
    return v.stops(spark, sf).select("stop", F.left("address", F.lit(20)).alias("address"), F.round(F.col("lat") + 1e-8, 5).alias("lat"))


_STATUS = "CASE WHEN precision IN ('confirmado', 'manual') THEN 'sure' WHEN precision IN ('rua', 'bairro') THEN 'doubtful' ELSE 'nearly' END"


@query("f14_status", f"WITH {v.STOPS} SELECT {_STATUS} AS status, count(*) AS n FROM stops GROUP BY 1")
def _(spark, sf):
    return v.stops(spark, sf).groupBy(F.expr(_STATUS).alias("status")).agg(F.count("*").alias("n"))


@query("f17_routes_with_profile", f"WITH {v.ROUTES}, {v.PROFILES} SELECT route, day, name FROM routes r JOIN profiles p ON p.driver = r.driver WHERE p.active AND day >= DATE '1998-01-01' ORDER BY day DESC, route")
def _(spark, sf):
    own = v.profiles(spark, sf).where("active").select("driver", "name")
    return v.routes(spark, sf).where("day >= DATE '1998-01-01'").join(own, "driver").select("route", "day", "name").orderBy(F.col("day").desc(), "route")


_POLICY = {"query": r"\?", "anchor": "#", "not secure": "^http://"}


@query("f18_address_policy", "SELECT page_id, CASE WHEN regexp_matches(url, '\\?') THEN 'query' WHEN regexp_matches(url, '#') THEN 'anchor' ELSE 'not secure' END AS rule FROM pages WHERE regexp_matches(url, '\\?|#|^http://')")
def _(spark, sf):
    rule = None
    for name, pattern in _POLICY.items():
        rule = (F if rule is None else rule).when(F.col("url").rlike(pattern), name)
    return load(spark, sf, "pages").select("page_id", rule.alias("rule")).where("rule IS NOT NULL")


@query("f09_checked_rows", f"""WITH {v.EVIDENCE} SELECT id, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND length(place) BETWEEN 2 AND 300 AND kind IN ('click', 'view', 'signup', 'purchase') AND value BETWEEN 0 AND 100 AS ok FROM evidence""")
def _(spark, sf):
    ok = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & F.length("place").between(2, 300) & F.col("kind").isin("click", "view", "signup", "purchase") & F.col("value").between(0, 100)
    return v.evidence(spark, sf).select("id", ok.alias("ok"))


# dates


@query("d01_local_days", f"WITH {v.EVIDENCE} SELECT day, count(*) AS n FROM evidence GROUP BY day")
def _(spark, sf):
    return v.evidence(spark, sf).groupBy("day").agg(F.count("*").alias("n"))


@query("d02_whole_minutes", f"WITH {v.EVIDENCE} SELECT id, CAST(floor((epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(happened)) / 60) AS BIGINT) AS minutes FROM evidence")
def _(spark, sf):
    seconds = F.unix_micros(F.expr("TIMESTAMP '2024-02-01 00:00:00'")) / 1e6 - F.unix_micros("happened") / 1e6
    return v.evidence(spark, sf).select("id", F.floor(seconds / 60).alias("minutes"))


@query("d03_days_that_count", f"WITH {v.EVIDENCE} SELECT id FROM evidence WHERE day BETWEEN DATE '2024-02-10' - 30 AND DATE '2024-02-10' + 1")
def _(spark, sf):
    return v.evidence(spark, sf).where("day BETWEEN date_sub(DATE '2024-02-10', 30) AND date_add(DATE '2024-02-10', 1)").select("id")


_NEW_DAY = "CASE WHEN n = 0 OR last_day >= today THEN 'nothing' WHEN open = 0 THEN 'clear' ELSE 'ask' END"


@query("d04_new_day", f"""WITH {v.PACKAGES}, s AS (SELECT route, count(*) AS n, count(*) FILTER (WHERE NOT delivered) AS open, max(CAST(delivered_at - INTERVAL 3 HOUR AS DATE)) AS last_day FROM packages GROUP BY route), x AS (SELECT *, DATE '1995-06-17' AS today FROM s)
SELECT route, {_NEW_DAY} AS step FROM x""")
def _(spark, sf):
    s = v.packages(spark, sf).groupBy("route").agg(F.count("*").alias("n"), F.count_if(~F.col("delivered")).alias("open"), F.max(v.local_day("delivered_at")).alias("last_day"))
    return s.withColumn("today", F.lit("1995-06-17").cast("date")).select("route", F.expr(_NEW_DAY).alias("step"))


@query("d05_deadlines", f"WITH {v.EVIDENCE} SELECT id, CAST(day AS TIMESTAMP) + to_minutes(CAST(id % 1440 AS BIGINT)) AS deadline, epoch(happened - INTERVAL 3 HOUR) > epoch(CAST(day AS TIMESTAMP)) + (id % 1440) * 60 AS late FROM evidence")
def _(spark, sf):
    local = F.from_utc_timestamp("happened", v.ZONE)
    at = F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 1440).cast("int"))
    return v.evidence(spark, sf).select("id", at.cast("timestamp_ntz").alias("deadline"), (local > at).alias("late"))


# keys, arrays, JSON


@query("k01_first_part", f"WITH {v.STOPS}, k AS (SELECT stop, cep || '|' || number || '|' || district AS key FROM stops) SELECT stop, split_part(key, '|', 1) AS code, split_part(key, '|', 3) AS district FROM k")
def _(spark, sf):
    key = F.concat_ws("|", F.col("cep").cast("string"), F.col("number").cast("string"), "district")
    return v.stops(spark, sf).select("stop", F.split_part(key, F.lit("|"), F.lit(1)).alias("code"), F.split_part(key, F.lit("|"), F.lit(3)).alias("district"))


@query("k02_json_records", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_array_length('[' || event_id || ',2]') AS BIGINT) AS n FROM events")
def _(spark, sf):
    record = F.from_json("props", "k bigint")
    listed = F.from_json(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(",2]")), "array<bigint>")
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), record["k"].alias("k"), F.size(listed).cast("long").alias("n"))


@query("k03_arrays", f"WITH {v.STOPS}, l AS (SELECT route, list_sort(list_distinct(list(district))) AS districts FROM stops GROUP BY route) SELECT route, d AS district, CAST(len(districts) AS BIGINT) AS of FROM l, unnest(districts) AS t(d)")
def _(spark, sf):
    each = v.stops(spark, sf).groupBy("route").agg(F.collect_set("district").alias("districts"))  # districts are few
    return each.select("route", F.explode("districts").alias("district"), F.size("districts").cast("long").alias("of"))


@query("k04_regular_expressions", "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, CAST(len(string_split_regex(url, '[/?#]+')) AS BIGINT) AS pieces, regexp_matches(url, '\\.org(/|$)') AS org FROM pages")
def _(spark, sf):
    url = F.col("url")
    return load(spark, sf, "pages").select("page_id", F.regexp_extract(url, "^(https?)://", 1).alias("scheme"), F.size(F.split(url, "[/?#]+")).cast("long").alias("pieces"), url.rlike(r"\.org(/|$)").alias("org"))


_SCALARS = {"district": "coalesce(nullif(trim(lower(district)), 'building'), 'none')", "most": "greatest(number, units, 5)", "least": "least(number, units * 100)", "start": "left(address, 5)", "norm": "round(sqrt(pow(number, 2)) * cos(radians(60e0)), 4)"}


@query("k06_scalars", f"WITH {v.STOPS} SELECT stop, {', '.join(f'{e} AS {n}' for n, e in _SCALARS.items())} FROM stops")
def _(spark, sf):
    return v.stops(spark, sf).selectExpr("stop", *(f"{e} AS {n}" for n, e in _SCALARS.items()))


@query("k08_ordered_digests", f"WITH {v.STOPS} SELECT route, sha256(string_agg(stop || ':' || number, '|' ORDER BY stop)) AS digest FROM stops GROUP BY route")
def _(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("stop", "number"))), lambda x: F.concat(x["stop"].cast("string"), F.lit(":"), x["number"].cast("string")))
    return v.stops(spark, sf).groupBy("route").agg(F.sha2(F.array_join(rows, "|"), 256).alias("digest"))


# texts

_LINKS = """CASE stop % 6 WHEN 0 THEN 'https://maps.google.com/maps/place/x/@-9.' || (400000 + stop) || ',-35.' || (600000 + stop) || ',17z/data=!3d-9.' || (410000 + stop) || '!4d-35.' || (610000 + stop) || '!3d-9.' || (420000 + stop) || '!4d-35.' || (620000 + stop)
WHEN 1 THEN 'veja https://maps.google.com/?q=-9.' || (430000 + stop) || ',-35.' || (630000 + stop) WHEN 2 THEN 'https://x.y/@-9.' || (440000 + stop) || ',-35.' || (640000 + stop) || ',15z' WHEN 3 THEN 'porta -9.' || (450000 + stop) || ', -35.' || (650000 + stop) || ' azul'
WHEN 4 THEN 'https://maps.app.goo.gl/Ab' || stop || '?g_st=1' ELSE address END"""
_PAIR = r"(-?[0-9]{1,3}\.[0-9]{4,})"
_PATTERNS = [f"!3d{_PAIR}!4d{_PAIR}", f"[?&](?:q|query|destination|ll)={_PAIR}(?:,|%2C){_PAIR}", f"@{_PAIR},{_PAIR}", f"{_PAIR}[, ]+{_PAIR}"]


def _pair_sql(k: int) -> str:
    last = [f"nullif(list_extract(regexp_extract_all(said, '{_PATTERNS[0]}', {k}), -1), '')"]
    rest = [f"nullif(regexp_extract({said}, '{p}', {k}), '')" for p, said in zip(_PATTERNS[1:], ("said", "said", "regexp_replace(said, 'https?://[^ ]+', ' ', 'g')"), strict=True)]
    return f"CAST(coalesce({', '.join(last + rest)}) AS DOUBLE)"


@query("x03_coordinates", f"WITH {v.STOPS}, s AS (SELECT stop, {_LINKS} AS said FROM stops) SELECT stop, {_pair_sql(1)} AS lat, {_pair_sql(2)} AS lng FROM s")
def _(spark, sf):
    s = v.stops(spark, sf).selectExpr("stop", f"{_LINKS} AS said")
    return s.select("stop", *(t.coordinate("said", k).alias(n) for k, n in ((1, "lat"), (2, "lng"))))


_MAP_LINK = r"https?://(maps\.app\.goo\.gl|goo\.gl/maps)/([A-Za-z0-9_-]{1,64})"


@query("x04_what_a_text_is", f"""WITH {v.STOPS}, s AS (SELECT stop, {_LINKS} AS said FROM stops), c AS (SELECT *, {_pair_sql(1)} AS lat FROM s)
SELECT stop, CASE WHEN lat IS NOT NULL THEN 'position' WHEN regexp_matches(said, 'https?://|\\bwww\\.') THEN 'link without position' ELSE 'address' END AS kind,
CASE WHEN regexp_matches(said, '{_MAP_LINK}') THEN 'https://' || regexp_extract(said, '{_MAP_LINK}', 1) || '/' || regexp_extract(said, '{_MAP_LINK}', 2) END AS short_link FROM c""")
def _(spark, sf):
    said = F.col("said")
    s = v.stops(spark, sf).selectExpr("stop", f"{_LINKS} AS said").withColumn("lat", t.coordinate("said", 1))
    kind = F.when(F.col("lat").isNotNull(), "position").when(said.rlike(r"https?://|\bwww\."), "link without position").otherwise("address")
    link = F.when(said.rlike(_MAP_LINK), F.concat(F.lit("https://"), F.regexp_extract(said, _MAP_LINK, 1), F.lit("/"), F.regexp_extract(said, _MAP_LINK, 2)))
    return s.select("stop", kind.alias("kind"), link.alias("short_link"))


@query("x02_noise_removed", f"""WITH {v.STOPS}, s AS (SELECT stop, CASE stop % 3 WHEN 0 THEN '| ' || street || ' ' || number || ' ✓' WHEN 1 THEN street || '  10:15h a 13:20h' ELSE '14:00 as 15:30 h' END AS said FROM stops),
c AS (SELECT stop, trim(regexp_replace(regexp_replace(said, '[|©®✔✓]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM s), b AS (SELECT *, trim(regexp_replace(regexp_replace(clean, '\\b[0-9]{{1,2}}:[0-9]{{2}} *h? *(a|às|as) *[0-9]{{1,2}}:[0-9]{{2}} *h?', ' ', 'g'), '\\s+', ' ', 'g')) AS bare FROM c)
SELECT stop, CASE WHEN bare <> clean AND NOT regexp_matches(bare, '[A-Za-z]') THEN '' ELSE bare END AS line FROM b""")
def _(spark, sf):
    said = F.expr("CASE stop % 3 WHEN 0 THEN '| ' || street || ' ' || number || ' ✓' WHEN 1 THEN street || '  10:15h a 13:20h' ELSE '14:00 as 15:30 h' END")
    return v.stops(spark, sf).select("stop", a.without_noise(said).alias("line"))


@query("x05_lines_read", f"""WITH {v.STOPS} SELECT stop, CASE WHEN stop % 3 = 0 THEN CAST(stop % 90 AS VARCHAR) END AS stop_number, address AS text, CASE WHEN stop % 4 = 0 THEN CAST(units AS INTEGER) END AS units, stop % 4 = 1 AS commercial FROM stops""")
def _(spark, sf):
    said = F.expr("CASE WHEN stop % 3 = 0 THEN (stop % 90) || ' ' ELSE '' END || address || CASE stop % 4 WHEN 0 THEN ' · ' || units || ' unidades' WHEN 1 THEN ' · comercial' ELSE '' END")
    return v.stops(spark, sf).withColumn("said", said).withColumn("read", a.read_line("said")).select("stop", "read.*")


@query("x06_addresses_in_parts", f"""WITH {v.STOPS} SELECT stop, street, CAST(number AS VARCHAR) AS number, CAST(cep AS VARCHAR) AS cep, CASE WHEN extra = '' THEN district ELSE extra || '; ' || district END AS rest FROM stops""")
def _(spark, sf):
    p = v.addressed(v.stops(spark, sf).select("stop", "address"))
    return p.select("stop", "parts.street", "parts.number", "parts.cep", F.array_join("parts.rest", "; ").alias("rest"))


@query("x07_address_keys", None)
def _(spark, sf):
    p = v.addressed(v.stops(spark, sf).select("stop", "address"))
    return p.select("stop", a.address_key().alias("key"), a.street_and_number().alias("door"))


@query("x08_looks_like_address", None)
def _(spark, sf):
    said = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return said.groupBy("doc_id").agg(F.count_if(a.looks_like_address("line")).alias("lines"))


@query("x09_street_keys", f"""WITH {v.STOPS}, s AS (SELECT DISTINCT street FROM stops) SELECT street, CASE regexp_replace(street, '^(Rua|Av[.]|Travessa|R) ', '') WHEN 'das Flores' THEN 'flores' WHEN 'Vinte e Cinco' THEN '25' WHEN 'Dr Carlos Firpo' THEN 'carlos firpo'
WHEN 'Palmeiras do Norte' THEN 'palmeiras norte' WHEN 'A' THEN 'a' WHEN 'Eng Jorge Neto' THEN 'engenheiro jorge neto' WHEN 'Mangueiras' THEN 'mangueiras' ELSE '110' END AS key FROM s""")
def _(spark, sf):
    return v.stops(spark, sf).select("street").distinct().select("street", a.street_key("street").alias("key"))


@query("x10_numbers_in_words", "SELECT p_partkey, CAST(p_partkey * 7 % 999 + 1 AS VARCHAR) || ' travessa ' || CAST(p_partkey % 999 + 1 AS VARCHAR) AS read FROM part")
def _(spark, sf):
    words = F.concat(a.spelled(F.expr("CAST(p_partkey * 7 % 999 + 1 AS INT)")), F.array(F.lit("travessa")), a.spelled(F.expr("CAST(p_partkey % 999 + 1 AS INT)")))
    return load(spark, sf, "part").select("p_partkey", F.array_join(a.digits_for_words(words), " ").alias("read"))


@query("x11_complex_names", f"WITH {v.STOPS} SELECT stop, CASE WHEN extra LIKE 'Conjunto%' THEN extra ELSE '' END AS complex FROM stops")
def _(spark, sf):
    return v.addressed(v.stops(spark, sf).select("stop", "address", "district")).select("stop", a.complex_name().alias("complex"))


@query("x12_edits_between_names", "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS edits FROM n a JOIN n b ON length(a.name) = length(b.name) AND a.name < b.name")
def _(spark, sf):
    n = load(spark, sf, "part").select(F.col("p_name").alias("a")).distinct().withColumn("size", F.length("a"))
    pairs = n.join(n.withColumnRenamed("a", "b"), "size").where("a < b")
    return pairs.select("a", "b", F.levenshtein("a", "b").cast("long").alias("edits"))


@query("x13_almost_equal", "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name <> b.name AND length(a.name) >= 5 AND levenshtein(a.name, b.name) <= 1")
def _(spark, sf):
    n = load(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    each = n.select("a", F.explode(t.one_edit_marks("a")).alias("mark"))
    pairs = each.join(each.withColumnRenamed("a", "b"), "mark").where("a <> b").select("a", "b").distinct()
    return pairs.where(t.almost_equal(F.col("a"), F.col("b")))


@query("x14_bent_door_numbers", f"WITH {v.STOPS} SELECT stop, CAST(1 AS INTEGER) AS edits FROM stops WHERE number >= 100")
def _(spark, sf):
    n = F.col("number").cast("string")
    bent = F.concat(F.left(n, F.lit(1)), F.lit("/"), F.substring(n, 3, 9), F.lit(" 8"))
    return v.stops(spark, sf).where("number >= 100").select("stop", a.wildcard_distance(bent, n).alias("edits"))


@query("x15_named_places", f"WITH {v.STOPS} SELECT stop, CASE WHEN extra LIKE 'Conjunto%' THEN 'dantas orlando' END AS key FROM stops")
def _(spark, sf):
    return v.addressed(v.stops(spark, sf).select("stop", "address", "district")).select("stop", a.place_name_key(a.place_hints()).alias("key"))


@query("x16_road_types", f"WITH {v.STOPS}, s AS (SELECT DISTINCT street FROM stops) SELECT street, CASE split_part(street, ' ', 1) WHEN 'Av.' THEN 'avenida' WHEN 'Travessa' THEN 'travessa' ELSE 'rua' END AS kind FROM s")
def _(spark, sf):
    return v.stops(spark, sf).select("street").distinct().select("street", a.road_type("street").alias("kind"))


@query("x17_generic_streets", f"WITH {v.STOPS} SELECT DISTINCT street FROM stops WHERE street LIKE '% A' OR street LIKE '%Vinte e Cinco'")
def _(spark, sf):
    return v.stops(spark, sf).select("street").distinct().where(a.is_generic_street("street"))


@query("x18_in_a_complex", f"WITH {v.STOPS} SELECT stop, extra LIKE 'Bloco%' AS inside, CASE WHEN stop % 7 = 0 THEN 'rua m' END AS inner_street FROM stops")
def _(spark, sf):
    s = v.stops(spark, sf).withColumn("address", F.when(F.col("stop") % 7 == 0, F.concat("address", F.lit(", Rua M atrás do mercado"))).otherwise(F.col("address")))
    return v.addressed(s).select("stop", a.in_complex().alias("inside"), a.complement_street().alias("inner_street"))


@query("x19_place_keys", f"WITH {v.STOPS} SELECT stop, cep || '|' || number AS place, CASE WHEN street NOT LIKE '% A' AND street NOT LIKE '%Vinte e Cinco' THEN regexp_replace(regexp_replace(lower(street), '^av[.]', 'avenida'), '^r ', 'rua ') || '|' || number END AS door FROM stops WHERE cep % 1000 <> 0")
def _(spark, sf):
    p = a.with_place_key(v.addressed(v.stops(spark, sf).where("cep % 1000 <> 0").withColumn("city", F.lit("Aracaju"))))
    return p.select("stop", F.col("place_key").alias("place"), a.door_key().alias("door"))


@query("x20_district_keys", f"WITH {v.STOPS} SELECT DISTINCT district, lower(district) AS key FROM stops")
def _(spark, sf):
    said = F.concat("district", F.lit(" Bl 04 Ap 403"))
    return v.stops(spark, sf).select("district").distinct().select("district", a.district_key(said).alias("key"))


@query("x21_customer_keys", f"WITH {v.STOPS} SELECT stop, cep || '|' || number || CASE WHEN extra LIKE 'Apto%' THEN '#apto' || CAST(stop % 30 AS VARCHAR) WHEN extra LIKE 'Bloco%' THEN '#blocob+casa3' ELSE '' END AS key FROM stops WHERE cep % 1000 <> 0")
def _(spark, sf):
    p = a.with_place_key(v.addressed(v.stops(spark, sf).where("cep % 1000 <> 0").withColumn("city", F.lit("Aracaju"))))
    return p.select("stop", a.customer_key(F.col("place_key")).alias("key"))


@query("x22_city_of_a_code", f"WITH {v.STOPS} SELECT stop, CASE WHEN starts_with(CAST(cep AS VARCHAR), '490') THEN 'Aracaju' WHEN starts_with(CAST(cep AS VARCHAR), '4910') THEN 'São Cristóvão' END AS city FROM (SELECT stop, cep + (stop % 3) * 50000 AS cep FROM stops)")
def _(spark, sf):
    code = F.expr("CAST(cep + (stop % 3) * 50000 AS STRING)")
    return v.stops(spark, sf).select("stop", t.city_of_code(code).alias("city"))


@query("x23_title_case", "SELECT DISTINCT p_name AS name, list_aggregate(list_transform(string_split(p_name || ' do sul', ' '), lambda w: CASE WHEN w IN ('de', 'da', 'do') THEN w ELSE upper(w[1:1]) || lower(w[2:]) END), 'string_agg', ' ') AS title FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().select("name", t.title(F.concat("name", F.lit(" do sul"))).alias("title"))


@query("x24_keys_as_text", f"WITH {v.STOPS}, k AS (SELECT stop, CASE WHEN stop % 2 = 0 THEN cep || '|' || number ELSE 'r|' || lower(street) || '|' || number || '|' || lower(district) || '|aracaju' END AS key FROM stops) SELECT stop, CASE WHEN starts_with(key, 'r|') THEN split_part(key, '|', 2) || ', ' || split_part(key, '|', 3) ELSE replace(key, '|', ', ') END AS said, CASE WHEN starts_with(key, 'r|') THEN 'r|' || split_part(key, '|', 2) || '|' || split_part(key, '|', 4) || '|' || split_part(key, '|', 5) ELSE split_part(key, '|', 1) END AS street FROM k")
def _(spark, sf):
    k = v.stops(spark, sf).selectExpr("stop", "CASE WHEN stop % 2 = 0 THEN cep || '|' || number ELSE 'r|' || lower(street) || '|' || number || '|' || lower(district) || '|aracaju' END AS key")
    p = F.split("key", "[|]")
    named = F.col("key").startswith("r|")
    said = F.when(named, F.concat(F.get(p, 1), F.lit(", "), F.get(p, 2))).otherwise(F.replace("key", F.lit("|"), F.lit(", ")))
    return k.select("stop", said.alias("said"), F.when(named, F.array_join(F.filter(p, lambda _, i: i != 2), "|")).otherwise(F.get(p, 0)).alias("street"))


@query("x25_file_names", "SELECT page_id, trim(regexp_replace(regexp_replace(strip_accents(lower(url || ' (' || (page_id % 4) || ')  Ç.xlsx')), '[(][0-9]+[)]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM pages")
def _(spark, sf):
    said = F.concat("url", F.lit(" ("), (F.col("page_id") % 4).cast("string"), F.lit(")  Ç.xlsx"))
    return load(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(t.normal(said), r"[(][0-9]+[)]", ""), r"\s+", " ")).alias("name"))


@query("x27_origin_of_a_list", f"WITH {v.STOPS} SELECT route, CASE WHEN count(DISTINCT precision) = 1 THEN min(precision) ELSE 'mixed' END AS origin FROM stops GROUP BY route")
def _(spark, sf):
    return v.stops(spark, sf).groupBy("route").agg(F.when(F.countDistinct("precision") == 1, F.min("precision")).otherwise("mixed").alias("origin"))


#: Kinds of secrets and personal data, and their patterns.
_SECRETS = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\+?\d{2,3}[ -]\(?\d{2,3}\)?[ -]\d{3,5}[ -]?\d{3,4}", "key": r"\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}",
    "assigned": r"(?i)\b(?:token|secret|password|api_key)\b *[=:] *[^ ]{8,}", "code": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "hex": r"\b[0-9a-f]{40}\b",
}


@query("x29_secret_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, count(*) AS lines FROM l WHERE regexp_matches(line, '{p}') GROUP BY doc_id" for k, p in _SECRETS.items()))
def _(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kinds = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(k)) for k, p in _SECRETS.items())))
    return lines.select("doc_id", F.explode(kinds).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("lines"))


@query("x30_lines_assembled", f"WITH {v.STOPS}, s AS (SELECT stop, CASE WHEN stop % 2 = 0 THEN address ELSE street || ', ' || number END AS line, district, CAST(cep AS VARCHAR) AS cep FROM stops) SELECT stop, line || CASE WHEN contains(lower(line), lower(district)) THEN '' ELSE ', ' || district END || CASE WHEN regexp_matches(line, '[0-9]{{5}}-?[0-9]{{3}}') THEN '' ELSE ', ' || cep END AS line FROM s")
def _(spark, sf):
    s = v.stops(spark, sf).selectExpr("stop", "CASE WHEN stop % 2 = 0 THEN address ELSE street || ', ' || number END AS line", "district", "CAST(cep AS STRING) AS cep")
    more = (F.when(~F.contains(F.lower("line"), F.lower("district")), F.concat(F.lit(", "), "district")).otherwise(""), F.when(~F.col("line").rlike(r"[0-9]{5}-?[0-9]{3}"), F.concat(F.lit(", "), "cep")).otherwise(""))
    return s.select("stop", F.concat("line", *more).alias("line"))


@query("x33_cities", "SELECT n_name AS name, lower(n_name) AS key, 'BR' AS state FROM nation")
def _(spark, sf):
    said = F.concat("n_name", F.lit(" - BR"))
    return load(spark, sf, "nation").select(F.col("n_name").alias("name"), t.normal(F.get(F.split(said, r"[,\-/]"), 0)).alias("key"), F.trim(F.get(F.split(said, r"[,\-/]"), 1)).alias("state"))


@query("x35_key_variants", f"""WITH {v.STOPS}, s AS (SELECT stop, street, cep || '|' || number AS code_key, number FROM stops WHERE street LIKE 'Av.%' OR street LIKE 'Travessa%')
SELECT stop, code_key AS key FROM s UNION SELECT stop, lower(street) || '|' || number FROM s UNION SELECT stop, replace(lower(street), 'av.', 'avenida') || '|' || number FROM s""")
def _(spark, sf):
    s = v.stops(spark, sf).where("street LIKE 'Av.%' OR street LIKE 'Travessa%'")
    n = F.concat(F.lit("|"), F.col("number").cast("string"))
    keys = F.array(F.concat(F.col("cep").cast("string"), n), F.concat(F.lower("street"), n), F.concat(a.full_street("street"), n))
    return s.select("stop", F.explode(F.array_distinct(keys)).alias("key"))


_LABEL = "CASE precision WHEN 'confirmado' THEN 'verified door' WHEN 'manual' THEN 'set by hand' WHEN 'censo' THEN 'census door' WHEN 'rua' THEN 'street only' WHEN 'bairro' THEN 'district only' ELSE 'from the sheet' END"


@query("x36_labels", f"WITH {v.STOPS} SELECT stop, {_LABEL} AS label FROM stops")
def _(spark, sf):
    return v.stops(spark, sf).select("stop", F.expr(_LABEL).alias("label"))


@query("x37_stop_numbers", f"WITH {v.STOPS}, s AS (SELECT stop, CASE WHEN additional THEN '-' ELSE CAST(carrier AS VARCHAR) END AS said FROM stops) SELECT stop, regexp_matches(said, '^[0-9]+$') AS valid, said = '-' AS additional FROM s")
def _(spark, sf):
    said = F.when(F.col("additional"), "-").otherwise(F.col("carrier").cast("string"))
    return v.stops(spark, sf).select("stop", said.rlike("^[0-9]+$").alias("valid"), (said == "-").alias("additional"))


@query("x38_navigation_links", f"WITH {v.STOPS} SELECT stop, 'https://waze.com/ul?ll=' || stop || ',' || number || '&navigate=yes' AS link FROM stops")
def _(spark, sf):
    return v.stops(spark, sf).select("stop", F.format_string("https://waze.com/ul?ll=%d,%d&navigate=yes", "stop", "number").alias("link"))


@query("x39_import_summaries", f"WITH {v.STOPS} SELECT 'Route ' || route || ': ' || count(*) || ' stops, ' || CAST(sum(units) AS BIGINT) || ' packages' || CASE WHEN count(*) FILTER (WHERE additional) > 0 THEN ', ' || count(*) FILTER (WHERE additional) || ' additional' ELSE '' END AS line FROM stops GROUP BY route")
def _(spark, sf):
    s = v.stops(spark, sf).groupBy("route").agg(F.count("*").alias("n"), F.sum("units").alias("u"), F.count_if("additional").alias("x"))
    more = F.when(F.col("x") > 0, F.format_string(", %d additional", "x")).otherwise("")
    return s.select(F.concat(F.format_string("Route %d: %d stops, %d packages", "route", "n", "u"), more).alias("line"))


# set operations and short lists


@query("u01_logs_with_roles", f"WITH {v.EVIDENCE} SELECT place, 'correction' AS role, admin, id FROM evidence WHERE correction UNION ALL SELECT place, 'passage', false, id FROM evidence WHERE NOT correction AND NOT refused")
def _(spark, sf):
    e = v.evidence(spark, sf)
    c, p = (e.where(w).select("place", F.lit(r).alias("role"), x.alias("admin"), "id") for w, r, x in (("correction", "correction", F.col("admin")), ("NOT correction AND NOT refused", "passage", F.lit(False))))
    return c.unionByName(p)


@query("u02_digest_difference", f"WITH {v.STOPS} SELECT stop FROM stops WHERE (stop, district, number % 3) NOT IN (SELECT (stop, district, number % 2) FROM stops)")
def _(spark, sf):
    s = v.stops(spark, sf)
    new, old = (s.select("stop", "district", (F.col("number") % k).alias("n")) for k in (3, 2))
    return rel.missing_rows(new, old, ["stop", "district", "n"]).select("stop")


@query("u04_ordered_union", f"WITH {v.STOPS}, s AS (SELECT route, carrier, min(seq) AS first FROM stops GROUP BY ALL) SELECT route, string_agg(CAST(carrier AS VARCHAR), ',' ORDER BY first, carrier) AS carriers FROM s GROUP BY route")
def _(spark, sf):
    first = v.stops(spark, sf).groupBy("route", "carrier").agg(F.min("seq").alias("first"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("first", "carrier"))), lambda x: x["carrier"].cast("string"))  # a route has some tens
    return first.groupBy("route").agg(F.array_join(order, ",").alias("carriers"))


@query("t01_capped_search", f"WITH {v.STOPS} SELECT stop FROM stops WHERE lower(street) LIKE '%flores%' ORDER BY stop LIMIT 200")
def _(spark, sf):
    return v.stops(spark, sf).where(F.contains(F.lower("street"), F.lit("flores"))).orderBy("stop").limit(200).select("stop")


@query("t02_best_candidates", f"""WITH {v.STOPS}, c AS (SELECT route, floor(lat * 99991) AS y, floor(lng * 99991) AS x, min(({_STATUS.replace("'sure'", '0').replace("'doubtful'", '2').replace("'nearly'", '1')}, stop)) AS best FROM stops GROUP BY ALL)
SELECT route, best[2] AS stop, r FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY best) AS r FROM c) WHERE r <= 6""")
def _(spark, sf):
    rank = F.expr(_STATUS.replace("'sure'", "0").replace("'doubtful'", "2").replace("'nearly'", "1"))
    s = v.stops(spark, sf).withColumns({"y": F.floor(F.col("lat") * 99991), "x": F.floor(F.col("lng") * 99991), "rank": rank})
    c = s.groupBy("route", "y", "x").agg(F.min(F.struct("rank", "stop")).alias("best"))
    r = F.row_number().over(Window.partitionBy("route").orderBy("best")).cast("long")
    return c.withColumn("r", r).where("r <= 6").select("route", "best.stop", "r")


@query("t04_near_by", f"WITH {v.STOPS} SELECT a.stop, b.stop AS other FROM stops a JOIN stops b ON a.stop <> b.stop AND NOT b.delivered AND {v.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} BETWEEN 10 AND 200")
def _(spark, sf):
    from ..functions import geo

    s, cells = v.stops(spark, sf), [geo.CELL_Y, geo.CELL_X]
    a = geo.with_cells(s.select("stop", "lat", "lng", F.cos(F.radians("lat")).alias("width")), 202.0, False)
    b = geo.with_cells(s.where("NOT delivered").select(F.col("stop").alias("other"), F.col("lat").alias("lat"), F.col("lng").alias("lng")), 202.0, True).withColumnsRenamed({"lat": "r_lat", "lng": "r_lng"})
    # of the pairs of neighbouring cells two thirds are too far apart by the plane, with room to spare; only the rest need the sphere
    y, x = F.col("r_lat") - F.col("lat"), (F.col("r_lng") - F.col("lng")) * F.col("width")
    close = y * y + x * x <= (210.0 / geo.DEGREE_M) ** 2
    near = geo.spread(a, *cells).join(geo.spread(b, *cells), cells).where((F.col("stop") != F.col("other")) & close)
    return near.where(geo.haversine("lat", "lng", "r_lat", "r_lng").between(10, 200)).select("stop", "other")


@query("t05_first_results", f"WITH {v.EVIDENCE} SELECT place, count(*) AS n FROM evidence WHERE place LIKE '%3%' GROUP BY place ORDER BY n DESC, place LIMIT 20")
def _(spark, sf):
    return v.evidence(spark, sf).where("place LIKE '%3%'").groupBy("place").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "place").limit(20)


@query("t07_state_order", f"WITH {v.STOPS}, s AS (SELECT route, {_STATUS} AS status, count(*) AS n FROM stops GROUP BY ALL) SELECT route, status, n, row_number() OVER (ORDER BY CASE status WHEN 'doubtful' THEN 0 WHEN 'nearly' THEN 1 ELSE 2 END, route) AS place FROM s")
def _(spark, sf):
    s = v.stops(spark, sf).groupBy("route", F.expr(_STATUS).alias("status")).agg(F.count("*").alias("n"))
    rank = F.expr("CASE status WHEN 'doubtful' THEN 0 WHEN 'nearly' THEN 1 ELSE 2 END")
    return rel.numbered(s.withColumn("rank", rank), "place", "rank", "route").drop("rank")
