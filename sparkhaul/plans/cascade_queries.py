"""Resolution of addresses by a cascade of sources, and the base's street look-up alone, over sources derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade
from ..scratch import settled
from ..session import load
from . import views as v
from .registry import registry

QUERIES, query = registry()


def _chosen(index: str, names: list[str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names))
    return f"CASE {index} {cases} END"


_FIRST = ["mangueiras", "palmeiras", "laranjeiras", "jenipapo", "cajueiros", "umbuzeiro", "carambola", "goiabeira"]
_SECOND = ["do norte", "velhas", "imperiais", "da colina", "reais"]


def _name(i: str) -> str:
    """A street's key by a number below 42: two of them have two letters at most."""
    first, second = _chosen(f"CAST({i} AS BIGINT) % 8", _FIRST), _chosen(f"CAST(floor({i} / 8) AS BIGINT) % 5", _SECOND)
    return f"CASE WHEN {i} = 40 THEN 'a' WHEN {i} = 41 THEN 'q2' ELSE {first} || ' ' || {second} END"


_DISTRICTS = ["automobile", "building", "furniture", "household", "machinery"]
_CODE = "CAST(49000000 + {n} * 1000 + {k} AS BIGINT)"
_LAT, _LNG = "-9.5e0 + ({n} % 5) * 0.02e0", "-35.69e0 + CAST(floor({n} / 5) AS BIGINT) * 0.02e0"
_n = "p_partkey % 25"

#: Each source as columns over one table, read alike by both engines: name -> (table, columns, condition).
TABLES = {
    "asked": ("customer", {
        "stop": "c_custkey",
        "street": f"CASE WHEN c_custkey % 13 = 0 THEN replace({_name('c_custkey % 42')}, 'ei', 'ie') || 's' WHEN c_custkey % 7 = 0 THEN {_chosen('c_custkey % 8', _FIRST)} WHEN c_custkey % 29 = 0 THEN NULL ELSE {_name('c_custkey % 42')} END",
        "road": "CASE c_custkey % 4 WHEN 0 THEN 'rua' WHEN 1 THEN 'avenida' END",
        "number": "c_custkey * 3 % 500",
        "cep": "CASE WHEN c_custkey % 5 < 2 THEN " + _CODE.format(n="c_nationkey", k="(c_custkey % 4)") + " END",
        "place": f"CASE WHEN c_custkey % 3 = 0 THEN {_chosen('c_nationkey % 5', _DISTRICTS)} WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'residencial ' || (c_custkey % 8) END",
        "city": "'city ' || (c_nationkey % 5)",
        "near_lat": _LAT.format(n="c_nationkey"),
        "near_lng": _LNG.format(n="c_nationkey"),
    }, "true"),
    "census": ("part", {
        "door": "p_partkey",
        "cep": _CODE.format(n=f"({_n})", k="(p_partkey % 3)"),
        "number": "p_partkey * 7 % 500",
        "street": _name("p_partkey % 37"),
        "district": _chosen(f"{_n} % 5", _DISTRICTS),
        "city": f"'city ' || ({_n} % 5)",
        "lat": f"{_LAT.format(n=f'({_n})')} + (p_partkey % 3) * 0.003e0 + (p_partkey * 7 % 500) / 500e0 * 0.002e0",
        "lng": f"{_LNG.format(n=f'({_n})')} + (p_partkey % 7) * 0.0003e0",
        "marked": "p_size % 5 = 0",
    }, "true"),
    "base": ("supplier", {
        "seg": "s_suppkey",
        "name": f"CASE WHEN s_suppkey % 17 < 2 THEN {_name('40 + s_suppkey % 2')} ELSE {_name('s_suppkey % 23')} END",
        "other_name": f"CASE WHEN s_suppkey % 10 = 0 THEN {_name('s_suppkey % 27')} END",
        "road": "CASE s_suppkey % 3 WHEN 0 THEN 'rua' WHEN 1 THEN 'avenida' END",
        "district": _chosen("s_nationkey % 5", _DISTRICTS),
        "complex": "CASE WHEN s_suppkey % 4 = 0 THEN 'residencial ' || (s_suppkey % 8) END",
        "city": "'city ' || (s_nationkey % 5)",
        "lat": _LAT.format(n="s_nationkey") + " + (s_suppkey % 9) * 0.001e0",
        "lng": _LNG.format(n="s_nationkey") + " + (s_suppkey % 11) * 0.001e0",
    }, "true"),
    "codes": ("nation, range(4) AS t(k)", {
        "cep": _CODE.format(n="n_nationkey", k="k"),
        "code_street": _name("(n_nationkey * 4 + k) % 40"),
        "code_district": _chosen("n_nationkey % 5", _DISTRICTS),
        "code_city": "'city ' || (n_nationkey % 5)",
        "code_lat": f"CASE WHEN n_nationkey % 2 = 0 THEN {_LAT.format(n='n_nationkey')} + k * 0.003e0 END",
        "code_lng": f"CASE WHEN n_nationkey % 2 = 0 THEN {_LNG.format(n='n_nationkey')} END",
    }, "true"),
    "answers": ("orders", {
        "id": "o_orderkey",
        "asked": _name("o_orderkey % 40"),
        "number": "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey * 3 % 500 END",
        "city": "'city ' || (o_custkey % 5)",
        "name": f"CASE WHEN o_orderkey % 4 = 0 THEN 'outra estrada' ELSE {_name('o_orderkey % 40')} END",
        "precision": "CASE WHEN o_orderkey % 3 > 0 THEN 'bom' ELSE 'rua' END",
        "lat": "-9.5e0 + (o_orderkey % 101) * 0.001e0",
        "lng": "-35.69e0 + (o_orderkey % 97) * 0.001e0",
    }, "o_orderkey % 5 < 4"),
}


def _table(spark, sf, name: str):
    source, columns, condition = TABLES[name]
    rows = load(spark, sf, source.split(",")[0])
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))) if "range" in source else rows
    return rows.where(condition).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def _cte(name: str) -> str:
    source, columns, condition = TABLES[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {condition})"


SOURCES = f"""{_cte('asked')}, {_cte('census')}, {_cte('base')}, {_cte('answers')},
{_cte('codes')},
marked AS (SELECT *, avg(lat) OVER (PARTITION BY cep) AS l_lat, avg(lng) OVER (PARTITION BY cep) AS l_lng FROM census WHERE marked),
learned AS (SELECT cep, l_lat, l_lng, count(*) AS marks, max({v.haversine_sql('l_lat', 'l_lng', 'lat', 'lng')}) AS l_radius FROM marked GROUP BY ALL),
centred AS (SELECT *, avg(lat) OVER (PARTITION BY district, city) AS d_lat, avg(lng) OVER (PARTITION BY district, city) AS d_lng FROM census),
districts AS (SELECT district, city, d_lat, d_lng, max({v.haversine_sql('d_lat', 'd_lng', 'lat', 'lng')}) AS d_radius FROM centred GROUP BY ALL),
outside AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked, number, city ORDER BY id) AS r FROM answers) WHERE r = 1)"""

_FITS = "coalesce(len({a}) > 0 AND len(list_filter({a}, lambda w: len(list_filter({b}, lambda t: w = t OR (length(w) >= 5 AND levenshtein(w, t) <= 1))) = 0)) = 0, false)"
_SAME = "coalesce({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})), false)"


def _fits(a: str, b: str) -> str:
    return _FITS.format(a=f"string_split({a}, ' ')", b=f"string_split({b}, ' ')")


def _choice(pairs: str, out: str) -> str:
    """CTEs that choose a segment for each stop of a CTE of pairs (see segment_choice)."""
    placed = f"(place IS NOT NULL AND ({_SAME.format(a='complex', b='place')} OR {_SAME.format(a='district', b='place')}))"
    return f"""{out}_rows AS (SELECT *, NOT (road IS NULL OR seg_road IS NULL OR seg_road = road) AS t, NOT {placed} AS p, {v.haversine_sql('near_lat', 'near_lng', 'lat', 'lng')} AS far, length(replace(name, ' ', '')) <= 2 AS short FROM {pairs}),
{out} AS (SELECT stop, b.seg AS seg, b.lat AS lat, b.lng AS lng, b.name AS name FROM (
  SELECT stop, min({{'t': t, 'p': p, 'far': far, 'seg': seg, 'lat': lat, 'lng': lng, 'name': name}}) AS b, count(*) AS n, count(*) FILTER (WHERE NOT t) AS typed, bool_or(short) AS generic FROM {out}_rows GROUP BY stop)
  WHERE NOT (b.p AND generic AND CASE WHEN typed > 0 THEN typed ELSE n END > 1))"""


def _base(asked: str, x: str) -> str:
    """CTEs that look the streets of a CTE up on the base; the last one is {x}base."""
    cols = "a.stop, a.street, a.road, a.place, a.city, a.near_lat, a.near_lng"
    seg = "b.seg, b.name, b.road AS seg_road, b.district, b.complex, b.lat, b.lng"
    word = "list_max(list_transform(string_split(a.street, ' '), lambda w: {'n': length(w), 'w': w}))"
    return f"""{x}own AS (SELECT {cols}, a.street IN (SELECT name FROM base) AS own FROM {asked} a WHERE street IS NOT NULL),
{x}here AS (SELECT {cols}, {seg} FROM {x}own a JOIN base b ON a.city = b.city AND (a.street = b.name OR (NOT a.own AND a.street = b.other_name))),
{_choice(f'{x}here', f'{x}in_city')},
{x}away AS (SELECT {cols}, {seg} FROM {x}own a JOIN base b ON a.street = b.name OR (NOT a.own AND a.street = b.other_name) WHERE a.stop NOT IN (SELECT stop FROM {x}here)),
{x}parts AS (SELECT {cols}, {seg} FROM {x}own a JOIN base b ON a.city = b.city AND contains(b.name, {word}.w) WHERE NOT a.own AND length({word}.w) >= 4 AND {_fits('a.street', 'b.name')} AND a.stop NOT IN (SELECT stop FROM {x}here)),
{_choice(f'{x}away', f'{x}elsewhere')},
{_choice(f'{x}parts', f'{x}by_word')},
{x}base AS (SELECT * FROM {x}in_city UNION ALL SELECT * FROM {x}elsewhere WHERE stop NOT IN (SELECT stop FROM {x}parts) UNION ALL SELECT * FROM {x}by_word)"""


def _pass(asked: str, x: str) -> str:
    """CTEs of all stages over a CTE of stops; the last one is {x}all."""
    inside = f"{v.haversine_sql('o.near_lat', 'o.near_lng', 'c.lat', 'c.lng')} <= 100000"
    far = f"(code_lat IS NOT NULL AND {v.haversine_sql('c.lat', 'c.lng', 'code_lat', 'code_lng')} >= 2500)"
    valid = f"CASE WHEN {_fits('o.street', 'c.name')} AND NOT {far} THEN c.precision ELSE 'ruim' END"
    told = lambda at, source: f"o.stop, {at} AS stage, '{source}' AS source"
    good = "precision IN ('bom', 'rua')"
    return f"""{x}open AS (SELECT a.* REPLACE (coalesce(code_street, street) AS street), code_street, code_district, code_lat, code_lng FROM {asked} a LEFT JOIN codes USING (cep)),
{x}exact AS (SELECT {told(0, 'census')}, 'bom' AS precision, arg_min(c.lat, door) AS lat, arg_min(c.lng, door) AS lng FROM {x}open o JOIN census c USING (cep, number, city) WHERE {inside} GROUP BY o.stop),
{x}open2 AS (FROM {x}open WHERE stop NOT IN (SELECT stop FROM {x}exact)),
{x}street AS (SELECT {told(0, 'census street')}, 'bom' AS precision, arg_min(c.lat, ({v.haversine_sql('o.near_lat', 'o.near_lng', 'c.lat', 'c.lng')}, door)) AS lat, arg_min(c.lng, ({v.haversine_sql('o.near_lat', 'o.near_lng', 'c.lat', 'c.lng')}, door)) AS lng
  FROM {x}open2 o JOIN census c USING (street, number, city) WHERE o.cep IS NULL AND o.place IS NULL AND {inside} GROUP BY o.stop),
{x}open3 AS (FROM {x}open2 WHERE stop NOT IN (SELECT stop FROM {x}street)),
{x}next AS (SELECT {told(0, 'next door')}, 'rua' AS precision, arg_min(c.lat, (abs(c.number - o.number), door)) AS lat, arg_min(c.lng, (abs(c.number - o.number), door)) AS lng FROM {x}open3 o JOIN census c USING (cep, city) WHERE abs(c.number - o.number) <= 20 AND {inside} GROUP BY o.stop),
{x}open4 AS (FROM {x}open3 WHERE stop NOT IN (SELECT stop FROM {x}next)),
{x}marks AS (SELECT {told(1, 'learned code')}, 'rua' AS precision, c.lat, c.lng FROM {x}open4 o JOIN (SELECT cep, l_lat AS lat, l_lng AS lng FROM learned WHERE marks >= 2 AND l_radius <= 400) c USING (cep) WHERE {inside}),
{_base(f'{x}open4', x)},
{x}on_base AS (SELECT {told(0, 'base')}, 'rua' AS precision, c.lat, c.lng FROM {x}base c JOIN {asked} o USING (stop) WHERE {inside}),
{x}open5 AS (FROM {x}open4 WHERE stop NOT IN (SELECT stop FROM {x}on_base)),
{x}numbered AS (SELECT {told(2, 'outside')}, {valid} AS precision, c.lat, c.lng FROM {x}open5 o JOIN outside c ON o.street = c.asked AND o.number = c.number AND o.city = c.city WHERE code_street IS NOT NULL),
{x}coded AS (SELECT {told(3, 'code')}, 'rua' AS precision, code_lat AS lat, code_lng AS lng FROM {x}open5 o WHERE code_lat IS NOT NULL AND stop NOT IN (SELECT stop FROM {x}numbered WHERE precision = 'bom')),
{x}still AS (FROM {x}open5 WHERE stop NOT IN (SELECT stop FROM {x}marks UNION ALL SELECT stop FROM {x}coded UNION ALL SELECT stop FROM {x}numbered WHERE {good})),
{x}plain AS (SELECT {told(4, 'outside')}, {valid} AS precision, c.lat, c.lng FROM {x}still o JOIN outside c ON o.street = c.asked AND c.number IS NULL AND o.city = c.city),
{x}last AS (SELECT o.*, coalesce(code_district, posted) AS district FROM {x}still o LEFT JOIN (SELECT code_street AS street, code_city AS city, arg_min(code_district, cep) AS posted FROM codes GROUP BY ALL) USING (street, city)
  WHERE street IS NOT NULL AND stop NOT IN (SELECT stop FROM {x}plain WHERE {good})),
{x}centre AS (SELECT {told(-1, 'district')}, 'bairro' AS precision, d_lat AS lat, d_lng AS lng FROM {x}last o JOIN districts USING (district, city)),
{x}all AS (FROM {x}exact UNION ALL FROM {x}street UNION ALL FROM {x}next UNION ALL FROM {x}marks UNION ALL FROM {x}on_base UNION ALL FROM {x}numbered UNION ALL FROM {x}coded UNION ALL FROM {x}plain UNION ALL FROM {x}centre)"""


def _stops(spark, sf):
    return _table(spark, sf, "asked").withColumn("places", F.array_compact(F.array("place"))).drop("place")


def _sources(spark, sf) -> cascade.Sources:
    from ..functions.geo import haversine

    census = settled(_table(spark, sf, "census"), "census")
    codes = _table(spark, sf, "codes").withColumnsRenamed({f"code_{c}": c for c in ("street", "district", "city", "lat", "lng")})

    def centred(doors, *keys):
        middle = doors.groupBy(*keys).agg(F.avg("lat").alias("m_lat"), F.avg("lng").alias("m_lng"))
        far = doors.join(middle, list(keys)).groupBy(*keys, "m_lat", "m_lng").agg(F.count("*").alias("marks"), F.max(haversine("m_lat", "m_lng", "lat", "lng")).alias("radius_m"))
        return settled(far.withColumnsRenamed({"m_lat": "lat", "m_lng": "lng"}), "centres")

    answers = _table(spark, sf, "answers")
    told = [c for c in answers.columns if c not in ("asked", "number", "city", "id")]
    outside = answers.groupBy("asked", "number", "city").agg(F.min(F.struct("id", *told)).alias("first")).select("asked", "number", "city", *(f"first.{c}" for c in told))
    return cascade.Sources(census.drop("marked"), codes, centred(census.where("marked"), "cep"), settled(_table(spark, sf, "base"), "base"), settled(outside, "outside"), centred(census, "district", "city"))


@query("o08_resolution_cascade", f"""WITH {SOURCES}, {_pass('asked', 'a_')},
lost AS (FROM asked WHERE street IS NOT NULL AND stop NOT IN (SELECT stop FROM a_all WHERE precision IN ('bom', 'rua'))),
names AS (SELECT DISTINCT street AS name FROM lost), known AS (SELECT DISTINCT street AS candidate FROM census),
edits AS (SELECT name, candidate, levenshtein(name, candidate) AS edits, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, candidate), candidate) AS r FROM names JOIN known ON name <> candidate WHERE length(name) >= 8),
bent AS (SELECT x.name, x.candidate FROM edits x LEFT JOIN edits y ON x.name = y.name AND y.r = 2 WHERE x.r = 1 AND x.edits <= 0.35 * length(x.name) AND coalesce(y.edits - x.edits, 3) >= 3
  AND array_to_string(regexp_extract_all(x.name, '[0-9]+'), ' ') = array_to_string(regexp_extract_all(x.candidate, '[0-9]+'), ' ')),
again AS (SELECT lost.* REPLACE (candidate AS street) FROM lost JOIN bent ON lost.street = bent.name),
{_pass('again', 'b_')},
better AS (SELECT DISTINCT stop FROM b_all WHERE precision IN ('bom', 'rua')),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stop, round(lat, 5), round(lng, 5) ORDER BY stage, source) AS again
  FROM (SELECT * FROM a_all WHERE stop NOT IN (FROM better) UNION ALL SELECT * FROM b_all WHERE stop IN (FROM better))) WHERE again = 1),
anchors AS (SELECT stop, CASE WHEN l_lat IS NOT NULL THEN l_lat ELSE d_lat END AS a_lat, CASE WHEN l_lat IS NOT NULL THEN l_lng ELSE d_lng END AS a_lng, greatest(3000, 2 * CASE WHEN l_lat IS NOT NULL THEN l_radius ELSE d_radius END) AS limit_m
  FROM asked a LEFT JOIN learned USING (cep) LEFT JOIN districts d ON d.district = a.place AND d.city = a.city),
judged AS (SELECT kept.*, a_lat IS NOT NULL AND {v.haversine_sql('lat', 'lng', 'a_lat', 'a_lng')} > limit_m AS fled FROM kept JOIN anchors USING (stop)),
final AS (SELECT stop, stage, source, CASE WHEN fled THEN 'ruim' ELSE precision END AS precision, lat, lng FROM judged
  UNION ALL SELECT stop, -2, 'anchor', 'bairro', a_lat, a_lng FROM anchors WHERE a_lat IS NOT NULL AND stop NOT IN (SELECT stop FROM judged WHERE NOT fled))
SELECT stop, place, source, precision, round(lat, 4) AS lat, round(lng, 4) AS lng FROM (
  SELECT *, row_number() OVER (PARTITION BY stop ORDER BY CASE precision WHEN 'bom' THEN 1 WHEN 'rua' THEN 2 WHEN 'bairro' THEN 3 ELSE 3.5 END, stage, source, lat, lng) AS place FROM final) WHERE place <= 6""")
def _(spark, sf):
    found = cascade.resolve(_stops(spark, sf), _sources(spark, sf))
    return found.withColumns({c: F.round(c, 4) for c in ("lat", "lng")})


@query("j30_street_on_the_base", f"""WITH {_cte('asked')}, {_cte('base')}, {_base('asked', 'a_')} SELECT stop, seg, name FROM a_base""")
def _(spark, sf):
    base = settled(_table(spark, sf, "base"), "base")
    return cascade.street_on_the_base(_stops(spark, sf).where("street IS NOT NULL"), base, cascade.name_index(base)).select("stop", "seg", "name")
