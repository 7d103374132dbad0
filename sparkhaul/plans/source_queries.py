"""Queries that write derived files to the shared folder and read them by the sources, and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import settled, shared_folder
from ..session import load
from ..sources import readers, sinks
from . import views as v
from .registry import registry

QUERIES, query = registry()

_SHEET = {"AT ID": "'R' || route", "Sequence": "CASE WHEN additional THEN '-' ELSE CAST(seq AS STRING) END", "Stop": "CAST(carrier AS STRING)", "SPX TN": "'TN' || stop", "Destination Address": "address", "Bairro": "district", "City": "'Aracaju'", "Zipcode/Postal code": "CAST(cep AS STRING)",
    "Latitude": "CASE stop % 5 WHEN 0 THEN '-35,' || (600000 + stop % 9000) WHEN 1 THEN '48.5' WHEN 2 THEN '-9.4' ELSE '-9.' || (400000 + stop % 9000) END", "Longitude": "CASE stop % 5 WHEN 0 THEN '-9,' || (400000 + stop % 9000) WHEN 1 THEN '2.35' WHEN 2 THEN '-35.6' ELSE '-35.' || (600000 + stop % 9000) END"}


def _sheet(spark, sf):
    path = shared_folder(spark, "sheet")
    v.stops(spark, sf).select(*(F.expr(e).alias(n) for n, e in _SHEET.items())).write.csv(path, header=True)
    return readers.sheet(spark, path)


@query("src01_sheet_rows", f"WITH {v.STOPS} SELECT 'R' || route AS at_id, 'TN' || stop AS code, district, CAST(cep AS VARCHAR) AS cep FROM stops")
def _(spark, sf):
    return _sheet(spark, sf).select("at_id", "code", "district", "cep")


@query("src03_headings", f"WITH {v.STOPS} SELECT 'TN' || stop AS code, CASE WHEN additional THEN '-' ELSE CAST(seq AS VARCHAR) END AS sequence, CAST(carrier AS VARCHAR) AS stop, address, 'Aracaju' AS city FROM stops")
def _(spark, sf):
    return _sheet(spark, sf).select("code", "sequence", "stop", "address", "city")


_POINT = "CASE stop % 5 WHEN 1 THEN NULL WHEN 2 THEN {1} ELSE CAST('{0}.' || ({2} + stop % 9000) AS DOUBLE) END"


@query("src04_repaired_positions", f"WITH {v.STOPS} SELECT 'TN' || stop AS code, {_POINT.format('-9', '-9.4', 400000)} AS lat, {_POINT.format('-35', '-35.6', 600000)} AS lng, stop % 5 = 2 AS approximate FROM stops")
def _(spark, sf):
    return readers.repaired(_sheet(spark, sf)).select("code", "lat", "lng", "approximate")


@query("src11_manifest", f"WITH {v.STOPS} SELECT district, 'A-' || route AS cage, count(*) AS n FROM stops WHERE stop % 10 <> 0 GROUP BY ALL")
def _(spark, sf):
    path = shared_folder(spark, "manifest")
    rows = v.stops(spark, sf).selectExpr("CASE WHEN stop % 10 = 0 THEN '' ELSE ' ' || district END AS Neighborhood", "'a-' || route AS `Cage name`", "stop")
    rows.write.csv(path, header=True, emptyValue="", ignoreLeadingWhiteSpace=False)
    return readers.manifest(spark, path).groupBy("district", "cage").agg(F.count("*").alias("n"))


@query("src12_census_files", f"WITH {v.STOPS} SELECT cep, number, district, 'RUA ' || upper(street) AS street, count(*) AS n FROM stops GROUP BY ALL")
def _(spark, sf):
    path = shared_folder(spark, "census")
    rows = v.stops(spark, sf).selectExpr("cep AS CEP", "district AS DSC_LOCALIDADE", "'RUA' AS NOM_TIPO_SEGLOGR", "'' AS NOM_TITULO_SEGLOGR", "upper(street) AS NOM_SEGLOGR", "number AS NUM_ENDERECO", "lat AS LATITUDE", "lng AS LONGITUDE")
    rows.write.csv(path, sep=";", header=True)
    return readers.census(spark, path).groupBy("cep", "number", "district", "street").agg(F.count("*").alias("n"))


@query("src15_geojson_lines", f"WITH {v.VERTICES} SELECT 'seg ' || seg AS name, CAST(0 AS BIGINT) AS part, i, round(lat, 6) AS lat, round(lng, 6) AS lng FROM vertices")
def _(spark, sf):
    path = shared_folder(spark, "geojson")
    line = F.array_sort(F.collect_list(F.struct("i", F.array("lng", "lat").alias("p"))))  # four vertices
    coords = F.transform(line, lambda x: x["p"])
    x = v.vertices(spark, sf).groupBy("seg").agg(coords.alias("c"))
    kind = F.when(F.col("seg") % 2 == 0, "MultiLineString").otherwise("LineString")
    geometry = F.when(F.col("seg") % 2 == 0, F.to_json(F.array("c"))).otherwise(F.to_json("c"))
    feature = F.concat(F.lit('{"properties":{"nome":"seg '), F.col("seg").cast("string"), F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'), geometry, F.lit("}}"))
    # a file has a few hundred features, so files are as many as the lines ask for and not one for each
    files = x.select(feature.alias("value"), F.floor(F.col("seg") / 500).alias("file")).groupBy("file").agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    files.write.partitionBy("file").text(path)
    found = readers.geojson_lines(spark, f"{path}/file=*", "nome")
    return found.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query("src18_backup_read", f"WITH {v.STOPS} SELECT stop, route, address FROM stops")
def _(spark, sf):
    path = shared_folder(spark, "backup")
    sinks.backup({"stops": v.stops(spark, sf).select("stop", "route", "address")}, path)
    return sinks.verified_backup(spark, path, "stops", "stop bigint, route bigint, address string")


@query("src22_doors_in_lines", f"WITH {v.STOPS} SELECT 'Door ' || stop AS name, CAST('-9.' || (400000 + stop) AS DOUBLE) AS lat, CAST('-35.' || (600000 + stop) AS DOUBLE) AS lng FROM stops WHERE stop % 4 <> 3")
def _(spark, sf):
    path = shared_folder(spark, "doors")
    pair = "CASE stop % 4 WHEN 0 THEN '-9.' || (400000 + stop) || ', -35.' || (600000 + stop) WHEN 1 THEN 'https://maps.google.com/?q=-9.' || (400000 + stop) || ',-35.' || (600000 + stop) WHEN 2 THEN 'https://x/!3d-9.' || (400000 + stop) || '!4d-35.' || (600000 + stop) ELSE 'none' END"
    v.stops(spark, sf).selectExpr(f"'Door ' || stop || '; ' || {pair} AS value").write.text(path)
    return readers.doors_in_lines(spark, path)


@query("src25_osm_areas", f"WITH {v.AREAS} SELECT CAST(area AS BIGINT) AS id, 'area ' || area AS name, CAST(4 AS BIGINT) AS points, round(2 * half, 6) AS height, round(2 * half, 6) AS width FROM areas")
def _(spark, sf):
    path = shared_folder(spark, "osm")
    a = v.areas(spark, sf)
    ring = F.array(*(F.struct((F.col("lat") + y * F.col("half")).alias("lat"), (F.col("lng") + x * F.col("half")).alias("lon")) for y, x in ((-1, -1), (-1, 1), (1, 1), (1, -1))))
    relation = F.col("area") % 2 == 0
    members = F.when(relation, F.array(F.struct(F.lit("outer").alias("role"), ring.alias("geometry")), F.struct(F.lit("inner").alias("role"), ring.alias("geometry"))))
    tags = F.create_map(F.when(F.col("area") % 3 == 0, "alt_name").otherwise("name"), F.concat(F.lit("area "), F.col("area").cast("string")))
    e = F.struct(F.col("area").cast("long").alias("id"), F.when(relation, "relation").otherwise("way").alias("type"), tags.alias("tags"), F.when(~relation, ring).alias("geometry"), members.alias("members"))
    a.select(F.to_json(F.struct(F.array(e).alias("elements"))).alias("value"), F.col("area").alias("part")).write.partitionBy("part").text(path)
    return readers.osm_areas(spark, f"{path}/part=*").withColumns({"height": F.round("height", 6), "width": F.round("width", 6)})


@query("src02_file_kinds", None)
def _(spark, sf):
    path = shared_folder(spark, "kinds")
    v.stops(spark, sf).select("address").coalesce(2).write.csv(f"{path}/sheets")
    return readers.sniffed(spark, f"{path}/sheets").groupBy("kind").agg(F.count("*").alias("n"))


@query("src05_pasted_lists", f"WITH {v.STOPS} SELECT count(*) AS lines, count(DISTINCT address) AS addresses FROM stops WHERE street NOT LIKE '% Dr %'")
def _(spark, sf):
    path = shared_folder(spark, "lists")
    v.stops(spark, sf).selectExpr("route", "CASE WHEN stop % 3 = 0 THEN street || ',\n' || number || substr(address, length(street || ', ' || number) + 1) ELSE address || ' https://x.y/' || stop END AS value").write.partitionBy("route").text(path)
    return readers.list_lines(spark, f"{path}/route=*").agg(F.count("*").alias("lines"), F.countDistinct("address").alias("addresses"))


@query("src06_labelled_lists", f"WITH {v.STOPS} SELECT CAST(stop AS VARCHAR) AS order_id, address FROM stops")
def _(spark, sf):
    path = shared_folder(spark, "labelled")
    v.stops(spark, sf).selectExpr("route", "'Pedido # ' || stop || '\nCliente: x\nEndereço: ' || address || '\nTotal 3' AS value").write.partitionBy("route").text(path)
    return readers.labelled_list(spark, f"{path}/route=*").select("order_id", "address")


@query("src07_receipts", f"WITH {v.STOPS} SELECT CASE WHEN street NOT LIKE '% Dr %' THEN address END AS address, district, 'casa azul' AS reference FROM stops")
def _(spark, sf):
    path = shared_folder(spark, "receipts")
    sinks.documents(v.stops(spark, sf).selectExpr("'ENTREGA\nTelefone: 0800 123\n' || address || '\nAracaju - ' || district || '\nRef: casa azul\nTotal 30' AS value"), path)
    return readers.receipts(readers.documents(spark, path)).select("address", "district", "reference")


@query("src07_vote_of_readings", f"WITH {v.STOPS}, r AS (SELECT route, CASE WHEN stop % 3 = 0 THEN lower(street) ELSE street END AS said FROM stops), n AS (SELECT route, said, count(*) AS n FROM r GROUP BY ALL) SELECT route, said FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY n DESC, length(said) DESC, said DESC) AS r FROM n) WHERE r = 1")
def _(spark, sf):
    return readers.voted(v.stops(spark, sf).selectExpr("route", "CASE WHEN stop % 3 = 0 THEN lower(street) ELSE street END AS said"), "route", "said")


@query("src08_lines_of_pages", f"WITH {v.STOPS}, r AS (SELECT route AS page, seq AS x, (stop % 7) * 4 + 0.5e0 AS y, 'w' || stop AS text FROM stops) SELECT page, CAST(round(y / 4) AS BIGINT) AS line, string_agg(text, ' ' ORDER BY x, text) AS text FROM r GROUP BY ALL")
def _(spark, sf):
    return readers.page_lines(v.stops(spark, sf).selectExpr("route AS page", "seq AS x", "(stop % 7) * 4 + 0.5e0 AS y", "'w' || stop AS text"))


_FRAMES = """f AS (SELECT vec_id // 50 AS video, vec_id % 50 AS frame, list_transform(embedding, lambda x: 128 + 100 * x::DOUBLE) AS rows FROM embeddings),
p AS (SELECT a.video, a.frame, a.rows AS b, z.rows AS a, least(len(a.rows), len(z.rows)) AS n FROM f a JOIN f z ON z.video = a.video AND z.frame = a.frame - 1),
t AS (SELECT video, frame, n, s, list_sum(list_transform(range(greatest(0, -s), least(n, n - s)), lambda i: abs(a[i + s + 1] - b[i + 1]))) / (n - abs(s)) + abs(s) * 1e-6 AS error FROM p, unnest(range(-CAST(floor(n * 0.6) AS BIGINT), CAST(floor(n * 0.6) AS BIGINT) + 1)) AS x(s)),
m AS (SELECT video, frame, n AS height, arg_min(s, (error, s)) AS shift, min(error) AS error FROM t GROUP BY ALL)"""


def _shifts(spark, sf):
    frames = load(spark, sf, "embeddings").select(F.expr("vec_id div 50").alias("video"), (F.col("vec_id") % 50).alias("frame"), F.transform("embedding", lambda x: 128 + 100 * x.cast("double")).alias("rows"))
    return readers.frame_shifts(settled(frames, "frames"))


@query("src10_shifted_frames", f"WITH {_FRAMES} SELECT video, frame, shift, round(error, 6) AS error FROM m")
def _(spark, sf):
    return _shifts(spark, sf).select("video", "frame", F.col("shift").cast("long").alias("shift"), F.round("error", 6).alias("error"))


@query("src10_key_frames", f"""WITH RECURSIVE {_FRAMES}, last AS (SELECT video, max(frame) AS last FROM m GROUP BY video),
w AS (SELECT DISTINCT video, 0::BIGINT AS frame, 0::BIGINT AS kept, 0::BIGINT AS moved, false AS jump, 0::BIGINT AS height FROM m
UNION ALL SELECT m.video, m.frame, CASE WHEN m.error > 20 OR w.moved + abs(m.shift) >= m.height * 0.45 THEN m.frame ELSE w.kept END, CASE WHEN m.error > 20 OR w.moved + abs(m.shift) >= m.height * 0.45 THEN 0 ELSE w.moved + abs(m.shift) END, m.error > 20, m.height
  FROM w JOIN m ON m.video = w.video AND m.frame = w.frame + 1)
SELECT video, frame, bool_or(jump) OVER (PARTITION BY video) AS fast FROM w JOIN last USING (video) QUALIFY kept = frame OR (frame = last AND moved > height * 0.1)""")
def _(spark, sf):
    return readers.key_frames(_shifts(spark, sf))


@query("src20_link_parts", f"WITH {v.STOPS}, s AS (SELECT stop, 'https://maps.google.com/x/data=!1s0x' || lower(printf('%016x', stop * 7919)) || ':0x' || lower(printf('%x', stop)) || '!3d-9.' || (400000 + stop) || '!4d-35.6000' AS link FROM stops) SELECT stop, CAST(stop AS VARCHAR) AS place_number, CAST('-9.' || (400000 + stop) AS DOUBLE) AS lat FROM s")
def _(spark, sf):
    from ..functions import text as t

    s = v.stops(spark, sf).selectExpr("stop", "'https://maps.google.com/x/data=!1s0x' || lower(lpad(hex(stop * 7919), 16, '0')) || ':0x' || lower(hex(stop)) || '!3d-9.' || (400000 + stop) || '!4d-35.6000' AS link")
    return s.select("stop", t.hex_to_decimal(F.regexp_extract("link", "!1s0x[0-9a-f]+:0x([0-9a-f]+)", 1)).alias("place_number"), t.coordinate("link", 1).alias("lat"))


_NAMES = "CASE stop % 3 WHEN 0 THEN street || ';' || lower(street) ELSE street END"


@query("src23_candidates", f"WITH {v.STOPS}, c AS (SELECT stop, {_NAMES} AS names, CASE WHEN stop % 4 = 0 THEN number END AS number FROM stops) SELECT stop, CASE WHEN number IS NOT NULL THEN 'door' WHEN names <> '' THEN 'street' ELSE 'district' END AS precision, CAST(len(list_distinct(string_split(names, ';'))) AS BIGINT) AS names FROM c")
def _(spark, sf):
    c = v.stops(spark, sf).selectExpr("stop", f"{_NAMES} AS names", "CASE WHEN stop % 4 = 0 THEN number END AS number")
    precision = F.when(F.col("number").isNotNull(), "door").when(F.col("names") != "", "street").otherwise("district")
    return c.select("stop", precision.alias("precision"), F.size(F.array_distinct(F.split("names", ";"))).cast("long").alias("names"))


@query("snk02_merge_update", f"WITH {v.STOPS}, old AS (SELECT stop, street, number FROM stops WHERE stop % 3 <> 0), new AS (SELECT stop, CASE WHEN stop % 2 = 0 THEN upper(street) END AS street, number + 1 AS number FROM stops WHERE stop % 3 <> 1) SELECT coalesce(o.stop, n.stop) AS stop, coalesce(n.street, o.street) AS street, coalesce(n.number, o.number) AS number FROM old o FULL JOIN new n ON o.stop = n.stop")
def _(spark, sf):
    s = v.stops(spark, sf)
    new = s.where("stop % 3 <> 1").selectExpr("stop", "CASE WHEN stop % 2 = 0 THEN upper(street) END AS street", "number + 1 AS number")
    return sinks.merged(s.where("stop % 3 <> 0").select("stop", "street", "number"), new, ["stop"])


@query("snk03_slices_replaced", f"WITH {v.STOPS} SELECT stop, number, district FROM stops WHERE district <> 'BUILDING' UNION ALL SELECT stop, number + 1000, district FROM stops WHERE district = 'BUILDING' AND stop % 2 = 0")
def _(spark, sf):
    s = v.stops(spark, sf).select("stop", "number", "district")
    new = s.where("district = 'BUILDING' AND stop % 2 = 0").withColumn("number", F.col("number") + 1000)
    return sinks.slice_replaced(s, new, shared_folder(spark, "slices"), ["district"])


@query("snk04_batch_update", f"WITH {v.STOPS} SELECT stop, CASE WHEN stop % 50 = 0 THEN left(street, 4) ELSE street END AS street, CASE WHEN stop % 100 = 0 THEN number + 5 ELSE number END AS number FROM stops")
def _(spark, sf):
    s = v.stops(spark, sf).select("stop", "street", "number")
    changes = s.where("stop % 50 = 0").select("stop", F.left("street", F.lit(4)).alias("street"), F.when(F.col("stop") % 100 == 0, F.col("number") + 5).alias("number"))
    return sinks.updated(s, changes, ["stop"])


_KEYS = "place LIKE '1%'"


def _decided(approve: bool) -> str:
    hit = f"(pending AND driver % 20 = 8 AND {_KEYS})"
    rows = "" if approve else f" WHERE NOT ({hit} AND correction)"
    return f"SELECT id, {str(approve).lower()} AS approved, CASE WHEN {hit} THEN false ELSE pending END AS pending, refused OR ({hit} AND {str(not approve).lower()}) AS refused FROM evidence{rows}"


@query("snk05_decisions", f"WITH {v.EVIDENCE} {_decided(True)} UNION ALL {_decided(False)}")
def _(spark, sf):
    e = v.evidence(spark, sf).withColumn("driver", F.col("driver") % 20)
    keys = e.where(_KEYS).select("place").distinct()
    both = [sinks.decided(e, 8, keys, ok).select("id", F.lit(ok).alias("approved"), "pending", "refused") for ok in (True, False)]
    return both[0].unionByName(both[1])


@query("snk06_backup_manifest", f"WITH {v.STOPS}, {v.SEGMENTS} SELECT 'stops' AS name, count(*) AS rows FROM stops UNION ALL SELECT 'segments', count(*) FROM segments")
def _(spark, sf):
    tables = {"stops": v.stops(spark, sf).select("stop", "address"), "segments": v.segments(spark, sf).select("seg", "source")}
    return sinks.backup(tables, shared_folder(spark, "backup")).select("name", "rows")
