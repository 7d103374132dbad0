"""Readers of text formats into DataFrames. Parsing is by column expressions, so files of any number are read in parallel."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as a
from ..functions import text as t

# How columns of a route sheet may be headed, in the order they are looked for.
SHEET_COLUMNS = {
    "at_id": r"(?i)^at[ _]?id|rota", "sequence": r"(?i)^sequence|sequ[eê]ncia", "stop": r"(?i)^stop|^parada", "code": r"(?i)spx|tracking|^tn$|c[oó]digo",
    "address": r"(?i)destination|address|endere[cç]o", "district": r"(?i)neighbo|bairro", "city": r"(?i)^city|cidade", "cep": r"(?i)zip|postal|^cep",
    "lat": r"(?i)^lat", "lng": r"(?i)^l(on|ng)",
}
#: The box of the country that positions must lie in.
SOUTH, NORTH, WEST, EAST = -34.0, 6.0, -74.5, -32.0


def sheet(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Rows of CSV sheets as text, under the names of SHEET_COLUMNS found among their headings; others are empty texts."""
    raw = spark.read.csv(path, sep=separator, header=True)
    found = {}
    for name, pattern in SHEET_COLUMNS.items():
        heading = next((c for c in raw.columns if re.search(pattern, c) and c not in found.values()), None)
        if heading is not None:
            found[name] = heading
    return raw.select(*(F.coalesce(F.trim(F.col(f"`{found[n]}`")), F.lit("")).alias(n) if n in found else F.lit("").alias(n) for n in SHEET_COLUMNS))


def number(text: str) -> Column:
    """A number with a decimal comma or point, or null."""
    return F.expr(f"try_cast(replace(trim({text}), ',', '.') AS DOUBLE)")


def repaired(rows: DataFrame) -> DataFrame:
    """rows with lat and lng as numbers: swapped if only that puts them into the country, null outside it; `approximate` if they have two decimals at most."""
    lat, lng = number("lat"), number("lng")
    rows = rows.withColumns({"__lat": lat, "__lng": lng, "__short": ~F.col("lat").rlike(r"[.,]\d{3,}") | ~F.col("lng").rlike(r"[.,]\d{3,}")})

    def inside(y: str, x: str) -> Column:
        return F.coalesce(F.col(y).between(SOUTH, NORTH) & F.col(x).between(WEST, EAST), F.lit(False))

    right, swapped = inside("__lat", "__lng"), inside("__lng", "__lat")
    value = {c: F.when(right, F.col(f"__{c}")).when(swapped, F.col(f"__{o}")) for c, o in (("lat", "lng"), ("lng", "lat"))}
    out = rows.withColumns({"lat_": value["lat"], "lng_": value["lng"], "approximate": F.col("__short") & (right | swapped)})
    return out.drop("__lat", "__lng", "__short", "lat", "lng").withColumnsRenamed({"lat_": "lat", "lng_": "lng"})


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """district, cage of manifest files: rows that have both; cages in capitals."""
    raw = spark.read.csv(path, header=True)
    heading = {n: next(c for c in raw.columns if re.search(p, c)) for n, p in (("district", r"(?i)neighbo|bairro"), ("cage", r"(?i)cage|gaiola"))}
    rows = raw.select(F.trim(F.col(f"`{heading['district']}`")).alias("district"), F.upper(F.trim(F.col(f"`{heading['cage']}`"))).alias("cage"))
    return rows.where("district <> '' AND cage <> ''")


def census(spark: SparkSession, path: str) -> DataFrame:
    """cep, number, district, street, lat, lng of census files, separated by semicolons; a missing column is an error."""
    raw = spark.read.csv(path, sep=";", header=True)
    missing = {"CEP", "DSC_LOCALIDADE", "NOM_TIPO_SEGLOGR", "NOM_TITULO_SEGLOGR", "NOM_SEGLOGR", "NUM_ENDERECO", "LATITUDE", "LONGITUDE"} - set(raw.columns)
    if missing:
        raise ValueError(f"census file without {sorted(missing)}")
    street = F.concat_ws(" ", *(F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("NOM_TIPO_SEGLOGR", "NOM_TITULO_SEGLOGR", "NOM_SEGLOGR")))
    return raw.select(
        F.expr("try_cast(CEP AS BIGINT)").alias("cep"), F.expr("try_cast(NUM_ENDERECO AS BIGINT)").alias("number"), F.col("DSC_LOCALIDADE").alias("district"), street.alias("street"),
        number("LATITUDE").alias("lat"), number("LONGITUDE").alias("lng"))


GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def geojson_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """name, part, i, lng, lat of the vertices of LineString and MultiLineString features."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", GEOJSON)["features"]).alias("f"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<double>>"))
    lines = raw.select(F.col("f.properties")[name].alias("name"), F.when(F.col("f.geometry.type").startswith("Multi"), many).otherwise(one).alias("lines"))
    parts = lines.select("name", F.posexplode("lines").alias("part", "line"))
    each = parts.select("name", "part", F.posexplode("line").alias("i", "p"))
    return each.select("name", F.col("part").cast("long").alias("part"), F.col("i").cast("long").alias("i"), F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"))


def osm_areas(spark: SparkSession, path: str) -> DataFrame:
    """id, name, points, height, width of areas: outer rings of ways and relations, the official name before the alternative one."""
    schema = "elements array<struct<id:bigint,type:string,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<role:string,geometry:array<struct<lat:double,lon:double>>>>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["elements"]).alias("e"))
    outer = F.flatten(F.transform(F.filter("e.members", lambda m: m["role"] == "outer"), lambda m: m["geometry"]))
    e = e.select("e.id", F.coalesce(F.col("e.tags")["name"], F.col("e.tags")["alt_name"]).alias("name"), F.when(F.col("e.type") == "relation", outer).otherwise(F.col("e.geometry")).alias("ring"))
    spans = (F.array_max(F.col(f"ring.{c}")) - F.array_min(F.col(f"ring.{c}")) for c in ("lat", "lon"))
    height, width = spans
    return e.select("id", "name", F.size("ring").cast("long").alias("points"), height.alias("height"), width.alias("width")).where("points >= 3")


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """path, kind of files: sheet (a zip archive whatever its name, or a sheet's ending), pdf, image, text."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 4))
    name = F.lower("path")
    kind = F.when((head == "504B0304") | name.rlike(r"\.(xlsx?|ods|csv)$"), "sheet").when(head == "25504446", "pdf").when(name.rlike(r"\.(png|jpe?g|webp)$"), "image").otherwise("text")
    return files.select("path", kind.alias("kind"))


def list_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, address: lines of pasted lists that look like addresses, without links, a line that goes on joined to the one before.

    A line goes on if the one before ends with a comma or a dash, or if it begins with a small letter or a digit and is no address itself.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    clean = F.transform(F.split("value", "\n"), lambda s: F.trim(F.regexp_replace(a.without_noise(s), r"https?://\S+", "")))
    ends_open = lambda s: s.rlike(r"[,\-]$")

    def join(lines: Column, s: Column) -> Column:
        last = F.element_at(lines, -1)
        goes_on = (F.size(lines) > 0) & (s != "") & (ends_open(last) | (s.rlike("^[a-zà-ÿ]") & ~a.looks_like_address(s)))
        return F.when(goes_on, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), s)))).when(s != "", F.concat(lines, F.array(s))).otherwise(lines)

    merged = F.aggregate(clean, F.array().cast("array<string>"), join)
    each = text.select("file", F.posexplode(merged).alias("line", "address"))
    return each.where(a.looks_like_address("address")).select("file", F.col("line").cast("long").alias("line"), "address")


def labelled_list(spark: SparkSession, path: str) -> DataFrame:
    """file, order_id, address of blocks like `Pedido # 12 ... Endereço: Rua Tal, 3`."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(F.split("value", r"(?i)(?=pedido\s*#)")).alias("block"))
    address = F.trim(F.regexp_extract("block", r"(?i)endere[cç]o\s*:\s*([^\n]+)", 1))
    return text.select("file", F.regexp_extract("block", r"(?i)pedido\s*#\s*(\d+)", 1).alias("order_id"), address.alias("address")).where("address <> ''")


#: What stands between documents of many lines in one file.
PAGE_BREAK = "\f"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """value: the documents of text files that hold many, with a page break behind each; sinks.documents() writes them so."""
    return spark.read.option("lineSep", PAGE_BREAK).text(path)


def receipts(texts: DataFrame) -> DataFrame:
    """The columns of texts with address, district, reference of the receipt in `value`: the address block between the customer's lines and the items."""
    text = texts.withColumn("lines", F.split("value", "\n"))
    own = F.filter("lines", lambda s: a.looks_like_address(s) & s.rlike(r"\d") & ~s.rlike(r"(?i)\b(telefone|localizador|pedido|cnpj|cliente|desconto)\b"))
    city = F.filter("lines", lambda s: s.rlike(r"^[A-Za-zÀ-ÿ' .]{3,30}\s+[-–]\s+[A-Za-zÀ-ÿ' .]{3,40}$"))
    reference = F.filter("lines", lambda s: s.rlike(r"(?i)^ref\s*[.:]"))
    found = {"address": F.get(own, 0), "district": F.trim(F.get(F.split(F.get(city, 0), r"\s+[-–]\s+"), 1)), "reference": F.trim(F.regexp_replace(F.get(reference, 0), r"(?i)^ref\s*[.:]", ""))}
    return text.withColumns(found).drop("lines")


def voted(readings: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the value that most readings of a key have, ties by the longest, then by the text."""
    n = readings.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max(F.struct("n", F.length(value).alias("size"), value)).alias("best")).select(key, F.col(f"best.{value}").alias(value))


def page_lines(runs: DataFrame, step: float = 4.0) -> DataFrame:
    """page, line, text: text runs (page, x, y, text) of a page in lines of about the same height, from top to bottom and left to right."""
    line = runs.withColumn("line", F.round(F.col("y") / step).cast("long"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda r: r["text"])  # a line has some tens of runs
    return line.groupBy("page", "line").agg(F.array_join(words, " ").alias("text"))


def doors_in_lines(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lng of lines like `name; link or pair`; lines that are empty, comments, or without a position are left out."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT value LIKE '#%'")
    name = F.trim(F.split_part("value", F.lit(";"), F.lit(1)))
    return lines.select(name.alias("name"), t.coordinate("value", 1).alias("lat"), t.coordinate("value", 2).alias("lng")).where("lat IS NOT NULL")


def frame_shifts(profiles: DataFrame, least_overlap: float = 0.4) -> DataFrame:
    """video, frame, height, shift, error: by how many rows each frame is shifted, up or down, against the frame before it.

    profiles: video, frame (numbered without gaps), rows (brightness of its rows). The shift is the one with the least mean difference
    over the rows that both show, which are least_overlap of all at least; a millionth for each row of shift lets the smaller one win.
    """
    before = profiles.select("video", (F.col("frame") + 1).alias("frame"), F.col("rows").alias("before"))
    n = F.least(F.size("rows"), F.size("before"))
    most = F.floor(n * (1 - F.lit(least_overlap))).cast("int")

    def tried(s: Column) -> Column:
        shared = n - F.abs(s)
        mine, other = F.slice("rows", F.greatest(F.lit(0), -s) + 1, shared), F.slice("before", F.greatest(F.lit(0), s) + 1, shared)
        total = F.aggregate(F.zip_with(mine, other, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)
        return F.struct((total / shared + F.abs(s) * 1e-6).alias("error"), s.alias("shift"))

    best = F.array_min(F.transform(F.sequence(-most, most), tried))
    return profiles.join(before, ["video", "frame"]).select("video", "frame", n.alias("height"), best.alias("best")).select("video", "frame", "height", "best.shift", "best.error")


def key_frames(shifts: DataFrame, step: float = 0.45, most_error: float = 20.0, rest: float = 0.1) -> DataFrame:
    """video, frame, fast: the first frame (numbered 0), then each one that is `step` of the height beyond the last one told, or that
    nothing in the frame before explains; the last frame too if it shows `rest` of the height more. fast: whether any was not explained.

    One fold in order over a video's shifts, some bytes for each frame.
    """
    each = shifts.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame", "height", F.abs("shift").alias("shift"), "error"))).alias("frames"))
    state = F.struct(F.array(F.lit(0).cast("long")).alias("kept"), F.lit(0.0).alias("moved"), F.lit(False).alias("fast"))

    def walked(held: Column, x: Column) -> Column:
        jump = x["error"] > most_error
        moved = held["moved"] + x["shift"]
        keep = jump | (moved >= x["height"] * F.lit(step))
        kept = F.when(keep, F.concat(held["kept"], F.array(x["frame"]))).otherwise(held["kept"])
        return F.struct(kept.alias("kept"), F.when(keep, F.lit(0.0)).otherwise(moved).alias("moved"), (held["fast"] | jump).alias("fast"))

    end = each.withColumn("end", F.aggregate("frames", state, walked)).withColumn("last", F.element_at("frames", -1))
    more = (F.element_at("end.kept", -1) != F.col("last.frame")) & (F.col("end.moved") > F.col("last.height") * F.lit(rest))
    kept = F.when(more, F.concat(F.col("end.kept"), F.array("last.frame"))).otherwise(F.col("end.kept"))
    return end.select("video", F.explode(kept).alias("frame"), F.col("end.fast").alias("fast"))
