"""Portuguese addresses: lines, their parts, and the keys made of them, as Column expressions.

An address in parts is a struct (street, number, cep, rest): the street without its number, the number without leading
zeros or null, the postal code as eight digits or null, and what is left, piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normal

# Words and patterns that decide what an address is.
STREET_WORD = r"(?i)(?:rua|r[.,:]?|avenida|av\.?|travessa|tv\.?|trav\.?|pra[çc]a|p[çc]\.|alameda|al\.|rodovia|rod\.|estrada|estr?\.|via|largo|beco|viela|passagem|conjunto|conj\.|loteamento|lot\.|residencial|quadra|qd\.?)\s"
STREET_TYPE = r"^(rua|r|avenida|av|travessa|tv|trav|praca|pc|alameda|al|rodovia|rod|estrada|est|via|largo|beco|viela|passagem)\b\.?\s*"
NO_NUMBER = r"(?i)\bs[/\s.]?n[º°o]?\b|\bsem\s+n(?:[º°o]|[uú]m(?:ero)?|[uú]mera[cç][aã]o)?\.?(?![\wà-ÿ])"
EMPTY_WORDS = "de da do das dos e doutor dr professor prof presidente pres governador gov ministro min senador sen deputado dep coronel cel general gen padre pe sao santa santo".split()
ABBREVIATIONS = {
    "poe": "poeta", "eng": "engenheiro", "des": "desembargador", "alm": "almirante", "mal": "marechal", "cap": "capitao",
    "ten": "tenente", "sgt": "sargento", "mons": "monsenhor", "pref": "prefeito", "jorn": "jornalista", "ver": "vereador",
}
ROAD_TYPES = {
    "r": "rua", "rua": "rua", "av": "avenida", "avenida": "avenida", "tv": "travessa", "trav": "travessa", "travessa": "travessa", "al": "alameda",
    "alameda": "alameda", "pc": "praca", "praca": "praca", "rod": "rodovia", "rodovia": "rodovia", "est": "estrada", "estrada": "estrada",
}
UNIT = "casas?|cs|ap|apt|apto|apartamento|bl|blc|bloco|lote|lt|quadra|qd"
UNIT_TAIL = rf"(?i)\s*[-–]?\s*\b(?:{UNIT})\b\.?(?:\s+(?:(?:{UNIT})|[a-z0-9]{{1,4}})\b\.?)*\s*$"
NUMBER_AT_END = r"(?i)^(.*(?:\D|[a-zà-ÿ]\d))\s+(?:n[º°o.]*\s*)?(\d{1,5})[a-z]?(?:\s*\(\d{1,3}\))?$"
NUMBER_INSIDE = r"(?i)^((?:\S+\s+){1,7}?\S*[a-zà-ÿ])\s+(?:n[º°o.]*\s*)?(\d{1,5})[a-z]?(?:\s+(.*))?$"
NUMBER_FIRST = r"(?i)^(?:n[º°o.]*\s*)?\d{1,5}[a-z]?\b"
TIME_WINDOW = r"(?i)\b(?:habilita\s+[àa]s\s+)?\d{1,2}:\d{2}\s*h?\s*(?:a|[àa]s)\s*\d{1,2}:\d{2}\s*h?|\bhabilita\s+[àa]s\s+\d{1,2}:\d{2}\s*h?"
REFERENCE = r"\b(perto|prox\w*|frente|defronte|atras|referencia|ref|depois|antes|fica|ao lado)\b"
COMPLEX = r"\b(cond\w*|cdm|cd|resid\w*|bloc\w*|blc|bl|bl\d+\w*|torre|casa \d+|cs \d+)\b"
AREA = r"(?i)^(conjunto|conj|loteamento|lot|residencial|resid|condom[ií]nio|cond|vila|parque|jardim|quadra|qd)\b\.?\s*"
UNITS = (r"\bap(?:to|artamento)?\.?\s*(\w{1,6})", r"\bbl(?:oco|c)?\.?\s*(\w{1,4})", r"\bcasa\s*(\w{1,4})", r"\b(?:sala|loja|lote|lt)\.?\s*(\w{1,4})", r"\bqu?a?d?r?a?\.?\s*(\d{1,4})")
DISTRICT_TAIL = r"(?i)\s+\b(?:bl|bloco|ap|apt|apto|apartamento|casa|cond|condominio|lot|loteamento|cj|conjunto|qd|quadra|lote)\b.*$"
NUMBER_WORDS = {
    1: "um uma", 2: "dois duas", 3: "tres", 4: "quatro", 5: "cinco", 6: "seis", 7: "sete", 8: "oito", 9: "nove", 10: "dez", 11: "onze", 12: "doze", 13: "treze",
    14: "quatorze catorze", 15: "quinze", 16: "dezesseis dezasseis", 17: "dezessete dezassete", 18: "dezoito", 19: "dezenove dezanove", 20: "vinte",
    30: "trinta", 40: "quarenta", 50: "cinquenta", 60: "sessenta", 70: "setenta", 80: "oitenta", 90: "noventa", 100: "cem cento", 200: "duzentos duzentas",
    300: "trezentos trezentas", 400: "quatrocentos quatrocentas", 500: "quinhentos quinhentas", 600: "seiscentos seiscentas", 700: "setecentos setecentas",
    800: "oitocentos oitocentas", 900: "novecentos novecentas",
}

_SYMBOLS = r"[^a-z0-9 ]"


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def plain(text: str | Column) -> Column:
    """Letters a-z, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(normal(_col(text)), _SYMBOLS, " "), " +", " "))


def without_noise(line: str | Column) -> Column:
    """A read line without stray symbols and without time windows; empty if it was no more than a time window."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(_col(line), "[|©®✔✓]", " "), r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(clean, TIME_WINDOW, " "), r"\s+", " "))
    cut = F.regexp_replace(F.regexp_replace(bare, r"(\d)\s+[^\s\d,]{1,2}$", "$1"), r"(?i)([a-zà-ÿ])\s+[^\sa-zà-ÿ\d]{1,2}$", "$1")
    return F.when((bare != clean) & ~bare.rlike("(?i)[a-zà-ÿ]"), "").otherwise(cut)


def read_line(line: str | Column) -> Column:
    """Struct (stop_number, text, units, commercial) of a list line: `12 Rua Tal, 30 · 2 unidades · comercial`."""
    text = without_noise(line)
    units = F.regexp_extract(text, r"(?i)\s·\s*(\d+)\s*unid", 1)
    body = F.trim(F.regexp_replace(text, r"\s·\s.*$", ""))
    body = F.regexp_replace(F.regexp_replace(body, r"(\d)\s+[^\s\d,]{1,2}$", "$1"), r"(\d)\s+[^\s\d,]{1,2}(?=,)", "$1")
    before = rf"^(.{{0,6}}?)\s*(?<![a-zà-ÿ])({STREET_WORD}.*)$"
    head, rest = (F.regexp_extract(F.concat(body, F.lit(" ")), before, k) for k in (1, 2))
    number = F.regexp_extract(head, r"(\d{1,3})(?!.*\d)", 1)
    return F.struct(
        F.when(head != "", F.nullif(number, F.lit(""))).alias("stop_number"),
        F.when(head != "", F.trim(rest)).otherwise(body).alias("text"),
        F.nullif(units, F.lit("")).cast("int").alias("units"),
        text.rlike(r"(?i)\s·\s*comercial\b").alias("commercial"),
    )


def with_address(df: DataFrame, line: str = "address") -> DataFrame:
    """df with `read` (see read_line) and `parts` (the address in parts), in steps, so no expression is worked out twice.

    Write keys made of parts to a table before joining or filtering on them: the optimizer would push that below the steps.
    """
    code = r"\b(\d{5})-?(\d{3})\b"
    text, first, second = F.col("read.text"), F.col("__first"), F.col("__second")
    df = df.withColumn("read", read_line(line))
    df = df.withColumn("__cep", F.concat(F.regexp_extract(text, code, 1), F.regexp_extract(text, code, 2)))
    bare = F.regexp_replace(F.when(F.col("__cep") != "", F.regexp_replace(text, rf"^(.*?){code}", "$1 ")).otherwise(text), r"(?i)\bCEP\b:?", " ")
    df = df.withColumn("__pieces", F.filter(F.transform(F.split(bare, ","), lambda s: F.trim(s)), lambda s: s != ""))
    df = df.withColumns({"__first": F.coalesce(F.get("__pieces", 0), F.lit("")), "__second": F.get("__pieces", 1), "__others": F.slice("__pieces", 2, 1 << 20)})
    end, inner = (F.array(*(F.regexp_extract(first, p, k) for k in range(n))) for p, n in ((NUMBER_AT_END, 3), (NUMBER_INSIDE, 4)))
    df = df.withColumns({"__end": end, "__inner": inner, "__digits": F.regexp_extract(second, r"\d{1,5}", 0)})
    end, inner = ([F.get(c, k) for k in range(n)] for c, n in (("__end", 3), ("__inner", 4)))
    df = df.withColumn("__alone", F.trim(F.regexp_replace(end[1], UNIT_TAIL, "")))
    df = df.withColumns({
        "__unit": (end[0] != "") & end[1].rlike(UNIT_TAIL) & F.col("__alone").rlike("(?i)[a-zà-ÿ]{2}"),
        "__numbered": F.coalesce(second.rlike(NUMBER_FIRST), F.lit(False)),
        "__nr": F.coalesce(second.rlike(r"(?i)^nr[º°o.]*\s*\d{1,5}[a-z]?\b"), F.lit(False)),
    })
    unit, numbered = F.col("__unit"), F.col("__numbered")
    street = F.when(unit, F.col("__alone")).when(numbered, first).when(end[0] != "", F.trim(end[1])).when(inner[0] != "", F.trim(inner[1])).otherwise(first)
    number = F.when(numbered, F.col("__digits")).when(unit, F.lit(None)).when(end[0] != "", end[2]).when(inner[0] != "", inner[2])
    df = df.withColumns({"__street": street, "__number": number})
    last_resort = F.col("__number").isNull() & F.col("__nr")
    left = F.when(numbered | last_resort, F.slice("__others", 2, 1 << 20)).otherwise(F.col("__others"))
    tail = F.trim(F.regexp_replace(F.substring(first, F.length("__alone") + 1, F.length(first)), r"^[\s\-–]+", ""))
    nothing = F.array().cast("array<string>")
    inside = F.when(~numbered & (end[0] == "") & (F.trim(inner[3]) != ""), F.array(F.trim(inner[3]))).otherwise(nothing)
    whole = F.struct(
        F.trim(F.regexp_replace("__street", r"(?i)\s+n[º°o.]*$", "")).alias("street"),
        F.regexp_replace(F.when(last_resort, F.col("__digits")).otherwise(F.col("__number")), r"^0+(?=\d)", "").alias("number"),
        F.nullif(F.col("__cep"), F.lit("")).alias("cep"),
        F.concat(F.when(unit, F.array(tail)).otherwise(inside), left).alias("rest"),
    )
    return df.withColumn("parts", whole).drop(*(f"__{c}" for c in "cep pieces first second others end inner digits alone unit numbered nr street number".split()))


def digits_for_words(words: Column) -> Column:
    """Numbers written in words as digits, hundreds, tens and units together, with or without "e" between them."""
    values = {w: n for n, ws in NUMBER_WORDS.items() for w in ws.split()}
    value = _map(values)
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("value"), F.lit(0).alias("level"), F.lit(False).alias("joined"))

    def flushed(acc: Column) -> Column:
        shown = F.when(acc["level"] > 0, F.concat(acc["out"], F.array(acc["value"].cast("string")))).otherwise(acc["out"])
        return F.when(acc["joined"], F.concat(shown, F.array(F.lit("e")))).otherwise(shown)

    def step(acc: Column, word: Column) -> Column:
        n = F.try_element_at(value, word)
        level = F.when(n >= 100, 3).when(n >= 20, 2).when(n >= 10, 1).when(n >= 1, 0)  # a unit may follow tens, what is below 100 may follow hundreds
        fits = ((acc["level"] == 3) & (n < 100)) | ((acc["level"] == 2) & (n < 10))
        next_level = F.when(level >= 2, level).otherwise(1)
        grown = F.struct(acc["out"].alias("out"), (acc["value"] + n).alias("value"), next_level.alias("level"), F.lit(False).alias("joined"))
        begun = F.struct(flushed(acc).alias("out"), n.alias("value"), next_level.alias("level"), F.lit(False).alias("joined"))
        joined = F.struct(acc["out"].alias("out"), acc["value"].alias("value"), acc["level"].alias("level"), F.lit(True).alias("joined"))
        other = F.struct(F.concat(flushed(acc), F.array(word)).alias("out"), F.lit(0).alias("value"), F.lit(0).alias("level"), F.lit(False).alias("joined"))
        waits = (word == "e") & (acc["level"] >= 2) & ~acc["joined"]
        return F.when(n.isNotNull() & fits, grown).when(n.isNotNull(), begun).when(waits, joined).otherwise(other)

    return F.aggregate(words, empty, step, flushed)


def street_words(name: str | Column) -> Column:
    """Words of a street name that tell it: without its type, abbreviations and numbers written out, empty words gone."""
    short = _map(ABBREVIATIONS)
    bare = F.regexp_replace(F.regexp_replace(normal(_col(name)), STREET_TYPE, ""), _SYMBOLS, " ")
    words = F.transform(_words(bare), lambda w: F.coalesce(F.try_element_at(short, w), w))
    return digits_for_words(F.filter(words, lambda w: ~w.isin(EMPTY_WORDS)))


def street_key(name: str | Column) -> Column:
    return F.array_join(street_words(name), " ")


def full_street(name: str | Column) -> Column:
    """The street in plain letters with its type written out."""
    words = _words(F.regexp_replace(normal(_col(name)), _SYMBOLS, " "))
    kind = F.try_element_at(_map(ROAD_TYPES), F.get(words, 0))
    return F.array_join(F.when(kind.isNotNull(), F.concat(F.array(kind), F.slice(words, 2, 1 << 20))).otherwise(words), " ")


def road_type(name: str | Column) -> Column:
    first = F.get(F.split(F.regexp_replace(normal(_col(name)), _SYMBOLS, " "), " "), 0)
    return F.coalesce(F.try_element_at(_map(ROAD_TYPES), first), F.lit(""))


def is_generic_street(name: str | Column) -> Column:
    """Whether a name tells no street: two letters at most, or "no denomination"."""
    return (F.length(F.array_join(street_words(name), "")) <= 2) | _col(name).rlike("(?i)denomina[cç]")


def looks_like_address(text: str | Column) -> Column:
    """By its first word and its share of letters."""
    text = _col(text)
    kind = rf"^{STREET_WORD}"
    rest = F.regexp_replace(F.trim(F.regexp_replace(text, kind, "")), r"(?i)^(?:d[aeo]s?|e)\s+(?=[a-zà-ÿ]{3})", "")
    first = F.coalesce(F.get(F.split(rest, r"[\s,]+"), 0), F.lit(""))
    letters = F.length(F.regexp_replace(text, "(?i)[^a-zà-ÿ]", ""))
    share = letters / F.greatest(F.lit(1), F.length(text))
    short = F.concat(text, F.lit(" ")).rlike(kind) & first.rlike(r"^[A-Z]\d?$")
    named = first.rlike("(?i)^[a-zà-ÿ]{3,}") | first.rlike(r"^\d+º?$")
    usual = F.when(short, (letters >= 3) & (share > 0.25)).otherwise(named & (letters >= 8) & (share > 0.45))
    return ~text.rlike(r"[=?@*<>~^{}\\]") & usual


def complement_key(rest: Column) -> Column:
    """Flat, block, house, shop and lot in what is left of an address, without blanks and leading zeros."""
    text = normal(F.array_join(F.coalesce(rest, F.array().cast("array<string>")), " "))
    found = (F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, p, 0), r"\s+", ""), r"^(\D+?)0+(?=\d)", "$1"), F.lit("")) for p in UNITS)
    return F.concat_ws("+", *found)


def door_letter(text: Column, number: Column) -> Column:
    """The letter behind the door number: 85A is not 85."""
    pattern = F.concat(F.lit(r"(?i)(?:^|[\s,])0*"), number, F.lit(r"([a-z])\b"))
    return F.coalesce(F.lower(F.call_function("regexp_extract", text, pattern, F.lit(1))), F.lit(""))


# What follows reads the columns `read` and `parts` of with_address.

def address_key() -> Column:
    """street|number with letter|cep|complement: equal for lines of the same address."""
    p, text = F.col("parts"), F.col("read.text")
    number = F.concat(F.coalesce(p["number"], F.lit("")), F.when(p["number"].isNotNull(), door_letter(text, p["number"])).otherwise(""))
    return F.concat_ws("|", F.regexp_replace(normal(p["street"]), STREET_TYPE, ""), number, F.coalesce(p["cep"], F.lit("")), complement_key(p["rest"]))


def street_and_number() -> Column:
    return F.substring_index(address_key(), "|", 2)


def door_key() -> Column:
    """full street|number; null without a number or for a name that tells no street."""
    p = F.col("parts")
    street = full_street(p["street"])
    return F.when(p["number"].isNotNull() & (street != "") & ~is_generic_street(p["street"]), F.concat(street, F.lit("|"), p["number"]))


def stop_complement(district: Column, city: Column) -> Column:
    """What only this delivery has in its address: the rest without district and city, 80 letters at most."""
    out = F.concat(F.array(normal(district)), F.transform(F.split(city, "[,-]"), lambda s: normal(s)))
    own = F.filter(F.transform(F.col("parts.rest"), lambda s: plain(s)), lambda s: (s != "") & ~F.array_contains(out, s))
    return F.left(F.array_join(F.transform(own, lambda s: F.regexp_replace(s, r"^(?:n[ao]s?|em|[ao]s?|ao)\s+", "")), " "), F.lit(80))


def with_place_key(df: DataFrame, line: str = "address", district: str = "district", city: str = "city") -> DataFrame:
    """df (with `parts`) with `complement` and `place_key`: cep|number, or r|street|number|district|city where the code is general or missing.

    The number may be `sn`, alone or with the complement as its reference; null if nothing tells the door.
    """
    p, said, town = F.col("parts"), F.coalesce(F.col(district), F.lit("")), F.coalesce(F.col(city), F.lit(""))
    df = df.withColumn("complement", stop_complement(said, town))
    reference = F.when(F.col("complement") != "", F.concat(F.lit("sn "), F.col("complement")))
    df = df.withColumn("__number", F.coalesce(p["number"], F.when(F.col(line).rlike(NO_NUMBER), "sn").otherwise(reference)))
    bare = F.regexp_replace(F.regexp_replace(p["street"], NO_NUMBER, " "), r"(?i)\s+sem$", "")
    df = df.withColumn("__street", full_street(F.when(F.col("__number") == "sn", bare).otherwise(p["street"])))
    by_street = F.when((F.col("__street") != "") & (normal(said) != ""), F.concat_ws("|", F.lit("r"), "__street", "__number", normal(said), normal(town)))
    by_code = F.when(p["cep"].isNotNull() & ~p["cep"].endswith("000"), F.concat(p["cep"], F.lit("|"), F.col("__number"))).otherwise(by_street)
    return df.withColumn("place_key", F.when(F.col("__number").isNotNull(), by_code)).drop("__number", "__street")


def stop_key(apart: Column) -> Column:
    """The place key, with the complement behind it where the stop was split off."""
    key, own = F.col("place_key"), F.col("complement")
    return F.when(apart & (own != ""), F.left(F.concat(key, F.lit("|"), own), F.lit(300))).otherwise(key)


def missing_in_key(line: str = "address") -> Column:
    """What is missing where there is no place key."""
    numbered = F.col("parts.number").isNotNull() | F.col(line).rlike(NO_NUMBER)
    return F.when(F.col("place_key").isNull(), F.when(numbered, "no code and no district").otherwise("no door number"))


def without_reference(piece: Column) -> Column:
    """Normal text up to a phrase like "near the bakery"."""
    return F.regexp_replace(normal(piece), rf"{REFERENCE}.*$", "")


def in_complex() -> Column:
    rest = F.transform(F.col("parts.rest"), lambda s: without_reference(s))
    return F.regexp_replace(F.regexp_replace(F.array_join(rest, " "), _SYMBOLS, " "), r"\s+", " ").rlike(COMPLEX)


def complex_name(district: str = "district") -> Column:
    """The housing complex that the rest of an address or the district names, or an empty text."""
    pieces = F.concat(F.col("parts.rest"), F.array(F.trim(F.coalesce(F.col(district), F.lit("")))))
    found = F.get(F.filter(pieces, lambda s: s.rlike(AREA)), 0)
    bare = F.regexp_replace(F.regexp_replace(found, r"(?i)\s+\b(ap(to|artamento)?|bl(oco|c)?|casa|sala|loja)\b.*$", ""), "[,;].*$", "")
    return F.coalesce(F.trim(bare), F.lit(""))


def complement_street() -> Column:
    """A street that the complement names, with its type written out, or null."""
    pattern = r"^(rua|r|travessa|tv|avenida|av|alameda|al)\s+([a-z0-9][a-z0-9 ]*)$"
    no_name = r"^(da|do|das|dos|de|sem|que|e|em|no|na|a|o|ao|principal)\b"
    pieces = F.transform(F.col("parts.rest"), lambda s: plain(without_reference(s)))
    good = F.filter(pieces, lambda s: s.rlike(pattern) & ~F.regexp_extract(s, pattern, 2).rlike(no_name))
    return F.nullif(full_street(F.coalesce(F.get(good, 0), F.lit(""))), F.lit(""))


def district_key(name: str | Column) -> Column:
    bare = F.trim(F.regexp_replace(plain(name), DISTRICT_TAIL, ""))
    return F.array_join(digits_for_words(F.filter(_words(bare), lambda w: ~w.isin(EMPTY_WORDS))), " ")


def district_readings(name: str | Column) -> Column:
    """Keys that a district field may be read as, the most special first: in brackets, before a slash, before a dash, whole."""
    raw = normal(_col(name))
    readings = (F.regexp_extract(raw, r"\(([^)]{2,})\)", 1), F.get(F.split(raw, "[/,]"), 0), F.get(F.split(raw, r"\s+-\s+"), 0), raw)
    return F.array_distinct(F.filter(F.array(*map(district_key, readings)), lambda k: k != ""))


def customer_key(place: Column) -> Column:
    """The place key with the flat, block or house behind it."""
    unit = complement_key(F.col("parts.rest"))
    return F.when(unit != "", F.concat(place, F.lit("#"), unit)).otherwise(place)


#: Words that tell no place.
COMMON_PLACE_WORDS = (
    "condominio condominios cond cdm conj conjunto residencial residence residencia resid edificio edificios edif apartamento apart apto bloco casa torre predio portaria porteira "
    "entrada fundos frente proximo perto referencia quadra lote sala loja galpao bairro pousada hotel motel mercado mercadinho supermercado padaria farmacia escola colegio igreja posto "
    "praca esquina numero andar terreo cobertura recepcao portao entregar receber falar ligar telefone whatsapp obrigado favor comercio comercial segunda terca quarta quinta sexta sabado "
    "domingo feriado horario horas manha tarde noite entrega entregas entregue recebe morador moradora inquilino proprietario vizinho vizinha deixar contato celular interfone campainha "
    "aberto fechado funciona atende atendimento apenas somente depois antes urgente antiga antigo novo nova lado esquerda direita mercearia quitanda lanchonete restaurante pizzaria oficina "
    "salao barbearia academia clinica consultorio laboratorio loterica correios borracharia deposito distribuidora sorveteria papelaria floricultura petshop conveniencia estacionamento"
).split()


def place_hints(district: str = "district") -> Column:
    """Words of five letters or more that tell a place, in the order they stand in the rest of an address."""
    own = F.filter(F.col("parts.rest"), lambda s: ~normal(s).rlike(REFERENCE))
    words = F.split(plain(F.array_join(own, " ")), " ")
    out = _words(plain(F.coalesce(F.col(district), F.lit(""))))
    good = F.filter(words, lambda w: (F.length(w) >= 5) & ~w.rlike(r"\d") & ~w.isin(COMMON_PLACE_WORDS) & ~w.isin(EMPTY_WORDS) & ~F.array_contains(out, w))
    return F.array_distinct(good)


def place_name_key(hints: Column) -> Column:
    """Sorted hints of a named place; null if there are fewer than two and none of eight letters."""
    return F.when((F.size(hints) >= 2) | F.exists(hints, lambda w: F.length(w) >= 8), F.array_join(F.array_sort(hints), " "))


def wildcard_distance(bent: str | Column, clean: str | Column) -> Column:
    """Edit distance in which a character that is no digit stands for any digit; for short door numbers."""
    a, b = F.regexp_replace(_col(bent), r"\s+", ""), _col(clean)
    letters = F.filter(F.split(b, ""), lambda c: c != "")
    first = F.transform(F.sequence(F.lit(0), F.size(letters)), lambda j: j)

    def row(above: Column, x: Column) -> Column:
        start = F.array(F.element_at(above, 1) + 1)

        def cell(left: Column, y: Column, j: Column) -> Column:
            same = (x == y) | (~x.rlike(r"\d") & y.rlike(r"\d"))
            return F.least(F.element_at(above, j + 2) + 1, F.element_at(left, -1) + 1, F.element_at(above, j + 1) + F.when(same, 0).otherwise(1))

        numbered = F.transform(letters, lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        return F.aggregate(numbered, start, lambda left, z: F.concat(left, F.array(cell(left, z["y"], z["j"]))))

    rows = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), first, row)
    return F.element_at(rows, -1)


def spelled(number: Column) -> Column:
    """A number below 1000 in words, as an array: hundreds, tens and units joined by "e"."""
    word = _map({n: ws.split()[0] for n, ws in NUMBER_WORDS.items()})
    hundreds, below = F.floor(number / 100).cast("int") * 100, number % 100
    tens, unit = F.floor(below / 10).cast("int") * 10, below % 10
    first = F.when(number == 100, "cem").otherwise(F.when(hundreds == 100, "cento").otherwise(F.try_element_at(word, hundreds)))
    small = F.when(below < 20, F.array(F.try_element_at(word, below))).otherwise(F.array(F.try_element_at(word, tens), F.try_element_at(word, unit)))
    named = F.array_compact(F.concat(F.array(first), small))
    return F.flatten(F.transform(named, lambda w, i: F.when(i > 0, F.array(F.lit("e"), w)).otherwise(F.array(w))))


#: Marks that receipts have; one alone stands in other texts too.
RECEIPT_MARKS = ("d[o0] pedido", "localizador", "c[oó]digo de coleta", "entrega para [aà]s", r"(?m)^\W*pedido\s*[:.]?\s*[#hH*]?\s*\d", "fiscal", "goomer", r"\bcnpj\b", r"cliente\s*:", "taxa de ent", "forma de pagamento", "sub ?total")


def receipt_marks(text: str | Column) -> Column:
    """How many different marks of a receipt a text has."""
    return sum((F.when(_col(text).rlike(f"(?i){m}"), 1).otherwise(0) for m in RECEIPT_MARKS), F.lit(0)).cast("long")
