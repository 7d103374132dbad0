"""Hand-written addresses and what they are read as."""

import pytest
from pyspark.sql import functions as F

from sparkhaul.functions import address as a


@pytest.fixture(scope="module")
def evaluate(spark):
    def run(rows, *columns):
        names = ["address"] if isinstance(rows[0], str) else ["address", "district", "city"][: len(rows[0])]
        df = a.with_address(spark.createDataFrame([(r,) if isinstance(r, str) else tuple(r) for r in rows], names).coalesce(1))
        if "city" in df.columns:
            df = a.with_place_key(df)
        return [tuple(r) for r in df.select(*columns).collect()]

    return run


def test_parts(evaluate):
    cases = {
        "Rua das Acacias, 120, Apto 3, Centro, 49010-020": ("Rua das Acacias", "120", "49010020", ["Apto 3", "Centro"]),
        "Rua das Acacias 120": ("Rua das Acacias", "120", None, []),
        "Av Brasil nº 007, fundos": ("Av Brasil", "7", None, ["fundos"]),
        "Rua do Sol - Casa 03": ("Rua do Sol", None, None, ["Casa 03"]),
        "Rua do Sol Bloco D Apto 303, 55": ("Rua do Sol", "55", None, ["Bloco D Apto 303"]),
        "Rua do Sol 55 perto do mercado": ("Rua do Sol", "55", None, ["perto do mercado"]),
        "Rua Q7 120": ("Rua Q7", "120", None, []),
        "Rua do Sol, Nr 5, Centro": ("Rua do Sol", "5", None, ["Centro"]),
        "Rua do Sol 2082(3)": ("Rua do Sol", "2082", None, []),
        "CEP: 49000123, Rua do Sol": ("Rua do Sol", None, "49000123", []),
        "": ("", None, None, []),
    }
    found = evaluate(list(cases), F.col("parts").alias("p"))
    assert [(p.street, p.number, p.cep, p.rest) for (p,) in found] == list(cases.values())


def test_lines(evaluate):
    lines = ["12 Rua Tal, 30 · 2 unidades · comercial", "Habilita as 14:25 h", "8 Habilita as 11:45 h", "Rua Tal 30 10:15h a 13:20h", "Rua Tal 30 ✓", "Rua Tal © 9"]
    found = evaluate(lines, F.col("read").alias("p"))
    assert [(p.stop_number, p.text, p.units, p.commercial) for (p,) in found] == [
        ("12", "Rua Tal, 30", 2, True), (None, "", None, False), (None, "", None, False), (None, "Rua Tal 30", None, False), (None, "Rua Tal 30", None, False), (None, "Rua Tal 9", None, False),
    ]


def test_number_words(evaluate):
    cases = {"vinte e cinco": "25", "cento e dez": "110", "cento e vinte e cinco de marco": "125 de marco", "duzentos tres": "203", "vinte dez": "20 10", "cento e rua": "100 e rua", "rua e um": "rua e 1", "e": "e"}
    found = evaluate(list(cases), F.array_join(a.digits_for_words(F.split("address", " ")), " "))
    assert [x for (x,) in found] == list(cases.values())


def test_keys(evaluate):
    rows = [
        ("Rua Vinte e Cinco, 85A, Apto 03", "Centro", "Aracaju"), ("R. 25, 085a, apto 3", "Centro", "Aracaju"), ("Rua A, 5", "Centro", "Aracaju"),
        ("Rua do Sol, 10, 49010-020", "Centro", "Aracaju"), ("Rua do Sol, S/N, 49010-020", "Centro", "Aracaju"), ("Rua do Sol, 49010-000, na mercearia da Ana", "Centro", "Aracaju"), ("Rua do Sol", "", "Aracaju"),
    ]
    found = evaluate(rows, a.street_key("parts.street"), a.street_and_number(), a.door_key(), F.col("place_key"))
    assert [f[0] for f in found][:3] == ["25", "25", "a"]
    assert [f[1] for f in found][:2] == ["vinte e cinco|85a", "25|85a"]
    assert [f[2] for f in found][2:4] == [None, "rua do sol|10"]
    assert [f[3] for f in found][3:] == ["49010020|10", "49010020|sn", "r|rua do sol|sn mercearia da ana|centro|aracaju", None]


def test_districts_and_complexes(evaluate):
    rows = [("17 de Março Bl 04 Ap 403", ""), ("DEZESSETE DE MARCO", ""), ("Zona de Expansão (Robalo)", ""), ("São José/Robalo", "")]
    assert [k for (k,) in evaluate(rows, a.district_key("address"))][:2] == ["17 marco", "17 marco"]
    assert evaluate(rows, a.district_readings("address"))[2][0][0] == "robalo"
    lines = [("Rua M, 10, Cond. Solar, casa 18", ""), ("Rua M, 10, perto do cond. Solar", ""), ("Recanto, 24, Rua M atrás do mercado", ""), ("Rua M, 3, Conjunto Orlando Dantas Bloco 2", "")]
    found = evaluate(lines, a.in_complex(), a.complement_street(), a.complex_name())
    assert found == [(True, None, "Cond. Solar"), (False, None, ""), (False, "rua m", ""), (True, None, "Conjunto Orlando Dantas")]


def test_names_and_distances(evaluate):
    rows = [("Rua M, 10, Vila Esperanca Torres, Centro", "Centro"), ("Rua M, 10, perto da Vila Esperanca", "Centro")]
    assert evaluate(rows, a.place_name_key(a.place_hints())) == [("esperanca torres",), (None,)]
    assert evaluate([("3/53 8", "3753"), ("375", "3753"), ("3753", "3753"), ("x", "7")], a.wildcard_distance("address", "district")) == [(1,), (1,), (0,), (0,)]
    assert evaluate(["Rua do Sol 10", "Rua E", "@#$ x", "ab cd", "Estrada da Tal"], a.looks_like_address("address")) == [(True,), (True,), (False,), (False,), (True,)]
    assert evaluate(["av. Brasil", "Praça X", "Casa"], a.road_type("address"), a.full_street("address")) == [("avenida", "avenida brasil"), ("praca", "praca x"), ("", "casa")]
