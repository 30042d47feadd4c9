"""Partial scores, normalisation and address parts.  Values pinned by the domain's definition are marked fixed."""

import random

import pytest
from pyspark.sql import functions as F

from confero.functions.address import common_length, parts, tokenize
from confero.functions.text import name_slots, normalize, soundex4, split_name, tokens, total_format, two_places
from confero.operators import comparators as cmp


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def both(spark, f, l, r, *args, norm=True):
    a, b = (normalize(F.col(c)) if norm else F.col(c) for c in "lr")
    return one(spark, f(a, b, *args), l=l, r=r)


@pytest.mark.parametrize(
    "raw, want",
    [("  João da Silva Jr.  ", "joao silva"), ("", ""), (None, ""), ("junior", "junior"), ("s/n", "sn"), ("1990-01-01", "19900101"), ("Straße Æsir", "strasse aesir"), ("Ana\t e\n Maria neto filho", "ana e maria neto"),
     ("Ana\u00a0Silva", "ana silva"), ("\u3000Ștefan\u2003Țepeș ", "stefan tepes"), ("Nguyễn Thị Hạnh", "nguyen thi hanh"), ("Ngu\u0065\u0302\u0303n", "nguen"), ("Đặng ư ø ł ı İ ŧ ƀ", "dang u o l i i t b"), ("½ ²", "12 2"), ("D’Ávila", "davila")],
)
def test_normalize(spark, raw, want):
    assert one(spark, normalize(F.col("a")), a=raw) == want


@pytest.mark.parametrize("word, code", [("bruno", "B650"), ("", "0000"), ("123", "1000"), ("ashcraft", "A261"), ("tymczak", "T522"), ("1b", "1100")])
def test_soundex(spark, word, code):
    assert one(spark, soundex4(F.col("a")), a=word) == code


def test_split_name(spark):
    for raw, want in (("ana maria souza", ("ana", ["maria"], "souza")), ("ana", ("ana", [], "ana")), ("", ("", [], ""))):
        assert tuple(one(spark, split_name(tokens(F.col("a"))), a=raw)) == want
    assert [tuple(x) for x in one(spark, name_slots(tokens(F.col("a"))), a="ana")] == [("first", "ana"), ("last", "ana")]
    assert one(spark, name_slots(tokens(F.col("a"))), a="") == []


def test_formats(spark):
    for x, want in ((-0.0, "-0,00"), (0.125, "0,12"), (2.675, "2,67"), (1.005, "1,00")):
        assert one(spark, two_places(F.lit(x))) == want
    for x, want in ((0.125, "0,13"), (2.675, "2,67"), (1234.5, "1234,50"), (0.0, "0,00")):
        assert one(spark, total_format(F.lit(x))) == want


def test_name(spark):
    r = both(spark, cmp.name, "ana m silva", "ana maria silva", F.lit(2), F.lit(1))
    assert r["p"][:5] == ["1,0", "1,0", "0,67", "0,67", "-0,33"] and r["p"][5] != "0,00" and r["p"][6] == "0,17"
    assert both(spark, cmp.name, "", "ana")["p"] == ["0,0"] * 7
    assert both(spark, cmp.name, "ana", "ana", F.lit(2), F.lit(0))["p"][3:5] == ["2,00", "-0,00"]


def test_text(spark):
    assert both(spark, cmp.text, "ana maria", "ana maria", F.lit(2), F.lit(0))["nota"] == pytest.approx(4.8)
    assert both(spark, cmp.text, "20200101", "20200101", F.lit(1), F.lit(0))["p"][3:5] == ["0,0", "0,0"]


@pytest.mark.parametrize("l, r, slot", [("20200101", "20200101", 0), ("20200101", "20200102", 1), ("20200112", "20200121", 2), ("20211201", "20212101", 3), ("20200101", "20020101", 4), ("", "", 0), ("20200101", "19990909", None)])
def test_date(spark, l, r, slot):
    got = both(spark, cmp.date, l, r)
    assert got["p"] == ["1,0" if i == slot else "0,0" for i in range(5)] and got["nota"] == float(slot is not None)


@pytest.mark.parametrize("l, r, p", [("SP1234", "SQ1235", ["0,0", "0,5", "0,0", "0,8"]), ("SP123", "SP1234", ["0,0"] * 4), ("SP1234", "SP1256", ["1,0", "0,0", "0,0", "0,5"]), ("SPAXQX", "SPAZXZ", ["1,0", "0,0", "0,0", None])])
def test_locality(spark, l, r, p):
    got = both(spark, cmp.locality, l, r)["p"]
    assert [a for a, b in zip(got, p) if b] == [b for b in p if b]


def test_number(spark):
    n = lambda l, r: both(spark, cmp.number, l, r, norm=False)
    assert n("2020", "2020")["nota"] == 4 and n("2020", "2021")["p"] == ["0,0", "0,80", "1,00", "1,00"]
    assert n("10,50", "10.5")["p"][0] == "1,0" and n("1.234.567", "1234.567")["nota"] == 4
    for odd in ("abc", "", None, "inf", "nan"):
        assert n(odd, "1")["p"] == ["0,0"] * 4
    for long in ("123456789012345", "7000000000001", "12.345.678/0001-95".translate(str.maketrans("", "", "./-")), "0,0000000001", "999999999999999999999999999", "-31415926535897932384,6264338327"):
        assert n(long, long)["p"] == ["1,0", "1,00", "1,00", "1,00"], long
    assert n("123456789012345", "123456789012346")["p"] == ["0,0", "0,80", "1,00", "1,00"] and n("1" + "0" * 20, "5" + "0" * 19)["p"] == ["0,0", "0,00", "0,50", "0,00"]
    assert n("1" + "0" * 26, "0")["p"] == ["0,0"] + ["0,00"] * 3 and n("1" + "0" * 30, "1")["p"] == ["0,0"] * 4
    assert n("0,001", "0,002")["p"] == ["0,0", "0,98", "1,00", "1,00"] and n("1\u00a0000,5", "1000.5")["nota"] == 4
    assert n("−5", "-5")["nota"] == 4 and n("1.234,5", "1234.5")["nota"] == 4


def test_address(spark):
    got = both(spark, cmp.address, "Rua das Flores 123 Bloco A", "Rua das Flores 123 Bloco A")["p"]
    assert got[:3] == ["1,0", "0,80", "1,0"] and got[5] == "0,50"
    assert both(spark, cmp.address, "Rua das Flores SN", "Rua das Flores s/n")["p"][2] == "1,0"
    assert both(spark, cmp.address, "", None)["p"] == ["0,0", "0,00", "0,0", "0,00", "0,00", "0,00"]
    a = one(spark, parts(tokenize(F.col("a"))), a="Rua dos Andradas, nº 123 - Bl A")
    assert a["via"] == "rua andradas" and a["numero"] == "123" and a["complemento_tokens"][-1] == "a"
    b = one(spark, parts(tokenize(F.col("a"))), a="Av Brasil s/n bloco 4 apto 501")
    assert b["numero"] == "sn" and {"4", "501"} <= set(b["complemento_tokens"])


def test_common_length(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    pairs = [("flores", "florais"), ("", "a"), ("abc", ""), ("rua x", "xaur r"), ("aaaa", "aa"), *((word(rng.randrange(150)), word(rng.randrange(150))) for _ in range(40)), *((word(n), word(n)) for n in (61, 62, 63, 124, 125))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", common_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == plain(r["a"], r["b"]) for r in got)
