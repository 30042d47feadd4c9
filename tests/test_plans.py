"""Scoring plans, files, frequency cache, header inference, streams, the command line."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from confero.__main__ import run
from confero.operators.frequency import Words, fixed_frequencies, name_frequency, rare_and_common, text_frequency
from confero.plans import header
from confero.plans.engine import FINAL, FixedLayout, Pair, fixed_labels, labels, score_fixed, score_pairs
from confero.sources.files import cached_frequencies, detect_separator, read_delimited, read_frequencies, read_frequency, write_delimited, write_frequency_files
from confero.streaming.scorer import score_batches, score_stream
from confero.version import DATE, VERSION, shown_date, version_info


def test_frequencies(spark):
    df = spark.createDataFrame([("Ana Ana", "Maria")], "a string, b string")
    assert {r["token"]: r["n"] for r in text_frequency(df, "a", "b").collect()} == {"ana": 2, "maria": 1}
    df = spark.createDataFrame([("Ana B Silva", "Joao C Souza")], "a string, b string")
    assert {(r["slot"], r["token"]) for r in name_frequency(df, "a", "b").collect()} == {("first", "ana"), ("first", "joao"), ("middle", "b"), ("middle", "c"), ("last", "silva"), ("last", "souza")}


def test_generic(spark):
    df = spark.createDataFrame([("Ana Silva", "Ana Silva", "SP1234", "SP1234", "Rua A 1", "Rua A 1", "20200101", "20200101")], ", ".join(f"`{c}.x` string" for c in "abcdefgh"))
    calls = []
    pairs = [Pair(0, 1, "n", "nome"), Pair(2, 3, "C", "loc"), Pair(4, 5, "L", "log"), Pair(6, 7, "D", "data")]
    out = score_pairs(df, pairs, progress=lambda *a: calls.append(a))
    assert out.columns == [*df.columns, *labels(pairs)] and calls[-1][0] == 100
    assert float(out.first()[FINAL].replace(",", ".")) > 3


def test_sorting(spark):
    df = spark.createDataFrame([("x", "y"), ("ana maria", "ana maria"), (None, "NA")], "a string, b string")
    out = score_pairs(df, [Pair(0, 1, "T", "t")], numeric=True)
    totals = [float(r[FINAL].replace(",", ".")) for r in out.collect()]
    assert totals == sorted(totals, reverse=True)
    assert [r["a"] for r in score_pairs(df, [Pair(0, 1, "T", "t")], sort_by=None).collect()] == ["x", "ana maria", ""]
    with pytest.raises(ValueError):
        score_pairs(df, [Pair(0, 1, "T", "t")], sort_by="none such")


def test_fixed(spark, tmp_path):
    rows = [("Ana Silva", "Maria Silva", "19900101", "Ana Silva", "Maria Silva", "19900101"), ("Ana Silva", "", "19900101", "Pedro Souza", "Rita", "1985")]
    df = spark.createDataFrame(rows, "n1 string, m1 string, d1 string, n2 string, m2 string, d2 string")
    out = score_fixed(df).collect()
    assert out[0]["n2"] == "Ana Silva" and list(out[0].asDict())[6:] == fixed_labels()
    assert out[1]["dt iguais"] == "0,0" and out[1]["mae prim frag igual"] == "0,0"
    people = {"paciente": ("n1", "n2"), "mae": ("m1", "m2")}
    path = str(tmp_path / "freq")
    a = cached_frequencies(df, people, path)
    b = cached_frequencies(df.limit(0), people, path)
    assert a.count() == b.count() > 0
    assert score_fixed(df, FixedLayout(), b).count() == 2


def test_files(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("R_Nome,T|a|a\nx|1|2\n|NA|3\n")
    df = read_delimited(spark, path)
    assert df.columns == ["R_Nome,T", "a", "a.1"] and df.count() == 2 and detect_separator(spark, path) == ","
    write_delimited(df, str(tmp_path / "out"), ";")
    assert read_delimited(spark, str(tmp_path / "out"), ";").count() == 2
    with open(tmp_path / "f.csv", "w") as f:
        f.write("Ana; 3\nana;5\nrui;1\n\n")
    assert {r["token"]: r["n"] for r in read_frequency(spark, str(tmp_path / "f.csv")).collect()} == {"ana": 5, "rui": 1}


def test_csv_as_others_write_it(spark, tmp_path):
    rows = [["a", "b c"], ['Bar "do Zé" x', "ends in \\"], ["two\nlines", " blanks "], ['"', "p|q"], ["", "NA"]]
    with open(tmp_path / "in.csv", "w", newline="") as f:
        csv.writer(f, delimiter="|", lineterminator="\n").writerows(rows)
    df = read_delimited(spark, str(tmp_path / "in.csv"))
    assert [[x or "" for x in r] for r in df.collect()] == rows[1:]
    write_delimited(df, str(tmp_path / "out"), "|")
    with open(glob.glob(str(tmp_path / "out/part-*"))[0], newline="") as f:
        assert list(csv.reader(f, delimiter="|")) == rows
    with open(tmp_path / "long.csv", "w") as f:
        f.write("a|b\n1|2\n1|2|3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_delimited(spark, str(tmp_path / "long.csv")).collect()
    with open(tmp_path / "c.csv", "w") as f:
        f.write("x;y\n1,5;2\n2,5;3\n")
    assert detect_separator(spark, str(tmp_path / "c.csv"), by_side=False) == ";"


def test_cache_fingerprint(spark, tmp_path):
    one, two = (spark.createDataFrame([(n,)], "n string") for n in ("Ana Silva", "Rui Souza"))
    people, path = {"paciente": ("n", "n")}, str(tmp_path / "freq")
    tokens = lambda df: {r["token"] for r in df.collect()}
    assert tokens(cached_frequencies(one, people, path, check=True)) == {"ana", "silva"}
    assert tokens(cached_frequencies(two, people, path)) == {"ana", "silva"}  # taken as it is
    assert tokens(cached_frequencies(two, people, path, check=True)) == {"rui", "souza"}


def test_frequency_files(spark, tmp_path):
    df = spark.createDataFrame([("Ana Maria Silva", "Ana Souza")], "a string, b string")
    freq = fixed_frequencies(df, {"paciente": ("a", "b")})
    back = read_frequencies(spark, write_frequency_files(freq, str(tmp_path / "six")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, freq.collect()))


def test_words_of_several_pairs(spark):
    rows = [("ana silva", "ana", "x y", "x"), ("ana silva", "rui", "", "y y"), ("", "ana", "x", ""), ("ana", "ana", "x y", "x")]
    df = spark.createDataFrame(rows * 3, "a string, b string, c string, d string")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in rare_and_common(df, [Words("0", "a", "b", True), Words("1", "c", "d", False)]).collect()}
    # first: ana 8*3 is not rare, last: silva 2*3, ana 4*3; words: x 6*3, y 4*3
    assert got == {rows[0]: (0, 0, 0, 0), rows[1]: (0, 0, 0, 0), rows[2]: (0, 0, 0, 0), rows[3]: (0, 0, 0, 0)}
    got = {tuple(r)[:4]: tuple(r)[4:] for r in rare_and_common(df.distinct(), [Words("0", "a", "b", True), Words("1", "c", "d", False)]).collect()}
    assert got == {rows[0]: (1, 0, 1, 0), rows[1]: (1, 0, 0, 0), rows[2]: (0, 0, 0, 0), rows[3]: (1, 0, 1, 0)}
    assert rare_and_common(df.limit(0), [Words("0", "a", "b", True)]).count() == 0


def test_scores_are_worked_out_before_the_sort(spark):
    df = spark.createDataFrame([("ana", "ana")], "a string, b string")
    plan = score_pairs(df, [Pair(0, 1, "L", "x")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("rangepartitioning") < plan.index("REPARTITION_BY_COL")


def test_command_line(spark, tmp_path):
    with open(tmp_path / "in.csv", "w") as f:
        f.write("R_Nome,T;C_Nome,T;R_dt;C_dt\nAna Silva;Ana Silva;20200101;20200101\nRui;Bo;20200101;19990909\n")
    run(spark, [str(tmp_path / "in.csv"), str(tmp_path / "out"), "--infer", "--sep", ";", "--numeric"])
    back = read_delimited(spark, str(tmp_path / "out"), ";")
    assert back.columns[:4] == ["R_Nome,T", "C_Nome,T", "R_dt", "C_dt"] and back.columns[-1] == FINAL
    assert [r[0] for r in back.collect()] == ["Ana Silva", "Rui"]
    with open(tmp_path / "six.csv", "w") as f:
        f.write("n;m;d;n2;m2;d2\nAna;Bia;19900101;Ana;Bia;19900101\n")
    out = run(spark, [str(tmp_path / "six.csv"), str(tmp_path / "fixed"), "--idx", *"012345", "--frequencies", str(tmp_path / "freq"), "--parquet"])
    assert out.count() == spark.read.parquet(str(tmp_path / "fixed")).count() == 1 and spark.read.parquet(str(tmp_path / "freq")).count() == 4
    with pytest.raises(ValueError):
        run(spark, [str(tmp_path / "six.csv"), str(tmp_path / "x"), "--pair", "0:3:N:nome", "--sort", "none such"])


def test_version(tmp_path):
    path = str(tmp_path / "version.env")
    with open(path, "w") as f:
        f.write("# settings\nAPP_VERSION = 9.1\n\nodd line\n")
    assert version_info({}, [str(tmp_path / "none"), path]) == ("9.1", DATE) and version_info({"APP_VERSION": "7"}, [path])[0] == "7"
    assert version_info({}, []) == (VERSION, DATE)
    assert shown_date("2026-02-03") == "03/02/2026" and shown_date("soon") == "soon"


def test_header():
    cols = ["R_Nome,T", "C_Nome,T", "R_cod_localidade,C", "C_cod_localidade,C", "R_endereco,L", "C_endereco,L"]
    assert header.prepare(cols, True).pairable == {"Nome", "cod_localidade", "endereco"}
    got = header.prepare(["Nome", "codigo_localidade", "logradouro", "ano"], True)
    assert [got.left[c][1] for c in ("Nome", "codigo_localidade", "logradouro", "ano")] == ["T", "C", "L", "M"]
    assert header.prepare(["R_CODMUNRES", "C_CODMUNRES"], False).pairable == {"CODMUNRES"}
    assert header.infer_pairs(cols)[0] == (0, 1, "T", "Nome")
    assert [header.guess_type(x) for x in ("dt_nasc", "nome1", "avaliacao", "cidade", "nome")] == ["D", "M", "L", "C", "T"]
    assert [header.resolve_type(*x) for x in (("E", "x"), ("C", "nome"), ("T", "ano"), ("", "x"), ("N", "x"))] == ["L", "T", "M", "", "N"]
    assert header.side_of("Rua") == ("R", "ua") and header.side_of("nome") is None
    assert header.infer_pairs(cols, types={"Nome": "N"})[0] == (0, 1, "N", "Nome")
    found = header.prepare(cols, True)
    assert [header.counterpart(found, c) for c in ("R_Nome,T", "C_endereco,L", "none")] == ["Nome", "endereco", None]
    assert header.counterpart(found, "C_Nome,T", to_right=False) == "Nome"
    assert header.sort_options(["a"], [(0, 1, "D", "d")]) == ["Nenhum", "a", *labels([Pair(0, 1, "D", "d")])]
    assert [header.side_of(x) for x in ("R_", "r_x_y,T,3", "Rua_x", "C", "Codigo", "")] == [None, ("R", "x_y"), None, None, ("C", "odigo"), None]
    assert header.pick_separator("a|b;c;d") == "|" and header.pick_separator("abc") == "|"


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("20200101", "20200102", "kept"), ("20200101", "20200101", "kept")], "a string, b string, l_ string")
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = score_stream(stream, "a", "b", "D").select("l_", F.col("score.nota").alias("nota")).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("scored").collect()] == [("kept", 1.0)] * 2
    with pytest.raises(ValueError):
        score_stream(df, "a", "b", "T")
    with pytest.raises(ValueError):
        score_stream(df, "a", "b", "D", out="l_")


def test_stream_against_frequencies(spark, tmp_path):
    df = spark.createDataFrame([("Ana Silva", "Ana Souza"), ("Rui", "")], "a string, `b.c` string")
    df.write.parquet(str(tmp_path / "s"))
    frequency = spark.createDataFrame([("first", "ana", 2000), ("last", "silva", 9)], "slot string, token string, n long")
    got = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = score_batches(stream, "a", "`b.c`", "n", frequency, lambda batch, number: got.extend(batch.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["a"]: r["score"]["p"][3:5] for r in got} == {"Ana Silva": ["0,00", "-0,50"], "Rui": ["0,0", "0,0"]}
