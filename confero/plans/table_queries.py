"""Queries of sources, sinks, caches, headers and streams over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import total_format
from ..operators.frequency import fixed_frequencies
from ..sources import files
from ..sources.scratch import Scratch
from ..streaming.scorer import score_batches, score_stream
from . import header
from .queries import _SQL_NAME, _name, _sql_date, _sql_norm, _sql_slots, _sql_text_counts, _sql_tokens, _sql_words, _table

def _awkward(spark: SparkSession, d: str) -> DataFrame:
    """Values with quotes, line breaks, separators, blanks at the ends, a backslash at the end, and missing ones."""
    key, name = F.col("p_partkey"), F.col("p_name")
    value = F.when(key % 7 == 0, F.concat(F.lit('say "'), name, F.lit('"; yes'))).when(key % 7 == 1, F.concat(name, F.lit("\n"), "p_type")).when(key % 7 == 2, F.concat(F.lit("  "), name, F.lit(" ")))
    value = value.when(key % 7 == 3, F.concat(name, F.lit("\\"))).when(key % 7 == 4, F.lit("")).when(key % 7 == 5, F.lit('"')).otherwise(F.concat(name, F.lit("|;,\té")))
    return _table(spark, d, "part").select(key.cast("string").alias("p_partkey"), value.alias("R_Nome"), F.col("p_brand").alias("a.b"), F.when(key % 2 == 0, F.col("p_type")).alias("c d"), F.lit("NA").alias("e"))


def delimited_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written, its separator found, read again."""
    path = Scratch(spark, "delimited").path("file")
    files.write_delimited(_awkward(spark, d), path, "|")
    sep = files.detect_separator(spark, path)
    back = files.read_delimited(spark, path, sep).toDF("p_partkey", "b", "c", "e", "f")
    return back.select(F.col("p_partkey").cast("bigint"), *(F.coalesce(c, F.lit("")).alias(c) for c in "bcef"), F.lit(sep).alias("sep"))


def frequency_files(spark: SparkSession, d: str) -> DataFrame:
    """Six text files written and read again."""
    paths = files.write_frequency_files(fixed_frequencies(*_people(spark, d)), Scratch(spark, "frequencies").path("files"))
    return files.read_frequencies(spark, paths)


def frequency_cache(spark: SparkSession, d: str) -> DataFrame:
    """Built once; the second call finds the table and reads nothing else, the third one has other rows and no match."""
    df, people = _people(spark, d)
    path = Scratch(spark, "cache").path("table")
    files.cached_frequencies(df.limit(1), people, path, check=True)
    files.cached_frequencies(df, people, path, check=True)
    return files.cached_frequencies(df.limit(0), people, path).select("person", "slot", "token", "n")


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    df = _table(spark, d, "part").select(_name().alias("n1"), F.col("p_name").alias("n2"), F.concat("p_name", F.lit(" "), "p_type").alias("m1"), F.col("p_brand").alias("m2"))
    return df, {"paciente": ("n1", "n2"), "mae": ("m1", "m2")}


#: Names of columns whose types are asked for.
NAMES = (
    "dt_nasc", "nome1", "nome", "avaliacao", "cidade", "cod_localidade", "Logradouro", "casamento", "ano", "numero do lote", "qtd_itens", "saldo_total", "mes_ref", "codmunres", "codigo ibge",
    "valor", "anota", "data nascimento", "sexo", "id_local", "Local", "vlr_pago", "desanos", "_", "", "p_partkey", "o_orderdate", "c_nationkey", "l_quantity", "mae", "nota2", "pontuacao", "indices",
)


def header_types(spark: SparkSession, d: str) -> DataFrame:
    """What the names of columns say about their types."""
    return spark.createDataFrame([(i, n, header.guess_type(n)) for i, n in enumerate(NAMES)], "i long, name string, kind string")


#: Headers, and whether their columns name their sides.
_HEADERS = (
    (("R_Nome,T", "C_Nome,T", "R_cod_localidade,C", "C_cod_localidade,C", "R_endereco,L", "C_endereco,L", "passo"), True),
    (("R_CODMUNRES", "C_CODMUNRES"), False), (("Nome", "codigo_localidade", "logradouro", "ano"), True), (("R_ano,T,4", "C_ano,N", "C_outro", "R_x,E", "C_x,E"), True),
)


def header_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that headers hold, each with the counterpart of its left column, and the type where one is set by hand."""
    rows = []
    for k, (names, sides) in enumerate(_HEADERS):
        found = header.prepare(names, sides)
        for (l, r, kind, name), (*_, by_hand, _) in zip(header.infer_pairs(names, sides), header.infer_pairs(names, sides, types={"Nome": "N"})):
            rows.append((k, name, l, r, kind, by_hand, header.counterpart(found, names[l]), header.sort_options(names, [(l, r, kind, name)])[-2]))
    return spark.createDataFrame(rows, "header long, name string, l long, r long, kind string, by_hand string, other string, last_label string")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(_table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _dated(df: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyyMMdd")
    return df.select("o_orderkey", day("o_orderdate").alias("l"), F.concat(F.substring(day("o_orderdate"), 1, 6), F.lpad((F.col("o_orderkey") % 31 + 1).cast("string"), 2, "0")).alias("r"))


def _points(out: DataFrame, key: str, n: int) -> DataFrame:
    return out.select(key, *(F.col("score.p")[i].alias(f"p{i}") for i in range(n)), total_format(F.col("score.nota")).alias("nota"))


def stream_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of a stream, scored row by row."""
    scratch = Scratch(spark, "stream")
    scored = _points(score_stream(_dated(_stream(spark, d, "orders")), "l", "r", "D"), "o_orderkey", 5)
    scored.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(scratch.path("out"))


def _described(df: DataFrame) -> DataFrame:
    """Two ways to name a part, with a word that is common and one that is rare."""
    return df.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("l"), F.concat("p_name", F.lit(" "), "p_brand").alias("r"))


def stream_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a stream, scored by micro-batch against a table of frequencies that was counted before."""
    from ..operators.frequency import text_frequency

    scratch = Scratch(spark, "stream")
    frequency = text_frequency(_described(_table(spark, d, "part")), "l", "r").select(F.lit("").alias("slot"), "token", "n")
    frequency = scratch.save(frequency, "frequency")
    stream = _described(_stream(spark, d, "part"))
    write = lambda batch, number: _points(batch, "p_partkey", 7).write.mode("overwrite").parquet(scratch.path(f"out/batch={number}"))
    score_batches(stream, "l", "r", "T", frequency, write).option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(scratch.path("out")).drop("batch")


def _sql_type(name: str) -> str:
    """The type of a column name, by lists of hints."""
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    has = lambda ws, e: f"len(list_filter({words(ws)}, lambda h: contains({e}, h))) > 0"
    n, plain = f"lower(trim({name}))", f"replace(lower(trim({name})), ' ', '')"
    number = f"""regexp_matches({n}, '[0-9]') OR len(list_filter(regexp_extract_all({n}, '[a-z]+'), lambda w: list_contains({words(header.NUMBERS)}, w))) > 0
      OR len(list_filter({words(header.NUMBER_STARTS)}, lambda h: starts_with({n}, h))) > 0 OR len(list_filter({words(header.NUMBER_ENDS)}, lambda h: ends_with({n}, h))) > 0"""
    return f"""CASE WHEN {has(header.STREETS, n)} THEN 'L' WHEN {has(header.PLACE_CODES, plain)} OR ({has(header.PLACES, plain)} AND {has(header.CODES, plain)}) THEN 'C'
      WHEN {has(('data', 'nasc', 'dt'), n)} THEN 'D' WHEN {number} THEN 'M' ELSE 'T' END"""


def _sql_people_counts() -> str:
    slots = lambda person, value: f"SELECT '{person}' AS person, unnest({_sql_slots('tk')}) AS s FROM (SELECT {_sql_tokens(_sql_norm(value))} AS tk FROM part)"
    every = " UNION ALL ".join(slots(*x) for x in (("paciente", _SQL_NAME), ("paciente", "p_name"), ("mae", "p_name || ' ' || p_type"), ("mae", "p_brand")))
    return f"SELECT person, s.slot AS slot, s.token AS token, count(*) AS n FROM ({every}) GROUP BY ALL"


_SQL_DAYS = "pairs AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS l, strftime(o_orderdate, '%Y%m') || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') AS r FROM orders)"
_SQL_DESCRIBED = f"pairs AS (SELECT p_partkey, {_sql_norm('p_name || chr(32) || p_type')} AS l, {_sql_norm('p_name || chr(32) || p_brand')} AS r FROM part)"
_PAIRS = (
    (0, "Nome", 0, 1, "T", "N", "Nome", "Nome qtd frag abrev"), (0, "cod_localidade", 2, 3, "C", "C", "cod_localidade", "cod_localidade local prox"), (0, "endereco", 4, 5, "L", "L", "endereco", "endereco tokens jacc"),
    (1, "CODMUNRES", 0, 1, "C", "C", "R_CODMUNRES", "CODMUNRES local prox"), (3, "ano", 0, 1, "M", "M", "ano", "ano num prox arred"), (3, "x", 3, 4, "L", "L", "x", "x tokens jacc"),
)

QUERIES = {f.__name__: f for f in (delimited_round_trip, frequency_files, frequency_cache, header_types, header_pairs, stream_dates, stream_texts)}

ORACLE_SQL: dict[str, str] = {
    "delimited_round_trip": r"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'say "' || p_name || '"; yes' WHEN 1 THEN p_name || chr(10) || p_type WHEN 2 THEN '  ' || p_name || ' ' WHEN 3 THEN p_name || '\'
      WHEN 4 THEN '' WHEN 5 THEN '"' ELSE p_name || '|;,' || chr(9) || 'é' END AS b, p_brand AS c, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS e, 'NA' AS f, '|' AS sep FROM part""",
    "frequency_files": _sql_people_counts(),
    "frequency_cache": _sql_people_counts(),
    "header_types": f"SELECT i::BIGINT AS i, name, {_sql_type('name')} AS kind FROM (VALUES {', '.join(f'({i}, {n!r})' for i, n in enumerate(NAMES))}) t(i, name)",
    "header_pairs": "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{n}', {l}::BIGINT, {r}::BIGINT, '{t}', '{h}', '{o}', '{s}')" for k, n, l, r, t, h, o, s in _PAIRS) + ") t(header, name, l, r, kind, by_hand, other, last_label)",
    "stream_dates": _sql_date("o_orderkey", _SQL_DAYS),
    "stream_texts": _sql_words("p_partkey", _SQL_DESCRIBED, _sql_text_counts("p_partkey")),
}
