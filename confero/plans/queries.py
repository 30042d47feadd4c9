"""Queries of the comparison engine over the test tables, and the same in DuckDB SQL.

Pairs are neighbouring rows: key and key + 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import parts, token_set_ratio, tokenize
from ..functions.text import ENDINGS, STOP_WORDS, normalize, soundex4, split_name, tokens, total_format, two_places
from ..operators import comparators as cmp
from ..operators.frequency import Words, name_frequency, rare_and_common, text_frequency
from ..sources.scratch import Scratch
from .engine import FINAL, LABELS, WORD_LABELS, FixedLayout, Pair, fixed_labels, labels, score_fixed, score_pairs, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(df: DataFrame, key: str, **columns: Column) -> DataFrame:
    """key, and l_x and r_x of each column: the row's value and that of the row with the next key."""
    left = df.select(key, *(c.alias(f"l_{n}") for n, c in columns.items()))
    right = df.select((F.col(key) - 1).alias(key), *(c.alias(f"r_{n}") for n, c in columns.items()))
    return spread(left.join(right, key), key)


def _points(df: DataFrame, key: str, result: Column, n: int) -> DataFrame:
    scored = df.select(key, result.alias("r"))
    return scored.select(key, *(F.col("r.p")[i].alias(f"p{i}") for i in range(n)), total_format(F.col("r.nota")).alias("nota"))


# --- what is compared -------------------------------------------------------------------------------------------


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "orders"), "o_orderkey", v=F.date_format("o_orderdate", "yyyyMMdd"))


def _cents(c: str) -> Column:
    n = F.round(F.col(c) * 100).cast("bigint")
    return F.concat((F.abs(n) / 100).cast("bigint").cast("string"), F.lit(","), F.lpad((F.abs(n) % 100).cast("string"), 2, "0"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "orders"), "o_orderkey", v=_cents("o_totalprice"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "customer"), "c_custkey", v=F.concat(F.substring("c_mktsegment", 1, 2), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")))


def _name() -> Column:
    short = F.when(F.col("p_partkey") % 3 == 0, F.substring("p_type", 1, 1)).otherwise(F.col("p_type"))
    return F.concat(F.initcap("p_name"), F.lit(" de "), F.lower(short), F.lit(" "), F.lower("p_brand"), F.when(F.col("p_partkey") % 7 == 0, " Junior").otherwise(""))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "part"), "p_partkey", v=_name()).select("p_partkey", normalize(F.col("l_v")).alias("l"), normalize(F.col("r_v")).alias("r"))


def _address() -> Column:
    return F.concat(F.lit("R. "), F.col("p_name"), F.lit(", nº "), F.col("p_size").cast("string"), F.lit(" - Bl "), F.lower(F.substring("p_type", 1, 1)), F.lit(" ap "), (F.col("p_partkey") % 50).cast("string"))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "part"), "p_partkey", v=_address())


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", normalize(F.col("text")).alias("norm"))


_S_NORM_DROP = ", ".join(f"'{w}'" for w in ("", *STOP_WORDS))


def _sql_norm(e: str) -> str:
    plain = f"strip_accents(replace(lower(trim(coalesce({e}, ''))), 'ß', 'ss'))"
    words = f"list_filter(string_split_regex(regexp_replace({plain}, '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: x NOT IN ({_S_NORM_DROP}))"
    return f"trim(regexp_replace(array_to_string({words}, ' '), ' ({'|'.join(ENDINGS)})$', ''))"


def _sql_tokens(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda x: x <> '')"


def _sql_soundex(w: str) -> str:
    code = f"translate({w}[1] || regexp_replace({w}[2:], '[hw]', '', 'g'), 'aeiouyhwbfpvcgjkqsxzdtlmnr0123456789', '000000001111222222223345560000000000')"
    for k in "123456":
        code = f"regexp_replace({code}, '{k}+', '{k}', 'g')"
    return f"CASE WHEN {w} = '' THEN '0000' ELSE upper({w}[1]) || rpad(left(replace(substr({code}, 2), '0', ''), 3), 3, '0') END"


def _two(e: str) -> str:
    return f"replace(printf('%.2f', ({e})::DOUBLE), '.', ',')"


def _flag(e: str) -> str:
    return f"CASE WHEN {e} THEN '1,0' ELSE '0,0' END"


def _total(e: str) -> str:
    return f"replace(CASE WHEN ({e}) * 8 = floor(({e}) * 8) THEN printf('%.2f', round(({e})::DOUBLE, 2)) ELSE printf('%.2f', ({e})::DOUBLE) END, '.', ',')"


_SQL_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' de ' || lower(CASE WHEN p_partkey % 3 = 0 THEN p_type[1] ELSE p_type END) || ' ' || lower(p_brand) || CASE WHEN p_partkey % 7 = 0 THEN ' Junior' ELSE '' END"
_SQL_NAMES = f"v AS (SELECT p_partkey, {_sql_norm(_SQL_NAME)} AS n FROM part), pairs AS (SELECT a.p_partkey, a.n AS l, b.n AS r FROM v a JOIN v b ON b.p_partkey = a.p_partkey + 1)"
_SQL_ADDRESS = "'R. ' || p_name || ', nº ' || p_size || ' - Bl ' || lower(p_type[1]) || ' ap ' || (p_partkey % 50)"


def _sql_words(key: str, pairs: str, counts: str, initials: bool = True, raw: bool = False) -> str:
    """The name and text comparators over pairs(key, l, r); counts: SQL of a table (key, rare, common), or nothing."""
    alike = " + ".join(f"(x[{i}] = y[{i}])::INT" for i in range(1, 5))
    n = "len(a)::DOUBLE"
    short = f"0.5::DOUBLE * ((len(list_filter(a, lambda x: len(x) = 1 AND len(list_filter(b, lambda y: starts_with(y, x))) > 0)) + len(list_filter(b, lambda x: len(x) = 1 AND len(list_filter(a, lambda y: starts_with(y, x))) > 0))) / {n})"
    few, many = (f"rare / {n}", f"-(common / {n})") if counts else ("0.0::DOUBLE", "0.0::DOUBLE")
    points = [_flag("p0"), _flag("p1"), _two("p2"), _two("p3") if counts else "'0,0'", _two("p4") if counts else "'0,0'", _two("p5"), _two("p6") if initials else "'0,0'"]
    total = "CASE WHEN blank THEN 0 ELSE 0.0::DOUBLE + p0::INT::DOUBLE + p1::INT::DOUBLE + p2 + p3 + p4 + p5 + p6 END"
    shown = ", ".join(f"CASE WHEN blank THEN '0,0' ELSE {p} END AS p{i}" for i, p in enumerate(points))
    return f"""WITH {pairs}{', counts AS (' + counts + ')' if counts else ''},
t AS (SELECT pairs.*, {_sql_tokens('l')} AS a, {_sql_tokens('r')} AS b{', coalesce(rare, 0) AS rare, coalesce(common, 0) AS common' if counts else ''} FROM pairs{f' LEFT JOIN counts USING ({key})' if counts else ''}),
x AS (SELECT *, list_transform(a, lambda w: {_sql_soundex('w')}) AS sa, list_transform(b, lambda w: {_sql_soundex('w')}) AS sb FROM t),
s AS (SELECT {key}, len(a) = 0 OR len(b) = 0 AS blank, a[1] = b[1] AS p0, a[-1] = b[-1] AS p1, len(list_filter(a, lambda w: list_contains(b, w))) / {n} AS p2, {few} AS p3, {many} AS p4,
  0.8::DOUBLE * (len(list_filter(sa, lambda x: len(list_filter(sb, lambda y: {alike} >= 3)) > 0)) / {n}) AS p5, {short if initials else '0.0::DOUBLE'} AS p6 FROM x)
SELECT {key}, {shown}, {total if raw else _total(total)} AS nota FROM s"""


def _sql_slots(e: str) -> str:
    return f"CASE WHEN len({e}) = 0 THEN [] ELSE list_concat(list_concat([{{'slot': 'first', 'token': {e}[1]}}], list_transform({e}[2:-2], lambda x: {{'slot': 'middle', 'token': x}})), [{{'slot': 'last', 'token': {e}[-1]}}]) END"


def _sql_person_counts(key: str) -> str:
    """Rare and common slots of l, by counts over l and r."""
    slot = lambda c: f"SELECT {key}, unnest({_sql_slots('tk')}) AS s FROM (SELECT {key}, {_sql_tokens(c)} AS tk FROM pairs)"
    return f"""SELECT m.{key}, sum((coalesce(n, 0) < 5)::INT) AS rare, sum((coalesce(n, 0) > 1000)::INT) AS common FROM (SELECT {key}, s.slot AS slot, s.token AS token FROM ({slot('l')})) m
  LEFT JOIN (SELECT s.slot AS slot, s.token AS token, count(*) AS n FROM ({slot('l')} UNION ALL {slot('r')}) GROUP BY ALL) f USING (slot, token) GROUP BY m.{key}"""


def _sql_text_counts(key: str) -> str:
    word = lambda c: f"SELECT {key}, unnest({_sql_tokens(c)}) AS token FROM pairs"
    return f"""SELECT m.{key}, sum((n < 5)::INT) AS rare, sum((n > 1000)::INT) AS common FROM ({word('l')}) m
  JOIN (SELECT token, count(*) AS n FROM ({word('l')} UNION ALL {word('r')}) GROUP BY ALL) f USING (token) GROUP BY m.{key}"""


_SQL_DATES = "v AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d') AS v FROM orders), pairs AS (SELECT a.k AS o_orderkey, a.v AS l, b.v AS r FROM v a JOIN v b ON b.k = a.k + 1)"


def _sql_date(key: str, pairs: str) -> str:
    digits = lambda c: f"array_to_string(list_sort(string_split({c}[1:4], '')), '')"
    return f"""WITH {pairs}, d AS (SELECT *, levenshtein(l, r) AS d FROM pairs),
c AS (SELECT *, CASE WHEN l = r THEN 0 WHEN d = 1 THEN 1 WHEN d <> 2 OR len(l) <> 8 OR len(r) <> 8 THEN -1 WHEN reverse(l[7:8]) = r[7:8] THEN 2 WHEN reverse(l[5:6]) = r[5:6] THEN 3
  WHEN levenshtein(l[1:4], r[1:4]) = 2 AND {digits('l')} = {digits('r')} THEN 4 ELSE -1 END AS c FROM d)
SELECT {key}, {', '.join(f"{_flag(f'c = {i}')} AS p{i}" for i in range(5))}, CASE WHEN c >= 0 THEN '1,00' ELSE '0,00' END AS nota FROM c"""


_SQL_PLACES = "v AS (SELECT c_custkey AS k, upper(c_mktsegment[1:2] || lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS v FROM customer), pairs AS (SELECT a.k AS c_custkey, a.v AS l, b.v AS r FROM v a JOIN v b ON b.k = a.k + 1)"
def _sql_locality(key: str, pairs: str, raw: bool = False) -> str:
    nota = "(CASE WHEN a = b THEN 1.0::DOUBLE ELSE s1 END + CASE WHEN x = y THEN 1.0::DOUBLE ELSE s2 END)"
    return f"""WITH {pairs},
t AS (SELECT *, l[1:2] AS a, r[1:2] AS b, l[3:6] AS x, r[3:6] AS y, len(l) <> 6 OR len(r) <> 6 AS bad FROM pairs),
s AS (SELECT *, CASE WHEN a = b THEN 0 WHEN levenshtein(a, b) = 1 THEN 0.5 WHEN {_sql_soundex('lower(a)')} = {_sql_soundex('lower(b)')} THEN 0.3 ELSE 0 END::DOUBLE AS s1,
  CASE WHEN x = y THEN 0 WHEN levenshtein(x, y) = 1 THEN 0.8 WHEN levenshtein(x, y) = 2 THEN 0.5 WHEN NOT regexp_full_match(x || y, '[0-9]+') AND {_sql_soundex('lower(x)')} = {_sql_soundex('lower(y)')} THEN 0.4 ELSE 0 END::DOUBLE AS s2 FROM t)
SELECT {key}, CASE WHEN bad THEN '0,0' ELSE {_flag('a = b')} END AS p0, CASE WHEN bad THEN '0,0' ELSE replace(printf('%.1f', s1), '.', ',') END AS p1, CASE WHEN bad THEN '0,0' ELSE {_flag('x = y')} END AS p2,
  CASE WHEN bad THEN '0,0' ELSE replace(printf('%.1f', s2), '.', ',') END AS p3, {f'CASE WHEN bad THEN 0 ELSE {nota} END' if raw else _total(f'CASE WHEN bad THEN 0 ELSE {nota} END')} AS nota FROM s"""


_SQL_WORD_PLACE = "upper(p_name[1:2] || replace(p_type, ' ', '')[1:CASE WHEN p_partkey % 9 = 0 THEN 3 ELSE 4 END])"
_SQL_WORD_PLACES = f"v AS (SELECT p_partkey AS k, {_SQL_WORD_PLACE} AS v FROM part), pairs AS (SELECT a.k AS p_partkey, a.v AS l, b.v AS r FROM v a JOIN v b ON b.k = a.k + 1)"


def _sql_number(key: str, pairs: str, raw: bool = False) -> str:
    """Over pairs (key, a, b) of whole hundredths, of any length."""
    return f"""WITH {pairs}, t AS (SELECT *, abs(a - b) AS diff, greatest(abs(a), abs(b), 100::HUGEINT) AS scale, a % 100 = 0 AND b % 100 = 0 AS whole FROM pairs),
u AS (SELECT *, CASE WHEN whole THEN 10000::HUGEINT ELSE greatest(scale, 20::HUGEINT) END AS tol FROM t),
s AS (SELECT *, a = b AS same, (tol - least(20 * diff, tol))::DOUBLE / tol::DOUBLE AS p1, (scale - least(diff, scale))::DOUBLE / scale::DOUBLE AS p2,
  CASE WHEN whole AND diff <= 100 THEN 1 WHEN scale <= 100000 THEN (a = b)::INT ELSE ((a + 5 * sign(a)) // 10 = (b + 5 * sign(b)) // 10)::INT END::DOUBLE AS p3 FROM u),
n AS (SELECT *, 0.0::DOUBLE + same::INT::DOUBLE + p1 + p2 + p3 AS total FROM s)
SELECT {key}, {_flag('same')} AS p0, {_two('p1')} AS p1, {_two('p2')} AS p2, {_two('p3')} AS p3, {'total' if raw else _total('total')} AS nota FROM n"""


_SQL_CENTS = "v AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::HUGEINT AS c FROM orders), pairs AS (SELECT a.k AS o_orderkey, a.c AS a, b.c AS b FROM v a JOIN v b ON b.k = a.k + 1)"
_SQL_LONG = "v AS (SELECT o_orderkey AS k, (700000000000000::HUGEINT + o_custkey * 10000 + (o_orderkey // 4) * 10) * 100 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 50 END AS c FROM orders), pairs AS (SELECT a.k AS o_orderkey, a.c AS a, b.c AS b FROM v a JOIN v b ON b.k = a.k + 1)"


def _sql_address_tokens(e: str) -> str:
    from ..functions import address as A

    s = f"regexp_replace(strip_accents(replace(replace(lower(trim({e})), 'º', 'o'), 'ß', 'ss')), '[#''\"()\\[\\]{{}}\\-/\\\\.,;:]', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')"
    cases = [f"WHEN x IN ({', '.join(repr(w) for w in A.NUMBERS)}) THEN 'numero'", f"WHEN x IN ({', '.join(repr(w) for w in A.WITHOUT_NUMBER)}) THEN 'semnumero'"]
    cases += [f"WHEN x IN ({', '.join(map(repr, words))}) THEN '{full}'" for table in (A.STREETS, A.COMPLEMENTS) for full, words in table.items() if words]
    words = f"list_transform(list_filter(string_split_regex({s}, '\\s+'), lambda x: x <> ''), lambda x: CASE {' '.join(cases)} ELSE x END)"
    return f"list_filter({words}, lambda x: x NOT IN ({', '.join(repr(w) for w in A.STOP_WORDS)}))"


def _sql_address_parts(source: str) -> str:
    """source: SQL of (key, t)."""
    from ..functions import address as A

    bare = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN coalesce(nullif(ltrim({x}, '0'), ''), '0') ELSE {x} END"
    marks = ", ".join(repr(w) for w in ("numero", "semnumero", *A.COMPLEMENTS))
    return f"""a AS (SELECT *, coalesce(list_position(list_transform(t, lambda x: regexp_full_match(x, '[0-9]+') OR x IN ({marks})), true), 0) AS cut FROM ({source})),
b AS (SELECT *, CASE WHEN cut = 0 THEN t ELSE t[1:cut - 1] END AS via, CASE WHEN cut = 0 THEN [] ELSE t[cut:] END AS tail FROM a),
c AS (SELECT *, coalesce(list_position(tail, 'semnumero'), 0) AS sp, coalesce(list_position(list_transform(tail, lambda x: regexp_full_match(x, '[0-9]+')), true), 0) AS dp FROM b),
d AS (SELECT *, CASE WHEN dp > 0 AND (sp = 0 OR dp < sp) THEN dp ELSE 0 END AS used, CASE WHEN sp > 0 THEN 'sn' WHEN dp > 0 THEN {bare('tail[dp]')} ELSE '' END AS numero FROM c),
e AS (SELECT *, list_filter(list_transform(tail, lambda x, i: CASE WHEN x IN ('numero', 'semnumero') OR i = used THEN '' ELSE {bare('x')} END), lambda x: x <> '') AS rest FROM d),
parts AS (SELECT *, list_concat(list_concat(via, CASE WHEN numero <> '' THEN [numero] ELSE [] END), rest) AS every FROM e)"""


def _sql_token_set_ratio(x: str, y: str, source: str, key: str = "p_partkey") -> str:
    """(key, ratio) of two lists of tokens; the common subsequence by rows of bits."""
    v = "(v + (v & m)) | (v - (v & m))"
    return f"""(WITH s AS (SELECT {key}, {x} AS x, {y} AS y FROM {source}),
 z AS (SELECT *, list_sort(list_distinct(list_filter(x, lambda w: list_contains(y, w)))) AS common_words, array_to_string(list_sort(list_distinct(list_filter(x, lambda w: NOT list_contains(y, w)))), ' ') AS l,
   array_to_string(list_sort(list_distinct(list_filter(y, lambda w: NOT list_contains(x, w)))), ' ') AS r FROM s),
 g AS (SELECT *, ((1::HUGEINT << len(l)::HUGEINT) - 1) AS ones, len(array_to_string(common_words, ' ')) AS n,
   list_transform(string_split(r, ''), lambda c: list_sum(list_transform(range(len(l)), lambda i: CASE WHEN l[i + 1] = c THEN 1::HUGEINT << i::HUGEINT ELSE 0::HUGEINT END))::HUGEINT) AS masks FROM z),
 h AS (SELECT *, CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0 ELSE len(l) - bit_count(list_reduce(list_prepend(ones, masks), lambda v, m: ({v}) & ones)) END AS common FROM g),
 q AS (SELECT *, CASE WHEN len(l) = 0 OR len(r) = 0 THEN 100 ELSE greatest(100::DOUBLE - 100::DOUBLE * (len(l) + len(r) - 2 * common) / (2 * n + 2 + len(l) + len(r)), 100::DOUBLE - 100::DOUBLE * (1 + len(l)) / (2 * n + 1 + len(l)), 100::DOUBLE - 100::DOUBLE * (1 + len(r)) / (2 * n + 1 + len(r))) END::DOUBLE AS ratio FROM h)
SELECT {key}, CASE WHEN len(common_words) = 0 THEN 0::DOUBLE ELSE ratio / 100 * (list_sum(list_transform(common_words, lambda w: least(len(list_filter(x, lambda t: t = w)), len(list_filter(y, lambda t: t = w)))))::DOUBLE / greatest(len(x), len(y))) END AS ratio FROM q)"""


def _sql_sides(source: str) -> str:
    """CTEs parts and sides: the parts of an address and of the next one."""
    names = ", ".join(f"{t}.{n} AS {t}_{n}" for t in "lr" for n in ("via", "numero", "rest", "every"))
    return f"{_sql_address_parts(source)}, sides AS (SELECT l.p_partkey, {names} FROM parts l JOIN parts r ON r.p_partkey = l.p_partkey + 1)"


def _sql_address(source: str, raw: bool = False) -> str:
    """source: SQL of (p_partkey, t)."""
    ratio = {n: _sql_token_set_ratio(f"l_{n}", f"r_{n}", "sides") for n in ("via", "rest", "every")}
    total = "(0.0::DOUBLE + p0::INT::DOUBLE + p1 + p2::INT::DOUBLE + p3 + p4 + p5)"
    return f"""WITH {_sql_sides(source)}, u AS (SELECT *, list_distinct(l_every) AS x, list_distinct(r_every) AS y FROM sides),
 w AS (SELECT p_partkey, len(l_via) > 0 AND l_via = r_via AS p0, 0.8::DOUBLE * a.ratio AS p1, l_numero <> '' AND l_numero = r_numero AS p2, 0.5::DOUBLE * b.ratio AS p3, 0.8::DOUBLE * c.ratio AS p4,
   0.5::DOUBLE * CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS p5
   FROM u JOIN {ratio['via']} a USING (p_partkey) JOIN {ratio['rest']} b USING (p_partkey) JOIN {ratio['every']} c USING (p_partkey))
SELECT p_partkey, {_flag('p0')} AS p0, {_two('p1')} AS p1, {_flag('p2')} AS p2, {_two('p3')} AS p3, {_two('p4')} AS p4, {_two('p5')} AS p5, {total if raw else _total(total)} AS nota FROM w"""


# --- queries ----------------------------------------------------------------------------------------------------


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d)


def strip_suffix(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", normalize(_name()).alias("norm"))


def tokenize_text(spark: SparkSession, d: str) -> DataFrame:
    t = _documents(spark, d).select("doc_id", tokens(F.col("norm")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"), F.when(F.size("t") > 0, F.element_at("t", -1)).otherwise("").alias("last"))


def name_parts(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "part").select("p_partkey", split_name(tokens(normalize(_name()))).alias("s"))
    return s.select("p_partkey", "s.first", F.array_join("s.middle", " ").alias("middle"), "s.last")


def soundex_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = _documents(spark, d).select(F.explode(tokens(F.col("norm"))).alias("token")).distinct()
    return words.select("token", soundex4(F.col("token")).alias("code"))


def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("p_partkey", F.levenshtein("l", "r").cast("long").alias("distance"))


def freq_text(spark: SparkSession, d: str) -> DataFrame:
    return text_frequency(_table(spark, d, "documents").select("text"), "text")


def freq_name_slots(spark: SparkSession, d: str) -> DataFrame:
    return name_frequency(_names(spark, d), "l", "r")


def freq_top(spark: SparkSession, d: str) -> DataFrame:
    """A report of the fifty most frequent words."""
    return freq_text(spark, d).orderBy(F.desc("n"), "token").limit(50)


def score_date(spark: SparkSession, d: str) -> DataFrame:
    return _points(_dates(spark, d), "o_orderkey", cmp.date(normalize(F.col("l_v")), normalize(F.col("r_v"))), 5)


def score_locality(spark: SparkSession, d: str) -> DataFrame:
    return _points(_places(spark, d), "c_custkey", cmp.locality(normalize(F.col("l_v")), normalize(F.col("r_v"))), 4)


def _word_place() -> Column:
    short = F.when(F.col("p_partkey") % 9 == 0, 3).otherwise(4)
    return F.concat(F.substring("p_name", 1, 2), F.substring(F.translate("p_type", " ", ""), F.lit(1), short))


def score_locality_words(spark: SparkSession, d: str) -> DataFrame:
    """Codes of letters, which may sound alike, some of them too short."""
    p = _pairs(_table(spark, d, "part"), "p_partkey", v=_word_place())
    return _points(p, "p_partkey", cmp.locality(normalize(F.col("l_v")), normalize(F.col("r_v"))), 4)


def score_number(spark: SparkSession, d: str) -> DataFrame:
    return _points(_numbers(spark, d), "o_orderkey", cmp.number(F.col("l_v"), F.col("r_v")), 4)


def score_long_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of fifteen digits, some with places after the mark; equal ones among them."""
    whole = F.lit(700000000000000) + F.col("o_custkey") * 10000 + F.floor(F.col("o_orderkey") / 4) * 10
    orders = _table(spark, d, "orders").select("o_orderkey", F.concat(whole.cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(",50")).alias("v"))
    return _points(_pairs(orders, "o_orderkey", v=F.col("v")), "o_orderkey", cmp.number(F.col("l_v"), F.col("r_v")), 4)


def score_name(spark: SparkSession, d: str) -> DataFrame:
    p = _names(spark, d)
    p = rare_and_common(p, [Words("0", "l", "r", True)])
    return _points(p, "p_partkey", cmp.name(F.col("l"), F.col("r"), F.col("rare_0"), F.col("common_0")), 7)


def score_name_plain(spark: SparkSession, d: str) -> DataFrame:
    return _points(_names(spark, d), "p_partkey", cmp.name(F.col("l"), F.col("r"), initials=False), 7)


def score_text(spark: SparkSession, d: str) -> DataFrame:
    p = _names(spark, d)
    p = rare_and_common(p, [Words("0", "l", "r", False)])
    return _points(p, "p_partkey", cmp.text(F.col("l"), F.col("r"), F.col("rare_0"), F.col("common_0")), 7)


def address_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", F.array_join(tokenize(_address()), " ").alias("tokens"))


def address_parts(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "part").select("p_partkey", tokenize(_address()).alias("t")).select("p_partkey", parts(F.col("t")).alias("s"))
    return s.select("p_partkey", "s.via", "s.numero", "s.complemento", F.array_join("s.all_tokens", " ").alias("every"))


def _address_sets(spark: SparkSession, d: str) -> DataFrame:
    t = _addresses(spark, d).select("p_partkey", tokenize(F.col("l_v")).alias("lt"), tokenize(F.col("r_v")).alias("rt"))
    return t.select("p_partkey", parts(F.col("lt")).alias("l"), parts(F.col("rt")).alias("r"))


def address_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _address_sets(spark, d).select("p_partkey", two_places(cmp.jaccard_ratio(F.col("l.all_tokens"), F.col("r.all_tokens"))).alias("jaccard"))


def address_token_set_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _address_sets(spark, d).select("p_partkey", two_places(token_set_ratio(F.col("l.all_tokens"), F.col("r.all_tokens"))).alias("ratio"))


def score_address(spark: SparkSession, d: str) -> DataFrame:
    return _points(_addresses(spark, d), "p_partkey", cmp.address(normalize(F.col("l_v")), normalize(F.col("r_v"))), 6)


def _generic_input(spark: SparkSession, d: str) -> DataFrame:
    dates = _dates(spark, d).select("o_orderkey", F.col("l_v").alias("l_date"), F.col("r_v").alias("r_date"))
    names = _pairs(_table(spark, d, "part"), "p_partkey", name=_name())
    return dates.join(names, F.col("o_orderkey") == F.col("p_partkey")).select("o_orderkey", "l_date", "r_date", "l_name", "r_name")


_GENERIC = (Pair(1, 2, "D", "data"), Pair(3, 4, "N", "nome"))


def score_generic(spark: SparkSession, d: str) -> DataFrame:
    return score_pairs(_generic_input(spark, d), _GENERIC)


def _sorted(spark: SparkSession, d: str, numeric: bool) -> DataFrame:
    """Places in the order of the total; rows that tie share a place."""
    from pyspark.sql import Window

    out = score_pairs(_generic_input(spark, d), _GENERIC, sort_by=None)
    key = F.translate(F.col(f"`{FINAL}`"), ",", ".").cast("double") if numeric else F.col(f"`{FINAL}`")
    counts = out.groupBy(key.alias("total")).agg(F.count("*").alias("n"))  # a place for each different total: a short table
    place = F.sum("n").over(Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("total", "n", (F.coalesce(place, F.lit(0)) + 1).alias("place"))


def sorted_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, False)


def sorted_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, True)


def sorted_position(spark: SparkSession, d: str) -> DataFrame:
    """Each row's place in the result as the engine sorts it; rows that tie stand in the input's order."""
    source = Scratch(spark, "sorted").save(_generic_input(spark, d).coalesce(1).sortWithinPartitions("o_orderkey"), "in")
    out = score_pairs(source.coalesce(1), _GENERIC).select("o_orderkey", F.col(f"`{FINAL}`").alias("total"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    out = Scratch(spark, "sorted").save(out, "out")
    counts = {r["part"]: r["n"] for r in out.groupBy("part").agg(F.count("*").alias("n")).collect()}  # as many as partitions
    starts = spark.createDataFrame([(p, sum(n for q, n in counts.items() if q < p)) for p in counts], "part int, start long")
    return out.join(F.broadcast(starts), "part").select("o_orderkey", "total", (F.col("start") + F.col("at") % (1 << 33)).alias("place"))


def _day() -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.lit("19"), two(F.col("p_size")), two(F.col("p_partkey") % 12 + 1), two(F.floor(F.col("p_partkey") / 2) % 28 + 1))


_ALL = tuple(Pair(l, l + 1, kind, name) for l, kind, name in ((1, "T", "texto"), (1, "N", "nome"), (3, "D", "data"), (5, "C", "lugar"), (7, "L", "rua"), (9, "M", "valor")))


def score_all_types(spark: SparkSession, d: str) -> DataFrame:
    """Every type in one plan."""
    p = _pairs(_table(spark, d, "part"), "p_partkey", name=_name(), day=_day(), place=_word_place(), street=_address(), price=_cents("p_retailprice"))
    return score_pairs(p.select("p_partkey", *(f"{s}_{c}" for c in ("name", "day", "place", "street", "price") for s in "lr")), _ALL)


def score_fixed_guards(spark: SparkSession, d: str) -> DataFrame:
    """The fixed layout where mothers are blank or missing and dates are cut short or missing."""
    key = F.col("p_partkey") % 5
    names = _pairs(_table(spark, d, "part"), "p_partkey", name=_name(), mother=F.when(key == 0, "").when(key == 1, "NA").otherwise(F.concat("p_name", F.lit(" "), "p_type")))
    short = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyyMM")).when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    rows = names.join(_pairs(_table(spark, d, "orders"), "o_orderkey", v=short), F.col("o_orderkey") == F.col("p_partkey"))
    return score_fixed(rows.select("l_name", "l_mother", F.col("l_v").alias("l_birth"), "r_name", "r_mother", F.col("r_v").alias("r_birth"), F.col("p_partkey").cast("string").alias("p_partkey")))


def normalize_letters(spark: SparkSession, d: str) -> DataFrame:
    """Letters with one mark or two, a fraction, and blanks of several kinds."""
    v = F.concat(F.translate("p_name", "aeioust", "ạễịọựșț"), F.lit("\u00a0ĐỖ ½\u2003"), "p_type", F.lit(" Jr.\u3000"))
    return _table(spark, d, "part").select("p_partkey", normalize(v).alias("norm"))


def score_fixed_layout(spark: SparkSession, d: str) -> DataFrame:
    names = _pairs(_table(spark, d, "part"), "p_partkey", name=_name(), mother=F.concat("p_name", F.lit(" "), "p_type"))
    dates = _dates(spark, d)
    rows = names.join(dates, F.col("o_orderkey") == F.col("p_partkey")).select("l_name", "l_mother", F.col("l_v").alias("l_birth"), "r_name", "r_mother", F.col("r_v").alias("r_birth"), F.col("p_partkey").cast("string").alias("p_partkey"))
    return score_fixed(rows, FixedLayout(0, 1, 2, 3, 4, 5))


_BOTH = "(SELECT a.o_orderkey FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)"


def _sql_people(value: str) -> str:
    """Pairs of a part's value, those that have a pair of orders."""
    return f"v AS (SELECT p_partkey, {_sql_norm(value)} AS n FROM part), pairs AS (SELECT a.p_partkey, a.n AS l, b.n AS r FROM v a JOIN v b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey IN {_BOTH})"


def _sql_scored(people: dict[str, str]) -> str:
    ctes = [f"{n} AS ({_sql_words('p_partkey', _sql_people(value), _sql_person_counts('p_partkey'), raw=True)})" for n, value in people.items()]
    return f"WITH dd AS ({_sql_date('o_orderkey', _SQL_DATES)}), {', '.join(ctes)}"


def _quoted(source: str, heads: list[str]) -> list[str]:
    return [f'{source}.p{i} AS "{h}"' for i, h in enumerate(heads)]


_DATE_SUM = "replace(dd.nota, ',', '.')::DOUBLE"
_RAW = "JOIN (SELECT p_partkey, {} AS v FROM part) a ON a.p_partkey = nn.p_partkey JOIN (SELECT p_partkey, {} AS v FROM part) b ON b.p_partkey = nn.p_partkey + 1"
_ORDERS = "JOIN (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS v FROM orders) c ON c.o_orderkey = nn.p_partkey JOIN (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS v FROM orders) e ON e.o_orderkey = nn.p_partkey + 1"
_HEADS = labels(_GENERIC)
_GENERIC_TOTAL = f"(0.0::DOUBLE + {_DATE_SUM} + nn.nota)"
_SQL_GENERIC = f"""{_sql_scored({'nn': _SQL_NAME})} SELECT nn.p_partkey::VARCHAR AS o_orderkey, c.v AS l_date, e.v AS r_date, a.v AS l_name, b.v AS r_name,
  {', '.join(_quoted('dd', _HEADS[:5]) + _quoted('nn', _HEADS[5:12]))}, {_total(_GENERIC_TOTAL)} AS "{FINAL}"
FROM nn JOIN dd ON dd.o_orderkey = nn.p_partkey {_RAW.format(_SQL_NAME, _SQL_NAME)} {_ORDERS}"""
_MOTHER = "p_name || ' ' || p_type"
_FIXED = fixed_labels()
_SQL_FIXED = f"""{_sql_scored({'nn': _SQL_NAME, 'mm': _MOTHER})} SELECT a.v AS l_name, a2.v AS l_mother, c.v AS l_birth, b.v AS r_name, b2.v AS r_mother, e.v AS r_birth, nn.p_partkey::VARCHAR AS p_partkey,
  {', '.join(_quoted('nn', _FIXED[:7]) + _quoted('mm', _FIXED[7:14]) + _quoted('dd', _FIXED[14:19]))}, {_total(f'(0.0::DOUBLE + nn.nota + mm.nota + {_DATE_SUM})')} AS "{FINAL}"
FROM nn JOIN mm USING (p_partkey) JOIN dd ON dd.o_orderkey = nn.p_partkey {_RAW.format(_SQL_NAME, _SQL_NAME)} {_RAW.format(_MOTHER, _MOTHER).replace(') a ON a.', ') a2 ON a2.').replace(') b ON b.', ') b2 ON b2.')} {_ORDERS}"""


def _sql_sorted(key: str) -> str:
    return f"""WITH g AS ({_SQL_GENERIC}), t AS (SELECT {key} AS total, count(*) AS n FROM g GROUP BY 1)
SELECT total, n, (1 + coalesce(sum(n) OVER (ORDER BY total DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place FROM t"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_text, strip_suffix, tokenize_text, name_parts, soundex_tokens, levenshtein_pairs, freq_text, freq_name_slots, freq_top, score_date, score_locality,
        score_number, score_name, score_name_plain, score_text, address_tokens, address_parts, address_jaccard, address_token_set_ratio, score_address,
        score_generic, sorted_lexical, sorted_numeric, score_fixed_layout, normalize_letters, score_long_numbers, score_locality_words, score_all_types, score_fixed_guards, sorted_position,
    )
}

_DOCS = f"SELECT doc_id, {_sql_norm('text')} AS norm FROM documents"
_ADDRESSES = f"SELECT p_partkey, {_sql_address_tokens(_SQL_ADDRESS)} AS t FROM part"

_PLAIN_ADDRESSES = f"SELECT p_partkey, {_sql_address_tokens(_sql_norm(_SQL_ADDRESS))} AS t FROM part"
_SQL_LETTERS = "replace(replace(replace(replace(replace(translate(p_name, 'aeioust', 'ạễịọựșț') || chr(160) || 'ĐỖ ½' || chr(8195) || p_type || ' Jr.' || chr(12288), 'Đ', 'd'), '½', '1/2'), chr(160), ' '), chr(8195), ' '), chr(12288), '')"


def _sql_all(kinds: str) -> str:
    """All types over neighbouring parts, summed from left to right."""
    pairs = lambda e: f"v AS (SELECT p_partkey AS k, {e} AS v FROM part), pairs AS (SELECT a.k AS p_partkey, a.v AS l, b.v AS r FROM v a JOIN v b ON b.k = a.k + 1)"
    names = f"v AS (SELECT p_partkey, {_sql_norm(_SQL_NAME)} AS n FROM part), pairs AS (SELECT a.p_partkey, a.n AS l, b.n AS r FROM v a JOIN v b ON b.p_partkey = a.p_partkey + 1)"
    source = {
        "T": _sql_words("p_partkey", names, _sql_text_counts("p_partkey"), raw=True), "N": _sql_words("p_partkey", names, _sql_person_counts("p_partkey"), raw=True), "D": _sql_date("p_partkey", pairs(_SQL_DAY)),
        "C": _sql_locality("p_partkey", pairs(_SQL_WORD_PLACE), raw=True), "L": _sql_address(_PLAIN_ADDRESSES, raw=True), "M": _sql_number("p_partkey", pairs("round(p_retailprice * 100)::HUGEINT").replace("a.v AS l, b.v AS r", "a.v AS a, b.v AS b"), raw=True),
    }
    raw = {k: f"replace(by_{k}.nota, ',', '.')::DOUBLE" if k == "D" else f"by_{k}.nota" for k in kinds}
    shown = ", ".join(f'by_{p.kind}.p{i} AS "{p.name} {h}"' for p in _ALL for i, h in enumerate(LABELS.get(p.kind, WORD_LABELS)))
    values = ", ".join(f"{t}.{n} AS {t}_{n}" for n in ("name", "day", "place", "street", "price") for t in "lr")
    cents = "(round(p_retailprice * 100)::BIGINT // 100)::VARCHAR || ',' || lpad((round(p_retailprice * 100)::BIGINT % 100)::VARCHAR, 2, '0')"
    rows = f"(SELECT p_partkey, {_SQL_NAME} AS name, {_SQL_DAY} AS day, {_SQL_WORD_PLACE_RAW} AS place, {_SQL_ADDRESS} AS street, {cents} AS price FROM part)"
    joined = " ".join(f"JOIN ({source[k]}) by_{k} ON by_{k}.p_partkey = l.p_partkey" for k in kinds)
    return f"SELECT l.p_partkey::VARCHAR AS p_partkey, {values}, {shown}, {_total('(0.0::DOUBLE + ' + ' + '.join(raw[k] for k in kinds) + ')')} AS \"{FINAL}\" FROM {rows} l JOIN {rows} r ON r.p_partkey = l.p_partkey + 1 {joined}"


_SQL_DAY = "'19' || lpad(p_size::VARCHAR, 2, '0') || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || lpad((p_partkey // 2 % 28 + 1)::VARCHAR, 2, '0')"
_SQL_WORD_PLACE_RAW = "p_name[1:2] || replace(p_type, ' ', '')[1:CASE WHEN p_partkey % 9 = 0 THEN 3 ELSE 4 END]"
_SQL_ALL = _sql_all("TNDCLM")
_BLANK_MOTHER = "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN 'NA' ELSE p_name || ' ' || p_type END"
_SHORT_DATE = "CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y%m') WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END"


def _sql_guarded() -> str:
    """The fixed layout where mothers are missing and dates are cut."""
    mother = f"(CASE WHEN p_partkey % 5 < 2 THEN '' ELSE p_name || ' ' || p_type END)"
    dates = f"v AS (SELECT o_orderkey AS k, coalesce({_SHORT_DATE}, '') AS v FROM orders), pairs AS (SELECT a.k AS o_orderkey, a.v AS l, b.v AS r FROM v a JOIN v b ON b.k = a.k + 1)"
    people = {"nn": _SQL_NAME, "mm": mother}
    ctes = [f"{n} AS ({_sql_words('p_partkey', _sql_people(value), _sql_person_counts('p_partkey'), raw=True)})" for n, value in people.items()]
    day = f"(SELECT o_orderkey, coalesce({_SHORT_DATE}, '') AS v FROM orders)"
    both = "len(c.v) = 8 AND len(e.v) = 8"
    guarded = ", ".join(f"CASE WHEN {both} THEN dd.p{i} ELSE '0,0' END AS \"{h}\"" for i, h in enumerate(_FIXED[14:19]))
    total = _total(f"(0.0::DOUBLE + nn.nota + mm.nota + CASE WHEN {both} THEN {_DATE_SUM} ELSE 0 END)")
    value = lambda e: f"(SELECT p_partkey, {e} AS v FROM part)"
    return f"""WITH dd AS ({_sql_date('o_orderkey', dates)}), {', '.join(ctes)} SELECT a.v AS l_name, a2.v AS l_mother, c.v AS l_birth, b.v AS r_name, b2.v AS r_mother, e.v AS r_birth, nn.p_partkey::VARCHAR AS p_partkey,
  {', '.join(_quoted('nn', _FIXED[:7]) + _quoted('mm', _FIXED[7:14]))}, {guarded}, {total} AS "{FINAL}"
FROM nn JOIN mm USING (p_partkey) JOIN dd ON dd.o_orderkey = nn.p_partkey JOIN {value(_SQL_NAME)} a ON a.p_partkey = nn.p_partkey JOIN {value(_SQL_NAME)} b ON b.p_partkey = nn.p_partkey + 1
  JOIN {value(mother)} a2 ON a2.p_partkey = nn.p_partkey JOIN {value(mother)} b2 ON b2.p_partkey = nn.p_partkey + 1 JOIN {day} c ON c.o_orderkey = nn.p_partkey JOIN {day} e ON e.o_orderkey = nn.p_partkey + 1"""


_SQL_GUARDED = _sql_guarded()
_SQL_POSITION = f'SELECT o_orderkey, "{FINAL}" AS total, (row_number() OVER (ORDER BY "{FINAL}" DESC, o_orderkey::BIGINT) - 1)::BIGINT AS place FROM ({_SQL_GENERIC})'

ORACLE_SQL: dict[str, str] = {
    "normalize_text": _DOCS,
    "strip_suffix": f"SELECT p_partkey, {_sql_norm(_SQL_NAME)} AS norm FROM part",
    "tokenize_text": f"WITH t AS (SELECT doc_id, {_sql_tokens('norm')} AS t FROM ({_DOCS})) SELECT doc_id, len(t) AS n_tokens, coalesce(t[1], '') AS first, coalesce(t[-1], '') AS last FROM t",
    "name_parts": f"WITH t AS (SELECT p_partkey, {_sql_tokens(_sql_norm(_SQL_NAME))} AS t FROM part) SELECT p_partkey, coalesce(t[1], '') AS first, array_to_string(t[2:-2], ' ') AS middle, coalesce(t[-1], '') AS last FROM t",
    "soundex_tokens": f"WITH t AS (SELECT DISTINCT unnest({_sql_tokens('norm')}) AS token FROM ({_DOCS})) SELECT token, {_sql_soundex('token')} AS code FROM t",
    "levenshtein_pairs": f"WITH {_SQL_NAMES} SELECT p_partkey, levenshtein(l, r) AS distance FROM pairs",
    "freq_text": f"SELECT token, count(*) AS n FROM (SELECT unnest({_sql_tokens('norm')}) AS token FROM ({_DOCS})) GROUP BY token",
    "freq_name_slots": f"WITH {_SQL_NAMES}, u AS (SELECT {_sql_tokens('l')} AS tk FROM pairs UNION ALL SELECT {_sql_tokens('r')} FROM pairs), s AS (SELECT unnest({_sql_slots('tk')}) AS s FROM u) SELECT s.slot AS slot, s.token AS token, count(*) AS n FROM s GROUP BY ALL",
    "freq_top": f"SELECT token, count(*) AS n FROM (SELECT unnest({_sql_tokens('norm')}) AS token FROM ({_DOCS})) GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "score_date": _sql_date("o_orderkey", _SQL_DATES),
    "score_locality": _sql_locality("c_custkey", _SQL_PLACES),
    "score_locality_words": _sql_locality("p_partkey", _SQL_WORD_PLACES),
    "score_number": _sql_number("o_orderkey", _SQL_CENTS),
    "score_long_numbers": _sql_number("o_orderkey", _SQL_LONG),
    "score_name": _sql_words("p_partkey", _SQL_NAMES, _sql_person_counts("p_partkey")),
    "score_name_plain": _sql_words("p_partkey", _SQL_NAMES, "", initials=False),
    "score_text": _sql_words("p_partkey", _SQL_NAMES, _sql_text_counts("p_partkey")),
    "address_tokens": f"SELECT p_partkey, array_to_string(t, ' ') AS tokens FROM ({_ADDRESSES})",
    "address_parts": f"WITH {_sql_address_parts(_ADDRESSES)} SELECT p_partkey, array_to_string(via, ' ') AS via, numero, array_to_string(rest, ' ') AS complemento, array_to_string(every, ' ') AS every FROM parts",
    "address_jaccard": f"WITH {_sql_address_parts(_ADDRESSES)}, j AS (SELECT a.p_partkey, list_distinct(a.every) AS x, list_distinct(b.every) AS y FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey + 1) SELECT p_partkey, {_two('len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y)))')} AS jaccard FROM j",
    "address_token_set_ratio": f"WITH {_sql_sides(_ADDRESSES)} SELECT p_partkey, {_two('ratio')} AS ratio FROM {_sql_token_set_ratio('l_every', 'r_every', 'sides')} z",
    "score_address": _sql_address(_PLAIN_ADDRESSES),
    "score_all_types": _SQL_ALL,
    "score_fixed_guards": _SQL_GUARDED,
    "sorted_position": _SQL_POSITION,
    "normalize_letters": f"SELECT p_partkey, {_sql_norm(_SQL_LETTERS)} AS norm FROM part",
    "score_generic": _SQL_GENERIC,
    "score_fixed_layout": _SQL_FIXED,
    "sorted_lexical": _sql_sorted(f'"{FINAL}"'),
    "sorted_numeric": _sql_sorted(f"replace(\"{FINAL}\", ',', '.')::DOUBLE"),
}
