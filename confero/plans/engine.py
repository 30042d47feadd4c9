"""The two scoring plans: any list of column pairs, and the fixed layout of two people and a birth date."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import missing_to_empty, normalize, total_format
from ..operators import comparators as cmp
from ..operators.frequency import Words, rare_and_common

FINAL = "nota final"
# Labels of the partial scores, in order.
WORD_LABELS = ("prim frag igual", "ult frag igual", "qtd frag iguais", "qtd frag raros", "qtd frag comuns", "qtd frag muito parec", "qtd frag abrev")
LABELS = {
    "D": ("dt iguais", "dt ap 1digi", "dt inv dia", "dt inv mes", "dt inv ano"), "C": ("uf igual", "uf prox", "local igual", "local prox"),
    "L": ("via igual", "via prox", "numero igual", "compl prox", "texto prox", "tokens jacc"), "M": ("num igual", "num prox abs", "num prox rel", "num prox arred"),
}


@dataclass(frozen=True)
class Pair:
    """Two columns, by index, their type and the label's first part."""

    left: int
    right: int
    kind: str
    name: str


@dataclass(frozen=True)
class FixedLayout:
    name1: int = 0
    mother1: int = 1
    birth1: int = 2
    name2: int = 3
    mother2: int = 4
    birth2: int = 5


def labels(pairs: Sequence[Pair]) -> list[str]:
    return [f"{p.name} {x}" for p in pairs for x in LABELS.get(p.kind.upper(), WORD_LABELS)] + [FINAL]


def fixed_labels() -> list[str]:
    return [*WORD_LABELS, *(f"mae {x}" for x in WORD_LABELS), *LABELS["D"], FINAL]


def _by_index(df: DataFrame, na: bool) -> DataFrame:
    """Columns by position, as strings, with nothing missing; names are free to hold dots and commas, or to repeat."""
    raw = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return raw.select(*((missing_to_empty(F.col(c).cast("string")) if na else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in raw.columns))


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows over as many tasks as the session shuffles to.  A task scores some thousands of pairs a second and shuffles
    a hundred times as many, so partitions that are right by their bytes are too few for the comparators."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _named(df: DataFrame, names: list[str], scores: list[Column], heads: list[str], sort_by: str | None, ascending: bool, numeric: bool) -> DataFrame:
    """Input columns and scores under their names, in order of one of them; rows that tie keep the input's order.

    A range sort looks at its input twice; the exchange before it keeps the scores, so that they are worked out once."""
    n = len(names)
    out = df.select(*(F.col(f"c{i}") for i in range(n)), *(s.alias(f"s{i}") for i, s in enumerate(scores)), "row").repartition("row")
    if sort_by is None:
        out = out.orderBy("row")
    else:
        at = [*names, *heads].index(sort_by)
        key = F.col(f"c{at}" if at < n else f"s{at - n}")
        key = F.translate(key, ",", ".").try_cast("double") if numeric else key
        out = out.orderBy(key.asc() if ascending else key.desc(), "row")
    return out.drop("row").toDF(*names, *heads)


def _check(sort_by: str | None, names: Sequence[str]) -> None:
    if sort_by is not None and sort_by not in names:
        raise ValueError(f"no column {sort_by!r} to sort by")


def _compare(p: Pair, name: str, initials: bool = True) -> Column:
    """The comparator of a pair's type over normalised columns n<i>, or raw ones c<i> for numbers."""
    l, r, kind = F.col(f"n{p.left}"), F.col(f"n{p.right}"), p.kind.upper()
    match kind:
        case "D" | "C" | "L":
            return {"D": cmp.date, "C": cmp.locality, "L": cmp.address}[kind](l, r)
        case "M":
            return cmp.number(F.col(f"c{p.left}"), F.col(f"c{p.right}"))
        case "N":
            return cmp.name(l, r, F.col(f"rare_{name}"), F.col(f"common_{name}"), initials=initials)
    return cmp.text(l, r, F.col(f"rare_{name}"), F.col(f"common_{name}"))


def score_pairs(df: DataFrame, pairs: Sequence[Pair], sort_by: str | None = FINAL, ascending: bool = False, numeric: bool = False, na: bool = True, initials: bool = True, progress: Callable | None = None) -> DataFrame:
    """Adds the partial scores of every pair and their sum.

    Types: D date, N name, C locality, L address, M number, any other text; case does not matter.  Scores are strings
    with a decimal comma; `numeric` sorts them as numbers, otherwise as strings.  An empty list gives a total of 0,00.
    """
    heads = labels(pairs)
    _check(sort_by, [*df.columns, *heads])
    if progress:
        progress(0, "")
    names = df.columns
    work = _by_index(df, na).withColumn("row", F.monotonically_increasing_id())
    used = sorted({i for p in pairs if p.kind.upper() != "M" for i in (p.left, p.right)})
    work = work.select("*", *(normalize(F.col(f"c{i}")).alias(f"n{i}") for i in used))
    work = rare_and_common(work, [Words(str(k), f"n{p.left}", f"n{p.right}", p.kind.upper() == "N") for k, p in enumerate(pairs) if p.kind.upper() not in ("D", "C", "L", "M")])
    work = spread(work, F.xxhash64("row"))  # another key than that after the scores, or Spark makes one exchange of both
    results = [_compare(p, str(k), initials) for k, p in enumerate(pairs)]
    work = work.select("*", *(x.alias(f"r{k}") for k, x in enumerate(results)))
    total, scores = F.lit(0.0), []
    for k, p in enumerate(pairs):
        scores += [F.col(f"r{k}")["p"][i] for i in range(cmp.SLOTS.get(p.kind.upper(), 7))]
        total = total + F.col(f"r{k}")["nota"]
    out = _named(work, names, [*scores, total_format(total)], heads, sort_by, ascending, numeric)
    if progress:
        progress(100, "", "")
    return out


def score_fixed(df: DataFrame, layout: FixedLayout = FixedLayout(), frequencies: DataFrame | None = None, sort_by: str | None = FINAL, ascending: bool = False, numeric: bool = False, na: bool = True) -> DataFrame:
    """Name, mother's name and birth date of two people: 20 columns.

    Names are scored where both are there, dates where both have eight characters as written; else all is 0,0.
    `frequencies` (person, slot, token, n) may come from an earlier run.
    """
    _check(sort_by, [*df.columns, *fixed_labels()])
    names = df.columns
    work = _by_index(df, na).withColumn("row", F.monotonically_increasing_id())
    people = {"paciente": (layout.name1, layout.name2), "mae": (layout.mother1, layout.mother2)}
    work = work.select("*", *(normalize(F.col(f"c{i}")).alias(f"n{i}") for i in sorted({i for pair in people.values() for i in pair} | {layout.birth1, layout.birth2})))
    known = None if frequencies is None else frequencies.withColumnRenamed("person", "pair")
    work = rare_and_common(work, [Words(p, f"n{a}", f"n{b}", True) for p, (a, b) in people.items()], known)
    work = spread(work, F.xxhash64("row"))  # another key than that after the scores, or Spark makes one exchange of both
    results = [_compare(Pair(a, b, "N", p), p) for p, (a, b) in people.items()]
    dated = (F.length(f"c{layout.birth1}") == 8) & (F.length(f"c{layout.birth2}") == 8)
    results.append(F.when(dated, cmp.date(F.col(f"n{layout.birth1}"), F.col(f"n{layout.birth2}"))).otherwise(cmp.zeros(5)))
    work = work.select("*", *(x.alias(f"r{k}") for k, x in enumerate(results)))
    scores = [F.col(f"r{k}")["p"][i] for k, n in enumerate((7, 7, 5)) for i in range(n)]
    total = F.lit(0.0) + F.col("r0")["nota"] + F.col("r1")["nota"] + F.col("r2")["nota"]
    return _named(work, names, [*scores, total_format(total)], fixed_labels(), sort_by, ascending, numeric)
