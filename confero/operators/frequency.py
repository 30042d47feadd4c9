"""Token frequency tables: built by partial and final aggregation, kept as one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_slots, normalize, tokens

#: A token rarer than this is rare; one more frequent than the other is common.
RARE, COMMON = 5, 1000


def text_frequency(df: DataFrame, *columns: str) -> DataFrame:
    """(token, n) over all words of the columns; a word repeated in a value counts each time."""
    both = F.array(*(normalize(F.col(c)) for c in columns))
    return df.select(F.explode(F.flatten(F.transform(both, tokens))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def name_frequency(df: DataFrame, *columns: str) -> DataFrame:
    """(slot, token, n) over the names in the columns, by first, middle and last."""
    both = F.array(*(normalize(F.col(c)) for c in columns))
    slots = F.flatten(F.transform(both, lambda c: name_slots(tokens(c))))
    return df.select(F.explode(slots).alias("s")).groupBy(F.col("s.slot").alias("slot"), F.col("s.token").alias("token")).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Words:
    """A pair of normalised columns whose words are counted, under a name; `person`: by first, middle and last."""

    pair: str
    left: str
    right: str
    person: bool

    def entries(self, *columns: str) -> Column:
        """(pair, slot, token) of the columns' words."""
        of = (lambda t: name_slots(t)) if self.person else (lambda t: F.transform(t, lambda x: F.struct(F.lit("").alias("slot"), x.alias("token"))))
        slots = F.flatten(F.transform(F.array(*columns), lambda c: of(tokens(c))))
        return F.transform(slots, lambda x: F.struct(F.lit(self.pair).alias("pair"), x["slot"].alias("slot"), x["token"].alias("token")))


def rare_and_common(df: DataFrame, words: Sequence[Words], frequency: DataFrame | None = None) -> DataFrame:
    """Adds rare_<pair> and common_<pair> for each pair: how many slots of its left value are rare and common.

    All pairs share one aggregation and one join.  Rows are first reduced to their different values, which are counted
    and looked up; only tokens that are not rare go into the look-up, and Spark broadcasts them where their measured
    size allows.  Without `frequency` (pair, slot, token, n) the words of the pairs' own columns are counted.
    """
    out = [f"{c}_{w.pair}" for w in words for c in ("rare", "common")]
    if not words:
        return df
    keys = list(dict.fromkeys(c for w in words for c in (w.left, w.right)))
    values = df.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 0")
    if frequency is None:
        every = F.flatten(F.array(*(w.entries(w.left, w.right) for w in words)))
        frequency = values.select("times", F.explode(every).alias("s")).groupBy("s.pair", "s.slot", "s.token").agg(F.sum("times").alias("n"))
    known = frequency.where(F.col("n") >= RARE).select("pair", "slot", "token", "n")
    left = F.flatten(F.array(*(w.entries(w.left) for w in words)))
    found = values.select(*keys, "times", F.explode(left).alias("s")).select(*keys, "s.pair", "s.slot", "s.token").join(known, ["pair", "slot", "token"], "left")
    of = lambda w, test: F.sum(F.when((F.col("pair") == w.pair) & test, 1).otherwise(0))
    counts = found.groupBy(*keys).agg(*(of(w, test).alias(f"{c}_{w.pair}") for w in words for c, test in (("rare", F.col("n").isNull()), ("common", F.coalesce(F.col("n") > COMMON, F.lit(False))))))
    return df.join(counts, keys, "left").select(*df.columns, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in out))


def fixed_frequencies(df: DataFrame, people: dict[str, tuple[str, str]]) -> DataFrame:
    """(person, slot, token, n) for each person's pair of columns."""
    parts = [name_frequency(df, *pair).select(F.lit(p).alias("person"), "slot", "token", "n") for p, pair in people.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
