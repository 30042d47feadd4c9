"""Scoring a stream of pairs.

Most types need the row alone.  Texts, and names with frequencies, are looked up in a table that was built before,
micro-batch by micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import normalize
from ..operators import comparators as cmp
from ..operators.frequency import Words, rare_and_common

_ROW_BY_ROW = {"D": cmp.date, "C": cmp.locality, "L": cmp.address, "N": cmp.name}


def _free(df: DataFrame, out: str) -> None:
    if out in df.columns:
        raise ValueError(f"the input has a column {out!r} already")


def score_stream(df: DataFrame, left: str, right: str, kind: str, out: str = "score") -> DataFrame:
    """Adds `out`, the comparator's struct, to a stream or a table: dates, localities, addresses, numbers, and names
    without frequencies.  Texts are counted against a table: see score_batches."""
    _free(df, out)
    kind, l, r = kind.upper(), F.col(left), F.col(right)
    if kind == "M":
        return df.withColumn(out, cmp.number(l, r))
    if kind not in _ROW_BY_ROW:
        raise ValueError(f"type {kind!r} needs a frequency table: use score_batches")
    return df.withColumn(out, _ROW_BY_ROW[kind](normalize(l), normalize(r)))


def score_table(df: DataFrame, left: str, right: str, kind: str, frequency: DataFrame, out: str = "score") -> DataFrame:
    """Adds `out` to a table of names (N) or texts (any other type), by a table (slot, token, n); texts have slot ''."""
    _free(df, out)
    person = kind.upper() == "N"
    names = df.columns
    work = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), normalize(F.col(left)).alias("l"), normalize(F.col(right)).alias("r"))
    work = rare_and_common(work, [Words("0", "l", "r", person)], frequency.select(F.lit("0").alias("pair"), "slot", "token", "n"))
    score = (cmp.name if person else cmp.text)(F.col("l"), F.col("r"), F.col("rare_0"), F.col("common_0"))
    return work.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), score.alias(out))


def score_batches(stream: DataFrame, left: str, right: str, kind: str, frequency: DataFrame, write: Callable[[DataFrame, int], None], out: str = "score") -> DataStreamWriter:
    """A writer that scores each micro-batch of names or texts against `frequency` and hands it to write(batch, number)."""
    return stream.writeStream.foreachBatch(lambda batch, number: write(score_table(batch, left, right, kind, frequency, out), number))
