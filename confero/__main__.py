"""Command line: python -m confero, or spark-submit with this file.

    python -m confero in.csv out --idx 9 10 11 13 14 15
    python -m confero in.csv out --pair 0:1:N:nome --pair 2:3:D:data
    python -m confero in.csv out --infer
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from confero.plans.engine import FINAL, FixedLayout, Pair, score_fixed, score_pairs
from confero.plans.header import infer_pairs
from confero.sources.files import cached_frequencies, detect_separator, read_delimited, write_delimited
from confero.version import shown_date, version_info


def _pair(text: str) -> Pair:
    left, right, kind, name = text.split(":", 3)
    return Pair(int(left), int(right), kind, name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("confero", description="Scores the candidate pairs that the rows of a delimited file hold.")
    p.add_argument("input", help="delimited file with a header")
    p.add_argument("output", help="folder for the result")
    how = p.add_mutually_exclusive_group(required=True)
    how.add_argument("--idx", nargs=6, type=int, metavar="I", help="columns of name, mother, birth of the first and the second person, from 0")
    how.add_argument("--pair", action="append", type=_pair, metavar="LEFT:RIGHT:TYPE:NAME", help="a pair of columns, from 0; types D, N, C, L, M, T")
    how.add_argument("--infer", action="store_true", help="pairs that the header names")
    p.add_argument("--sep", help="separator; found in the first line where it is not given")
    p.add_argument("--sort", default=FINAL, help="column to sort by, or 'none' for the input's order")
    p.add_argument("--ascending", action="store_true")
    p.add_argument("--numeric", action="store_true", help="sort scores as numbers")
    p.add_argument("--keep-na", action="store_true", help="words such as NA and null are values")
    p.add_argument("--frequencies", help="folder of the fixed layout's frequency table: used if there, else written")
    p.add_argument("--parquet", action="store_true", help="write Parquet in many files instead of one CSV")
    p.add_argument("--single-line", action="store_true", help="no value holds a line break: large files are split")
    version, date = version_info()
    p.add_argument("--version", action="version", version=f"{version} ({shown_date(date)})")
    return p


def run(spark: SparkSession, arguments: Sequence[str] | None = None) -> DataFrame:
    """Reads, scores and writes; returns what it wrote."""
    a = parser().parse_args(arguments)
    sep = a.sep or detect_separator(spark, a.input)
    df = read_delimited(spark, a.input, sep, multi_line=not a.single_line)
    order = {"sort_by": None if a.sort == "none" else a.sort, "ascending": a.ascending, "numeric": a.numeric, "na": not a.keep_na}
    if a.idx:
        layout, names = FixedLayout(*a.idx), df.columns
        known = None
        if a.frequencies:
            plain = df.toDF(*(f"c{i}" for i in range(len(names))))
            known = cached_frequencies(plain, {"paciente": (f"c{layout.name1}", f"c{layout.name2}"), "mae": (f"c{layout.mother1}", f"c{layout.mother2}")}, a.frequencies)
        out = score_fixed(df, layout, known, **order)
    else:
        out = score_pairs(df, a.pair or [Pair(*p) for p in infer_pairs(df.columns)], **order)
    if a.parquet:
        out.write.mode("overwrite").parquet(a.output)
    else:
        write_delimited(out, a.output, sep)
    return out


if __name__ == "__main__":
    run(SparkSession.builder.appName("confero").getOrCreate())
