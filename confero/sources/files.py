"""Delimited files and frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..operators.frequency import fixed_frequencies
from ..plans.header import pick_separator

SLOTS = ("first", "middle", "last")


def _csv(spark: SparkSession, sep: str, header: bool, multi_line: bool) -> DataFrameReader:
    return spark.read.options(sep=sep, header=header, quote='"', escape='"', multiLine=multi_line)


def read_delimited(spark: SparkSession, path: str, sep: str = "|", multi_line: bool = True) -> DataFrame:
    """A file with a header, every column a string; repeated names get .1, .2 and so on.

    Quotes inside quoted values are doubled.  Line breaks inside them need `multi_line`, which reads a file in one
    task; switch it off for large files without such breaks, which are then split.  Rows longer than the header stop
    the reading.
    """
    df = _csv(spark, sep, True, multi_line).options(enforceSchema=True, mode="FAILFAST").csv(path)
    head = _csv(spark, sep, False, multi_line).csv(path).limit(1).first()
    if head is None:
        return df
    seen: dict[str, int] = {}
    names = []
    for name in head:
        name = name if name is not None else f"Unnamed: {len(names)}"
        names.append(name if name not in seen else f"{name}.{seen[name]}")
        seen[name] = seen.get(name, 0) + 1
    return df.toDF(*names)


def read_header(spark: SparkSession, path: str, sep: str = "|") -> list[str]:
    return read_delimited(spark, path, sep).columns


def detect_separator(spark: SparkSession, path: str, by_side: bool = True) -> str:
    """By the first line, or for other files by the first 2048 characters."""
    lines = [r[0] for r in spark.read.text(path).limit(1 if by_side else 200).collect()]
    return pick_separator("\n".join(lines)[:2048], by_side)


def write_delimited(df: DataFrame, path: str, sep: str = "|", one_file: bool = True) -> None:
    """A folder of CSV with header, values as they are, quotes doubled; one file keeps the order, several scale."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").options(header=True, sep=sep, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_frequency(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(token, n) of a headerless file; tokens in lower case, the last line of a token counts."""
    df = spark.read.schema("token string, n string").options(sep=sep, quote='"', escape='"').csv(path)
    df = df.select(F.lower("token").alias("token"), F.trim("n").cast("bigint").alias("n"), F.monotonically_increasing_id().alias("line")).where("token is not null")
    return df.groupBy("token").agg(F.max_by("n", "line").alias("n"))


def read_frequencies(spark: SparkSession, paths: dict[tuple[str, str], str], sep: str = ";") -> DataFrame:
    """(person, slot, token, n) of one file for each (person, slot)."""
    out = None
    for (person, slot), path in paths.items():
        part = read_frequency(spark, path, sep).select(F.lit(person).alias("person"), F.lit(slot).alias("slot"), "token", "n")
        out = part if out is None else out.unionByName(part)
    return out


def write_frequencies(frequencies: DataFrame, path: str) -> None:
    """One table, a folder for each person and slot, most frequent first; as many tasks as its size asks for."""
    frequencies.repartitionByRange("person", "slot", F.desc("n"), "token").sortWithinPartitions("person", "slot", F.desc("n"), "token").write.mode("overwrite").partitionBy("person", "slot").parquet(path)


def write_frequency_files(frequencies: DataFrame, path: str, sep: str = ";") -> dict[tuple[str, str], str]:
    """A folder of headerless `token;n` text for each (person, slot), most frequent first; their paths by (person, slot)."""
    paths = {}
    for person, slot in [(r["person"], r["slot"]) for r in frequencies.select("person", "slot").distinct().collect()]:
        paths[person, slot] = f"{path}/{person}-{slot}"
        own = frequencies.where((F.col("person") == person) & (F.col("slot") == slot)).select("token", F.col("n").cast("string").alias("n"))
        own.orderBy(F.col("n").cast("bigint").desc(), "token").write.mode("overwrite").options(sep=sep, quote='"', escape='"').csv(paths[person, slot])
    return paths


def fingerprint(df: DataFrame, people: dict[str, tuple[str, str]]) -> str:
    """Of the columns that frequencies are built from, in any order of rows."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for pair in people.values() for c in pair]
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return f"{sorted(people.items())} {n} {total}"


def cached_frequencies(df: DataFrame, people: dict[str, tuple[str, str]], path: str, check: bool = False) -> DataFrame:
    """The table at `path` if there is one, else built from `df` and written there.

    It is not checked against `df`, unless `check` asks for a fingerprint: then a table of other rows is built anew."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    mark = f"{path}.fingerprint"
    own = fingerprint(df, people) if check else ""
    if there and check:
        held = jvm.org.apache.hadoop.fs.Path(mark)
        there = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held) and spark.read.text(mark).first()[0] == own
    if not there:
        write_frequencies(fixed_frequencies(df, people), path)
        spark.createDataFrame([(own,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.parquet(path)
