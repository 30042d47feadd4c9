"""Shared plumbing of the corpus operators: tables, intermediate tables, words."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir  # noqa: F401

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words are what stands between these bytes: blank and 09 to 0D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; only Spark touches its path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus."""
    return F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % {modulus}")


def word_bytes(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case.  bytes.split() knows ASCII blanks only."""
    return text.lower().split()


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns as Python lists; strings as UTF-8 bytes without decoding."""
    out = []
    for name in names:
        col = batch.column(name)
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
        out.append(col.to_pylist())
    return out


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about `limit` bytes of text, or one row."""
    start, held = 0, 0
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
