"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that normalisation folds; all others stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null as empty; a few rows at a time become objects."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    column = column.cast(kind)
    for start in range(0, len(column), step):
        for text in column.slice(start, step).to_pylist():
            yield text or b""


def texts(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    for start in range(0, len(column), step):
        yield from column.slice(start, step).to_pylist()


def partitions_for(rows: int, per_part: int) -> int:
    """How many parts of about ``per_part`` rows hold ``rows``."""
    return max(1, -(-rows // per_part))


def bucket(n: int, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
