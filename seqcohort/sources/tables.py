"""Result tables, gold standards, dates and external estimates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcohort.functions import formulas as fm

DATE_FORMATS = ("M/d/yy", "yyyy/M/d", "yyyy-MM-dd")


def read_results(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType | str, file_col: str,
                 ptid_pattern: str, partition_size: int | None = None) -> DataFrame:
    """Tab-separated sample results. Rows without a value in the second column (pooled
    pseudo rows) are dropped, the participant comes from the file name, and a partition
    size keeps only files of that size with their partition number."""
    df = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").schema(schema).csv(paths)
    return tidy_results(df, file_col, ptid_pattern, partition_size)


def tidy_results(df: DataFrame, file_col: str, ptid_pattern: str, partition_size: int | None = None) -> DataFrame:
    df = df.filter(F.col(df.columns[1]).isNotNull()).withColumn("ptid", F.regexp_extract(file_col, ptid_pattern, 1))
    if partition_size is not None:
        mark = rf"_p{partition_size}_([0-9]+)\.fasta$"
        df = df.filter(F.col(file_col).rlike(mark)).withColumn(
            "partition_id", F.regexp_extract(file_col, mark, 1).cast("bigint"))
    return df


def overlay_updates(base: DataFrame, update: DataFrame, on: Sequence[str], mode: str = "replace") -> DataFrame:
    """Columns of a later table replace those of the same name and new ones are added.
    ``replace`` also overwrites with missing values, ``coalesce`` keeps the old ones. Rows
    the update does not hold stay as they are."""
    shared = [c for c in update.columns if c in base.columns and c not in on]
    fresh = [c for c in update.columns if c not in base.columns]
    new = update.select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_u_{c}") for c in shared], *fresh)
    out = base.join(new, list(on), "left")

    def value(c: str) -> Column:
        if c not in shared:
            return F.col(c)
        if mode == "coalesce":
            return F.coalesce(f"_u_{c}", c).alias(c)
        return F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)

    return out.select(*[value(c) for c in base.columns], *fresh)


def concat_results(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sample_dates(sequences: DataFrame, ptid: str = "ptid", idx: str = "seq_idx", header: str = "header") -> DataFrame:
    """Sample date of a participant: fifth header field of its last record."""
    field = F.get(F.split(F.max_by(header, idx), r"\|"), 4)
    return sequences.groupBy(ptid).agg(field.alias("date_text")).withColumn("sample_date", parse_date(F.col("date_text")))


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def read_gold(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType | str, dates: Sequence[str] = ()) -> DataFrame:
    df = spark.read.option("header", True).option("nullValue", "NA").schema(schema).csv(paths)
    return df.withColumns({c: parse_date(F.col(c)) for c in dates}) if dates else df


def read_external_estimates(spark: SparkSession, paths: Sequence[str] | str, path_pattern: str) -> DataFrame:
    """One-row estimate files (estimate, upper, lower); bounds type and participant come
    from the path by a pattern with two groups. Negative values mean no estimate."""
    raw = spark.read.option("header", True).schema("estimate double, ci_high double, ci_low double").csv(paths)
    path = F.col("_metadata.file_path")
    known = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("estimate", "ci_low", "ci_high")}
    return raw.select(
        F.regexp_extract(path, path_pattern, 1).alias("bounds_type"), F.regexp_extract(path, path_pattern, 2).alias("ptid"),
        *[v.alias(c) for c, v in known.items()],
    )


def offsets_to_dates(df: DataFrame, columns: Sequence[str], origin: str = "2000-01-01") -> DataFrame:
    """Day offsets from the origin to dates (rounded half to even); texts that start with
    ``-`` mean no estimate."""
    def date(c: str) -> Column:
        number = F.when(~F.trim(F.col(c).cast("string")).startswith("-"), F.col(c).cast("string")).try_cast("double")
        return F.date_add(F.lit(origin).cast("date"), F.bround(number, 0).cast("int"))

    return df.withColumns({c: date(c) for c in columns})


def fixed_table(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return df.withColumns({c: fm.fixed_digits(F.col(c), digits) for c in columns})


def write_results(df: DataFrame, path: str, columns: Sequence[str], partition: Sequence[str] = ("region", "time", "bounds_type"),
                  digits: int = 2) -> None:
    """Fixed-digit tables, one folder per region, time and bounds type."""
    fixed_table(df, columns, digits).write.partitionBy(*partition).option("sep", "\t").option("header", True).csv(path)


def duplicate_lines(dups: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Retained name with the comma list of all removed ones, one line each. A cell holds as
    many names as a sequence has copies: for very many the long form is the one to use."""
    return dups.filter("kept <> dup").groupBy(*keys, F.col("kept").alias("retained")).agg(
        F.array_join(F.sort_array(F.collect_list("dup")), ",").alias("removed")
    )


def write_duplicate_map(dups: DataFrame, path: str, keys: Sequence[str] = ("sample_id",), form: str = "long") -> None:
    if form == "long":
        dups.select(*keys, F.col("kept").alias("kept_seq"), F.col("dup").alias("dup_seq")).write.option("header", True).csv(path)
    else:
        duplicate_lines(dups, keys).write.option("header", True).option("sep", "\t").csv(path)
