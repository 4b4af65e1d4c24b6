"""Alignment files to the ``sequences`` table (sample_id, seq_idx, seq_name, seq) and back.

Files are read by Spark's splittable text source; record order is restored from the split
offset and the row number inside the split, so a large file is not read by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcohort.operators.ranks import running_totals
from seqcohort.session import settle


def read_records(spark: SparkSession, paths: Sequence[str] | str, separator: str = "\n", once: bool = False) -> DataFrame:
    """(path, at, value): text records with ``at`` increasing in file order. ``once`` writes the
    records and reads them back, so that every file is opened a single time."""
    raw = spark.read.option("lineSep", separator).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    raw = settle(raw) if once else raw
    first = raw.groupBy("path", "_start").agg(F.min("_id").alias("_first"))
    # a split has fewer records than bytes, so start + row number never overlaps
    return raw.join(first, ["path", "_start"]).select(
        "path", (F.col("_start") + F.col("_id") - F.col("_first")).alias("at"), "value"
    )


def _sample_of(path: Column, pattern: str) -> Column:
    return F.regexp_extract(path, pattern, 1)


FILE_STEM = r"([^/]+?)(?:\.[^./]*)?$"


def read_fasta(spark: SparkSession, paths: Sequence[str] | str, sample_pattern: str = FILE_STEM, whole_header: bool = False) -> DataFrame:
    """All records of all files. The name is the header up to the first blank (or the whole
    header); white space inside residues is dropped, residues are lower case."""
    r = read_records(spark, paths, "\n>")
    text = F.regexp_replace("value", "^>", "")
    header = F.regexp_replace(F.substring_index(text, "\n", 1), r"\s+$", "")
    body = F.when(F.instr(text, "\n") > 0, F.expr("substring(_t, instr(_t, '\n') + 1)")).otherwise("")
    name = header if whole_header else F.regexp_extract(header, r"^(\S*)", 1)
    return (
        r.withColumn("_t", text).select(
            _sample_of(F.col("path"), sample_pattern).alias("sample_id"), F.col("at").alias("seq_idx"),
            name.alias("seq_name"), header.alias("header"), F.lower(F.regexp_replace(body, r"\s", "")).alias("seq"),
        ).filter("seq_name <> '' OR seq <> ''")
    )


def split_valid(df: DataFrame, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a sample is rejected when names repeat (ignoring case) or
    sequences differ in length. Repeats are found per name, so no group holds a sample."""
    repeats = df.groupBy(sample, F.lower("seq_name").alias("_n")).count().filter("count > 1")
    widths = df.groupBy(sample).agg(F.min(F.length("seq")).alias("_a"), F.max(F.length("seq")).alias("_b"))
    bad = (
        repeats.select(sample, F.lit("duplicate name").alias("reason"))
        .unionByName(widths.filter("_a <> _b").select(sample, F.lit("unequal length").alias("reason")))
        .groupBy(sample).agg(F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reason"))
    )
    return df.join(bad.select(sample), sample, "left_anti"), bad


def read_file_list(spark: SparkSession, list_path: str, **options) -> DataFrame:
    """FASTA files named one per line in a text file; only the names pass the driver."""
    paths = [r.value.strip() for r in spark.read.text(list_path).filter("trim(value) <> ''").collect()]
    return read_fasta(spark, paths, **options)


def _numbered(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Lines with their number. The files are opened once, however often the lines are used:
    many small ones cost more to open than to read."""
    lines = settle(read_records(spark, paths, once=True).filter("trim(value) <> ''"))
    numbers = running_totals(lines.withColumn("_one", F.lit(1).cast("bigint")), ["path"], "at", ["_one"])
    return settle(lines.join(numbers.select("path", "at", F.col("_one_through").alias("line")), ["path", "at"]))


def _assemble(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces of one sequence in line order; as many as the file has blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "piece")))
    return pieces.groupBy(*keys).agg(
        F.max("seq_name").alias("seq_name"), F.min("line").alias("seq_idx"),
        F.lower(F.array_join(F.transform(ordered, lambda s: s["piece"]), "")).alias("seq"),
    )


# What an aligned sequence may hold (nucleotide and amino-acid letters, gaps,
# unknowns, matches to the first sequence).
RESIDUES = r"[A-Za-z*?.~-]*"


def checked(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Sequences of ``found`` (with ``path``) after comparison with what their file declares:
    the number of sequences ``_n`` and of sites ``_sites`` (null: not declared), and the
    characters that may occur. A file that disagrees is an error, never a guess."""
    found = settle(found)  # read twice, put together once
    seen = found.groupBy("path").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(F.length("seq")).alias("_short"), F.max(F.length("seq")).alias("_long"),
        F.bool_and(F.col("seq").rlike(f"^{RESIDUES}$")).alias("_clean"),
    ).join(declared, "path", "left")
    trouble = (
        F.when(~F.col("_clean"), F.lit("holds characters that no sequence has"))
        .when(F.col("_rows") != F.col("_n"), F.format_string("declares %s sequences and has %s", "_n", "_rows"))
        .when((F.col("_short") != F.col("_sites")) | (F.col("_long") != F.col("_sites")),
              F.format_string("declares %s sites and has sequences of %s to %s", "_sites", "_short", "_long"))
    )
    verdict = seen.select("path", F.when(trouble.isNotNull(), F.raise_error(F.concat("path", F.lit(" "), trouble)).cast("int")).alias("_bad"))
    return found.join(verdict, "path").filter("_bad IS NULL").drop("_bad")


def read_phylip(spark: SparkSession, paths: Sequence[str] | str, sample_pattern: str = FILE_STEM) -> DataFrame:
    """Interleaved PHYLIP, or sequential with one line per sequence: the first line gives
    the number of sequences and sites, names stand in the first block only. Files whose
    sequences do not have the declared number and length (such as sequential files with
    wrapped lines) are an error."""
    lines = _numbered(spark, paths)
    size = lines.filter("line = 1").select("path", *[
        F.regexp_extract("value", r"^\s*(\d+)\s+(\d+)", i).cast("bigint").alias(c) for i, c in ((1, "_n"), (2, "_sites"))
    ])
    rows = lines.filter("line > 1").join(size, "path").withColumns(
        {"_row": (F.col("line") - 2) % F.col("_n"), "_first": F.col("line") - 2 < F.col("_n")}
    )
    name = F.when(F.col("_first"), F.regexp_extract(F.trim("value"), r"^(\S+)", 1))
    body = F.when(F.col("_first"), F.regexp_replace(F.trim("value"), r"^\S+", "")).otherwise(F.col("value"))
    pieces = rows.select("path", "_row", "line", name.alias("seq_name"), F.regexp_replace(body, r"\s", "").alias("piece"))
    return checked(_assemble(pieces, ["path", "_row"]), size).select(
        _sample_of(F.col("path"), sample_pattern).alias("sample_id"), (F.col("seq_idx") - 1).alias("seq_idx"), "seq_name", "seq"
    )


def _without_comments(lines: DataFrame) -> DataFrame:
    # depth of brackets at the start of each line, from running totals of the two kinds
    count = lambda mark: (F.length("value") - F.length(F.replace("value", F.lit(mark), F.lit("")))).cast("bigint")
    depth = lines.withColumns({"_up": count("["), "_down": count("]")})
    before = running_totals(depth, ["path"], "line", ["_up", "_down"]).select(
        "path", "line", (F.col("_up_before") - F.col("_down_before")).alias("_open")
    )
    inside = F.concat(F.when(F.col("_open") > 0, F.lit("[")).otherwise(F.lit("")), F.col("value"))
    plain = F.regexp_replace(F.regexp_replace(inside, r"\[[^\]]*\]", ""), r"\[.*$", "")
    return lines.join(before, ["path", "line"]).withColumn("value", plain).drop("_open").filter("trim(value) <> ''")


def read_nexus(spark: SparkSession, paths: Sequence[str] | str, sample_pattern: str = FILE_STEM) -> DataFrame:
    """Matrix block of NEXUS files, interleaved or not: every line repeats its name. Comments
    in brackets are left out, also over several lines; the declared dimensions are checked."""
    lines = _numbered(spark, paths)
    # only files with a bracket can hold a comment; the lines are read four times below
    commented = settle(lines.filter(F.col("value").contains("[")).select("path").distinct())
    lines = settle(lines.join(commented, "path", "left_anti").unionByName(
        _without_comments(lines.join(commented, "path", "left_semi"))))
    declared = lines.filter(F.lower("value").rlike(r"^\s*dimensions\b")).withColumn("value", F.lower("value")).select(
        "path", F.nullif(F.regexp_extract("value", r"\bntax\s*=\s*(\d+)", 1), F.lit("")).cast("bigint").alias("_n"),
        F.nullif(F.regexp_extract("value", r"\bnchar\s*=\s*(\d+)", 1), F.lit("")).cast("bigint").alias("_sites"),
    ).groupBy("path").agg(F.max("_n").alias("_n"), F.max("_sites").alias("_sites"))
    start = lines.filter(F.lower(F.trim("value")) == "matrix").groupBy("path").agg(F.min("line").alias("_a"))
    ends = lines.filter(F.trim("value").startswith(";")).join(start, "path").filter("line > _a")
    span = start.join(ends.groupBy("path").agg(F.min("line").alias("_b")), "path")
    rows = lines.join(span, "path").filter("line > _a AND line < _b")
    pieces = rows.select(
        "path", "line", F.regexp_extract(F.trim("value"), r"^(\S+)", 1).alias("seq_name"),
        F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\S+", ""), r"[\s;]", "").alias("piece"),
    ).withColumn("_name", F.col("seq_name"))
    return checked(_assemble(pieces, ["path", "_name"]), declared).select(
        _sample_of(F.col("path"), sample_pattern).alias("sample_id"), "seq_idx", "seq_name", "seq"
    )


def write_fasta(df: DataFrame, path: str, width: int = 72, sample: str = "sample_id") -> None:
    """One folder of FASTA text per sample. Rows are range-partitioned by sample and order,
    so a large sample becomes several ordered files instead of one task."""
    wrapped = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    (
        df.repartitionByRange(sample, "seq_idx").sortWithinPartitions(sample, "seq_idx")
        .select(sample, F.concat(F.lit(">"), F.col("seq_name"), F.lit("\n"), wrapped).alias("value"))
        .write.partitionBy(sample).text(path)
    )


def write_files(df: DataFrame, path: str, name: str = "sample_id", order: Sequence[str] = (), value: str = "value") -> None:
    """One text file ``name=value.txt`` per value, in folders of one task each, with its lines in ``order``.
    A task opens its files itself, one after the other: a writer that partitions by folder takes
    many times as long per file."""
    named = F.coalesce(F.col(name).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("_name")
    rows = df.select(named, *order, F.col(value).alias("_value")).repartition("_name").sortWithinPartitions("_name", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = re.match(r"^(file:)?/", path)
        store, root = (fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", path)) if local else fs.FileSystem.from_uri(path)
        folder, out, now, written = f"{root}/{TaskContext.get().partitionId()}", None, None, 0
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != now:
                    if out is None:
                        store.create_dir(folder, recursive=True)
                    else:
                        out.close()
                    now, written = own, written + 1
                    out = store.open_output_stream(f"{folder}/{name}={quote(own, safe='=+@ ')}.txt")
                out.write(f"{text}\n".encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    rows.select("_name", "_value").mapInArrow(run, "files bigint").agg(F.sum("files")).collect()
