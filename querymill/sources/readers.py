"""Readers of logs, results and small tables."""

from __future__ import annotations

import random
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.schema import DROPPED, RAW_JSON, RENAMES, STANDARD

_FORMATS = {"txt": "text", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}


def files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The files under a path in order, through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(root).isDirectory():
        return [path]
    found = [s.getPath().toString() for s in fs.listStatus(root) if s.isFile()]
    found = sorted(f for f in found if f.endswith(suffix) and not PurePosixPath(f).name.startswith(("_", ".")))
    if not found:
        raise FileNotFoundError(f"no {suffix or 'file'} under {path}")
    return found


def pick(paths: list[str], first: int | None = None, sample: int | None = None, half: str | None = None, seed: int = 42) -> list[str]:
    """The first n files, a seeded sample without repeats, or one half of the listing."""
    if half:
        middle = len(paths) // 2
        paths = paths[:middle] if half == "first" else paths[middle:]
    if first is not None:
        paths = paths[:first]
    if sample is not None and sample < len(paths):
        paths = sorted(random.Random(seed).sample(paths, sample))
    return paths


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """One or several folders; the columns and the condition reach the scan."""
    df = spark.read.parquet(*paths)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str, kind: str | None = None, schema=None, delimiter: str | None = None, header: bool = True, first: int | None = None, with_path: bool = False) -> DataFrame:
    """txt, csv, tsv, json, jsonl or parquet, gzipped or not; the kind is told by the suffix if all files share one."""
    paths = pick(files(spark, path), first=first)
    if kind is None:
        kinds = {(PurePosixPath(p).suffixes[-2] if p.endswith(".gz") and len(PurePosixPath(p).suffixes) > 1 else PurePosixPath(p).suffix).lstrip(".") for p in paths}
        if kinds == {"json", "jsonl"}:  # of results written both ways the lines count
            kinds, paths = {"jsonl"}, [p for p in paths if ".jsonl" in PurePosixPath(p).name]
        if len(kinds) != 1:
            raise ValueError(f"files of several kinds: {sorted(kinds)}")
        kind = kinds.pop()
    reader = spark.read.format(_FORMATS[kind])
    if kind in ("csv", "tsv"):
        reader = reader.option("header", header).option("sep", delimiter or ("\t" if kind == "tsv" else ","))
    if kind == "json":
        reader = reader.option("multiLine", True)
    df = (reader.schema(schema) if schema is not None else reader).load(paths)
    return df.withColumn("path", F.col("_metadata.file_path")) if with_path else df


def read_raw_json(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines under the explicit raw schema; other fields are ignored and unused ones pruned."""
    return spark.read.schema(RAW_JSON).json(list(paths))


def rows_per_partition(df: DataFrame) -> DataFrame:
    """(partition, n): how many rows each partition holds."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def key_from_path(column: str = "path", pattern: str = r"([^/]+?)(?:\.[^/.]+)*$"):
    """A key in the file's name, by default the name without its endings."""
    return F.regexp_extract(F.col(column), pattern, 1)


def read_skipping(spark: SparkSession, path: str, skip: int, rows: int | None = None, names: list[str] = ("item", "score")) -> DataFrame:
    """Small CSV files with lines before the data: (names…, line, path). The line number is that within the file, counted from the data's first line."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r", ""), "\n")).alias("line", "text"))
    kept = text.where((F.col("line") >= skip) & (F.trim("text") != "")).withColumn("line", F.col("line") - skip)
    kept = kept.where(F.col("line") < rows) if rows is not None else kept
    parts = F.from_csv(F.col("text"), ", ".join(f"{n} string" for n in names))
    return kept.select(parts.alias("p"), "line", "path").select("p.*", "line", "path")


def trend_score(column: str = "score"):
    """Scores given as text, with `<1` for less than one."""
    return F.when(F.trim(column) == "<1", 0.5).otherwise(F.col(column).try_cast("double"))


def split_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) of lines cut at their tab, or else at their first blank, and the lines that can't be cut."""
    line = F.col("value")
    tabs = F.split(line, "\t")
    blank = F.split(F.trim(line), " ", 2)
    parts = F.when(F.size(tabs) == 2, tabs).when((F.size(tabs) == 1) & (F.size(blank) == 2), blank)
    rows = spark.read.text(path).withColumn("parts", parts)
    good = rows.where("parts is not null").select(F.trim(F.col("parts")[0]).alias("id"), F.trim(F.col("parts")[1]).alias("text"))
    return good, rows.where("parts is null").select("value")


def standardise(df: DataFrame, log: str, keep: list[str] = ()) -> DataFrame:
    """A raw log under the standard schema: renamed, cast and padded with nulls. Date-times become epoch seconds. Other columns go, but for those to keep."""
    df = df.drop(*DROPPED[log]).withColumnsRenamed({k: v for k, v in RENAMES[log].items() if k in df.columns})
    cols = []
    for f in STANDARD.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name == "serp_timestamp":
            text = F.col(f.name).cast("string")
            cols.append(F.coalesce(text.try_cast("bigint"), F.unix_timestamp(F.try_to_timestamp(text))).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return df.select(*keep, *cols)


def fill_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls become "", 0 or 0.0 by type, in the named columns or all: the same for every row, however it is partitioned."""
    names = columns or df.columns
    return df.fillna("", names).fillna(0, names)
