"""Writers of results and the names of their folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_name(datasets: list[str], analysis: str, level: str | None = None, half: str | None = None, sample: int | None = None, scope: str = "all", english: bool = False) -> str:
    """{datasets}-{analysis}[-{level}][-{half}]-{sample or scope}[-english]."""
    parts = ["-".join(datasets), analysis, level, half, str(sample) if sample else scope, "english" if english else None]
    return "-".join(p for p in parts if p)


def with_metadata(df: DataFrame, analysis: str, datasets: list[str], sample: int | None = None) -> DataFrame:
    return df.withColumn("analysis_name", F.lit(analysis)).withColumn("dataset", F.lit("-".join(datasets))).withColumn("sample_files", F.lit(str(sample) if sample else "all"))


def write(df: DataFrame, path: str, kind: str = "parquet", files: int | None = None, rows_per_file: int | None = None) -> None:
    """parquet, csv (with header), jsonl or txt (of one text column); what was there is replaced."""
    df = df.coalesce(files) if files else df
    writer = df.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind == "txt":
        writer.text(path)
    else:
        writer.parquet(path)


def write_object(df: DataFrame, path: str) -> None:
    """A result of one row as one JSON object in a file of that very name; more rows are an error. What was there is replaced."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("one row makes an object")
    _put(df.sparkSession, path, rows[0])


def _put(spark, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_result(spark, value, path: str) -> None:
    """By the kind of result: a DataFrame as csv files with a header, a dict as a JSON object, a text or several texts (one a line) as a text file."""
    if isinstance(value, DataFrame):
        write(value, path, "csv")
    elif isinstance(value, dict):
        _put(spark, path, json.dumps(value, ensure_ascii=False))
    else:
        _put(spark, path, value if isinstance(value, str) else "\n".join(map(str, value)) + "\n")


def compatible_names(df: DataFrame) -> DataFrame:
    """Columns as downstream notebooks know them: kebab case, and `count()` for n."""
    keep = {"serp_query_text_url", "serp_timestamp", "search_provider_name", "serp_url"}
    return df.toDF(*["count()" if c == "n" else c if c in keep else c.replace("_", "-") for c in df.columns])
