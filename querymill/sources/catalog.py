"""Where the stages of a log live: {root}/{name of the stage}, as writers.output_name gives it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from querymill.sources.readers import files, pick
from querymill.sources.writers import output_name

# fixed values: analyses that read the lengths, not the log
FROM_LENGTHS = {"character-count-frequencies", "word-count-frequencies", "entity-count-frequencies", "filter-urls", "aql-anomaly"}


def stage_path(root: str, dataset: str, analysis: str, level: str | None = None, english: bool = False) -> str:
    """The folder an analysis reads: the lengths for frequencies, the extraction for words and named entities, else the log itself."""
    if analysis in FROM_LENGTHS:
        return f"{root}/{output_name([dataset], 'get-lengths', level or 'queries')}"
    if level in ("words", "named-entities") and not analysis.startswith("extract-"):
        return f"{root}/{output_name([dataset], f'extract-{level}')}"
    return f"{root}/{dataset}{'-english' if english else ''}"


def load(spark: SparkSession, root: str, dataset: str, analysis: str, level: str | None = None, english: bool = False, sample: int | None = None, half: str | None = None, read_dir: list[str] | None = None) -> DataFrame:
    """The input of an analysis. A sample or a half takes whole files; read_dir names other folders instead."""
    folders = read_dir or [stage_path(root, dataset, analysis, level, english)]
    if sample is None and half is None:
        return spark.read.parquet(*folders)
    paths = [p for f in folders for p in files(spark, f, ".parquet")]
    return spark.read.parquet(*pick(paths, sample=sample, half=half))


def resolve(spark: SparkSession, root: str, dataset: str, analysis: str) -> str:
    """The folder of a finished analysis."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    found = []
    for name in names:
        m = re.fullmatch(re.escape(f"{dataset}-{analysis}-") + r"(all|special|\d+)(-english)?", name)
        if m:
            found.append((m[2] is None, {"all": float("inf"), "special": -1.0}.get(m[1]) or float(m[1]), name))
    if not found:
        raise FileNotFoundError(f"no result of {analysis} for {dataset} under {root}")
    return f"{root}/{max(found)[2]}"


def result(spark: SparkSession, root: str, dataset: str, analysis: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """A finished analysis, with the columns and rows that are asked for: the one over all files, else the one over the largest sample, in English only if there is
    no other."""
    df = spark.read.parquet(resolve(spark, root, dataset, analysis))
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df
