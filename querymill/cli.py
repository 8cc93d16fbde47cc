"""Command line: python -m querymill.cli <command> …"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from querymill.operators import stats, vectors
from querymill.operators.sets import union_logs
from querymill.plans import analyses
from querymill.session import DEFAULTS, materialise
from querymill.sources import catalog, readers, writers

LEVELS = ["queries", "words", "named-entities"]


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("querymill")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="querymill")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("analyser", "presidio-analysis", "questions", "annual-deduplication", "get-deduplication-results"):
        c = commands.add_parser(name)
        c.add_argument("--dataset", nargs="+", required=True)
        c.add_argument("--analysis", default={"presidio-analysis": "extract-presidio-pii", "questions": "questions", "get-deduplication-results": "get-deduplication-results", "annual-deduplication": "count-regular"}.get(name), choices=sorted(analyses.REGISTRY))
        c.add_argument("--struc-level", choices=LEVELS)
        c.add_argument("--sample-files", type=int)
        c.add_argument("--only-english", action="store_true")
        c.add_argument("--which-half", choices=["first", "second"])
        c.add_argument("--read-dir", nargs="+")
        c.add_argument("--write-dir")
        c.add_argument("--root", default=".")
        c.add_argument("--format", default="parquet", choices=["parquet", "csv", "jsonl"])
        c.add_argument("--files", type=int)
        c.add_argument("--exact", action="store_true", help="exact distinct counts instead of sketches")
    c = commands.add_parser("embeddings-analysis")
    c.add_argument("--datasets", nargs=2, required=True)
    c.add_argument("--analysis", default="embeddings-distance", choices=["embeddings-distance", "projection"])
    c.add_argument("--root", default=".")
    c.add_argument("--num-input-files", type=int, default=12)
    c.add_argument("--shuffle-files", action="store_true", help="random files instead of the first ones")
    c.add_argument("--projections", type=int, default=16_000)
    c.add_argument("--dim", type=int, default=64)
    c.add_argument("--write-dir", help="for a projection: where its rows are written")
    c = commands.add_parser("distances", help="the distances of lengths between all pairs of logs, as one CSV table")
    c.add_argument("--datasets", nargs="+", required=True)
    c.add_argument("--root", default=".")
    c.add_argument("--write-dir", required=True)
    c = commands.add_parser("clustering")
    c.add_argument("dataset")
    c.add_argument("--similarity", type=float, default=0.75)
    c.add_argument("--smallest", type=int, default=25)
    c.add_argument("--dim", type=int, default=64)
    c.add_argument("--root", default=".")
    c.add_argument("--write-dir", required=True)
    c = commands.add_parser("standardise")
    c.add_argument("dataset", choices=["aql", "aol", "ms-marco", "orcas"])
    c.add_argument("--read-dir", required=True)
    c.add_argument("--write-dir", required=True)
    commands.add_parser("test-cli").add_argument("words", nargs="*")
    return p


def _some(paths: list[str], a: argparse.Namespace) -> list[str]:
    return readers.pick(paths, sample=a.num_input_files) if a.shuffle_files else readers.pick(paths, first=a.num_input_files)


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    if a.command == "test-cli":
        print(json.dumps(a.words))
        return
    spark = _session()
    if a.command == "standardise":
        kinds = {"aql": lambda: readers.read_raw_json(spark, a.read_dir), "orcas": lambda: readers.split_lines(spark, a.read_dir)[0].withColumnRenamed("text", "query")}
        raw = kinds[a.dataset]() if a.dataset in kinds else readers.read_any(spark, a.read_dir, "tsv")
        writers.write(readers.standardise(raw, a.dataset), a.write_dir, rows_per_file=500_000)
        return
    if a.command == "clustering":
        df = spark.read.parquet(catalog.stage_path(a.root, a.dataset, "get-embeddings")).withColumn("id", F.monotonically_increasing_id())
        df = materialise(df, "clustering")  # the numbers of its rows stay the same
        members = vectors.communities(df, "id", "embeddings", a.dim, a.similarity, a.smallest)
        writers.write(members.join(df, "id"), a.write_dir)  # with the query and the vector of each member
        return
    if a.command == "distances":
        lengths = [analyses.query_length_chars(catalog.load(spark, a.root, d, "query-length-chars")).select(F.lit(d).alias("dataset"), F.col("character_count").alias("x"), "n") for d in a.datasets]
        writers.write(stats.wasserstein(stats.paired(union_logs(*lengths), a.datasets)), a.write_dir, "csv", files=1)
        return
    if a.command == "embeddings-analysis":
        clouds = [spark.read.parquet(*_some(readers.files(spark, f"{a.root}/{writers.output_name([d], 'get-embeddings')}", ".parquet"), a)).select(F.lit(d).alias("dataset"), "embeddings") for d in a.datasets]
        both = clouds[0].unionByName(clouds[1])
        if a.analysis == "projection":
            if not a.write_dir:
                raise SystemExit("a projection needs --write-dir")
            numbered = materialise(both.withColumn("id", F.monotonically_increasing_id()), "projection")
            placed = vectors.project(numbered, "id", "embeddings", a.dim)
            writers.write(placed.join(numbered.select("id", "dataset"), "id"), a.write_dir)
        else:
            print(vectors.sliced_wasserstein(both, "dataset", "embeddings", tuple(a.datasets), a.dim, a.projections).first()["distance"])
        return
    name = a.analysis
    logs = [catalog.load(spark, a.root, d, name, a.struc_level, a.only_english, a.sample_files, a.which_half, a.read_dir) for d in a.dataset]
    options: dict = {}
    if name.startswith("count-") or name == "get-deduplication-results":
        options["exact"] = a.exact
    if name in ("count-regular", "count-lowercase", "get-deduplication-results"):
        if len(logs) != 2:
            raise SystemExit("two datasets are compared")
        options["other"] = logs.pop()
    if name == "get-lengths":
        options["level"] = a.struc_level or "queries"
    out = writers.with_metadata(analyses.run(spark, name, logs, **options), name, a.dataset, a.sample_files)
    folder = a.write_dir or f"{a.root}/{writers.output_name(a.dataset, name, a.struc_level, a.which_half, a.sample_files, english=a.only_english)}"
    writers.write(out, folder, a.format, a.files)


if __name__ == "__main__":
    main()
