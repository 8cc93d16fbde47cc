import gzip
import json

import pytest
from pyspark.sql import functions as F

from querymill import cli
from querymill.plans import analyses
from querymill.schema import STANDARD
from querymill.sources import catalog, readers, writers
from querymill.streaming import counts


def test_line_cleaner(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("1\tred, car\n2 blue\nnothing\n3\ta\tb\n")
    good, bad = readers.split_lines(spark, str(tmp_path / "x.tsv"))
    assert sorted(map(tuple, good.collect())) == [("1", "red, car"), ("2", "blue")] and sorted(r.value for r in bad.collect()) == ["3\ta\tb", "nothing"]


def test_standardise_gzipped_tsv(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write("AnonID\tQuery\tQueryTime\tItemRank\tClickURL\n7\tcheese\t2006-03-01 11:30:43\t2\tx\n")
    df = readers.standardise(readers.read_any(spark, str(tmp_path), with_path=True).drop("path"), "aol")
    assert df.schema == STANDARD
    row = df.first()
    assert (row.serp_id, row.serp_query_text_url, row.serp_timestamp, row.serp_offset) == ("7", "cheese", 1141212643, 2)


def test_raw_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"serp_id": "1", "serp_timestamp": 5, "serp_results": [{"result_id": "r"}], "other": 1}) + "\n")
    assert readers.standardise(readers.read_raw_json(spark, str(tmp_path)), "aql").first().serp_timestamp == 5


def test_files_and_picks(spark, tmp_path):
    for n in range(6):
        (tmp_path / f"{n}.csv").write_text("a\n1\n")
    found = readers.files(spark, f"file://{tmp_path}", ".csv")
    assert len(found) == 6 and len(readers.pick(found, sample=3)) == 3 and readers.pick(found, sample=3) == readers.pick(found, sample=3)
    assert readers.pick(found, half="first") + readers.pick(found, half="second") == found
    with pytest.raises(FileNotFoundError):
        readers.files(spark, f"file://{tmp_path}", ".parquet")
    (tmp_path / "z.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.read_any(spark, f"file://{tmp_path}")


def test_trends_with_lines_before_the_data(spark, tmp_path):
    (tmp_path / "us-2010.csv").write_text("title\n\nred,100\nblue,<1\n")
    df = readers.read_skipping(spark, str(tmp_path), 2, 25).withColumn("year", F.regexp_extract(readers.key_from_path(), r"-(\d+)", 1)).withColumn("x", readers.trend_score())
    assert sorted((r.item, r.x, r.line, r.year) for r in df.collect()) == [("blue", 0.5, 1, "2010"), ("red", 100.0, 0, "2010")]


def test_writers(spark, tmp_path):
    assert writers.output_name(["aql", "aol"], "extract-words", "words", "first", 5, english=True) == "aql-aol-extract-words-words-first-5-english"
    df = writers.with_metadata(spark.createDataFrame([("a", 1)], "word string, n long"), "x", ["aol"])
    for kind in ("parquet", "csv", "jsonl"):
        writers.write(df, str(tmp_path / kind), kind, 1)
        writers.write(df, str(tmp_path / kind), kind, 1)  # replaces
    assert spark.read.json(str(tmp_path / "jsonl")).first().sample_files == "all"
    assert writers.compatible_names(spark.createDataFrame([(1, 2)], "character_count long, n long")).columns == ["character-count", "count()"]


def test_fill_nulls(spark):
    row = readers.fill_nulls(spark.createDataFrame([(None, None, None)], "a string, b long, c double")).first()
    assert tuple(row) == ("", 0, 0.0)


def test_registry_and_cli(spark, tmp_path):
    (tmp_path / "aol").mkdir()
    spark.createDataFrame([("site:x a", 1_100_000_000, "p")], "serp_query_text_url string, serp_timestamp long, search_provider_name string").write.mode("overwrite").parquet(str(tmp_path / "aol"))
    cli.main(["analyser", "--dataset", "aol", "--analysis", "extract-search-operators", "--root", str(tmp_path)])
    assert spark.read.parquet(str(tmp_path / "aol-extract-search-operators-all")).first().operator == "site:"
    with pytest.raises(KeyError):
        analyses.run(spark, "nothing", [spark.range(1)])
    assert len(analyses.REGISTRY) >= 37


def test_streaming_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 12:00:00", "a"), ("2024-02-20 00:00:00", "b"), (None, "c")]
    spark.createDataFrame(rows, "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    query = counts.run_available(counts.bucket_counts(stream, "ts", ["k"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2)]


def test_cli_distances_deduplication_and_projection(spark, tmp_path):
    root = str(tmp_path)
    schema = "serp_query_text_url string, serp_timestamp long, search_provider_name string"
    for name, texts in (("aol", ["a", "bb", "bb"]), ("aql", ["bb", "cccc"])):
        spark.createDataFrame([(t, 1_100_000_000, "p") for t in texts], schema).coalesce(1).write.parquet(f"{root}/{name}")
        spark.createDataFrame([([float(len(t)), 1.0],) for t in texts], "embeddings array<float>").coalesce(1).write.parquet(f"{root}/{name}-get-embeddings-all")
    cli.main(["distances", "--datasets", "aol", "aql", "--root", root, "--write-dir", f"{root}/d"])
    row = readers.read_any(spark, f"{root}/d", "csv").first()
    assert (row.ds1, row.ds2, float(row.distance)) == ("aol", "aql", pytest.approx((1 / 3) * 1 + 0.5 * 2))
    cli.main(["annual-deduplication", "--dataset", "aql", "aol", "--root", root, "--exact"])
    years = {r.year: r.both for r in spark.read.parquet(f"{root}/aql-aol-count-regular-all").collect()}
    assert years[2004] == 1 and years[2005] == 0
    cli.main(["embeddings-analysis", "--datasets", "aol", "aql", "--analysis", "projection", "--dim", "2", "--shuffle-files", "--root", root, "--write-dir", f"{root}/p"])
    assert spark.read.parquet(f"{root}/p").groupBy("dataset").count().count() == 2 and spark.read.parquet(f"{root}/p").count() == 5
    with pytest.raises(SystemExit):
        cli.main(["embeddings-analysis", "--datasets", "aol", "aql", "--analysis", "projection", "--dim", "2", "--root", root])


def test_results_by_kind_and_folders_by_scope(spark, tmp_path):
    root = str(tmp_path)
    writers.write_result(spark, {"a": 1, "ü": [2]}, f"{root}/r.json")
    writers.write_result(spark, ["x", "y"], f"{root}/r.txt")
    assert (tmp_path / "r.json").read_text() == '{"a": 1, "ü": [2]}' and (tmp_path / "r.txt").read_text() == "x\ny\n"
    with pytest.raises(ValueError):
        writers.write_object(spark.range(2), f"{root}/o.json")
    for name in ("aol-x-5", "aol-x-20", "aol-x-20-english"):
        (tmp_path / name).mkdir()
    assert catalog.resolve(spark, root, "aol", "x") == f"{root}/aol-x-20"
    (tmp_path / "aol-x-all").mkdir()
    assert catalog.resolve(spark, root, "aol", "x") == f"{root}/aol-x-all"
    with pytest.raises(FileNotFoundError):
        catalog.resolve(spark, root, "aol", "y")
    for kind in ("json", "jsonl"):
        (tmp_path / "mixed").mkdir(exist_ok=True)
        (tmp_path / "mixed" / f"r.{kind}").write_text('{"k": "' + kind + '"}\n')
    assert [r.k for r in readers.read_any(spark, f"{root}/mixed").collect()] == ["jsonl"]
    assert readers.rows_per_partition(spark.range(10, numPartitions=2)).agg({"n": "sum"}).first()[0] == 10


def test_models_run_in_place_of_rules(spark):
    df = spark.createDataFrame([("red car", 1, "p"), ("red car", 2, "p"), (None, 3, "p")], "serp_query_text_url string, serp_timestamp long, search_provider_name string")
    load = lambda: lambda texts: [[{"entity": t[:3], "entity_label": "X"}] for t in texts]
    assert [tuple(r) for r in analyses.run(spark, "extract-named-entities", [df], model=load).collect()] == [("red", "X", 2)]
    assert [r.entity_label for r in analyses.run(spark, "extract-presidio-pii", [df], model=load).collect()] == ["X", "X"]
    assert [tuple(r) for r in analyses.run(spark, "query-intent", [df], model=lambda: lambda texts: ["Y"] * len(texts)).collect()] == [("Y", 2)]
    assert analyses.run(spark, "get-embeddings", [df], share=1.0, model=lambda: lambda texts: [[1.0, 2.0]] * len(texts)).first().embeddings == [1.0, 2.0]
