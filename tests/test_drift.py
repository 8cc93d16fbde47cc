import json

from querymill.operators import drift


def tables(spark, files):
    names = [(i, feed, seq) for i, feed, seq, _ in files]
    rows = [(i * 100 + k, i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, _, _, records in files for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "raw_id long, file_id long, payload string"), spark.createDataFrame(names, "file_id long, feed string, file_seq int")


def found(spark, files):
    return sorted(tuple(r) for r in drift.changes(*tables(spark, files)).collect())


def test_changes(spark):
    a = [{"serp_id": f"r{i}", "q": f"t{i}", "rank": i, "page": i, "old": i, "when": 100 + i} for i in range(5)]
    b = [{"serp_id": f"r{i}", "Query": f"t{i}", "rank": str(i), "page": float(i), "new": "x", "time": str(100 + i)} for i in range(3, 8)]
    assert found(spark, [(7, "f", 1, a), (3, "f", 5, b)]) == [
        (3, "added", "new", ""), (3, "removed", "old", ""), (3, "renamed", "Query", "q"), (3, "renamed", "time", "when"), (3, "retyped", "page", ""), (3, "retyped", "rank", ""), (3, "retyped", "time", "")]


def test_another_unit_is_no_change_and_strays_do_not_retype(spark):
    a = [{"serp_id": f"r{i}", "t": 1000 + i, "n": i} for i in range(4)]
    b = [{"serp_id": f"r{i}", "t": (1000 + i) * 1000, "n": i if i > 3 else str(i)} for i in range(3, 8)]
    assert found(spark, [(1, "f", 1, a), (2, "f", 2, b)]) == []


def test_values_must_match_in_every_shared_record(spark):
    a = [{"serp_id": f"r{i}", "a": i % 2 == 0} for i in range(4)]
    b = [{"serp_id": f"r{i}", "b": True} for i in range(4)]
    assert found(spark, [(1, "f", 1, a), (2, "f", 2, b)]) == [(2, "added", "b", ""), (2, "removed", "a", "")]


def test_names_are_case_sensitive_and_rivals_are_settled(spark):
    a = [{"serp_id": f"r{i}", "page": i, "p": i} for i in range(4)]
    b = [{"serp_id": f"r{i}", "PAGE": i, "Q": i} for i in range(4)]
    assert found(spark, [(1, "f", 1, a), (2, "f", 2, b)]) == [(2, "renamed", "PAGE", "p"), (2, "renamed", "Q", "page")]


def test_many_fields_of_equal_values_are_all_renamed(spark):
    a = [{"serp_id": f"r{i}", **{f"a{k}": True for k in range(5)}} for i in range(3)]
    b = [{"serp_id": f"r{i}", **{f"b{k}": True for k in range(5)}} for i in range(3)]
    assert found(spark, [(1, "f", 1, a), (2, "f", 2, b)]) == [(2, "renamed", f"b{k}", f"a{k}") for k in range(5)]


def test_bad_payloads_nulls_and_empty_files(spark):
    a = [{"serp_id": "r1", "x": None, "y": 1}, None, "no json", "[1]", ""]
    assert found(spark, [(1, "f", 1, a), (2, "f", 2, []), (3, "g", 1, a)]) == [(2, "removed", "serp_id", ""), (2, "removed", "x", ""), (2, "removed", "y", "")]
    assert found(spark, [(1, "f", 1, [])]) == []
    records, files = tables(spark, [(1, "f", 1, a)])
    assert drift.changes(records.limit(0), files.limit(0)).count() == 0


def test_null_only_fields_are_not_retyped(spark):
    assert found(spark, [(1, "f", 1, [{"serp_id": "a", "x": None}]), (2, "f", 2, [{"serp_id": "a", "x": 3}])]) == []


def test_lifespans(spark):
    on, off = [{"serp_id": "a", "x": 1}], [{"serp_id": "a"}]
    records, files = tables(spark, [(1, "f", 1, on), (2, "f", 2, on), (3, "f", 3, off), (4, "f", 4, on)])
    columns = drift.catalogue(drift.explode_fields(records, "file_id", "serp_id", "payload"), files)
    rows = sorted((r.first_rank, r.last_rank, r.ended) for r in drift.lifespans(columns).where("field = 'x'").collect())
    assert rows == [(1, 2, True), (4, 4, False)]


def test_standard_records(spark):
    rows = [{"serp_id": "a", "queryText": ["red", "car"], "QueryTime": "2013-08-02 15:17:11", "SearchProvider": {"name": "p"}, "resultPage": "7", "is_cached": 1, "odd": 5},
            {"serp_id": "b", "q_text": "x", "ts": 1370097475000, "provider": ["p"], "page": 3.0, "cached": "no", "took": "0.5"},
            {"serp_id": "c", "serpTimestamp": {"sec": 1211986597, "zone": "UTC"}, "event_time": None, "page": "seven"}, "broken", None]
    records, _ = tables(spark, [(1, "f", 1, rows)])
    got = {r.raw_id: r for r in drift.standard_records(records).collect()}
    a, b, c = got[100], got[101], got[102]
    assert (a.serp_query_text_url, a.serp_timestamp, a.search_provider_name, a.serp_page, a.from_cache, a.unknown_fields) == ("red car", 1375456631, "p", 7, True, "odd")
    assert (b.serp_query_text_url, b.serp_timestamp, b.search_provider_name, b.serp_page, b.from_cache, b.elapsed) == ("x", 1370097475, "p", 3, False, 0.5)
    assert (c.serp_timestamp, c.serp_page) == (1211986597, None)
    assert len(got) == 5 and got[103].serp_id is None


def test_footers(spark, tmp_path):
    shapes = [("1 as a, 'x' as b", 1), ("1L as a, 'x' as b, 2.5D as c", 2), ("1L as a, 2.5D as c", 3)]
    listed = []
    for what, seq in shapes:
        path = str(tmp_path / f"{seq}")
        spark.sql(f"select {what}").coalesce(1).write.parquet(path)
        listed.append((seq * 10, "f", seq, str(next(p for p in (tmp_path / f"{seq}").iterdir() if p.suffix == ".parquet"))))
    files = spark.createDataFrame([*listed, (99, "g", 1, None)], "file_id long, feed string, file_seq int, path string")
    assert sorted(tuple(r) for r in drift.footer_fields(files).where("file_id = 20").collect()) == [(20, "a", "int64"), (20, "b", "string"), (20, "c", "double")]
    assert sorted(tuple(r) for r in drift.footer_changes(files).collect()) == [(20, "added", "c", ""), (20, "retyped", "a", ""), (30, "removed", "b", "")]
    assert drift.footer_fields(files.limit(0)).count() == 0


def test_one_record_with_two_values_is_no_rename(spark):
    a = [{"serp_id": "r", "a": 1}, {"serp_id": "r", "a": 2}]
    b = [{"serp_id": "r", "b": 1}]
    assert found(spark, [(1, "f", 1, a), (2, "f", 2, b)]) == [(2, "added", "b", ""), (2, "removed", "a", "")]
