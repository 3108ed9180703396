"""FeedFrame operators and views of the profile."""

import time

import pytest

from siftline.functions.inference import infer_type, is_candidate_key
from siftline.operators import health
from siftline.operators.analytics import page_after
from siftline.operators.feed import FeedFrame
from siftline.sources.catalog import Catalog
from siftline.streaming.ingest import ProgressListener, Tracker, ingest, ingest_available, stream_fields


@pytest.fixture(scope="module")
def feed(spark):
    return FeedFrame.from_table(spark.createDataFrame([("1", "Cook", "Rome", None), ("2", "Cook", " ", "\t"), ("2", "Clerk", None, " "), ("3", "a", " Rome", " ")], "id string, title string, city string, none string"))


def test_profile(feed):
    p = {r["column_name"]: r for r in feed.profile().collect()}
    assert (p["city"]["empty_count"], p["city"]["valid_count"], p["city"]["unique_count"]) == (2, 2, 3)
    assert p["none"]["valid_count"] == 1 and p["none"]["non_null_count"] == 3
    assert p["id"]["inferred_type"] == "Identifier" and not p["id"]["is_candidate_key"]
    assert p["title"]["sample_values"] == ["Clerk", "Cook", "a"] and p["city"]["avg_length"] == round(8 / 3, 1)
    assert [r["column_name"] for r in feed.profile().collect()][:2] == ["id", "title"]


def test_counts(feed):
    assert [tuple(r) for r in feed.duplicates("id").collect()] == [("2", 2)]
    assert [tuple(r) for r in feed.distribution("city").collect()] == [("[EMPTY]", 1, 25.0), (" Rome", 1, 25.0), ("Rome", 1, 25.0), ("[NULL]", 1, 25.0)]
    assert {tuple(r) for r in feed.distribution("none").collect()} == {("[NULL]", 1, 25.0), ("[EMPTY]", 1, 25.0), ("[EMPTY]", 2, 50.0)}
    assert [tuple(r) for r in feed.pairs("title", "city").collect()][0][2] == 1
    t = feed.cross_tab("title", "city")
    assert t.columns == ["primary_value", "Rome", "[Empty]", "total"] and [tuple(r) for r in t.collect()] == [("Cook", 1, 1, 2), ("Clerk", 0, 1, 1), ("a", 1, 0, 1)]
    assert feed.overview(2.0).first()["records_per_sec"] == 2.0


def test_cross_tab_other(spark):
    f = FeedFrame.from_table(spark.createDataFrame([("p", f"v{i:02}") for i in range(25)] + [("p", "[Empty]"), ("q", None)], "a string, b string"))
    rows = {r["primary_value"]: r.asDict() for r in f.cross_tab("a", "b").collect()}
    assert rows["p"]["[Empty]"] == 0 and rows["q"]["[Empty]"] == 1 and rows["p"]["[Other]"] == 26 - 19 and rows["p"]["total"] == 26


def test_pages(feed):
    p = feed.page(0, 3, "city")
    assert (p.page, p.total_records, p.total_pages) == (1, 4, 2) and [r["city"] for r in p.rows.collect()] == [" ", " Rome", "Rome"]
    assert feed.page(9, 3).rows.count() == 0 and feed.page(1, 0).total_pages == 1
    assert [r["city"] for r in feed.page(1, 9, "city", True).rows.collect()][-1] is None


def test_inference():
    cases = {("x", ()): "Empty", ("my_link", ("a",)): "URL", ("c", ("a@b.c",)): "Email", ("c", ("<b>",)): "HTML", ("video", ("a",)): "Identifier", ("x", ("2026-01-02",)): "Date", ("updated", ("a",)): "Date", ("x", ("TRUE", "0")): "Boolean", ("x", ("$1,000", "2e3")): "Numeric", ("country", ("a",)): "Numeric", ("x", ("a",)): "Text"}
    for (name, samples), label in cases.items():
        assert infer_type(name, samples) == label, name
    assert is_candidate_key("job_id", "Identifier", 100, 99, 95) and not is_candidate_key("job_id", "Identifier", 100, 98, 98)
    assert is_candidate_key("x", "Text", 3, 3, 3) and not is_candidate_key("x", "URL", 3, 3, 3)


def test_health(feed, spark):
    p = feed.profile()
    t = health.tier_counts(p).first()
    assert (t["complete"], t["warning"], t["critical"]) == (2, 2, 0)
    assert [r["column_name"] for r in health.priorities(p).collect()] == ["none", "city"]
    assert health.filter_profile(p, "ITY", 0, 60).count() == 1 and health.filter_profile(p, in_tier="complete").count() == 2
    assert [r["unique_count"] for r in health.sort_profile(p, "uniques").collect()] == [3, 3, 3, 2]
    assert "title" in health.suggested_pivots(p) and "id" not in health.suggested_pivots(p)
    assert health.chart(feed.distribution("title"), 1).count() == 1
    assert health.company_column(["file_name", "brand_name"]) == "brand_name" and health.company_column(["first_name", "x"]) is None
    assert health.visible_columns({"a": 10.0, "b": 90.0}, ["a", "b", "c"], "missing:a") == ["a", "b", "c"]
    rows = p.collect()
    assert health.complete_query("ti", rows)[0] == "title:" and "title:Cook" in health.complete_query("x title:Co", rows)
    assert health.inspect(feed.df, "cook").count() == 2 and health.record_json(feed.df).first()[0].startswith("{")
    assert health.split_complete(p)[0].count() == 2 and health.uniqueness(p).count() == 4


def test_tracker():
    t = Tracker(100 << 20)
    time.sleep(0.06)
    t.add(50 << 20, 10)
    s = t.snapshot()
    assert s.percentage == 50.0 and s.records_per_sec > 0 and s.estimated_remaining_secs > 0
    t.cancel()
    assert t.snapshot().status == "cancelled"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('{"a":1}\n{"a":2}\n')
    spark.streams.addListener(listener := ProgressListener(Tracker()))
    for more, total in ((False, 2), (True, 3)):
        if more:
            (tmp_path / "in" / "b.ndjson").write_text('{"a":3}\n')
        q = ingest_available(stream_fields(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == total
    spark.streams.removeListener(listener)


def test_command_line(spark, tmp_path, capsys):
    from siftline.__main__ import main

    p = tmp_path / "a.ndjson"
    p.write_text('{"id":1,"city":"Rome"}\n{"id":2,"city":"Rome"}\n')
    main([str(p)])
    main([str(p), "--duplicates", "city", "--cross", "city", "id", "--page", "1", "--csv", str(tmp_path / "csv"), "--filter", "id:2"])
    out = capsys.readouterr().out
    assert "Rome" in out and "1 rows written" in out
    main([str(p), "--catalog", str(tmp_path / "catalog"), "--distribution", "city"])
    assert "ready, profiling: 100 %, 2 records" in capsys.readouterr().err and Catalog(str(tmp_path / "catalog"), spark).entries()[0].total_records == 2


def test_ingest_is_watched_kept_and_profiled(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text("".join(f'{{"id":{i},"city":"c{i % 7}"}}\n' for i in range(20_000)))
    catalog, told = Catalog(str(tmp_path / "catalog")), []
    done = ingest(spark, str(p), catalog=catalog, feed_id="f", tell=told.append)
    assert done.progress == told[-1] and done.progress.status == "ready" and done.progress.percentage == 100.0
    assert done.progress.records_ingested == 20_000 and done.progress.bytes_read == p.stat().st_size
    assert [t.status for t in told[:-1]] == ["ingesting"] * (len(told) - 1) and sorted(t.bytes_read for t in told) == [t.bytes_read for t in told]
    assert done.profile.count() == 2 and done.entry.total_records == 20_000 and catalog.load(spark, "f").df.count() == 20_000
    tracker = Tracker()
    tracker.cancel()
    stopped = ingest(spark, str(p), catalog=catalog, feed_id="g", tracker=tracker)
    assert stopped.progress.status == "cancelled" and stopped.profile is None and [e.id for e in catalog.entries()] == ["f"]
    told.clear()
    with pytest.raises(Exception, match="(?i)exist"):
        ingest(spark, str(tmp_path / "none.json"), tell=told.append)
    assert told[-1].status == "error" and told[-1].error_message


def test_cancelled_stream_keeps_what_came(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.ndjson").write_text(f'{{"a":{k}}}\n')
    tracker = Tracker(sum(f.stat().st_size for f in (tmp_path / "in").iterdir()))
    add = tracker.add

    def cancelling(n_bytes=0, n_records=0):
        add(n_bytes, n_records)
        if tracker.records == 2:
            tracker.cancel()

    tracker.add = cancelling
    fields = stream_fields(spark, str(tmp_path / "in"), files_at_once=1)
    q = ingest_available(fields, str(tmp_path / "out"), str(tmp_path / "ck"), tracker)
    q.awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out")).count()
    assert 2 <= kept < 4 and tracker.snapshot().status == "cancelled"
    # Begun again, it goes on behind what was committed, and no file counts twice.
    rest = ingest_available(fields, str(tmp_path / "out"), str(tmp_path / "ck"), more := Tracker())
    rest.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 and more.snapshot().status == "ingesting"
    for _ in range(100):  # reports come when they come
        if more.bytes == 8 * more.records:
            break
        time.sleep(0.1)
    assert more.bytes == 8 * more.records


def test_samples_and_long_values(spark):
    long = [("x" * 5000 + str(i % 3), "m" if i % 2 else None, f"{i:05}") for i in range(5000)]
    f = FeedFrame.from_table(spark.createDataFrame(long, "long string, few string, many string"))
    p = {r["column_name"]: r for r in f.profile().collect()}
    assert (p["long"]["unique_count"], p["long"]["max_length"], len(p["long"]["sample_values"])) == (3, 5001, 3)
    assert p["few"]["sample_values"] == ["m"] and p["few"]["unique_count"] == 1 and p["few"]["non_null_count"] == 2500
    assert p["many"]["sample_values"] == [f"{i:05}" for i in range(10)] and p["many"]["is_candidate_key"]


def test_profile_of_a_wide_table(spark):
    f = FeedFrame.from_table(spark.createDataFrame([[f"v{k % 7}" if i % 2 else None for k in range(250)] for i in range(6)], [f"c{k}" for k in range(250)]))
    p = f.profile().collect()
    assert [r["column_name"] for r in p] == f.columns
    assert all((r["valid_count"], r["unique_count"], r["sample_values"]) == (3, 1, [f"v{k % 7}"]) for k, r in enumerate(p))


def test_page_after(feed):
    everything = [tuple(r) for r in feed.page(1, 9, "city", True).rows.collect()]
    rows, after = [], None
    while got := [tuple(r) for r in page_after(feed.df, after, 1, "city", True).collect()]:
        rows += got
        after = got[-1]
    assert rows == everything


def test_completions(feed):
    rows = [{"column_name": "source_name", "original_name": "source.name", "sample_values": ["Big Co", "Ink"], "fill_rate": 1.0}, {"column_name": "is_remote", "original_name": "is_remote", "sample_values": [], "fill_rate": 1.0}, {"column_name": "pay", "original_name": "pay", "sample_values": ["7"], "fill_rate": 1.0}]
    assert health.complete_query("", rows) == ["source.name:", "is_remote:"] and health.complete_query("x (so", rows) == ["source.name:"]
    assert health.complete_query("source.name:", rows) == ['source.name:"Big Co"', "source.name:Ink", "missing:source.name", "populated:source.name"]
    assert health.complete_query("a is_remote:t", rows) == ["is_remote:true"] and health.complete_query("pay:>", rows) == ["pay:>50k", "pay:>80k", "pay:>100k"]
    assert health.complete_query("nope:", rows) == ["missing:nope", "populated:nope"] and health.complete_query("po", rows) == ["populated:"]
    assert health.company_columns(["Name", "x", "brand", "data_source"]) == ["Name", "brand", "data_source"]
    assert health.export_columns(["x", "Name"]) == ["Name"] and health.export_columns(["x", "y"]) == ["x"] and health.export_columns([]) == []
