"""What the star stream keeps on disk is that of a batch or two, whatever has gone through it; and no event is lost."""

from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import catalog
from checks.compare import check
from checks.oracles import ORACLES
from seclog.operators import network, star
from seclog.sinks import batchlog
from seclog.sources import topics
from seclog.streaming import queries

T0 = datetime(2025, 1, 1)


def shuffle_files(spark) -> set[str]:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = disk.getAllFiles()
    return {names.apply(i).getName() for i in range(names.size()) if names.apply(i).getName().startswith("shuffle_")}


def message(micros: int, port: int = 1) -> str:
    return f'{{"ts":1735689600.{micros:06d},"id.orig_h":"10.0.0.1","id.orig_p":{port},"hostname":"h","vm_id":"v"}}'


def test_star_stream_keeps_little(spark, tmp_path):
    """After four runs: one run's messages, two batches' state, no shuffle; tables get the dozen columns they need."""
    source, out, given = str(tmp_path / "in"), str(tmp_path / "star"), []
    tables = queries.star_tables()

    def facts(events):
        given.append(events.columns)
        return tables["fact_zeek_events"](events)

    before, runs, rows = shuffle_files(spark), 4, 200
    for day in range(runs):
        sent = [(f'{{"ts":{1735689600 + 86400 * day + i}.5,"uid":"C{day}-{i}","id.orig_h":"10.0.0.1","hostname":"h","vm_id":"v"}}',
                 "zeek_conn", 0, T0) for i in range(rows)]
        spark.createDataFrame(sent * 2, topics.MESSAGE).coalesce(2).write.mode("append").parquet(source)
        parsed = topics.read_all(lambda t: topics.read_topic_files(spark, source, consume=True), ["zeek_conn"])
        queries.start_star(
            parsed, f"{out}/t", f"{out}/c", tables={"fact_zeek_events": facts}, every=None).awaitTermination()
    assert not shuffle_files(spark) - before
    assert batchlog.read_logged(spark, f"{out}/t/fact_zeek_events").count() == runs * rows
    assert len(given) == runs and set(given[0]) == {*star._FACT_ROW, "__peer"}
    assert 1 <= len(list(Path(source).glob("*.parquet"))) <= 4
    assert not list(Path(f"{out}/c/state").rglob("*.changelog"))  # which the next run would work off from the first on


def test_events_a_microsecond_apart_are_two(spark, tmp_path):
    """Without a uid only their time tells these apart, and only microseconds of it."""
    source, out = str(tmp_path / "in"), str(tmp_path / "star")
    sent = [message(1), message(1), message(2), message(2, port=7)]
    spark.createDataFrame([(m, "zeek_conn", 0, T0) for m in sent], topics.MESSAGE).write.parquet(source)

    def read(stream):
        return topics.read_all(lambda t: topics.read_topic_files(spark, source, stream=stream), ["zeek_conn"])

    queries.start_star(read(True), f"{out}/t", f"{out}/c", every=None).awaitTermination()
    want = star.fact_events(network.add_event_time(read(False)))
    got = batchlog.read_logged(spark, f"{out}/t/fact_zeek_events").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_spans_take_each_row_once(spark):
    rows = spark.range(1000).select(F.timestamp_micros(F.pmod("id", F.lit(400)) * 1_000_000).alias("timestamp"))
    spans = catalog._spans(rows, 100)
    counts = [rows.where(span).count() for span in spans]
    assert len(spans) == 10 and sum(counts) == 1000 and max(counts) <= 150
    ends = [rows.where(span).agg(F.min("timestamp"), F.max("timestamp")).first() for span in spans]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    one = spark.range(5).select(F.timestamp_micros(F.lit(7)).alias("timestamp"))
    assert sum(one.where(span).count() for span in catalog._spans(one, 2)) == 5
    assert len(catalog._spans(one.limit(0), 2)) == 1


@pytest.fixture
def two_months(spark, sf_dir, tmp_path):
    """Events from the end of a month to the middle of the next, so that days of the month are not in order of time."""
    rows = [(i, datetime(2024, 1, 18) + timedelta(hours=9 * i, microseconds=i), i % 40, ("click", "error", "view")[i % 3], i / 7, "{}")
            for i in range(80)]
    kind = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con, str(tmp_path)


def test_star_query_over_two_months_in_more_batches(spark, two_months, monkeypatch):
    monkeypatch.setattr(catalog, "BATCH_MESSAGES", 200)  # 480 messages: three parts
    con, folder = two_months
    result = check(spark, con, "stream_star", catalog.QUERIES["stream_star"], ORACLES["stream_star"], folder)
    assert result.startswith("ok") and "TYPES" not in result, result
