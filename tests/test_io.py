from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seclog import schemas
from seclog.operators import features, metrics, network, star
from seclog.plans import ingest, sql, sweep
from seclog.session import materialize, shared_dir
from seclog.sinks import batchlog, writers
from seclog.sources import files, topics
from seclog.streaming import monitor, queries

T0 = datetime(2025, 1, 1)


def conn_message(i, second, port=22, host="h1"):
    return (f'{{"ts":{1735689600 + second}.5,"uid":"C{i}","id.orig_h":"10.0.0.{i % 3}","id.orig_p":{i},'
            f'"id.resp_h":"9.9.9.9","id.resp_p":{port},"proto":"tcp","hostname":"{host}","vm_id":"v"}}')


def put(spark, path, values, seconds=None, topic="zeek_conn"):
    """One more file of messages; files are read in the order they are written."""
    rows = [(v, topic, i % 2, T0 + timedelta(seconds=(seconds or [0] * len(values))[i]))
            for i, v in enumerate(values)]
    spark.createDataFrame(rows, topics.MESSAGE).coalesce(1).write.mode("append").parquet(path)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


# --- sources ---------------------------------------------------------------------

def test_follow_logs(spark, tmp_path):
    for name in ("syslog", "auth.log", "strange.txt"):
        (tmp_path / name).write_text(f"line of {name}\nsecond\n")
    rows = files.follow_logs(spark, str(tmp_path), "lubuntu", stream=False).collect()
    got = {(r.message, r.log_source, r.topic) for r in rows}
    assert ("line of auth.log", "auth", "lubuntu_auth") in got
    assert ("line of strange.txt", None, None) in got and len(rows) == 6
    stream = files.follow_logs(spark, str(tmp_path), "lubuntu", max_files_per_trigger=1)
    out = str(tmp_path / "out")
    run(queries.start_table(stream, f"{out}/t", f"{out}/c", every=None))
    assert {(r.message, r.log_source, r.topic) for r in spark.read.parquet(f"{out}/t").collect()} == got


def test_tailed(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "2025-01-01 10:00:00 ERROR disk full\nno match\n2025-01-01 10:00:00 error low\n9999-99-99 99:99:99 INFO x\n")
    rows = files.follow_parsed_log(spark, str(tmp_path), stream=False).collect()
    assert [(r.time, r.level, r.message) for r in rows] == [
        (datetime(2025, 1, 1, 10), "ERROR", "disk full"), (None, "INFO", "x")]


def test_tables_json_and_rows(spark, tmp_path):
    df = files.rows(spark, [(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    writers.append_table(df, str(tmp_path / "t"))
    read = files.read_table(spark, str(tmp_path / "t"), ["name"], F.col("n") > 5)
    assert [r.name for r in read.collect()] == ["b"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,5)" in plan and "id" not in plan[plan.index("ReadSchema"):]
    (tmp_path / "j" / "partition=0").mkdir(parents=True)
    (tmp_path / "j" / "partition=0" / "x.json").write_text('{"message":"m","k":1}\n')
    inferred = files.read_json_files(spark, str(tmp_path / "j")).first()
    assert (inferred.message, inferred.k, inferred.partition) == ("m", 1, 0)
    typed = files.read_json_files(spark, str(tmp_path / "j"), "k double")
    assert typed.first().k == 1.0


def test_kafka_options(spark):
    """The connector is not on the class path here: the request must get as far as that."""
    with pytest.raises(Exception, match="(?i)kafka"):
        topics.read_topic(spark, "zeek_conn", "host:9092", max_offsets_per_trigger=5)


def test_fan_in(spark, tmp_path):
    made = {"zeek_conn": [conn_message(1, 0), "broken {"],
            "zeek_capture_loss": ['{"ts":1.0,"percent_lost":7.5,"hostname":"h","vm_id":"v"}']}
    for topic, values in made.items():
        put(spark, str(tmp_path / topic), values, topic=topic)
    united = topics.read_all(
        lambda t: topics.read_topic_files(spark, str(tmp_path / t), stream=False), made)
    rows = {r.log_type: r for r in united.collect()}
    assert rows["zeek_conn"].uid == "C1" and rows["zeek_conn"].percent_lost is None
    assert rows["zeek_capture_loss"].loss_severity == "Medium" and len(rows) == 2


# --- sinks -------------------------------------------------------------------------

def test_batch_writer_is_repeatable(spark, tmp_path):
    path, write = str(tmp_path / "t"), writers.batch_writer(str(tmp_path / "t"), drop=["debug"])
    df = spark.range(5).select("id", F.lit("x").alias("debug"), F.lit(2025).alias("year"),
                               F.lit(1).alias("month"), F.lit(1).alias("day"))
    write(df, 0)
    write(df, 1)
    write(df, 1)
    write(df.limit(0), 2)
    read = writers.read_batches(spark, path)
    assert read.count() == 10 and "debug" not in read.columns


def test_retry():
    waits, calls = [], []

    def failing(times):
        def action():
            calls.append(1)
            if len(calls) <= times:
                raise OSError("no")
        return action

    writers.retrying(failing(2), sleep=waits.append)
    assert (len(calls), waits) == (3, [4, 4])
    calls.clear()
    with pytest.raises(OSError):
        writers.retrying(failing(9), attempts=5, sleep=waits.append)
    assert len(calls) == 5 and waits[2:] == [4, 4, 8, 10]


def test_create_and_drop_days(spark, tmp_path):
    writers.create_table(spark, "t_loss", "zeek_capture_loss", str(tmp_path / "loss"), replace=True)
    try:
        columns = {r.col_name: r.comment for r in spark.sql("DESCRIBE t_loss").collect()}
        assert columns["percent_lost"] == schemas.COLUMN_NOTES["percent_lost"]
        names = schemas.table_schema("zeek_capture_loss").fieldNames()
        row = {"year": 2025, "month": 1}
        for day in (1, 2, 3):
            values = [F.lit(dict(row, day=day).get(n)) for n in names]
            kinds = schemas.table_schema("zeek_capture_loss")
            df = spark.range(2).select(*[v.cast(kinds[n].dataType).alias(n) for v, n in zip(values, names)])
            order = [c for c in spark.table("t_loss").columns]
            df.select(*order).write.insertInto("t_loss")
        assert spark.table("t_loss").count() == 6
        assert writers.drop_days_before(spark, "t_loss", (2025, 1, 3)) == 2
        assert [r.day for r in spark.table("t_loss").select("day").distinct().collect()] == [3]
    finally:
        spark.sql("DROP TABLE IF EXISTS t_loss")


def test_csv_and_messages(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b'), (2, None)], "i int, s string")
    writers.write_csv(df, str(tmp_path / "csv"))
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').count() == 2
    writers.write_messages(topics.as_messages(df, "t"), str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect())[1] == '{"i":2}'
    with pytest.raises(Exception, match="(?i)kafka"):
        writers.send_messages(topics.as_messages(df, "t"), "host:9092", "alerts")


# --- streams ----------------------------------------------------------------------

def test_batch_equals_stream(spark, tmp_path):
    """Every topic's table, read whole and read file by file."""
    from checks.frames import VIEW_OF_TOPIC, topic_messages

    for topic in VIEW_OF_TOPIC:
        source = str(tmp_path / topic)
        sent = topic_messages(spark, "/root/testdata/sf0.001", topic)
        for part in range(3):
            sent.where(F.pmod(F.hash("value"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(source)
        read = topics.read_topic_files(spark, source, max_files_per_trigger=1)
        out = str(tmp_path / f"{topic}_out")
        run(queries.start_table(ingest.network_table(read, topic), f"{out}/t", f"{out}/c", every=None))
        batch = ingest.network_table(topics.read_topic_files(spark, source, stream=False), topic)
        stream = spark.read.parquet(f"{out}/t").select(*batch.columns)
        assert stream.count() == 1000 and batch.exceptAll(stream).isEmpty()


@pytest.mark.parametrize("few", [0, 100])
def test_placed_stream_and_rejects(spark, tmp_path, few):
    from seclog.operators.geo import geo_enrich

    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    put(spark, source, [conn_message(1, 1), "broken {", conn_message(2, 2)])
    put(spark, source, [conn_message(3, 3)])
    ranges = spark.createDataFrame(
        [(167772161, 167772161, 1.0, 2.0, "one")],
        "ip_lo long, ip_hi long, latitude double, longitude double, city string")

    def table(batch):
        good = network.good_rows(network.parse_messages(batch, "zeek_conn"))
        return geo_enrich(good.select("uid", "id_orig_h"), ranges, {"orig": "id_orig_h"},
                          max_range_bytes=few)

    write = ingest.placing_writer(
        f"{out}/t", table, f"{out}/r", lambda b: ingest.rejected_messages(b, "zeek_conn"))
    read = topics.read_topic_files(spark, source, max_files_per_trigger=1)
    run(queries.start_batches(read, write, f"{out}/c", every=None))
    got = {r.uid: r.orig_city for r in writers.read_batches(spark, f"{out}/t").collect()}
    assert got == {"C1": "one", "C2": None, "C3": None}
    assert [r[0] for r in writers.read_batches(spark, f"{out}/r").collect()] == ["broken {"]


def test_inline_placement_runs_on_a_stream(spark, tmp_path):
    from seclog.operators.geo import place_inline, prepare

    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    put(spark, source, [conn_message(1, 1), conn_message(2, 2)])
    ranges = spark.createDataFrame(
        [(167772161, 167772161, 1.0, 2.0, "one")],
        "ip_lo long, ip_hi long, latitude double, longitude double, city string")
    parsed = network.parse_messages(topics.read_topic_files(spark, source), "zeek_conn")
    placed = place_inline(parsed.select("uid", "id_orig_h"), prepare(ranges), "orig", "id_orig_h")
    run(queries.start_table(placed, f"{out}/t", f"{out}/c", every=None))
    assert {r.uid: r.orig_city for r in spark.read.parquet(f"{out}/t").collect()} == {"C1": "one", "C2": None}


def test_stream_with_a_large_range_table(spark, tmp_path):
    """400,000 ranges, more than are broadcast: the same places as in batch."""
    from seclog.operators.geo import geo_enrich, prepare
    from seclog.operators.lookup import MAX_BROADCAST_BYTES

    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    put(spark, source, [conn_message(1, 1), conn_message(2, 2)])
    put(spark, source, [conn_message(3, 300)])
    ranges = spark.range(400_000).selectExpr(
        "167772160 + id * 256 + 2 AS ip_lo", "167772160 + id * 256 + 255 AS ip_hi", "CAST(id AS double) AS latitude",
        "0D AS longitude", "concat('city ', id) AS city")
    table = prepare(ranges.union(ranges.where("id = 0").selectExpr("ip_lo - 2", "ip_hi - 256 + 2", "7D", "7D", "'edge'")))
    assert table.bytes > MAX_BROADCAST_BYTES
    parsed = network.parse_messages(topics.read_topic_files(spark, source, max_files_per_trigger=1), "zeek_conn")
    placed = geo_enrich(parsed.select("uid", "id_orig_h"), table, {"orig": "id_orig_h"})
    run(queries.start_table(placed, f"{out}/t", f"{out}/c", every=None))
    batch = network.parse_messages(topics.read_topic_files(spark, source, stream=False), "zeek_conn")
    want = geo_enrich(batch.select("uid", "id_orig_h"), table, {"orig": "id_orig_h"})
    found = {r.uid: (r.id_orig_h, r.orig_city) for r in spark.read.parquet(f"{out}/t").collect()}
    assert found == {r.uid: (r.id_orig_h, r.orig_city) for r in want.collect()}
    assert found["C1"][1] is None or found["C1"][1].startswith(("edge", "city"))


def test_system_log_stream(spark, tmp_path):
    from checks.frames import view
    from seclog.operators import syslog

    for source in ("syslog", "kern", "ufw", "auth"):
        lines = view(spark, "/root/testdata/sf0.001", f"v_{source}_raw").select("message", "hostname", "vm_id")
        messages = topics.as_messages(lines, source)
        path = str(tmp_path / source)
        messages.write.parquet(path)
        stream = ingest.system_log_table(topics.read_topic_files(spark, path), source)
        run(queries.start_table(stream, f"{path}_t", f"{path}_c", every=None))
        batch = syslog.parse_system_log(lines, source).drop("processed_at")
        got = spark.read.parquet(f"{path}_t").select(*batch.columns)
        assert batch.exceptAll(got).isEmpty() and got.count() == 1000


def test_metric_windows_close_once(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")

    def cpu(v):
        return f'{{"user":"{v}","hostname":"h","vm_id":"v"}}'

    put(spark, source, [cpu(1), '{"total":"10","used":"4","hostname":"h","vm_id":"v"}', cpu(2)], [1, 2, 13])
    put(spark, source, [cpu(3)], [45])
    put(spark, source, [cpu(3.5)], [46])
    put(spark, source, [cpu(4), cpu(5)], [0, 90])  # the first is too late by now

    def step():
        stream = queries.metrics_stream(topics.read_topic_files(spark, source, max_files_per_trigger=1))
        query = queries.start_table(stream, f"{out}/t", f"{out}/c", every=None)
        run(query)
        return query

    query = step()
    late = sum(monitor.progress_row(p)[5] for p in query.recentProgress)
    rows = spark.read.parquet(f"{out}/t").orderBy("timestamp").collect()
    assert [(r.timestamp.second, r.cpu_user, r.mem_used) for r in rows] == [
        (0, 1.0, 4.0), (10, 2.0, None), (40, 3.0, None)]
    assert late == 1
    put(spark, source, [cpu(6)], [200])
    step()  # goes on from the checkpoint
    rows = spark.read.parquet(f"{out}/t").orderBy("timestamp").collect()
    assert [r.cpu_user for r in rows] == [1.0, 2.0, 3.0, 5.0]


def test_dedupe_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    for _ in range(2):
        put(spark, source, [conn_message(i, i) for i in range(4)])
    parsed = network.parse_messages(topics.read_topic_files(spark, source, max_files_per_trigger=1), "zeek_conn")
    events = network.add_event_time(network.good_rows(parsed))
    run(queries.start_table(queries.once(events, ["uid"]).select("uid"), f"{out}/t", f"{out}/c", every=None))
    assert sorted(r.uid for r in spark.read.parquet(f"{out}/t").collect()) == ["C0", "C1", "C2", "C3"]


def test_star_streams_equal_batch(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    put(spark, source, [conn_message(i, i, host=f"h{i % 2}") for i in range(6)])
    put(spark, source, [conn_message(i, i, host=f"h{i % 2}") for i in range(3, 9)])

    def read(stream):
        messages = topics.read_topic_files(spark, source, stream=stream, max_files_per_trigger=1)
        return topics.read_all(lambda t: messages, ["zeek_conn"])

    queries.wait_for(spark, [queries.start_star(read(True), f"{out}/t", f"{out}/c", every=None)], all_of_them=True)
    events = network.add_event_time(read(False))
    batch = {"dim_time": star.dim_time(events), "dim_host": star.dim_host(events),
             "dim_network_entity": star.dim_network_entity(events), "fact_zeek_events": star.fact_events(events)}
    for name, expected in batch.items():
        got = batchlog.read_logged(spark, f"{out}/t/{name}")
        if name.startswith("dim"):
            got = queries.merge_star(name, got)
        got = got.select(*expected.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect())), name


def test_star_stream_keeps_its_state_on_disk(spark, tmp_path):
    """Whatever store the session names; and facts that the stream has told apart are not told apart again."""
    source, out = str(tmp_path / "in"), str(tmp_path / "star")
    line = '{"ts":1735689600.5,"uid":"C1","id.orig_h":"10.0.0.1","id.orig_p":1,"hostname":"h","vm_id":"v"}'
    spark.createDataFrame([(line, "zeek_conn", 0, T0)] * 3, topics.MESSAGE).write.parquet(source)
    kept, made = "spark.sql.streaming.stateStore.providerClass", []
    tables = queries.star_tables()

    def facts(events):
        made.append(tables["fact_zeek_events"](events))
        return made[-1]

    before = spark.conf.get(kept)
    in_memory = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(kept, in_memory)
    try:
        parsed = topics.read_all(lambda t: topics.read_topic_files(spark, source), ["zeek_conn"])
        started = queries.start_star(
            parsed, f"{out}/t", f"{out}/c", tables={"fact_zeek_events": facts}, every=None)
        started.awaitTermination()
        assert spark.conf.get(kept) == in_memory
    finally:
        spark.conf.set(kept, before)
    assert "RocksDBStateStoreProvider" in Path(f"{out}/c/offsets/0").read_text()
    assert batchlog.read_logged(spark, f"{out}/t/fact_zeek_events").count() == 1
    top = made[0]._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" not in top and "Distinct" not in top


def test_feature_stream_is_exact(spark, tmp_path):
    source = str(tmp_path / "dns")
    rows = [(T0 + timedelta(seconds=s), "h", q, "v") for s, q in
            [(1, "aa"), (2, "aa"), (3, "ab"), (301, "abcd"), (4000, "late")]]
    kind = "timestamp timestamp, id_orig_h string, query string, vm_id string"
    spark.createDataFrame(rows, kind).write.parquet(source)
    dns = spark.readStream.schema(kind).parquet(source).withWatermark("timestamp", "1 minute")
    run(queries.start_table(features.dns_features(dns), f"{source}_t", f"{source}_c", every=None))
    got = {r.ts_window_start.minute: (r.unique_queries, r.query_name_entropy)
           for r in spark.read.parquet(f"{source}_t").collect()}
    assert got == {0: (2, pytest.approx(1 / 3)), 5: (1, pytest.approx(2.0))}


def test_archive_console_and_progress(spark, tmp_path, capfd):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    put(spark, source, ["a", "b", "c"], topic="kali_auth")
    put(spark, source, ["x"], topic="unknown_topic")
    log = monitor.ProgressLog(spark, f"{out}/progress")
    spark.streams.addListener(log)
    try:
        read = topics.read_topic_files(spark, source, max_files_per_trigger=1)
        run(queries.start_archive(read, f"{out}/a", f"{out}/ac", every=None))
        run(queries.start_console(read.select("value"), f"{out}/cc", every=None))
        for _ in range(50):
            if len(log.pending) or (tmp_path / "o" / "progress").exists():
                break
            __import__("time").sleep(0.2)
    finally:
        __import__("time").sleep(1)
        spark.streams.removeListener(log)
    log.flush()
    kept = spark.read.text(f"{out}/a")
    assert sorted((r.value, r.topic, r.partition) for r in kept.collect()) == [
        ("a", "kali_auth", 0), ("b", "kali_auth", 1), ("c", "kali_auth", 0)]
    rows = log.read().collect()
    assert sum(r.input_rows for r in rows) >= 4 and "Offset" in rows[0].sources or rows[0].sources


# --- sweep ----------------------------------------------------------------------------

def strain(spark, minutes):
    rows = [(T0 + timedelta(minutes=m), 99.0, 1.0, 10.0) for m in minutes]
    return {"system_metrics": spark.createDataFrame(
        rows, "timestamp timestamp, cpu_user double, mem_used double, mem_total double")}


def test_sweeps_neither_skip_nor_repeat(spark, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    tables = strain(spark, range(0, 600, 60))
    first = T0 + timedelta(hours=5, seconds=30)
    assert sweep.incremental_sweep(spark, tables, state, out, first) == (
        T0 - timedelta(hours=20), T0 + timedelta(hours=4))
    assert sweep.incremental_sweep(spark, tables, state, out, first) is None
    sweep.incremental_sweep(spark, tables, state, out, T0 + timedelta(hours=20))
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 10 and len({r.description for r in rows}) == 10
    assert sweep.last_sweep(spark, state) == T0 + timedelta(hours=19)


def test_failed_sweep_is_run_again(spark, tmp_path, monkeypatch):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    tables = strain(spark, [0, 60])
    as_of = T0 + timedelta(hours=5)
    monkeypatch.setattr(sweep, "incident_rows", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sweep.incremental_sweep(spark, tables, state, out, as_of)
    monkeypatch.undo()
    assert sweep.last_sweep(spark, state) == T0 - timedelta(hours=20)  # where the first begins
    sweep.incremental_sweep(spark, tables, state, out, as_of)
    assert spark.read.parquet(out).count() == 2


def test_sweep_after_a_failed_commit_repeats_nothing(spark, tmp_path, monkeypatch):
    """Written, end not remembered, run again an hour later."""
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    tables = strain(spark, range(0, 600, 60))
    real, calls = sweep.remember, []

    def fails_on_the_end(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        real(*args)

    monkeypatch.setattr(sweep, "remember", fails_on_the_end)
    with pytest.raises(OSError):
        sweep.incremental_sweep(spark, tables, state, out, T0 + timedelta(hours=5))
    monkeypatch.undo()
    assert spark.read.parquet(out).count() > 0
    sweep.incremental_sweep(spark, tables, state, out, T0 + timedelta(hours=20))
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 10 and len({r.description for r in rows}) == 10


# --- SQL and session ------------------------------------------------------------------

def test_sql_surface(spark):
    sql.register({"numbers": spark.range(5)})
    outcomes = sql.run_sql(spark, "SELECT ';' AS s, \"a;b\" AS d; SELEC 1;; SELECT nope FROM numbers;"
                                  " SELECT sum(id) AS n FROM numbers -- end")
    assert [o.error is None for o in outcomes] == [True, False, False, True]
    assert outcomes[0].result.first().s == ";" and outcomes[3].result.first().n == 10
    assert outcomes[1].error.startswith("Error executing query 'SELEC 1'")
    assert sql.split_script("a 'it''s; x' ; b `c;d`;\n;") == ["a 'it''s; x'", "b `c;d`"]
    assert sql.split_script("SELECT 'open; quote") == ["SELECT 'open", "quote"]
    assert sql.split_script("SELECT 1 -- a; b\n; /* c; d */ SELECT 2; -- all;\n") == [
        "SELECT 1 -- a; b", "/* c; d */ SELECT 2"]
    (bad,) = sql.run_sql(spark, "SELECT 1 / 0 AS x")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    rows, reason, more = sql.rows_of(bad)
    assert rows == [] and not more and "Error executing query 'SELECT 1 / 0 AS x'" in reason
    assert sql.rows_of(outcomes[3])[0][0].n == 10 and sql.rows_of(outcomes[1])[:2] == ([], outcomes[1].error)
    (many,) = sql.run_sql(spark, "SELECT * FROM range(5000)")
    assert len(sql.rows_of(many).rows) == 5000 and not sql.rows_of(many).more
    assert (len(sql.rows_of(many, 10).rows), sql.rows_of(many, 10).more, sql.rows_of(many, 5000).more) == (10, True, False)
    firsts = sql.first_row_each({"n": spark.range(5)}, "id")
    assert firsts["n"].collect()[0].id == 0


def test_catalog(spark):
    rows = schemas.describe_catalog(spark).collect()
    assert {r.table_name for r in rows} == set(schemas.table_names())
    assert [r.column_name for r in rows if r.table_name == "dns_baseline"] == [
        "id_orig_h", "metric", "mean", "std_dev", "last_updated"]
    assert next(r.comment for r in rows if r.column_name == "query") == "name asked for"


def test_materialize_cuts_lineage(spark):
    assert shared_dir(spark)
    df = materialize(spark.range(10).repartition(3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and df.count() == 10


def test_as_messages_round_trip(spark):
    df = spark.createDataFrame([("a", 1.5)], "`id.orig_h` string, ts double")
    sent = topics.as_messages(df, "zeek_conn")
    back = network.good_rows(network.parse_messages(sent, "zeek_conn")).first()
    assert (back.id_orig_h, back.ts) == ("a", 1.5)
    assert metrics.KINDS.keys() == {"user", "total", "device"}


def test_package_stays_on_spark():
    """No row functions, nothing collected whole, no machine-local checkpoints."""
    from pathlib import Path

    import seclog

    root = Path(seclog.__file__).parent
    text = "\n".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts)
    for word in ("udf(", "toPandas", "localCheckpoint", ".rdd", "crossJoin", "toLocalIterator"):
        assert word not in text, word
