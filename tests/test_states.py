"""Baselines merged from days, and sweeps of tables that get late rows, against one look at everything."""

import random
import statistics
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seclog.functions.timing import add_time_parts
from seclog.operators import features
from seclog.operators.detect import detect_all
from seclog.plans import baselines, sweep
from seclog.sinks.batchlog import compact_day, logged_writer
from seclog.sinks.writers import append_table

T0 = datetime(2025, 1, 6)
DNS = "timestamp timestamp, id_orig_h string, vm_id string, query string"


def dns_rows(n=1500):
    rng = random.Random(5)
    return [(T0 + timedelta(minutes=rng.randrange(10 * 1440)), rng.choice(["a", "b", "hot", "hot", "hot", None]),
             rng.choice(["v", "w"]), "q") for _ in range(n)] + [(T0 + timedelta(days=9), "once", "v", "q")]


def plain(df):
    return sorted(((r.id_orig_h, round(r["mean"], 12), r.std_dev and round(r.std_dev, 12)) for r in df.collect()), key=str)


@pytest.mark.parametrize("as_of", [T0 + timedelta(days=10), T0 + timedelta(days=9, hours=7, minutes=3)])
def test_states_of_days_equal_a_look_at_all_rows(spark, tmp_path, as_of):
    dns, path = spark.createDataFrame(dns_rows(), DNS), str(tmp_path / "states")
    append_table(add_time_parts(dns), str(tmp_path / "dns"))
    table = spark.read.parquet(str(tmp_path / "dns"))
    for day in range(11):
        baselines.store_day(table, path, (T0 + timedelta(days=day)).date())
    states = spark.read.parquet(path)
    got = baselines.baseline_from_days(states, as_of, 7, table)
    want = features.query_rate_baseline(features.dns_features(dns), F.lit(as_of).cast("timestamp"))
    assert plain(got) == plain(want) and got.columns == want.columns
    if as_of.hour:
        with pytest.raises(ValueError):
            baselines.baseline_from_days(states, as_of, 7)


def test_a_day_reads_its_folder_and_is_replaced_alone(spark, tmp_path):
    dns, path = spark.createDataFrame(dns_rows(), DNS), str(tmp_path / "states")
    append_table(add_time_parts(dns), str(tmp_path / "dns"))
    table = spark.read.parquet(str(tmp_path / "dns"))
    day = date(2025, 1, 8)
    plan = baselines.host_states(baselines.rows_of_day(table, day))._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert all(f"({c}#" in pruned for c in ("year", "month", "day")) and " = 2025)" in pruned, pruned
    for _ in range(2):
        baselines.store_day(table, path, day)
    baselines.store_day(table, path, date(2025, 1, 9))
    late = add_time_parts(spark.createDataFrame([(datetime(2025, 1, 8, 12), "new", "v", "q")], DNS))
    append_table(late, str(tmp_path / "dns"))
    baselines.store_day(spark.read.parquet(str(tmp_path / "dns")), path, day)
    states = spark.read.parquet(path)
    assert [r.id_orig_h for r in states.where(F.col("state_day") == F.lit(day)).where("id_orig_h = 'new'").collect()] == ["new"]
    assert states.groupBy("state_day", "id_orig_h").count().where("count > 1").count() == 0


def test_merging_is_exact_in_any_order(spark):
    counts = [1, 10**9, 3, 7, 10**9 - 1]
    states = spark.createDataFrame([("h", 1, n, Decimal(n * n)) for n in counts], "id_orig_h string, n_windows long, queries long, squares decimal(38,0)")
    row = baselines.baseline_of(states, F.current_timestamp()).first()
    assert row["mean"] == pytest.approx(statistics.mean(counts) / 300, rel=1e-14)
    assert row.std_dev == pytest.approx(statistics.stdev(counts) / 300, rel=1e-12)
    assert baselines.baseline_of(states.limit(1), F.current_timestamp()).first().std_dev is None


METRICS = "timestamp timestamp, cpu_user double, mem_used double, mem_total double"
CONN = ("timestamp timestamp, id_orig_h string, id_resp_h string, id_resp_p int, proto string, conn_state string, "
        "duration double, orig_pkts long, resp_bytes long, orig_bytes long, uid string")


def found_of(df, time="minute"):
    return sorted(((str(r[time])[:16], r.attack_type, r.description, r.src_ip, r.details) for r in df.collect()), key=str)


def metric_rows(spark, minutes, cpu=99.0):
    return spark.createDataFrame([(T0 + timedelta(minutes=m, seconds=5), cpu, 1.0, 10.0) for m in minutes], METRICS)


def conn_rows(spark, minute, seconds):
    return spark.createDataFrame(
        [(T0 + timedelta(minutes=minute, seconds=s), "1.1.1.1", "2.2.2.2", 443, "tcp", "SF", 0.1, 600, 5, 5, f"u{minute}{s}")
         for s in seconds], CONN)


def test_late_rows_change_what_their_minute_gave(spark, tmp_path, monkeypatch):
    """Rows late by hours, a group that only late rows make large enough, compaction between, and a failed sweep."""
    paths = {"system_metrics": str(tmp_path / "m"), "zeek_conn": str(tmp_path / "c")}
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    write = {n: logged_writer(p) for n, p in paths.items()}
    go = lambda hour: sweep.sweep_logged(spark, paths, state, out, T0 + timedelta(hours=hour))
    day = lambda df: add_time_parts(df)
    write["system_metrics"](day(metric_rows(spark, [10, 70])), 0)
    write["zeek_conn"](day(conn_rows(spark, 20, [1])), 0)  # 600 packets in its minute: no incident
    assert go(3) == (T0 - timedelta(hours=22), T0 + timedelta(hours=2))
    first = found_of(sweep.read_incidents(spark, state, out))
    assert [r[1] for r in first].count("System_Strain") == 2 and "TCP_DoS" not in {r[1] for r in first}
    assert go(3) is None

    write["system_metrics"](day(metric_rows(spark, [10, 11, 130], 95.0)), 1)  # two late ones
    write["zeek_conn"](day(conn_rows(spark, 20, [2])), 1)  # 1,200 packets now
    compact_day(spark, paths["system_metrics"], (2025, 1, 6))
    real = sweep.remember
    monkeypatch.setattr(sweep, "remember", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        go(5)
    monkeypatch.setattr(sweep, "remember", real)
    assert found_of(sweep.read_incidents(spark, state, out)) == first  # nothing of it counts
    assert go(6)
    tables = {"system_metrics": metric_rows(spark, [10, 70]).union(metric_rows(spark, [10, 11, 130], 95.0)),
              "zeek_conn": conn_rows(spark, 20, [1, 2])}
    want = found_of(detect_all(tables).withColumn("minute", F.date_trunc("minute", "event_time")))
    assert found_of(sweep.read_incidents(spark, state, out)) == want
    assert "TCP_DoS" in {r[1] for r in want}
    assert go(7) and found_of(sweep.read_incidents(spark, state, out)) == want


def test_a_sweep_reads_from_the_oldest_late_minute_on_and_once(spark, tmp_path, monkeypatch):
    """Days before that minute are not opened, however long the table is, and late rows need no second scan."""
    paths, state, out = {"system_metrics": str(tmp_path / "m")}, str(tmp_path / "state"), str(tmp_path / "out")
    write, scans, real = logged_writer(paths["system_metrics"]), [], sweep.detect_all
    go = lambda hour: sweep.sweep_logged(spark, paths, state, out, T0 + timedelta(hours=hour), timedelta(days=8))
    write(add_time_parts(metric_rows(spark, [-6 * 1440, -4 * 1440, 10])), 0)
    assert go(3)
    old = [f for d in (31, 2) for f in (tmp_path / "m").glob(f"commit=0-*/year=*/month=*/day={d}/*.parquet")]
    assert len(old) == 2
    for file in old:  # of no use to any reader
        file.write_bytes(b"no parquet")

    def counted(tables):
        scans.append(tables["system_metrics"]._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return real(tables)

    monkeypatch.setattr(sweep, "detect_all", counted)
    write(add_time_parts(metric_rows(spark, [11, 250], 95.0)), 1)
    assert go(6) and scans == [2]  # the table and the late minutes
    write(add_time_parts(metric_rows(spark, [430], 95.0)), 2)
    assert go(9) and scans == [2, 1]  # nothing is late
    found = sweep.read_incidents(spark, state, out).where(F.col("minute") >= F.lit(T0))
    assert [r[0] for r in found_of(found)] == [f"2025-01-06 {t}" for t in ("00:10", "00:11", "04:10", "07:10")]


def test_a_broken_state_is_an_error_and_not_a_first_sweep(spark, tmp_path):
    state = tmp_path / "state"
    assert sweep.last_sweep(spark, str(state)) is None
    state.mkdir()
    (state / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|file"):
        sweep.last_sweep(spark, str(state))
