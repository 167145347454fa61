"""One query per operator over the given tables."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.frames import (
    VIEW_OF_TOPIC, detection_tables, for_check, log_messages, topic_messages, view, view_stream,
)
from seclog import schemas
from seclog.functions import net, text
from seclog.functions.timing import add_time_parts
from seclog.operators import (
    alerts, assets, detect, features, geo, metrics, network, packets, records, star, syslog,
    tables,
)
from seclog.plans import baselines, ingest, sql, sweep, tunneling
from seclog.session import materialize, use_utc, work_dir
from seclog.sinks import batchlog, writers
from seclog.sources import files, tail, topics
from seclog.streaming import joins
from seclog.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-31 00:00:00"
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
SWEEPS = [datetime(2024, 1, 10), datetime(2024, 1, 20), datetime(2024, 1, 31, 1)]


def query(name: str, digits: int = 6):
    def add(make: Query) -> Query:
        def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return for_check(make(spark, sf_dir), digits)

        QUERIES[name] = checked
        return make

    return add


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# --- features and score -----------------------------------------------------

@query("dns_features")
def _(spark, sf):
    return features.dns_features(view(spark, sf, "v_dns"))


@query("notice_features")
def _(spark, sf):
    return features.notice_features(view(spark, sf, "v_notice"))


@query("dns_baseline", digits=9)
def _(spark, sf):
    rows = features.dns_features(view(spark, sf, "v_dns"))
    return features.query_rate_baseline(rows, _as_of(), "31 days")


@query("dns_baseline_week", digits=9)
def _(spark, sf):
    rows = features.dns_features(view(spark, sf, "v_dns"))
    return features.query_rate_baseline(rows, _as_of())


@query("dns_tunneling_score")
def tunneling_score(spark, sf):
    scored = tunneling.tunneling_scores(view(spark, sf, "v_dns"), view(spark, sf, "v_notice"))
    fired = F.regexp_replace("details", "=[0-9.E+-]+", "")
    return scored.withColumn("fired", fired).drop("details")


@query("stored_scores")
def _(spark, sf):
    """Features to their tables, then scored from there, from a start on."""
    base = work_dir(spark, "features")
    dns, notices = view(spark, sf, "v_dns"), view(spark, sf, "v_notice")
    for made, name in zip(tunneling.feature_frames(dns, notices), ("dns_features", "notice_features")):
        writers.append_table(made, f"{base}/{name}")
    stored = [files.read_table(spark, f"{base}/{n}") for n in ("dns_features", "notice_features")]
    return tunneling.score_stored(*stored, start="2024-01-10 00:00:00").drop("timestamp", "details")


@query("stored_baseline", digits=9)
def _(spark, sf):
    base = work_dir(spark, "baseline")
    rows = features.dns_features(view(spark, sf, "v_dns"))
    tunneling.store_baseline(rows, base, _as_of(), "31 days")
    return files.read_table(spark, f"{base}/dns_baseline")


@query("dns_baseline_states", digits=9)
def _(spark, sf):
    """Seven days as a merge of stored states; each state comes from one day's folder."""
    base = work_dir(spark, "states")
    writers.append_table(add_time_parts(view(spark, sf, "v_dns")), f"{base}/dns")
    table = files.read_table(spark, f"{base}/dns")
    for day in range(24, 32):
        baselines.store_day(table, f"{base}/states", date(2024, 1, day))
    return baselines.baseline_from_days(spark.read.parquet(f"{base}/states"), datetime(2024, 1, 31))


@query("url_entropy", digits=9)
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", text.char_entropy(F.col("url")).alias("entropy"))


@query("page_entropy", digits=9)
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", text.char_entropy(F.col("html")).alias("entropy"))


# --- rules --------------------------------------------------------------------

def _rule(name: str, rule, *needed: str) -> None:
    @query(name)
    def _(spark, sf):
        found = detection_tables(spark, sf, needed)
        return rule(*[found[n] for n in needed], start=START, end=END)


_rule("rule_dns_tunneling", detect.detect_dns_tunneling, "zeek_notice")
_rule("rule_suspicious_http", detect.detect_suspicious_http, "zeek_http")
_rule("rule_exfiltration", detect.detect_exfiltration, "zeek_conn")
_rule("rule_tcp_dos", detect.detect_tcp_dos, "zeek_conn")
_rule("rule_unauthorized", detect.detect_unauthorized, "zeek_conn", "tshark")
_rule("rule_syn_flood", detect.detect_syn_flood, "zeek_conn")
_rule("rule_system_strain", detect.detect_system_strain, "system_metrics")


def _incidents(spark, sf, limit=None):
    return detect.detect_all(detection_tables(spark, sf), START, END, limit)


@query("incidents_all")
def _(spark, sf):
    return _incidents(spark, sf)


@query("incidents_earliest")
def _(spark, sf):
    """The top list of every rule: the earliest 100."""
    return _incidents(spark, sf, detect.fv.INCIDENTS_PER_RULE)


def _triage(table: str) -> None:
    @query(f"triage_{table.removeprefix('zeek_')}")
    def _(spark, sf):
        return detect.triage_samples(detection_tables(spark, sf, [table]), START, END)[table]


for _table in ("zeek_notice", "zeek_http", "zeek_conn", "zeek_capture_loss", "zeek_dns", "tshark"):
    _triage(_table)


# --- alerts ---------------------------------------------------------------------

@query("incident_rollup")
def _(spark, sf):
    return alerts.incident_rollup(_incidents(spark, sf))


@query("incident_addresses")
def _(spark, sf):
    return alerts.incident_addresses(_incidents(spark, sf))


@query("alert_messages")
def _(spark, sf):
    sent = alerts.to_alert_messages(_incidents(spark, sf), F.lit(END))
    read = F.from_json("value", (
        "type string, description string, src_ip string, dst_ip string, timestamp string, "
        "details struct<type: string, query: string, dst_port: int, orig_pkts: bigint>"
    ))
    return sent.select(text.evaluated_once(read).alias("m")).select(
        "m.type", "m.description", "m.src_ip", "m.dst_ip", "m.timestamp",
        F.col("m.details.type").alias("detail_type"),
        F.col("m.details.query").alias("detail_query"),
        F.col("m.details.dst_port").alias("detail_port"),
        F.col("m.details.orig_pkts").alias("detail_pkts"),
    )


@query("incident_text")
def _(spark, sf):
    sent = alerts.to_alert_messages(_incidents(spark, sf), F.lit(END))
    return alerts.incident_text(sent).select("text")


@query("asset_attribution")
def _(spark, sf):
    return assets.attribute_asset(_incidents(spark, sf), view(spark, sf, "v_assets")).select(
        "attack_type", "event_time", "description", "asset_name", "asset_short_name",
        "asset_ip", "matched_by",
    )


@query("attack_type_in_text")
def _(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return alerts.type_free_text(documents, "text").select("doc_id", "attack_type")


@query("record_assembly")
def _(spark, sf):
    built = records.assemble_records(view(spark, sf, "v_lines"), block_lines=5000)
    field = lambda key: F.try_element_at("fields", F.lit(key)).alias(key)
    return built.select(
        "file", F.col("record_no").cast("bigint").alias("record_no"),
        *[field(k) for k in ("attack_type", "incident_count", "source_ips", "details")],
    )


@query("record_fields")
def _(spark, sf):
    return records.record_fields(view(spark, sf, "v_lines"), block_lines=5000).groupBy(
        "file", "key"
    ).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("record_no").alias("n_records"),
        F.sum(F.length("value")).alias("value_chars"),
    )


# --- logs -------------------------------------------------------------------------

@query("auth_parse")
def _(spark, sf):
    return syslog.parse_auth(view(spark, sf, "v_auth_raw")).drop("message", "log_message")


@query("failed_logins")
def _(spark, sf):
    return ingest.failed_login_table(log_messages(view(spark, sf, "v_auth_raw")))


@query("login_geo")
def _(spark, sf):
    placed = ingest.login_table(log_messages(view(spark, sf, "v_auth_raw")), view(spark, sf, "v_geo"))
    return placed.groupBy("event_type", "sshd_src_ip", "src_latitude", "src_longitude", "src_city").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("sudo_commands")
def _(spark, sf):
    return syslog.run_commands(view(spark, sf, "v_auth_raw")).select(
        "event_id", "command", "is_dangerous"
    )


def _system_log(source: str) -> None:
    @query(f"{source}_rows")
    def _(spark, sf):
        boot = F.lit("2024-01-01 00:00:00").cast("timestamp")
        return syslog.parse_system_log(
            view(spark, sf, f"v_{source}_raw"), source, boot_time=boot, keep=["event_id"]
        ).drop("processed_at")


for _source in syslog.SOURCES:
    _system_log(_source)


@query("tailed_lines")
def _(spark, sf):
    return files.parse_tailed(view(spark, sf, "v_tailed"))


@query("log_routing")
def _(spark, sf):
    listed = view(spark, sf, "v_files").withColumn("log_source", files.source_of_file(F.col("file")))
    topic = files.topic_of(F.col("host_group"), F.col("log_source"))
    return listed.select("event_id", "log_source", topic.alias("topic"))


@query("ip_checks")
def _(spark, sf):
    ip = F.col("ip")
    return view(spark, sf, "v_addresses").select(
        "event_id", "ip", net.is_ipv4(ip).alias("is_ipv4"), net.is_ip(ip).alias("is_ip"),
        net.is_private(ip).alias("is_private"), net.ipv4_number(ip).alias("number"),
    )


# --- packets and metrics -------------------------------------------------------------

@query("tshark_parse")
def _(spark, sf):
    return packets.parse_packets(view(spark, sf, "v_tshark_raw"), keep=["event_id"])


@query("packet_table")
def _(spark, sf):
    lines = log_messages(view(spark, sf, "v_tshark_raw"))
    return ingest.packet_table(lines, view(spark, sf, "v_geo"))


@query("traffic_class")
def _(spark, sf):
    parsed = packets.parse_packets(view(spark, sf, "v_tshark_raw"))
    return parsed.groupBy("traffic_type").agg(F.count(F.lit(1)).alias("packets"))


def _metric_messages(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("raw_json").alias("value"), "timestamp")


@query("metrics_parse")
def _(spark, sf):
    return metrics.parse_metrics(_metric_messages(view(spark, sf, "v_metrics_raw")))


@query("metrics_10s")
def _(spark, sf):
    parsed = metrics.parse_metrics(_metric_messages(view(spark, sf, "v_metrics_raw")))
    return metrics.metrics_by_window(parsed)


@query("metrics_1h")
def _(spark, sf):
    """Windows wide enough that the kinds meet in one row."""
    parsed = metrics.parse_metrics(_metric_messages(view(spark, sf, "v_metrics_raw")))
    return metrics.metrics_by_window(parsed, "1 hour")


@query("capture_loss_severity")
def _(spark, sf):
    rows = network.add_loss_severity(view(spark, sf, "v_loss"))
    return rows.select("event_id", "percent_lost", "loss_severity")


# --- network tables and star schema ------------------------------------------------

def _network_table(topic: str, columns: list[str]) -> None:
    @query(f"table_{topic.removeprefix('zeek_')}")
    def _(spark, sf):
        made = ingest.network_table(
            topic_messages(spark, sf, topic), topic, view(spark, sf, "v_geo")
        )
        return made.select(*columns)


_PLACED = [
    "id_orig_h", "id_resp_h", "orig_latitude", "orig_longitude", "orig_city", "resp_latitude",
    "resp_longitude", "resp_city", "hostname", "vm_id",
]
_WHEN = ["timestamp", "year", "month", "day", "hour", "minute", "second"]
TABLE_CHECKS = {
    "zeek_conn": [*_WHEN, *_PLACED, "id_orig_p", "id_resp_p", "proto", "duration", "resp_bytes",
                  "conn_state", "orig_pkts"],
    "zeek_dns": [*_WHEN, *_PLACED, "uid", "id_resp_p", "proto", "query", "qtype_name"],
    "zeek_http": [*_WHEN, *_PLACED, "uid", "response_body_len", "user_agent", "status_code"],
    "zeek_notice": [*_WHEN, *_PLACED, "uid", "note", "msg"],
    "zeek_ssl": [*_WHEN, *_PLACED, "uid", "id_resp_p", "version", "server_name", "established"],
    "zeek_capture_loss": [*_WHEN, "peer", "gaps", "acks", "percent_lost", "loss_severity",
                          "hostname", "vm_id"],
}
for _topic, _columns in TABLE_CHECKS.items():
    _network_table(_topic, _columns)


def _united(spark, sf):
    return topics.read_all(lambda topic: topic_messages(spark, sf, topic))


def _events(spark, sf):
    return network.add_event_time(_united(spark, sf))


@query("zeek_union")
def _(spark, sf):
    return _united(spark, sf).select(
        "log_type", "uid", "id_orig_h", "id_resp_h", "id_resp_p", "proto", "query", "note",
        "status_code", "version", "percent_lost", "loss_severity", "hostname", "vm_id",
    )


@query("dim_time")
def _(spark, sf):
    return star.dim_time(_events(spark, sf))


@query("dim_host")
def _(spark, sf):
    return star.dim_host(_events(spark, sf))


@query("dim_network_entity")
def _(spark, sf):
    return star.dim_network_entity(_events(spark, sf), view(spark, sf, "v_geo"))


def _fact_columns(fact: DataFrame) -> DataFrame:
    packed = ["query", "note", "status_code", "server_name", "peer", "conn_state"]
    data = F.json_tuple("event_data", *packed).alias(*packed)  # one look at the text for all of them
    return fact.select(*[c for c in star.FACT if c != "event_data"], data)


@query("fact_events")
def _(spark, sf):
    return _fact_columns(star.fact_events(_events(spark, sf)))


@query("fact_by_join")
def _(spark, sf):
    return _fact_columns(star.fact_by_join(_events(spark, sf)))


@query("geo_enrich")
def _(spark, sf):
    placed = geo.geo_enrich(
        view(spark, sf, "v_conn"), view(spark, sf, "v_geo"), network.ENDPOINTS
    )
    return placed.select("event_id", *_PLACED[:8])


def _placed_both(spark, sf, **limits):
    placed = geo.geo_enrich(view(spark, sf, "v_both"), view(spark, sf, "v_nested"), {"at": "ip"}, **limits)
    return placed.select("event_id", "ip", "at_latitude", "at_longitude", "at_city")


@query("geo_nested")
def _(spark, sf):
    """Nested ranges and both address families, placed by broadcast."""
    return _placed_both(spark, sf)


@query("geo_large")
def _(spark, sf):
    """The same by the way of large tables: addresses looked up once, joined back by shuffle."""
    return _placed_both(spark, sf, max_range_bytes=0, max_broadcast_bytes=0)


@query("quarantine")
def _(spark, sf):
    """NULL, empty, broken, array and metric messages, told apart from good ones."""
    mixed = view(spark, sf, "v_mixed")
    parsed = network.parse_messages(mixed, "zeek_conn")
    bad = network.quarantine(parsed).select(F.lit("bad").alias("kind"), F.col(schemas.CORRUPT).alias("bad_text"))
    good = ingest.network_table(mixed, "zeek_conn").select(
        F.lit("good").alias("kind"), F.lit(None).cast("string").alias("bad_text"))
    return bad.unionByName(good).groupBy("kind", "bad_text").agg(F.count(F.lit(1)).alias("n"))


# --- tables and SQL -----------------------------------------------------------------

@query("time_range")
def _(spark, sf):
    dated = network.add_event_time(
        view(spark, sf, "v_conn").withColumn("ts", F.unix_micros("timestamp") / 1e6)
    )
    path = f"{work_dir(spark, 'conn')}/table"
    writers.append_table(dated.drop("ts"), path)
    days = files.read_table(spark, path)
    picked = detect.time_range(days, "2024-01-05 22:00:00", "2024-01-08 03:30:00")
    return picked.select("event_id", "timestamp", "year", "month", "day")


@query("retention")
def _(spark, sf):
    kept = tables.retain_since(view(spark, sf, "v_dns"), "2024-01-15 00:00:00")
    return kept.select("event_id", "timestamp", "query")


@query("dropped_days")
def _(spark, sf):
    """A catalog table by day, with a day that is not known; whole days before the cutoff go."""
    name = f"loss_{uuid.uuid4().hex}"
    made = network.event_table(network.good_rows(network.parse_messages(
        topic_messages(spark, sf, "zeek_capture_loss"), "zeek_capture_loss")), "zeek_capture_loss")
    undated = made.where("gaps = 7").select(*[
        F.lit(None).cast(made.schema[c].dataType).alias(c) if c in (*_WHEN,) else F.col(c) for c in made.columns])
    path = f"{work_dir(spark, 'loss')}/table"
    writers.create_table(spark, name, "zeek_capture_loss", path)
    wanted = spark.table(name).columns
    made.unionByName(undated).select(*wanted).write.insertInto(name)
    writers.drop_days_before(spark, name, (2024, 1, 15))
    kept = materialize(spark.table(name).select("timestamp", "day", "peer", "gaps", "hostname"))
    spark.sql(f"DROP TABLE {name}")
    return kept


@query("dropped_column")
def _(spark, sf):
    """Batches of a stream to a table, without a column meant for debugging."""
    base = work_dir(spark, "drop")
    rows = view_stream(spark, sf, "v_loss").withColumn("raw", F.col("peer"))
    _run(streams.start_batches, rows, writers.batch_writer(f"{base}/t", [], drop=["raw"]), f"{base}/c")
    kept = writers.read_batches(spark, f"{base}/t")
    return kept.select(*[c for c in ("event_id", "peer", "gaps", "raw") if c in kept.columns])


@query("followed_lines")
def _(spark, sf):
    """Log files followed by a stream that is stopped and started again after there is more: every line once."""
    base = work_dir(spark, "logs")
    lines = view(spark, sf, "v_tailed").select(
        "event_id", F.concat_ws(" ", F.lpad(F.col("event_id").cast("string"), 9, "0"), "value").alias("line"))
    for part in (0, 1, 2):
        lines.where(F.col("event_id") % 3 == part).select("line").write.mode("append").text(f"{base}/files")
        followed = tail.follow_files(spark, f"{base}/files", split_bytes=1 << 20)
        _run(streams.start_table, followed, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").select("line")


@query("first_row_each")
def _(spark, sf):
    """The first event of each table, by time."""
    named = {t: view(spark, sf, v) for t, v in VIEW_OF_TOPIC.items()}
    firsts = sql.first_row_each(named, "timestamp", "event_id")
    rows = [df.select(F.lit(t).alias("table_name"), "event_id", "hostname", "timestamp")
            for t, df in firsts.items()]
    return reduce(DataFrame.unionByName, rows)


@query("sql_surface")
def _(spark, sf):
    sql.register({"zeek_conn": view(spark, sf, "v_conn")})
    outcomes = sql.run_sql(spark, """
        -- totals; by port
        SELECT id_resp_p, proto, count(*) AS n, sum(resp_bytes) AS bytes
        FROM zeek_conn WHERE proto <> ';' GROUP BY id_resp_p, proto;
        SELECT nothing FROM zeek_conn;
        SELECT CAST(min(uid) AS int) AS n FROM zeek_conn
    """)
    reasons = [sql.rows_of(o)[1] for o in outcomes[1:]]
    assert len(outcomes) == 3 and all(r.startswith("Error executing query") for r in reasons)
    return outcomes[0].result


@query("csv_round_trip")
def _(spark, sf):
    path = work_dir(spark, "csv")
    rows = syslog.parse_system_log(view(spark, sf, "v_auth_raw"), "auth", keep=["event_id"])
    writers.write_csv(rows.drop("processed_at", "timestamp"), path)
    return spark.read.csv(path, header=True).groupBy("event_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("message_chars")
    )


@query("json_round_trip")
def _(spark, sf):
    path = work_dir(spark, "json")
    writers.write_messages(topic_messages(spark, sf, "zeek_ssl"), path)
    read = files.read_json_files(spark, path)
    return read.groupBy("version", "established").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("uids")
    )


# --- streams --------------------------------------------------------------------------

def _run(start, *arguments, **options):
    query = start(*arguments, every=None, **options)
    query.awaitTermination()


def _in_batches(spark, rows: DataFrame, closing: dict, base: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    """The table of a stream over rows that arrive in order of time, all files of a part in one micro-batch; a
    closing row, a day after the last, moves the watermark past all of them."""
    day = F.dayofmonth("timestamp")
    last = rows.agg((F.max("timestamp") + F.expr("INTERVAL 1 DAY")).alias("timestamp"))
    end = last.select(*[
        "timestamp" if c == "timestamp" else F.lit(closing.get(c)).cast(rows.schema[c].dataType).alias(c)
        for c in rows.columns])
    spans = ((1, 8), (8, 15), (15, 23), (23, 32))
    for part in [*(rows.where((day >= low) & (day < high)) for low, high in spans), end]:
        part.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        _run(streams.start_table, plan(source), f"{base}/table", f"{base}/checkpoint")


@query("stream_metrics")
def _(spark, sf):
    base = work_dir(spark, "metrics")
    messages = _metric_messages(view(spark, sf, "v_metrics_raw"))
    closing = {"value": '{"user":"1","system":"1","iowait":"1","idle":"1","hostname":"closing","vm_id":"v"}'}
    _in_batches(spark, messages, closing, base, streams.metrics_stream)
    return spark.read.parquet(f"{base}/table").select(
        *schemas.TABLE_SCHEMAS["system_metrics"].fieldNames()
    )


@query("stream_dns_features")
def _(spark, sf):
    base = work_dir(spark, "features")
    closing = {"event_id": -1, "id_orig_h": "closing", "query": "closing", "vm_id": "v"}
    _in_batches(spark, view(spark, sf, "v_dns"), closing, base,
                lambda dns: features.dns_features(dns.withWatermark("timestamp", "10 minutes")))
    return spark.read.parquet(f"{base}/table")


@query("stream_dedupe")
def _(spark, sf):
    base = work_dir(spark, "hosts")
    hosts = streams.once(
        view_stream(spark, sf, "v_conn").select("timestamp", "hostname", "vm_id"),
        ["hostname", "vm_id"],
    )
    _run(streams.start_table, star.host_dimension(hosts), f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


@query("stream_hosts")
def _(spark, sf):
    """Hosts of a stream in several batches: a key comes out once within the delay, and the deltas give each once."""
    base = work_dir(spark, "hosts")
    rows = view(spark, sf, "v_conn").select("timestamp", "hostname", "vm_id")
    _in_batches(spark, rows, {"hostname": "closing"}, base,
                lambda hosts: star.host_dimension(streams.once(hosts, ["hostname", "vm_id"])))
    return streams.merge_star("dim_host", spark.read.parquet(f"{base}/table")).where("hostname <> 'closing'")


@query("stream_network_table")
def _(spark, sf):
    """Messages to the placed table, batch by batch."""
    base, ranges = work_dir(spark, "conn"), geo.prepare(view(spark, sf, "v_geo"))  # once, not per batch
    write = ingest.placing_writer(
        f"{base}/table", lambda batch: ingest.network_table(batch, "zeek_conn", ranges)
    )
    _run(streams.start_batches, topic_messages(spark, sf, "zeek_conn", stream=True), write,
         f"{base}/checkpoint")
    return writers.read_batches(spark, f"{base}/table").select(*TABLE_CHECKS["zeek_conn"])


@query("stream_archive")
def _(spark, sf):
    base = work_dir(spark, "archive")
    routed = view_stream(spark, sf, "v_files").withColumn(
        "log_source", files.source_of_file(F.col("file"))
    )
    sent = routed.select(
        F.to_json(F.struct("event_id", "file")).alias("value"),
        files.topic_of(F.col("host_group"), F.col("log_source")).alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
    )
    _run(streams.start_archive, sent, f"{base}/table", f"{base}/checkpoint")
    return files.read_json_files(spark, f"{base}/table").select(
        "topic", F.col("partition").cast("int").alias("partition"), "event_id", "file"
    )


#: Messages of a micro-batch: what its shuffles, its state and the rows kept for its tables take on disk grows with them.
BATCH_MESSAGES = 8_000_000


def _spans(moments: DataFrame, most: int, least: int = 2) -> list[Column]:
    """Conditions on ``timestamp`` that cut rows into about equal parts in order of time, of about ``most`` rows."""
    moment = F.unix_micros("timestamp")
    parts = max(least, -(-moments.count() // most))
    shares = [part / parts for part in range(1, parts)]
    cuts = sorted(set(moments.agg(F.percentile_approx(moment, shares, 100 * parts)).first()[0] or []))
    return [
        (F.lit(True) if low is None else moment >= low) & (F.lit(True) if high is None else moment < high)
        for low, high in zip([None, *cuts], [*cuts, None])]


@query("stream_star")
def _(spark, sf):
    """All four star tables of all topics from one read, in several batches; the second fails once after two tables."""
    base = work_dir(spark, "star")
    tables = streams.star_tables(geo.prepare(view(spark, sf, "v_geo")))
    calls = []

    def fails_once(events: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise OSError("the store is gone")
        return tables["dim_network_entity"](events)

    broken = {**tables, "dim_network_entity": fails_once}

    def run() -> None:
        parsed = topics.read_all(lambda topic: topics.read_topic_files(spark, f"{base}/in/{topic}", consume=True))
        _run(streams.start_star, parsed, f"{base}/t", f"{base}/c", tables=broken)

    def send(topic: str, span: Column) -> None:
        sent[topic].where(span).write.mode("append").parquet(f"{base}/in/{topic}")

    sent = {topic: topic_messages(spark, sf, topic).where("timestamp IS NOT NULL") for topic in VIEW_OF_TOPIC}
    moments = reduce(DataFrame.unionByName, [rows.select("timestamp") for rows in sent.values()])
    for span in _spans(moments, BATCH_MESSAGES):  # in order of time, so that no event is late
        with ThreadPoolExecutor(len(sent)) as pool:
            started = [pool.submit(inheritable_thread_target(spark)(send), topic, span) for topic in sent]
            for topic in started:
                topic.result()
        try:
            run()
        except StreamingQueryException:
            if len(calls) != 2:
                raise
            run()
    assert len(calls) != 2
    keys = {"dim_time": "time_id", "dim_host": "host_id",
            "dim_network_entity": "network_entity_id", "fact_zeek_events": "event_id"}
    found = []
    for name, key in keys.items():
        rows = batchlog.read_logged(spark, f"{base}/t/{name}")
        if name.startswith("dim_"):
            rows = streams.merge_star(name, rows)
        place = "latitude" if "latitude" in rows.columns else F.lit(None).cast("double").alias("latitude")
        found.append(rows.select(F.lit(name).alias("table_name"), F.col(key).alias("key"), place))
    return reduce(DataFrame.unionByName, found)


@query("stream_left_join")
def _(spark, sf):
    """Connections with what their source host asked names for in the same hour; two streams, in several batches."""
    base = work_dir(spark, "join")
    sides = {
        "conn": view(spark, sf, "v_conn").select("timestamp", "event_id", "id_orig_h"),
        "dns": view(spark, sf, "v_dns").select("timestamp", "id_orig_h", F.col("vm_id").alias("asked_by")),
    }
    closing = F.expr("TIMESTAMP '2024-02-05 00:00:00'")
    day = F.dayofmonth("timestamp")
    for low, high in ((1, 16), (16, 32), (0, 0)):
        for name, df in sides.items():
            part = df.where((day >= low) & (day < high)) if high else spark.range(2).select(*[
                closing.alias(f.name) if f.name == "timestamp" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
            part.write.mode("append").parquet(f"{base}/in/{name}")
        conn, dns = [spark.readStream.schema(df.schema).parquet(f"{base}/in/{n}") for n, df in sides.items()]
        joined = joins.left_within_windows(conn, dns, ["id_orig_h"], window="1 hour")
        _run(streams.start_table, joined, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").where("event_id IS NOT NULL")


@query("stream_compacted")
def _(spark, sf):
    """The placed table in batches that are not in order of time: days are compacted between them."""
    base, places = work_dir(spark, "compacted"), geo.prepare(view(spark, sf, "v_geo"))
    messages = topic_messages(spark, sf, "zeek_conn")
    write = batchlog.logged_writer(f"{base}/t")
    for part in range(3):  # every batch has rows of every day
        messages.where(F.pmod(F.xxhash64("value"), F.lit(3)) == part).write.mode("append").parquet(f"{base}/in")
        stream = topics.read_topic_files(spark, f"{base}/in")
        _run(streams.start_batches, stream, lambda batch, n: write(ingest.network_table(batch, "zeek_conn", places), n),
             f"{base}/checkpoint")
        for day in (3, 4, 5):
            batchlog.compact_day(spark, f"{base}/t", (2024, 1, day))
    return batchlog.read_logged(spark, f"{base}/t").select(*TABLE_CHECKS["zeek_conn"])


@query("incremental_sweep")
def _(spark, sf):
    base, found = work_dir(spark, "sweep"), detection_tables(spark, sf)
    for as_of in SWEEPS:
        sweep.incremental_sweep(
            spark, found, f"{base}/state", f"{base}/incidents", as_of, look_back=timedelta(days=40),
        )
    return spark.read.parquet(f"{base}/incidents").drop("sweep", "details")


@query("late_sweep")
def _(spark, sf):
    """Tables with batch logs, a third of whose rows come after their time was swept; the incidents are those of one look."""
    base, found = work_dir(spark, "late"), detection_tables(spark, sf)
    paths = {name: f"{base}/tables/{name}" for name in found}
    first, second, third, last = [F.lit(s) for s in (SWEEPS[0] - timedelta(days=40), *SWEEPS)]

    def staged(name: str) -> Callable[[int], None]:
        """A table, made and written once; its batches become visible one by one."""
        moment = F.col(sweep.TIME_COLUMN.get(name, "timestamp"))
        late = F.pmod(F.xxhash64(F.date_trunc("minute", moment)), F.lit(3)) == 0
        held_back = F.when(moment >= second, 2).when(moment >= first, 1)
        on_time = F.when(moment >= last, None).when(moment >= third, 2).when(moment >= second, 1).when(moment >= first, 0)
        return batchlog.stage_batches(found[name], paths[name], F.when(late, held_back).otherwise(on_time), [])

    with ThreadPoolExecutor(len(found)) as pool:  # side by side: no core waits for the last task of one table
        started = [pool.submit(inheritable_thread_target(spark)(staged), name) for name in found]
        commits = [table.result() for table in started]
    for number, as_of in enumerate(SWEEPS):
        for commit in commits:
            commit(number)
        sweep.sweep_logged(spark, paths, f"{base}/state", f"{base}/incidents", as_of, timedelta(days=40))
    return sweep.read_incidents(spark, f"{base}/state", f"{base}/incidents").select(
        "minute", "attack_type", "description", "src_ip", "dst_ip")


logging.getLogger("py4j").setLevel(logging.ERROR)
