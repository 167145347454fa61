"""Schema registry: message types, table types and column notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seclog import fixed_values as fv

CORRUPT = "_corrupt_record"
TOPICS = list(fv.TOPIC_SCHEMAS)


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def ddl(text: str) -> T.StructType:
    """``name type, ...`` as a schema, without the session ``StructType.fromDDL`` needs."""
    fields = (field.rsplit(" ", 1) for field in text.split(", "))
    return T.StructType([T.StructField(n.strip("`"), _TYPES[t]) for n, t in fields])


def message_schema(topic: str) -> T.StructType:
    return ddl(fv.TOPIC_SCHEMAS[topic])


def plain_name(field: str) -> str:
    """Column name of a dotted message field."""
    return field.replace(".", "_")


METRICS_MESSAGE = ddl(
    ", ".join(f"{name} string" for group in fv.METRIC_FIELDS.values() for name in group)
    + ", hostname string, vm_id string"
)

SYSTEM_LOG = ddl(
    "timestamp timestamp, hostname string, process string, pid string, event_type string, "
    "severity string, message string, log_source string, processed_at timestamp"
)

_PARTS = ", ".join(f"{p} int" for p in fv.TIME_PARTS)

#: Tables without a message schema of their own.
TABLE_SCHEMAS: dict[str, T.StructType] = {
    "system_log": SYSTEM_LOG,
    "system_metrics": ddl(
        f"{_PARTS}, timestamp timestamp, cpu_user double, cpu_system double, "
        "cpu_iowait double, cpu_idle double, disk_read_kbs double, disk_write_kbs double, "
        "mem_used double, mem_total double, hostname string, vm_id string"
    ),
    "auth_logs": ddl(
        "timestamp timestamp, hostname string, vm_id string, event_type string, "
        "raw_message string, source_ip string, source_port string"
    ),
    "tshark": ddl(
        "frame_time timestamp, ip_src string, ip_dst string, udp_port string, "
        "tcp_port string, ip_proto string, src_latitude double, src_longitude double, "
        "src_city string, dst_latitude double, dst_longitude double, dst_city string, "
        f"{_PARTS}, traffic_type string"
    ),
    "dns_features": ddl(
        "ts_window_start timestamp, id_orig_h string, vm_id string, query_rate double, "
        "unique_queries bigint, avg_query_len double, query_name_entropy double"
    ),
    "notice_features": ddl(
        "ts_window_start timestamp, id_orig_h string, vm_id string, "
        "dns_tunneling_notices bigint, avg_notice_msg_len double"
    ),
    "dns_baseline": ddl(
        "id_orig_h string, metric string, mean double, std_dev double, last_updated timestamp"
    ),
    "scored_anomalies": ddl(
        "timestamp timestamp, id_orig_h string, vm_id string, anomaly_type string, "
        "score double, details string"
    ),
    "incidents": ddl(
        "timestamp timestamp, attack_type string, description string, src_ip string, "
        "dst_ip string, details string"
    ),
    "assets": ddl("name string, short_name string, ip_address string, status string"),
    "geo_ranges": ddl(
        "ip_lo bigint, ip_hi bigint, latitude double, longitude double, city string"
    ),
}

#: Notes by column name; a name means the same in every table.
COLUMN_NOTES = {
    **{part: f"{part} of the event time, UTC" for part in fv.TIME_PARTS},
    "timestamp": "event time",
    "frame_time": "capture time of the packet",
    "ts_window_start": "start of the time window",
    "uid": "id of the connection",
    "id_orig_h": "address that opened the connection",
    "id_orig_p": "port that opened the connection",
    "id_resp_h": "address that answered",
    "id_resp_p": "port that answered",
    "orig_latitude": "latitude of the opening address",
    "orig_longitude": "longitude of the opening address",
    "orig_city": "city of the opening address",
    "resp_latitude": "latitude of the answering address",
    "resp_longitude": "longitude of the answering address",
    "resp_city": "city of the answering address",
    "proto": "transport protocol",
    "service": "application protocol, when known",
    "duration": "seconds the connection lasted",
    "conn_state": "state of the connection; S0 is an open without an answer",
    "query": "name asked for",
    "qtype_name": "record type asked for",
    "rcode_name": "result of the name lookup",
    "answers": "records in the answer",
    "note": "kind of notice",
    "msg": "text of the notice",
    "user_agent": "client program named in the request",
    "status_code": "HTTP result code",
    "response_body_len": "bytes in the response body",
    "percent_lost": "share of traffic the sensor missed, percent",
    "loss_severity": "band of percent_lost",
    "hostname": "machine that sent the log",
    "vm_id": "virtual machine that sent the log",
    "event_type": "class of the log line",
    "severity": "how serious the log line is",
    "log_source": "log file family",
    "traffic_type": "service guessed from the ports",
    "cpu_user": "CPU share of user processes, percent",
    "mem_used": "memory in use",
    "mem_total": "memory installed",
    "query_rate": "name lookups per second in the window",
    "unique_queries": "different names asked for in the window",
    "avg_query_len": "mean length of the names",
    "query_name_entropy": "mean character entropy of the names, bits",
    "score": "weighted sum of the signals that fired",
    "attack_type": "rule that found the incident",
    "description": "the incident in one sentence",
    "src_ip": "source address",
    "dst_ip": "destination address",
}


def table_schema(name: str) -> T.StructType:
    """Columns of a table, with a comment on every column that has a note."""
    if name in TABLE_SCHEMAS:
        fields = TABLE_SCHEMAS[name].fields
    else:
        types = {plain_name(f.name): f.dataType for f in message_schema(name).fields}
        types.update({p: T.IntegerType() for p in fv.TIME_PARTS})
        types["timestamp"] = T.TimestampType()
        types["loss_severity"] = T.StringType()
        for end in ("orig", "resp"):
            types[f"{end}_latitude"] = T.DoubleType()
            types[f"{end}_longitude"] = T.DoubleType()
            types[f"{end}_city"] = T.StringType()
        names = [*fv.TIME_PARTS, "timestamp", *fv.TABLE_COLUMNS[name]]
        fields = [T.StructField(n, types[n]) for n in names]
    return T.StructType([
        T.StructField(
            f.name, f.dataType, True,
            {"comment": COLUMN_NOTES[f.name]} if f.name in COLUMN_NOTES else {},
        )
        for f in fields
    ])


def table_names() -> list[str]:
    return [*TOPICS, *TABLE_SCHEMAS]


def describe_catalog(spark: SparkSession) -> DataFrame:
    """One row per column of every known table."""
    rows = [
        (table, position, f.name, f.dataType.simpleString(), f.metadata.get("comment"))
        for table in table_names()
        for position, f in enumerate(table_schema(table).fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, type string, comment string"
    )
