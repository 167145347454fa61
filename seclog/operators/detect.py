"""Rules over the event tables. Each gives ``event_time, attack_type, description, src_ip,
dst_ip, details`` (JSON text). Every match is kept; ``limit`` asks for the earliest only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog.functions.net import unusual_port
from seclog.functions.text import capture, reasons, shown
from seclog.functions.timing import shown_time

INCIDENT = ["event_time", "attack_type", "description", "src_ip", "dst_ip", "details"]
Limit = int | None


def time_range(df: DataFrame, start=None, end=None, time_col: str = "timestamp",
               end_open: bool = False) -> DataFrame:
    """Rows with start <= time <= end (time < end with ``end_open``).

    A predicate on time does not prune year/month/day folders, so the matching predicate
    on those columns is added where the table has them. It is a day wider on both sides:
    the table may have been written under another session time zone.
    """
    kind = df.schema[time_col].dataType
    moment = F.col(time_col)
    has_parts = {"year", "month", "day"} <= set(df.columns)
    number = F.col("year") * 10000 + F.col("month") * 100 + F.col("day") if has_parts else None

    def day(bound: Column) -> Column:
        return F.year(bound) * 10000 + F.month(bound) * 100 + F.dayofmonth(bound)

    for value, after in ((start, True), (end, False)):
        if value is None:
            continue
        bound = F.lit(str(value)).cast(kind)
        before = moment < bound if end_open else moment <= bound
        df = df.where(moment >= bound if after else before)
        if has_parts:
            year, one_day = F.col("year"), F.expr("INTERVAL 1 DAY")
            wide = bound - one_day if after else bound + one_day
            df = df.where(year >= F.year(wide) if after else year <= F.year(wide))
            df = df.where(number >= day(wide) if after else number <= day(wide))
    return df


def earliest(df: DataFrame, limit: Limit, *order: str) -> DataFrame:
    """The first rows in a total order: a per-task top list merged, never a full sort."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def _details(attack_type: str, details: Mapping[str, Column]) -> Column:
    packed = F.struct(*[value.alias(name) for name, value in details.items()], F.lit(attack_type).alias("type"))
    return F.to_json(packed, {"ignoreNullFields": "false"})


def _incidents(
    df: DataFrame, attack_type: str, description: Column, details: Mapping[str, Column],
    *, time_col: str = "timestamp", src: Column | None = None, dst: Column | None = None,
    limit: Limit = None,
) -> DataFrame:
    found = df.select(
        F.col(time_col).alias("event_time"),
        F.lit(attack_type).alias("attack_type"),
        description.alias("description"),
        (F.col("id_orig_h") if src is None else src).alias("src_ip"),
        (F.col("id_resp_h") if dst is None else dst).alias("dst_ip"),
        _details(attack_type, details).alias("details"),
    )
    return earliest(found, limit, "event_time", "src_ip", "dst_ip", "description", "details")


def _sentence(template: str, **columns: Column) -> Column:
    """A fixed text with columns in the place of the names in braces."""
    parts = [
        piece for text, name, _, _ in Formatter().parse(template)
        for piece in ([F.lit(text)] if text else []) + ([shown(columns[name])] if name else [])
    ]
    return F.concat(*parts)


def _ends() -> dict[str, Column]:
    return {"src": F.col("id_orig_h"), "dst": F.col("id_resp_h"), "at": _at()}


def _two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value.cast("double"))


def _at(time_col: str = "timestamp") -> Column:
    return shown_time(F.col(time_col))


def detect_dns_tunneling(notices: DataFrame, start=None, end=None,
                         limit: Limit = None) -> DataFrame:
    asked = F.coalesce(capture(F.col("msg"), fv.NOTICE_QUERY), F.lit(fv.UNKNOWN_QUERY))
    hits = time_range(notices, start, end).where(F.col("note") == fv.TUNNELING_NOTE)
    sentence = _sentence(fv.SENTENCES["DNS_Tunneling"], **_ends(), query=asked)
    return _incidents(hits, "DNS_Tunneling", sentence, {"query": asked}, limit=limit)


def suspicious_http(http: DataFrame) -> DataFrame:
    return http.where(
        (F.col("response_body_len") > fv.LARGE_BODY_BYTES)
        | (F.col("user_agent") == "")
        | ~F.col("status_code").isin(fv.EXPECTED_STATUS)
    )


def detect_suspicious_http(http: DataFrame, start=None, end=None,
                           limit: Limit = None) -> DataFrame:
    size, agent, status = F.col("response_body_len"), F.col("user_agent"), F.col("status_code")
    why = reasons(
        (size > fv.LARGE_BODY_BYTES, _sentence(fv.HTTP_LARGE, size=size)),
        (agent == "", F.lit(fv.HTTP_NO_AGENT)),
        ((status != 0) & ~status.isin(fv.EXPECTED_STATUS),
         _sentence(fv.HTTP_STATUS, status=status)),
    )
    sentence = _sentence(fv.SENTENCES["Suspicious_HTTP"], **_ends(), why=why)
    details = {"response_body_len": size, "user_agent": agent, "status_code": status}
    hits = suspicious_http(time_range(http, start, end))
    return _incidents(hits, "Suspicious_HTTP", sentence, details, limit=limit)


@dataclass(frozen=True)
class RowRule:
    """A rule that looks at one row: when it holds, what it says, the figures it keeps."""

    attack_type: str
    condition: Column
    sentence: Column
    details: Mapping[str, Column]


def _exfiltration() -> RowRule:
    sent, lasted = F.col("resp_bytes"), F.col("duration")
    sentence = _sentence(fv.SENTENCES["Data_Exfiltration"], **_ends(), sent=sent, lasted=_two_decimals(lasted))
    condition = (sent > fv.EXFILTRATION_BYTES) & (lasted < fv.EXFILTRATION_SECONDS)
    return RowRule("Data_Exfiltration", condition, sentence, {"resp_bytes": sent, "duration": lasted})


def _syn_flood() -> RowRule:
    sent = F.col("orig_pkts")
    sentence = _sentence(fv.SENTENCES["SYN_Flood"], **_ends(), sent=sent)
    condition = (
        (F.col("conn_state") == fv.HALF_OPEN_STATE)
        & (sent > fv.FLOOD_PACKETS)
        & (F.col("duration") < fv.FLOOD_SECONDS)
    )
    return RowRule("SYN_Flood", condition, sentence, {"orig_pkts": sent})


def _by_row(rows: DataFrame, rule: RowRule, limit: Limit) -> DataFrame:
    return _incidents(rows.where(rule.condition), rule.attack_type, rule.sentence, rule.details, limit=limit)


def _by_row_together(rows: DataFrame, *rules: RowRule) -> DataFrame:
    """Every incident of several rules from one pass over the rows."""
    def found(rule: RowRule) -> Column:
        return F.when(rule.condition, F.struct(
            F.lit(rule.attack_type).alias("attack_type"), rule.sentence.alias("description"),
            _details(rule.attack_type, rule.details).alias("details")))

    every = F.filter(F.array(*[found(r) for r in rules]), lambda x: x.isNotNull())
    any_holds = reduce(or_, [F.coalesce(r.condition, F.lit(False)) for r in rules])
    return rows.where(any_holds).select(
        F.col("timestamp").alias("event_time"), F.col("id_orig_h").alias("src_ip"),
        F.col("id_resp_h").alias("dst_ip"), F.inline(every)).select(*INCIDENT)


def detect_exfiltration(conn: DataFrame, start=None, end=None, limit: Limit = None) -> DataFrame:
    return _by_row(time_range(conn, start, end), _exfiltration(), limit)


def detect_tcp_dos(conn: DataFrame, start=None, end=None,
                   limit: Limit = None) -> DataFrame:
    """Many packets or many unanswered opens between two addresses within a minute."""
    lasted = F.col("duration")
    packets, half_open = F.col("total_packets"), F.col("s0_count")
    per_minute = (
        time_range(conn, start, end)
        .where((F.col("proto") == "tcp") & ((lasted < fv.DOS_SECONDS) | lasted.isNull()))
        .groupBy(F.date_trunc("minute", "timestamp").alias("minute_timestamp"),
                 "id_orig_h", "id_resp_h")
        .agg(
            F.sum("orig_pkts").alias("total_packets"),
            F.count_if(F.col("conn_state") == fv.HALF_OPEN_STATE).alias("s0_count"),
        )
        .where((packets > fv.DOS_PACKETS) | (half_open > fv.DOS_HALF_OPEN))
    )
    sentence = _sentence(
        fv.SENTENCES["TCP_DoS"], **_ends() | {"at": _at("minute_timestamp")}, packets=packets, half_open=half_open)
    return _incidents(
        per_minute, "TCP_DoS", sentence, {"total_packets": packets, "s0_count": half_open},
        time_col="minute_timestamp", limit=limit,
    )


def _unusual_packets(packets: DataFrame) -> DataFrame:
    return packets.where(~F.col("tcp_port").isin(fv.EXPECTED_PORT_TEXTS))


def detect_unauthorized(conn: DataFrame, packets: DataFrame, start=None, end=None,
                        limit: Limit = None) -> DataFrame:
    """Traffic to unexpected ports, seen as a connection or as a packet. A port text that
    is no number gives a NULL port."""
    connections = (
        time_range(conn, start, end)
        .where(~F.col("id_resp_p").isin(fv.EXPECTED_PORTS))
        .select("timestamp", F.col("id_orig_h").alias("src"), F.col("id_resp_h").alias("dst"),
                F.col("id_resp_p").cast("string").alias("port_text"))
    )
    frames = _unusual_packets(time_range(packets, start, end, "frame_time")).select(
        F.col("frame_time").cast(connections.schema["timestamp"].dataType).alias("timestamp"),
        F.col("ip_src").alias("src"), F.col("ip_dst").alias("dst"),
        F.col("tcp_port").alias("port_text"),
    )
    port = unusual_port(F.col("port_text"))
    sentence = _sentence(
        fv.SENTENCES["Unauthorized_Access"], src=F.col("src"), dst=F.col("dst"), port=port, at=_at())
    return _incidents(
        connections.union(frames).distinct(), "Unauthorized_Access", sentence,
        {"dst_port": port}, src=F.col("src"), dst=F.col("dst"), limit=limit,
    )


def detect_syn_flood(conn: DataFrame, start=None, end=None, limit: Limit = None) -> DataFrame:
    return _by_row(time_range(conn, start, end), _syn_flood(), limit)


def detect_system_strain(metrics: DataFrame, start=None, end=None,
                         limit: Limit = None) -> DataFrame:
    cpu, used, total = F.col("cpu_user"), F.col("mem_used"), F.col("mem_total")
    share = F.try_divide(used, total)
    percent = share * 100
    hits = time_range(metrics, start, end).where(
        ((cpu > fv.CPU_PERCENT) | (share > fv.MEMORY_SHARE))
        & cpu.isNotNull() & used.isNotNull() & total.isNotNull()
    )
    sentence = _sentence(
        fv.SENTENCES["System_Strain"], at=_at(), cpu=_two_decimals(cpu),
        memory=F.when(percent.isNotNull(), _two_decimals(percent)))
    nobody = F.lit(None).cast("string")
    return _incidents(
        hits, "System_Strain", sentence, {"cpu_user": cpu, "mem_percent": percent},
        src=nobody, dst=nobody, limit=limit,
    )


def detect_all(tables: Mapping[str, DataFrame], start=None, end=None,
               limit: Limit = None) -> DataFrame:
    """All rules in one lazy plan. ``tables``: zeek_notice, zeek_http, zeek_conn, tshark,
    system_metrics; a rule whose tables are missing is left out."""
    rules = [
        (detect_dns_tunneling, ["zeek_notice"]),
        (detect_system_strain, ["system_metrics"]),
        (detect_suspicious_http, ["zeek_http"]),
        (detect_tcp_dos, ["zeek_conn"]),
        (detect_unauthorized, ["zeek_conn", "tshark"]),
    ]
    if limit is not None:  # a top list of its own for every rule
        rules += [(detect_syn_flood, ["zeek_conn"]), (detect_exfiltration, ["zeek_conn"])]
    found = [
        rule(*[tables[n] for n in needed], start=start, end=end, limit=limit)
        for rule, needed in rules
        if all(n in tables for n in needed)
    ]
    if limit is None and "zeek_conn" in tables:
        found.append(_by_row_together(time_range(tables["zeek_conn"], start, end), _exfiltration(), _syn_flood()))
    return reduce(DataFrame.unionByName, found)


def triage_samples(tables: Mapping[str, DataFrame], start=None, end=None,
                   limit: int = fv.TRIAGE_ROWS) -> dict[str, DataFrame]:
    """The earliest suspicious rows of each table."""
    ends = ["id_orig_h", "id_resp_h"]
    column = F.col

    def sample(name: str, keep: list[str], condition: Column, time_col: str = "timestamp"):
        hits = time_range(tables[name], start, end, time_col).where(condition)
        return earliest(hits.select(time_col, *keep), limit, time_col, *keep)

    wanted = {
        "zeek_notice": ([*ends, "msg", "note"],
                        column("note").isin(fv.TUNNELING_NOTE, fv.DROPPED_PACKETS_NOTE)),
        "zeek_conn": ([*ends, "resp_bytes", "duration", "id_resp_p"],
                      (column("resp_bytes") > fv.EXFILTRATION_BYTES)
                      | ~column("id_resp_p").isin(fv.EXPECTED_PORTS)
                      | (column("conn_state") == fv.HALF_OPEN_STATE)),
        "zeek_capture_loss": (["percent_lost"],
                              column("percent_lost") > fv.TRIAGE_LOSS_PERCENT),
        "zeek_dns": ([*ends, "query"], F.length("query") > fv.TRIAGE_QUERY_LENGTH),
    }
    samples = {n: sample(n, *spec) for n, spec in wanted.items() if n in tables}
    if "zeek_http" in tables:
        keep = [*ends, "response_body_len", "user_agent", "status_code"]
        hits = suspicious_http(time_range(tables["zeek_http"], start, end))
        samples["zeek_http"] = earliest(
            hits.select("timestamp", *keep), limit, "timestamp", *keep
        )
    if "tshark" in tables:
        samples["tshark"] = sample(
            "tshark", ["ip_src", "ip_dst", "tcp_port"],
            ~column("tcp_port").isin(fv.EXPECTED_PORT_TEXTS), "frame_time",
        )
    return samples
