"""System logs to one common row; login daemon details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog.functions.text import (
    all_of, capture, captures, evaluated_once, first_class, is_dangerous_command, known,
)
from seclog.functions.timing import add_time_parts, from_iso

_STAMP = f"({fv.LOG_TIME})"


def _none() -> Column:
    return F.lit(None).cast("string")


def _stamped(line: Column) -> dict[str, Column]:
    return {
        "timestamp": from_iso(F.regexp_extract(line, _STAMP, 1)),
        "hostname": F.regexp_extract(line, fv.LOG_HOST, 1),
    }


def _syslog(line: Column) -> dict[str, Column]:
    return _stamped(line) | {
        "process": F.regexp_extract(line, fv.SYSLOG_PROCESS, 1),
        "pid": F.regexp_extract(line, fv.LOG_PID, 1),
        "message": F.regexp_extract(line, fv.SYSLOG_MESSAGE, 1),
    }


def _kern(line: Column) -> dict[str, Column]:
    return _stamped(line) | {
        "process": F.lit("kernel"),
        "pid": F.regexp_extract(line, fv.KERN_PID, 1),
        "message": F.regexp_extract(line, fv.KERN_MESSAGE, 1),
    }


def _ufw(line: Column) -> dict[str, Column]:
    return _stamped(line) | {
        "process": F.lit("kernel"),
        "pid": _none(),
        "message": F.regexp_extract(line, fv.UFW_MESSAGE, 1),
    }


def _dmesg(line: Column, boot_time: Column) -> dict[str, Column]:
    uptime = F.regexp_extract(line, fv.DMESG_UPTIME, 1).try_cast("double")
    moment = F.timestamp_micros(
        F.unix_micros(boot_time) + F.round(uptime * 1_000_000).cast("bigint")
    )
    return {
        "timestamp": moment,
        "hostname": F.lit("unknown"),
        "process": F.lit("kernel"),
        "pid": _none(),
        "message": F.regexp_extract(line, fv.DMESG_MESSAGE, 1),
    }


def _auth(line: Column) -> dict[str, Column]:
    named = F.regexp_extract(line, fv.AUTH_NAMED, 1)
    return {
        "timestamp": from_iso(F.regexp_extract(line, f"^{_STAMP}", 1)),
        "hostname": F.regexp_extract(line, fv.AUTH_HOST, 1),
        "process": F.regexp_extract(named, fv.AUTH_PROCESS, 1),
        "pid": F.regexp_extract(named, fv.LOG_PID, 1),
        "message": F.regexp_extract(line, fv.AUTH_MESSAGE, 1),
    }


SOURCES = ["syslog", "kern", "dmesg", "ufw", "auth"]


def parse_system_log(
    lines: DataFrame,
    source: str,
    *,
    line: str = "message",
    log_source: str | None = None,
    boot_time: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Lines of one log family as the common nine-column row.

    ``boot_time`` turns dmesg's seconds since boot into a time; without it the time is
    NULL. ``keep`` carries input columns along.
    """
    raw = F.col(line)
    if source == "dmesg":
        boot = F.lit(None).cast("timestamp") if boot_time is None else boot_time
        fields = _dmesg(raw, boot)
    else:
        fields = {"syslog": _syslog, "kern": _kern, "ufw": _ufw, "auth": _auth}[source](raw)
    event = first_class(raw, fv.EVENT_RULES[source], fv.EVENT_DEFAULTS[source])
    severity = first_class(raw, fv.SEVERITY_RULES[source], fv.SEVERITY_DEFAULTS[source])
    return lines.select(
        *(keep or []),
        fields["timestamp"].alias("timestamp"),
        fields["hostname"].alias("hostname"),
        fields["process"].alias("process"),
        fields["pid"].alias("pid"),
        event.alias("event_type"),
        severity.alias("severity"),
        fields["message"].alias("message"),
        F.lit(log_source or fv.LOG_SOURCE_NAMES.get(source, source)).alias("log_source"),
        F.current_timestamp().alias("processed_at"),
    )


#: time, process, pid, text
_LOGIN_LINE = rf"^{_STAMP}\s+\S+\s+([^\s\[\]():]+)(?:\(\w+\))?(?:\[(\d+)\])?:\s+(.*)$"


def _login_details(text: Column, event: Column) -> Column:
    """User, address and port by the patterns of the row's event type, as an array."""
    return F.coalesce(*[
        F.when(event == name, captures(text, pattern, list(groups)))
        for name, patterns in fv.SSHD_DETAILS.items()
        for pattern, *groups in patterns
    ])


def parse_auth(messages: DataFrame, line: str = "message") -> DataFrame:
    """Login log lines with event type, user, address, port, method and outcome.

    A line is matched once for its header and once per candidate pattern for its details.
    """
    text, event = F.col("log_message"), F.col("event_type")
    header, who = F.col("__header"), F.col("__who")
    event_type = F.when(
        F.col("process") == "sshd",
        first_class(text, fv.SSHD_EVENTS, fv.SSHD_OTHER, all_of),
    ).otherwise(fv.NOT_SSHD)
    method = F.create_map(*[F.lit(x) for pair in fv.SSHD_METHODS.items() for x in pair])
    success = F.when(event.startswith("sshd_login_success"), True).when(
        event == "sshd_login_fail", False
    )
    split = captures(F.col(line), _LOGIN_LINE, [1, 2, 3, 4])
    parsed = (
        messages.select("*", evaluated_once(split).alias("__header"))
        .withColumns({
            "log_timestamp": from_iso(header[0]),
            "process": known(header[1]),
            "pid": known(header[2]),
            "log_message": F.coalesce(header[3], F.lit("")),
        })
        .select("*", evaluated_once(event_type).alias("event_type"))
        .select("*", evaluated_once(_login_details(text, event)).alias("__who"))
        .withColumns({
            "sshd_user": known(who[0]),
            "sshd_src_ip": known(who[1]),
            "sshd_port": known(who[2]),
            "sshd_auth_method": F.try_element_at(method, event),
            "sshd_success": success,
        })
        .drop("__header", "__who")
    )
    return add_time_parts(parsed, "log_timestamp")


def failed_logins(auth: DataFrame, line: str = "message") -> DataFrame:
    return auth.where(F.col("event_type") == "sshd_login_fail").select(
        F.col("log_timestamp").alias("timestamp"),
        "hostname",
        "vm_id",
        "event_type",
        F.col(line).alias("raw_message"),
        F.col("sshd_src_ip").alias("source_ip"),
        F.col("sshd_port").alias("source_port"),
    )


def run_commands(messages: DataFrame, line: str = "message") -> DataFrame:
    """Commands run through sudo, with the dangerous ones marked."""
    command = capture(F.col(line), r"COMMAND=(.+)$")
    return (
        messages.withColumn("command", command)
        .where(F.col("command").isNotNull())
        .withColumn("is_dangerous", is_dangerous_command(F.col("command")))
    )
