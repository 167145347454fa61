"""SQL for DuckDB that each query of the catalogue must agree with."""

from __future__ import annotations

import re

from checks.views import VIEWS
from seclog import fixed_values as fv

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
SHOWN = "strftime({t}, '%Y-%m-%d %H:%M:%S') || CASE WHEN extract(microsecond FROM {t}) % 1000000 = 0 " \
        "THEN '' ELSE '.' || strftime({t}, '%f') END"
PARTS = (
    "CAST(year({t}) AS int) AS year, CAST(month({t}) AS int) AS month, CAST(day({t}) AS int) AS day, "
    "CAST(hour({t}) AS int) AS hour, CAST(minute({t}) AS int) AS minute, "
    "CAST(second({t}) AS int) AS second"
)


def shown(t: str = "ts") -> str:
    return SHOWN.format(t=t)


def parts(t: str = "ts") -> str:
    return PARTS.format(t=t)


def with_views(body: str, **extra: str) -> str:
    """The body behind the views and named parts it uses."""
    named = dict(VIEWS) | extra
    used: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", text):
            if name in named and name not in used:
                need(named[name])
                if name not in used:
                    used.append(name)

    need(body)
    if not used:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({named[n]})" for n in used) + "\n" + body


def entropy(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR regexp_full_match({c}, '\\s*') THEN 0.0::double ELSE "
        f"list_sum(list_transform(list_distinct(string_split({c}, '')), lambda ch: "
        f"-((length({c}) - length(replace({c}, ch, '')))::double / length({c})) * "
        f"log2((length({c}) - length(replace({c}, ch, '')))::double / length({c})))) END"
    )


def key(*columns: str) -> str:
    joined = " || ".join(
        f"coalesce('v' || length(CAST({c} AS varchar)) || ':' || CAST({c} AS varchar), 'n')" for c in columns)
    return f"('0x' || substring(sha256({joined}), 1, 15))::bigint"


def words(text: str, rules, default: str, all_words: bool = False) -> str:
    if not rules:
        return f"'{default}'"
    glue = " AND " if all_words else " OR "
    cases = " ".join(
        "WHEN " + glue.join(f"contains({text}, '{w}')" for w in ws) + f" THEN '{name}'"
        for name, ws in rules
    )
    return f"CASE {cases} ELSE '{default}' END"


# --- Features -----------------------------------------------------------------

DNS_FEATURES = f"""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ts_window_start, id_orig_h, vm_id,
  count(*) / 300.0::double AS query_rate, count(DISTINCT query) AS unique_queries,
  avg(length(query)) AS avg_query_len, avg({entropy('query')}) AS query_name_entropy
FROM v_dns GROUP BY ALL"""
NOTICE_FEATURES = """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ts_window_start, id_orig_h, vm_id,
  count(*) AS dns_tunneling_notices, avg(length(msg)) AS avg_notice_msg_len
FROM v_notice WHERE note = 'Custom::DNS_Tunneling' GROUP BY ALL"""
BASELINE = """
SELECT id_orig_h, 'QUERY_RATE' AS metric, round(avg(query_rate), 9) AS mean,
  round(stddev_samp(query_rate), 9) AS std_dev, TIMESTAMP '2024-01-31 00:00:00' AS last_updated
FROM f_dns WHERE ts_window_start >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {days} DAY
GROUP BY id_orig_h"""
F = {"f_dns": DNS_FEATURES, "f_notice": NOTICE_FEATURES}

# --- Incidents ----------------------------------------------------------------

IN_RANGE = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
PORT_PICK = (
    "CASE WHEN contains(port_text, ',') AND split_part(port_text, ',', 1) NOT IN ('80', '443') "
    "THEN split_part(port_text, ',', 2) ELSE split_part(port_text, ',', 1) END"
)
PACKETS = """
SELECT event_id, string_split(message, chr(9)) AS f FROM v_tshark_raw
WHERE len(string_split(message, chr(9))) = 6"""
PACKET_ROWS = """
SELECT p.event_id, date_trunc('second', e.ts) + to_microseconds(p.event_id % 1000000) AS frame_time,
  f[2] AS ip_src, f[3] AS ip_dst, f[4] AS udp_port, f[5] AS tcp_port, f[6] AS ip_proto
FROM packet_fields p JOIN events e USING (event_id)"""
JSON_NULL = "coalesce({v}, 'null')"


def text_or_none(c: str) -> str:
    return f"coalesce(CAST({c} AS varchar), 'None')"


def json_text(c: str) -> str:
    return f"coalesce('\"' || {c} || '\"', 'null')"


def json_number(c: str) -> str:
    return f"coalesce(CAST({c} AS varchar), 'null')"


I_DNS = f"""
SELECT ts AS event_time, 'DNS_Tunneling' AS attack_type,
  'Suspicious DNS tunneling traffic from ' || id_orig_h || ' to ' || id_resp_h || ' at ' || {shown()}
    || ' with query ' || asked AS description, id_orig_h AS src_ip, id_resp_h AS dst_ip,
  '{{"query":"' || asked || '","type":"DNS_Tunneling"}}' AS details
FROM (SELECT *, coalesce(nullif(regexp_extract(msg, 'query=([^\\s,]+)', 1), ''), 'unknown') AS asked
      FROM v_notice WHERE note = 'Custom::DNS_Tunneling' AND ts {IN_RANGE})"""
I_HTTP = f"""
SELECT ts AS event_time, 'Suspicious_HTTP' AS attack_type,
  'Suspicious HTTP traffic from ' || id_orig_h || ' to ' || id_resp_h || ' at ' || {shown()} || ': '
    || concat_ws(', ',
      CASE WHEN response_body_len > 1000000 THEN 'large response size (' || response_body_len || ' bytes)' END,
      CASE WHEN user_agent = '' THEN 'missing user agent' END,
      CASE WHEN status_code NOT IN (0, 200, 204) THEN 'unusual status code (' || status_code || ')' END)
    AS description, id_orig_h AS src_ip, id_resp_h AS dst_ip,
  '{{"response_body_len":' || {json_number('response_body_len')} || ',"user_agent":'
    || {json_text('user_agent')} || ',"status_code":' || {json_number('status_code')}
    || ',"type":"Suspicious_HTTP"}}' AS details
FROM v_http
WHERE (response_body_len > 1000000 OR user_agent = '' OR status_code NOT IN (200, 204)) AND ts {IN_RANGE}"""
I_EXFIL = f"""
SELECT ts AS event_time, 'Data_Exfiltration' AS attack_type,
  'Potential data exfiltration from ' || id_orig_h || ' to ' || id_resp_h || ' at ' || {shown()}
    || ': transferred ' || resp_bytes || ' bytes in ' || printf('%.2f', duration) || ' seconds'
    AS description, id_orig_h AS src_ip, id_resp_h AS dst_ip,
  '{{"resp_bytes":' || resp_bytes || ',"duration":' || duration || ',"type":"Data_Exfiltration"}}' AS details
FROM v_conn WHERE resp_bytes > 1000000 AND duration < 10 AND ts {IN_RANGE}"""
I_DOS = f"""
SELECT m AS event_time, 'TCP_DoS' AS attack_type,
  'TCP DoS attack detected at ' || {shown('m')} || ' from ' || id_orig_h || ' targeting ' || id_resp_h
    || ': ' || total_packets || ' packets sent, ' || s0_count || ' incomplete handshakes' AS description,
  id_orig_h AS src_ip, id_resp_h AS dst_ip,
  '{{"total_packets":' || total_packets || ',"s0_count":' || s0_count || ',"type":"TCP_DoS"}}' AS details
FROM (SELECT date_trunc('minute', ts) AS m, id_orig_h, id_resp_h, sum(orig_pkts) AS total_packets,
        sum(CASE WHEN conn_state = 'S0' THEN 1 ELSE 0 END) AS s0_count
      FROM v_conn WHERE proto = 'tcp' AND (duration < 1 OR duration IS NULL) AND ts {IN_RANGE}
      GROUP BY ALL)
WHERE total_packets > 1000 OR s0_count > 50"""
I_PORT = f"""
SELECT t AS event_time, 'Unauthorized_Access' AS attack_type,
  'Unauthorized access attempt from ' || src || ' to ' || dst || ' on port ' || {text_or_none('port')}
    || ' at ' || {shown('t')} AS description, src AS src_ip, dst AS dst_ip,
  '{{"dst_port":' || {json_number('port')} || ',"type":"Unauthorized_Access"}}' AS details
FROM (SELECT t, src, dst, CAST(TRY_CAST({PORT_PICK} AS double) AS int) AS port FROM (
  SELECT ts AS t, id_orig_h AS src, id_resp_h AS dst, CAST(id_resp_p AS varchar) AS port_text
  FROM v_conn WHERE id_resp_p NOT IN (80, 443, 53) AND ts {IN_RANGE}
  UNION
  SELECT frame_time, ip_src, ip_dst, tcp_port FROM packet_rows
  WHERE tcp_port NOT IN ('80', '443', '80,80', '443,443') AND frame_time {IN_RANGE}))"""
I_FLOOD = f"""
SELECT ts AS event_time, 'SYN_Flood' AS attack_type,
  'Potential SYN flood from ' || id_orig_h || ' to ' || id_resp_h || ' at ' || {shown()} || ': '
    || orig_pkts || ' packets' AS description, id_orig_h AS src_ip, id_resp_h AS dst_ip,
  '{{"orig_pkts":' || orig_pkts || ',"type":"SYN_Flood"}}' AS details
FROM v_conn WHERE conn_state = 'S0' AND orig_pkts > 500 AND duration < 0.5 AND ts {IN_RANGE}"""
I_STRAIN = f"""
SELECT ts AS event_time, 'System_Strain' AS attack_type,
  'System strain detected at ' || {shown()} || ': CPU ' || printf('%.2f', cpu_user) || '%, Memory '
    || CASE WHEN mem_total = 0 THEN 'None' ELSE printf('%.2f', mem_used / mem_total * 100) END || '%'
    AS description, CAST(NULL AS varchar) AS src_ip, CAST(NULL AS varchar) AS dst_ip,
  '{{"cpu_user":' || cpu_user || ',"mem_percent":'
    || CASE WHEN mem_total = 0 THEN 'null' ELSE CAST(mem_used / mem_total * 100 AS varchar) END
    || ',"type":"System_Strain"}}' AS details
FROM v_metrics
WHERE (cpu_user > 80 OR CASE WHEN mem_total = 0 THEN NULL ELSE mem_used / mem_total END > 0.9)
  AND cpu_user IS NOT NULL AND mem_used IS NOT NULL AND mem_total IS NOT NULL AND ts {IN_RANGE}"""
RULES = {
    "rule_dns_tunneling": "i_dns", "rule_syn_flood": "i_flood", "rule_system_strain": "i_strain",
    "rule_suspicious_http": "i_http", "rule_exfiltration": "i_exfil", "rule_tcp_dos": "i_dos",
    "rule_unauthorized": "i_port",
}
I = {  # noqa: E741
    "packet_fields": PACKETS, "packet_rows": PACKET_ROWS,
    "i_dns": I_DNS, "i_http": I_HTTP, "i_exfil": I_EXFIL, "i_dos": I_DOS, "i_port": I_PORT,
    "i_flood": I_FLOOD, "i_strain": I_STRAIN,
}
I["incidents"] = "\nUNION ALL\n".join(f"SELECT * FROM {n}" for n in RULES.values())
ORDER = ", ".join(f"{c} NULLS FIRST" for c in
                  ("event_time", "src_ip", "dst_ip", "description", "details"))
I["earliest"] = "\nUNION ALL\n".join(
    f"(SELECT * FROM {n} ORDER BY {ORDER} LIMIT 100)" for n in RULES.values()
)
I["addresses"] = """
SELECT attack_type, role, ip, count(*) AS incidents FROM (
  SELECT attack_type, 'source' AS role, src_ip AS ip FROM incidents
  UNION ALL SELECT attack_type, 'destination', dst_ip FROM incidents)
WHERE ip IS NOT NULL GROUP BY ALL"""


def triage(table: str, time: str, columns: list[str], condition: str) -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in [time, *columns])
    stamp = f"{time} AS timestamp" if time == "ts" else time
    return with_views(
        f"SELECT {stamp}, {', '.join(columns)} FROM {table} "
        f"WHERE ({condition}) AND {time} {IN_RANGE} ORDER BY {order} LIMIT 10", **I
    )


def listing(source: str, value: str) -> str:
    """First three values and dots, per attack type."""
    return (
        f"SELECT attack_type, count(*) AS n, array_to_string(list_sort(list({value}))[1:3], ', ') "
        f"|| CASE WHEN count(*) > 3 THEN ', ...' ELSE '' END AS listed FROM {source} GROUP BY ALL"
    )


def detail(name: str) -> str:
    return f"TRY_CAST(json_extract_string(details, '$.{name}') AS double)"


ROLLUP = f"""
SELECT t.attack_type, incident_count, first_time, last_time,
  strftime(first_time, '%Y-%m-%d %H') || ' to ' || strftime(last_time, '%Y-%m-%d %H') AS time_range,
  coalesce(s.n, 0) AS source_ip_count, coalesce(s.listed, 'None') AS source_ips,
  coalesce(d.n, 0) AS destination_ip_count, coalesce(d.listed, 'None') AS destination_ips,
  CASE WHEN max_cpu IS NOT NULL AND max_memory IS NOT NULL
    THEN 'Max CPU: ' || printf('%.2f', max_cpu) || '%, Max Memory: ' || printf('%.2f', max_memory) || '%'
    WHEN p.listed IS NOT NULL THEN 'Ports targeted: ' || p.listed END AS details
FROM (SELECT attack_type, count(*) AS incident_count, min(event_time) AS first_time,
        max(event_time) AS last_time, max({detail('cpu_user')}) AS max_cpu,
        max({detail('mem_percent')}) AS max_memory FROM incidents GROUP BY ALL) t
LEFT JOIN ({listing("(SELECT * FROM addresses WHERE role = 'source')", 'ip')}) s USING (attack_type)
LEFT JOIN ({listing("(SELECT * FROM addresses WHERE role = 'destination')", 'ip')}) d USING (attack_type)
LEFT JOIN ({listing(f"(SELECT DISTINCT attack_type, CAST({detail('dst_port')} AS int) AS port FROM incidents WHERE {detail('dst_port')} IS NOT NULL)", 'port')}) p USING (attack_type)"""

SCORED = """
SELECT ts_window_start, id_orig_h, vm_id, 'DNS_Tunneling' AS anomaly_type, round(score, 6) AS score, fired
FROM (SELECT f_dns.ts_window_start, f_dns.id_orig_h, f_dns.vm_id,
  CASE WHEN avg_query_len > 50 THEN 0.4::double ELSE 0.0::double END
  + CASE WHEN dns_tunneling_notices > 3 THEN 0.4::double ELSE 0.0::double END
  + CASE WHEN query_name_entropy > 4.0 THEN 0.2::double ELSE 0.0::double END AS score,
  concat_ws(', ', CASE WHEN avg_query_len > 50 THEN 'High AVG_QUERY_LEN' END,
    CASE WHEN dns_tunneling_notices > 3 THEN 'DNS_TUNNELING_NOTICES' END,
    CASE WHEN query_name_entropy > 4.0 THEN 'QUERY_NAME_ENTROPY' END) AS fired
  FROM f_dns LEFT JOIN f_notice ON f_dns.ts_window_start = f_notice.ts_window_start
    AND f_dns.id_orig_h = f_notice.id_orig_h AND f_dns.vm_id = f_notice.vm_id)
WHERE score > 0"""

ORACLES: dict[str, str] = {
    "dns_features": with_views(
        "SELECT ts_window_start, id_orig_h, vm_id, round(query_rate, 6) AS query_rate, unique_queries, "
        "round(avg_query_len, 6) AS avg_query_len, round(query_name_entropy, 6) AS query_name_entropy "
        "FROM f_dns", **F),
    "notice_features": with_views(
        "SELECT ts_window_start, id_orig_h, vm_id, dns_tunneling_notices, "
        "round(avg_notice_msg_len, 6) AS avg_notice_msg_len FROM f_notice", **F),
    "dns_baseline": with_views(BASELINE.format(days=31), **F),
    "dns_baseline_week": with_views(BASELINE.format(days=7), **F),
    "dns_baseline_states": with_views(BASELINE.format(days=7), **F),
    "dns_tunneling_score": with_views(SCORED, **F),
    "stored_scores": with_views(
        f"SELECT id_orig_h, vm_id, anomaly_type, score FROM ({SCORED}) WHERE ts_window_start >= TIMESTAMP '2024-01-10'",
        **F),
    "url_entropy": f"SELECT page_id, round({entropy('url')}, 9) AS entropy FROM pages",
    "page_entropy": f"SELECT page_id, round({entropy('html')}, 9) AS entropy FROM pages",
    **{name: with_views(f"SELECT * FROM {part}", **I) for name, part in RULES.items()},
    "incidents_all": with_views("SELECT * FROM incidents", **I),
    "incidents_earliest": with_views("SELECT * FROM earliest", **I),
    "triage_notice": triage("v_notice", "ts", ["id_orig_h", "id_resp_h", "msg", "note"],
                            "note IN ('Custom::DNS_Tunneling', 'PacketFilter::Dropped_Packets')"),
    "triage_http": triage(
        "v_http", "ts", ["id_orig_h", "id_resp_h", "response_body_len", "user_agent", "status_code"],
        "response_body_len > 1000000 OR user_agent = '' OR status_code NOT IN (200, 204)"),
    "triage_conn": triage(
        "v_conn", "ts", ["id_orig_h", "id_resp_h", "resp_bytes", "duration", "id_resp_p"],
        "resp_bytes > 1000000 OR id_resp_p NOT IN (80, 443, 53) OR conn_state = 'S0'"),
    "triage_capture_loss": triage("v_loss", "ts", ["percent_lost"], "percent_lost > 50"),
    "triage_dns": triage("v_dns", "ts", ["id_orig_h", "id_resp_h", "query"], "length(query) > 50"),
    "triage_tshark": triage("packet_rows", "frame_time", ["ip_src", "ip_dst", "tcp_port"],
                            "tcp_port NOT IN ('80', '443', '80,80', '443,443')"),
    "incident_rollup": with_views(ROLLUP, **I),
    "incident_addresses": with_views("SELECT * FROM addresses", **I),
    "alert_messages": with_views(f"""
SELECT attack_type AS type, description, coalesce(src_ip, 'None') AS src_ip,
  coalesce(dst_ip, 'None') AS dst_ip, '{END}' AS timestamp, attack_type AS detail_type,
  json_extract_string(details, '$.query') AS detail_query,
  CAST(json_extract_string(details, '$.dst_port') AS int) AS detail_port,
  CAST(json_extract_string(details, '$.orig_pkts') AS bigint) AS detail_pkts FROM incidents""", **I),
    "incident_text": with_views(f"""
SELECT 'Attack Type: ' || attack_type || chr(10) || 'Description: ' || description || chr(10)
  || 'Source IP: ' || {text_or_none('src_ip')} || chr(10) || 'Destination IP: ' || {text_or_none('dst_ip')}
  || chr(10) || 'Details: ' || details || chr(10) || 'Timestamp: {END}' AS text FROM incidents""", **I),
    "asset_attribution": with_views("""
SELECT attack_type, event_time, description, coalesce(s.name, d.name, 'Lubuntu VM') AS asset_name,
  coalesce(s.short_name, d.short_name, 'lubuntu') AS asset_short_name,
  coalesce(s.ip_address, d.ip_address, '10.0.0.1') AS asset_ip,
  CASE WHEN s.name IS NOT NULL THEN 'source' WHEN d.name IS NOT NULL THEN 'destination' ELSE 'default' END
    AS matched_by
FROM incidents LEFT JOIN v_assets s ON src_ip = s.ip_address LEFT JOIN v_assets d ON dst_ip = d.ip_address""", **I),
    "attack_type_in_text": (
        "SELECT doc_id, CASE WHEN length(text) > 0 AND NOT contains(lower(text), 'no anomalies') THEN "
        + words("lower(text)", fv.ATTACK_TEXT_RULES, fv.ATTACK_TEXT_DEFAULT)
        + " END AS attack_type FROM documents"),
}

# --- Records --------------------------------------------------------------------

R = {
    "numbered": """
SELECT *, max(CASE WHEN starts_with(trim(line), 'Attack Type:') THEN line_no END)
  OVER (PARTITION BY file ORDER BY line_no) AS record_no FROM v_lines""",
    "fields": r"""
SELECT file, record_no, line_no, t,
  CASE WHEN starts_with(t, 'Attack Type:') THEN 'attack_type'
    WHEN regexp_matches(t, '^-\s+.+?:\s+.*$') THEN replace(lower(regexp_extract(t, '^-\s+(.+?):\s', 1)), ' ', '_')
    ELSE 'details' END AS key,
  CASE WHEN starts_with(t, 'Attack Type:') THEN trim(substr(t, 13))
    WHEN regexp_matches(t, '^-\s+.+?:\s+.*$') THEN trim(regexp_extract(t, '^-\s+.+?:\s+(.*)$', 1))
    ELSE '; ' || t END AS value,
  NOT starts_with(t, 'Attack Type:') AND NOT regexp_matches(t, '^-\s+.+?:\s+.*$') AS loose
FROM (SELECT *, trim(line) AS t FROM numbered WHERE record_no IS NOT NULL)""",
    "kept": """
SELECT * FROM (SELECT *, max(CASE WHEN NOT loose THEN line_no END)
  OVER (PARTITION BY file, record_no, key) AS last_set FROM fields)
WHERE last_set IS NULL OR line_no >= last_set""",
    "keyed": """
SELECT file, record_no, key, string_agg(value, '' ORDER BY line_no) AS value FROM kept GROUP BY ALL""",
}
ORACLES |= {
    "record_assembly": with_views("""
SELECT file, record_no, max(value) FILTER (key = 'attack_type') AS attack_type,
  max(value) FILTER (key = 'incident_count') AS incident_count,
  max(value) FILTER (key = 'source_ips') AS source_ips, max(value) FILTER (key = 'details') AS details
FROM keyed GROUP BY ALL""", **R),
    "record_fields": with_views("""
SELECT file, key, count(*) AS n, count(DISTINCT record_no) AS n_records,
  CAST(sum(length(value)) AS bigint) AS value_chars FROM fields GROUP BY ALL""", **R),
}

# --- Logs -----------------------------------------------------------------------

#: True time of an ISO line: wall time in its offset.
ISO_TIME = (
    "date_trunc('second', e.ts) + to_microseconds(event_id % 1000000) "
    "- CASE WHEN event_id % 2 = 0 THEN INTERVAL 1 HOUR ELSE -INTERVAL 5 HOUR END"
)
AUTH = {
    "auth_time": f"""
SELECT a.*, {ISO_TIME} AS log_timestamp, u.user_id FROM v_auth_raw a JOIN events e USING (event_id)
JOIN (SELECT event_id, user_id FROM events) u USING (event_id)""",
    "login_rows": """
SELECT event_id, hostname, vm_id, message, log_timestamp,
  CASE WHEN k < 5 THEN 'sshd' WHEN k = 5 THEN 'sudo' WHEN k = 6 THEN 'CRON' ELSE 'systemd' END AS process,
  CASE k WHEN 0 THEN CAST(1000 + event_id % 9000 AS varchar) WHEN 1 THEN CAST(1000 + event_id % 9000 AS varchar)
    WHEN 2 THEN '77' WHEN 3 THEN '78' WHEN 4 THEN '79' WHEN 5 THEN NULL
    WHEN 6 THEN CAST(event_id AS varchar) ELSE '1' END AS pid,
  CASE WHEN k IN (0, 1, 4) THEN 'sshd_login_fail' WHEN k = 2 THEN 'sshd_login_success'
    WHEN k = 3 THEN 'sshd_login_success_pubkey' ELSE 'other' END AS event_type,
  CASE WHEN k = 0 THEN 'root' WHEN k < 5 THEN 'u' || user_id END AS sshd_user,
  CASE WHEN k IN (0, 1) THEN '203.0.113.' || (user_id % 250) WHEN k IN (2, 3) THEN '10.0.0.9'
    WHEN k = 4 THEN '203.0.113.7' END AS sshd_src_ip,
  CASE WHEN k IN (0, 1) THEN CAST(40000 + event_id % 20000 AS varchar) WHEN k = 2 THEN '50000'
    WHEN k = 3 THEN '50001' END AS sshd_port,
  CASE WHEN k IN (0, 1, 2, 4) THEN 'password' WHEN k = 3 THEN 'publickey' END AS sshd_auth_method,
  CASE WHEN k IN (0, 1, 4) THEN false WHEN k IN (2, 3) THEN true END AS sshd_success
FROM (SELECT *, event_id % 8 AS k FROM auth_time)""",
}


def stamped(view: str, process: str, pid: str, message: str, source: str, time: str = ISO_TIME,
            host: str | None = None) -> str:
    """Common log rows, with the captures written as DuckDB expressions."""
    host = host or f"{view}.hostname"
    return with_views(f"""
SELECT event_id, {time} AS timestamp, {host} AS hostname, {process} AS process, {pid} AS pid,
  {words('message', fv.EVENT_RULES[source], fv.EVENT_DEFAULTS[source])} AS event_type,
  {words('message', fv.SEVERITY_RULES[source], fv.SEVERITY_DEFAULTS[source])} AS severity,
  {message} AS message, '{fv.LOG_SOURCE_NAMES.get(source, source)}' AS log_source
FROM {view} JOIN events e USING (event_id)""")


#: What follows the host name in a line.
REST = r"regexp_replace(message, '^\S+\s+\S+\s+', '')"
ORACLES |= {
    "auth_parse": with_views(
        "SELECT event_id, hostname, vm_id, log_timestamp, process, pid, event_type, sshd_user, sshd_src_ip, "
        f"sshd_port, sshd_auth_method, sshd_success, {parts('log_timestamp')} FROM login_rows", **AUTH),
    "failed_logins": with_views(
        "SELECT log_timestamp AS timestamp, hostname, vm_id, event_type, message AS raw_message, "
        "sshd_src_ip AS source_ip, sshd_port AS source_port FROM login_rows WHERE event_type = 'sshd_login_fail'",
        **AUTH),
    "login_geo": with_views("""
SELECT event_type, sshd_src_ip, CASE WHEN near THEN 1.0::double END AS src_latitude,
  CASE WHEN near THEN 2.0::double END AS src_longitude,
  CASE WHEN near THEN (SELECT r_name FROM region WHERE r_regionkey = 0) END AS src_city, count(*) AS n
FROM (SELECT *, starts_with(sshd_src_ip, '203.0.113.')
        AND CAST(split_part(sshd_src_ip, '.', 4) AS int) < 128 AS near FROM login_rows)
GROUP BY event_type, sshd_src_ip, near""", **AUTH),
    "sudo_commands": with_views("""
SELECT event_id, command, regexp_matches(command, '(?i)rm\\s+-rf\\s+/|reboot|shutdown|init\\s+0|mkfs\\.|dd\\s+.*of=/dev/')
  AS is_dangerous
FROM (SELECT event_id, regexp_extract(message, 'COMMAND=(.+)$', 1) AS command FROM v_auth_raw
      WHERE contains(message, 'COMMAND='))"""),
    "syslog_rows": stamped(
        "v_syslog_raw", rf"regexp_extract({REST}, '^(\S+?)(?:\[\d+\])?:', 1)",
        r"regexp_extract(message, '\[(\d+)\]', 1)", rf"regexp_extract({REST}, '^\S+:\s+(.+)', 1)", "syslog"),
    "kern_rows": stamped(
        "v_kern_raw", "'kernel'", r"regexp_extract(message, 'Process ID:\s+(\d+)', 1)",
        "CASE WHEN contains(message, 'kernel: 10:11:12.123456') THEN "
        r"regexp_extract(message, 'kernel: \S+\s+\S+\s+(.+)', 1) ELSE '' END", "kern"),
    "ufw_rows": stamped("v_ufw_raw", "'kernel'", "CAST(NULL AS varchar)",
                        "split_part(message, '[UFW BLOCK] ', 2)", "ufw"),
    "dmesg_rows": stamped(
        "v_dmesg_raw", "'kernel'", "CAST(NULL AS varchar)", "split_part(message, 'kernel: ', 2)", "dmesg",
        time="TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(event_id * 1000000 + event_id * 7 % 1000000)",
        host="'unknown'"),
    "auth_rows": stamped(
        "v_auth_raw", "CASE WHEN event_id % 8 < 5 THEN 'sshd' WHEN event_id % 8 = 5 THEN 'sudo' "
        "WHEN event_id % 8 = 6 THEN 'CRON' ELSE 'systemd' END",
        "CASE event_id % 8 WHEN 0 THEN CAST(1000 + event_id % 9000 AS varchar) WHEN 1 THEN "
        "CAST(1000 + event_id % 9000 AS varchar) WHEN 2 THEN '77' WHEN 3 THEN '78' WHEN 4 THEN '79' "
        "WHEN 5 THEN '' WHEN 6 THEN CAST(event_id AS varchar) ELSE '1' END",
        rf"regexp_extract({REST}, '^\S+:\s+(.*)', 1)", "auth"),
    "tailed_lines": with_views(r"""
SELECT strptime(substr(value, 1, 19), '%Y-%m-%d %H:%M:%S') AS time,
  split_part(value, ' ', 3) AS level, regexp_extract(value, '^\S+ \S+ \S+ (.+)$', 1) AS message
FROM v_tailed WHERE regexp_matches(value, '^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [A-Z]+ .+$')"""),
    "log_routing": with_views("""
SELECT event_id, source AS log_source,
  CASE WHEN host_group = 'lubuntu' THEN CASE source WHEN 'ufw' THEN 'lubuntu_firewall' ELSE 'lubuntu_' || source END
    WHEN source IN ('syslog', 'kern', 'auth') THEN 'kali_' || source END AS topic
FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN 'syslog' WHEN 1 THEN 'kern' WHEN 2 THEN 'hardware' WHEN 3 THEN 'ufw'
        WHEN 4 THEN 'auth' WHEN 5 THEN 'audit' END AS source FROM v_files)"""),
    "ip_checks": with_views("""
SELECT event_id, ip, v4 AS is_ipv4, v4 OR contains(ip, ':') AS is_ip,
  coalesce(v4 AND (o[1] = '10' OR o[1] = '127' OR (o[1] = '172' AND TRY_CAST(o[2] AS int) BETWEEN 16 AND 31)
    OR (o[1] = '192' AND o[2] = '168')), false) AS is_private,
  CASE WHEN v4 THEN TRY_CAST(o[1] AS bigint) * 16777216 + TRY_CAST(o[2] AS bigint) * 65536
    + TRY_CAST(o[3] AS bigint) * 256 + TRY_CAST(o[4] AS bigint) END AS number
FROM (SELECT *, coalesce(TRY_CAST(o[1] AS int) <= 255 AND TRY_CAST(o[2] AS int) <= 255
        AND TRY_CAST(o[3] AS int) <= 255 AND TRY_CAST(o[4] AS int) <= 255, false) AS v4
      FROM (SELECT *, string_split(ip, '.') AS o FROM v_addresses))"""),
}

# --- Packets and metrics ----------------------------------------------------------


def service_map(services: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{p}': '{s}'" for p, s in services.items()) + "}"


P = {
    **{n: I[n] for n in ("packet_fields", "packet_rows")},
    "served": f"""
SELECT *, list_filter(list_transform(string_split(tcp_port, ','),
    lambda p: ({service_map(fv.TCP_SERVICES)})[p]), lambda s: s IS NOT NULL) AS tcp,
  list_filter(list_transform(string_split(udp_port, ','),
    lambda p: ({service_map(fv.UDP_SERVICES)})[p]), lambda s: s IS NOT NULL) AS udp FROM packet_rows""",
    "classed": """
SELECT *, coalesce(list_filter(tcp, lambda s: s IN ('HTTP', 'HTTPS', 'SSH'))[-1], tcp[1], udp[1], 'OTHER')
  AS traffic_type FROM served""",
    "metric_rows": """
SELECT ts, CAST(raw_json::json->>'user' AS double) AS cpu_user, CAST(raw_json::json->>'system' AS double) AS cpu_system,
  CAST(raw_json::json->>'iowait' AS double) AS cpu_iowait, CAST(raw_json::json->>'idle' AS double) AS cpu_idle,
  CAST(raw_json::json->>'used' AS double) AS mem_used, CAST(raw_json::json->>'total' AS double) AS mem_total,
  CAST(raw_json::json->>'rkB_s' AS double) AS disk_read_kbs, CAST(raw_json::json->>'wkB_s' AS double) AS disk_write_kbs,
  raw_json::json->>'hostname' AS hostname, raw_json::json->>'vm_id' AS vm_id
FROM (SELECT * FROM v_metrics_raw WHERE starts_with(raw_json, '{'))""",
}
MEASURES = ["cpu_user", "cpu_system", "cpu_iowait", "cpu_idle", "disk_read_kbs", "disk_write_kbs",
            "mem_used", "mem_total"]


def metric_windows(width: str, where: str = "true") -> str:
    firsts = ", ".join(f"arg_min({m}, ts) FILTER ({m} IS NOT NULL) AS {m}" for m in MEASURES)
    return with_views(f"""
SELECT {parts('timestamp')}, * FROM (
  SELECT time_bucket(INTERVAL {width}, ts) AS timestamp, hostname, vm_id, {firsts}
  FROM metric_rows GROUP BY time_bucket(INTERVAL {width}, ts), hostname, vm_id)
WHERE {where}""", **P)


def geo_join(prefix: str, address: str) -> str:
    octets = f"string_split({address}, '.')"
    number = " + ".join(f"CAST({octets}[{i + 1}] AS bigint) * {256 ** (3 - i)}" for i in range(4))
    return f"LEFT JOIN v_geo {prefix}_g ON ({number}) BETWEEN {prefix}_g.ip_lo AND {prefix}_g.ip_hi"


def places(prefix: str) -> str:
    return ", ".join(f"{prefix}_g.{c} AS {prefix}_{c}" for c in ("latitude", "longitude", "city"))


def network_table(view: str, *columns: str) -> str:
    return with_views(
        f"SELECT ts AS timestamp, {parts()}, id_orig_h, id_resp_h, {places('orig')}, {places('resp')}, "
        f"hostname, vm_id, {', '.join(columns)} FROM {view} "
        f"{geo_join('orig', 'id_orig_h')} {geo_join('resp', 'id_resp_h')}"
    )


#: Groups of both families written out; the view's short forms have their gap before the last group.
def whole_key(c: str) -> str:
    octet = f"string_split({c}, '.')"
    tail = f"string_split({c}, ':')[-1]"
    four = " || ".join(f"lpad(to_hex(CAST({octet}[{i}] AS bigint)), 2, '0')" for i in range(1, 5))
    filled = f"CASE WHEN {tail} = '' THEN '0000' ELSE lpad({tail}, 4, '0') END"
    full = f"array_to_string(list_transform(string_split({c}, ':'), lambda g: lpad(g, 4, '0')), '')"
    return (f"lower(CASE WHEN {c} LIKE '%.%' THEN repeat('0', 20) || 'ffff' || {four} "
            f"WHEN {c} LIKE '%::%' THEN '20010db8' || repeat('0', 20) || {filled} ELSE {full} END)")


NESTED = f"""
SELECT event_id, ip, latitude AS at_latitude, longitude AS at_longitude, city AS at_city FROM (
  SELECT b.event_id, b.ip, n.*, row_number() OVER (
    PARTITION BY b.event_id ORDER BY {whole_key('n.ip_lo')} DESC, {whole_key('n.ip_hi')}) AS r
  FROM v_both b LEFT JOIN v_nested n
  ON {whole_key('b.ip')} BETWEEN {whole_key('n.ip_lo')} AND {whole_key('n.ip_hi')})
WHERE r = 1"""


SEVERITY = ("CASE WHEN percent_lost < 5 THEN 'Low' WHEN percent_lost BETWEEN 5 AND 10 THEN 'Medium' "
            "WHEN percent_lost > 10 THEN 'High' ELSE 'Unknown' END")
TABLE_CONN = network_table("v_conn", "id_orig_p", "id_resp_p", "proto", "duration", "resp_bytes",
                           "conn_state", "orig_pkts")
ORACLES |= {
    "tshark_parse": with_views(
        "SELECT event_id, frame_time, ip_src, ip_dst, udp_port, tcp_port, ip_proto, "
        f"{parts('frame_time')}, traffic_type FROM classed", **P),
    "packet_table": with_views(
        f"SELECT frame_time, ip_src, ip_dst, udp_port, tcp_port, ip_proto, {places('src')}, {places('dst')}, "
        f"{parts('frame_time')}, traffic_type FROM classed {geo_join('src', 'ip_src')} "
        f"{geo_join('dst', 'ip_dst')}", **P),
    "traffic_class": with_views(
        "SELECT traffic_type, count(*) AS packets FROM classed GROUP BY ALL", **P),
    "metrics_parse": with_views("SELECT * RENAME (ts AS timestamp) FROM metric_rows", **P),
    "metrics_10s": metric_windows("10 SECOND"),
    "metrics_1h": metric_windows("1 HOUR"),
    "stream_metrics": metric_windows("10 SECOND"),
    "capture_loss_severity": with_views(
        f"SELECT event_id, round(percent_lost, 6) AS percent_lost, {SEVERITY} AS loss_severity FROM v_loss"),
    "table_conn": TABLE_CONN,
    "stream_network_table": TABLE_CONN,
    "table_dns": network_table("v_dns", "uid", "id_resp_p", "proto", "query", "qtype_name"),
    "table_http": network_table("v_http", "uid", "response_body_len", "user_agent", "status_code"),
    "table_notice": network_table("v_notice", "uid", "note", "msg"),
    "table_ssl": network_table("v_ssl", "uid", "id_resp_p", "version", "server_name", "established"),
    "table_capture_loss": with_views(
        f"SELECT ts AS timestamp, {parts()}, peer, gaps, acks, round(percent_lost, 6) AS percent_lost, "
        f"{SEVERITY} AS loss_severity, hostname, vm_id FROM v_loss"),
    "geo_enrich": with_views(
        f"SELECT event_id, id_orig_h, id_resp_h, {places('orig')}, {places('resp')} FROM v_conn "
        f"{geo_join('orig', 'id_orig_h')} {geo_join('resp', 'id_resp_h')}"),
}

# --- Star schema --------------------------------------------------------------------

WANTED = ["uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", "query", "note",
          "status_code", "version", "server_name", "peer", "conn_state", "percent_lost",
          "loss_severity", "hostname", "vm_id"]
TEXTS = [c for c in WANTED if c not in ("id_orig_p", "id_resp_p", "status_code", "percent_lost")]
HAS = {
    "zeek_capture_loss": ("v_loss", ["peer", "percent_lost", "loss_severity"]),
    "zeek_conn": ("v_conn", ["uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", "conn_state"]),
    "zeek_dns": ("v_dns", ["uid", "id_orig_h", "id_resp_h", "id_resp_p", "proto", "query"]),
    "zeek_http": ("v_http", ["uid", "id_orig_h", "id_resp_h", "status_code"]),
    "zeek_notice": ("v_notice", ["uid", "id_orig_h", "id_resp_h", "note"]),
    "zeek_ssl": ("v_ssl", ["uid", "id_orig_h", "id_resp_h", "id_resp_p", "version", "server_name"]),
}


def united(*topics: str) -> str:
    def column(topic: str, name: str) -> str:
        has = HAS[topic][1]
        if name in ("hostname", "vm_id"):
            return name
        if name == "loss_severity" and name in has:
            return f"{SEVERITY} AS {name}"
        if name in has:
            return name
        kind = "varchar" if name in TEXTS else "double" if name == "percent_lost" else "int"
        return f"CAST(NULL AS {kind}) AS {name}"

    return "\nUNION ALL\n".join(
        f"SELECT event_id, ts, '{t}' AS log_type, {', '.join(column(t, c) for c in WANTED)} FROM {HAS[t][0]}"
        for t in topics
    )


def star(*topics: str) -> dict[str, str]:
    return {
        "united": united(*topics),
        "ends": """
SELECT id_orig_h AS ip_address, id_orig_p AS port, true AS is_source, false AS is_destination FROM united
UNION ALL SELECT id_resp_h, id_resp_p, false, true FROM united""",
        "d_time": f"SELECT DISTINCT ts AS timestamp, {parts()}, {key('ts')} AS time_id FROM united",
        "d_host": f"SELECT DISTINCT hostname, vm_id, {key('hostname', 'vm_id')} AS host_id FROM united",
        "d_entity": f"""
SELECT ip_address, port, bool_or(is_source) AS is_source, bool_or(is_destination) AS is_destination,
  {key('ip_address', 'port')} AS network_entity_id
FROM ends WHERE ip_address IS NOT NULL GROUP BY ip_address, port""",
        "facts": f"""
SELECT DISTINCT {key('uid', 'ts', 'log_type', 'hostname', 'vm_id', 'peer')} AS event_id, {key('ts')} AS time_id,
  {key('hostname', 'vm_id')} AS host_id,
  CASE WHEN id_orig_h IS NOT NULL THEN {key('id_orig_h', 'id_orig_p')} END
    AS source_network_entity_id,
  CASE WHEN id_resp_h IS NOT NULL THEN {key('id_resp_h', 'id_resp_p')} END
    AS dest_network_entity_id,
  uid, log_type, proto, CAST(NULL AS varchar) AS service, CAST(year(ts) AS int) AS year,
  CAST(month(ts) AS int) AS month, CAST(day(ts) AS int) AS day, query, note,
  CAST(status_code AS varchar) AS status_code, server_name, peer, conn_state FROM united""",
    }


ALL = star(*HAS)
ORACLES |= {
    "zeek_union": with_views(
        "SELECT log_type, uid, id_orig_h, id_resp_h, id_resp_p, proto, query, note, status_code, version, "
        "round(percent_lost, 6) AS percent_lost, loss_severity, hostname, vm_id FROM united", **ALL),
    "dim_time": with_views("SELECT * FROM d_time", **ALL),
    "dim_host": with_views("SELECT * FROM d_host", **ALL),
    "dim_network_entity": with_views(
        "SELECT d_entity.*, at_g.latitude, at_g.longitude, at_g.city FROM d_entity "
        + geo_join("at", "ip_address"), **ALL),
    "fact_events": with_views("SELECT * FROM facts", **ALL),
    "fact_by_join": with_views("SELECT * FROM facts", **ALL),
    "stream_star": with_views("""
SELECT 'dim_time' AS table_name, time_id AS key, CAST(NULL AS double) AS latitude FROM d_time
UNION ALL SELECT 'dim_host', host_id, NULL FROM d_host
UNION ALL SELECT 'dim_network_entity', network_entity_id, at_g.latitude FROM d_entity """
        + geo_join("at", "ip_address") + """
UNION ALL SELECT 'fact_zeek_events', event_id, NULL FROM facts""", **ALL),
    "stream_compacted": TABLE_CONN,
    "stream_left_join": with_views("""
SELECT c.ts AS timestamp, event_id, c.id_orig_h, asked_by FROM v_conn c LEFT JOIN (
  SELECT DISTINCT date_trunc('hour', ts) AS hour, id_orig_h, vm_id AS asked_by FROM v_dns) d
ON date_trunc('hour', c.ts) = d.hour AND c.id_orig_h = d.id_orig_h"""),
    "stream_dedupe": with_views(
        f"SELECT DISTINCT hostname, vm_id, {key('hostname', 'vm_id')} AS host_id FROM v_conn"),
    "stream_hosts": with_views(
        f"SELECT DISTINCT hostname, vm_id, {key('hostname', 'vm_id')} AS host_id FROM v_conn"),
    "stream_dns_features": with_views(
        "SELECT ts_window_start, id_orig_h, vm_id, round(query_rate, 6) AS query_rate, unique_queries, "
        "round(avg_query_len, 6) AS avg_query_len, round(query_name_entropy, 6) AS query_name_entropy "
        "FROM f_dns", **F),
    "stream_archive": with_views("""
SELECT topic, CAST(event_id % 3 AS int) AS partition, event_id, file FROM (
  SELECT *, CASE WHEN host_group = 'lubuntu'
    THEN CASE source WHEN 'ufw' THEN 'lubuntu_firewall' ELSE 'lubuntu_' || source END
    WHEN source IN ('syslog', 'kern', 'auth') THEN 'kali_' || source END AS topic
  FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN 'syslog' WHEN 1 THEN 'kern' WHEN 2 THEN 'hardware'
          WHEN 3 THEN 'ufw' WHEN 4 THEN 'auth' WHEN 5 THEN 'audit' END AS source FROM v_files))
WHERE topic IS NOT NULL"""),
    "incremental_sweep": with_views("""
SELECT CASE WHEN event_time < TIMESTAMP '2024-01-09 23:00:00' THEN TIMESTAMP '2024-01-09 23:00:00'
    WHEN event_time < TIMESTAMP '2024-01-19 23:00:00' THEN TIMESTAMP '2024-01-19 23:00:00'
    ELSE TIMESTAMP '2024-01-31 00:00:00' END AS timestamp,
  attack_type, description, src_ip, dst_ip FROM incidents""", **I),
    "late_sweep": with_views(
        "SELECT date_trunc('minute', event_time) AS minute, attack_type, description, src_ip, dst_ip FROM incidents", **I),
    # --- Tables and SQL ---
    "geo_nested": with_views(NESTED),
    "geo_large": with_views(NESTED),
    "quarantine": with_views("""
SELECT 'bad' AS kind, coalesce(value, 'null') AS bad_text, count(*) AS n FROM v_mixed
WHERE value IS NULL OR value NOT LIKE '{"ts"%' GROUP BY ALL
UNION ALL SELECT 'good', NULL, count(*) FROM v_mixed WHERE value LIKE '{"ts"%'"""),
    "time_range": with_views(
        "SELECT event_id, ts AS timestamp, CAST(year(ts) AS int) AS year, CAST(month(ts) AS int) AS month, "
        "CAST(day(ts) AS int) AS day FROM v_conn "
        "WHERE ts BETWEEN TIMESTAMP '2024-01-05 22:00:00' AND TIMESTAMP '2024-01-08 03:30:00'"),
    "retention": with_views(
        "SELECT event_id, ts AS timestamp, query FROM v_dns WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'"),
    "first_row_each": with_views("\nUNION ALL\n".join(
        f"(SELECT '{t}' AS table_name, event_id, hostname, ts AS timestamp FROM {v} ORDER BY ts, event_id LIMIT 1)"
        for t, (v, _) in HAS.items())),
    "dropped_days": with_views("""
SELECT ts AS timestamp, CAST(day(ts) AS int) AS day, peer, gaps, hostname FROM v_loss WHERE ts >= TIMESTAMP '2024-01-15'
UNION ALL SELECT NULL, NULL, peer, gaps, hostname FROM v_loss WHERE gaps = 7"""),
    "dropped_column": with_views("SELECT event_id, peer, gaps FROM v_loss"),
    "followed_lines": with_views(
        "SELECT lpad(CAST(event_id AS varchar), 9, '0') || ' ' || value AS line FROM v_tailed"),
    "stored_baseline": with_views(BASELINE.format(days=31), **F),
    "sql_surface": with_views(
        "SELECT id_resp_p, proto, count(*) AS n, CAST(sum(resp_bytes) AS bigint) AS bytes "
        "FROM v_conn GROUP BY ALL"),
    "csv_round_trip": with_views(
        f"SELECT {words('message', fv.EVENT_RULES['auth'], 'auth_misc')} AS event_type, "
        f"{words('message', fv.SEVERITY_RULES['auth'], 'info')} AS severity, count(*) AS n, "
        rf"CAST(sum(length(regexp_extract({REST}, '^\S+:\s+(.*)', 1))) AS bigint) AS message_chars "
        "FROM v_auth_raw GROUP BY ALL"),
    "json_round_trip": with_views(
        "SELECT version, established, count(*) AS n, count(DISTINCT uid) AS uids FROM v_ssl GROUP BY ALL"),
}
