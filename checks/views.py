"""Log tables derived from the given tables, as SQL that Spark and DuckDB both run."""

HOSTS = "'host' || (user_id % 7) AS hostname, 'vm' || (user_id % 3) AS vm_id"
ISO = (
    "replace(substr(CAST(ts AS string), 1, 19), ' ', 'T') || '.' "
    "|| lpad(CAST(event_id % 1000000 AS string), 6, '0') "
    "|| CASE WHEN event_id % 2 = 0 THEN '+01:00' ELSE '-05:00' END"
)

VIEWS = {
    "v_conn": f"""
SELECT event_id, ts, 'C' || event_id AS uid,
  '10.0.0.' || (user_id % 5) AS id_orig_h, CAST(40000 + event_id % 20000 AS int) AS id_orig_p,
  '10.' || (event_id % 30) || '.1.' || (user_id % 200) AS id_resp_h,
  CASE event_id % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22
    WHEN 4 THEN 8080 ELSE 3389 END AS id_resp_p,
  CASE WHEN event_id % 4 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 120 AS double) / 10 END AS duration,
  CAST(floor(value * 20000) AS bigint) AS resp_bytes,
  CASE WHEN event_type = 'error' THEN 'S0' ELSE 'SF' END AS conn_state,
  CAST(floor(value * 10) AS bigint) AS orig_pkts, {HOSTS}
FROM events""",
    "v_dns": f"""
SELECT event_id, ts, 'C' || event_id AS uid, '10.0.0.' || (user_id % 5) AS id_orig_h,
  '8.8.8.' || (event_id % 3) AS id_resp_h, 53 AS id_resp_p, 'udp' AS proto,
  CASE WHEN event_type = 'error'
       THEN 'partition-' || event_id || '-' || md5(CAST(event_id AS string)) || '.example.com'
       ELSE event_type || (event_id % 20) || '.example.com' END AS query,
  CASE WHEN event_type = 'error' THEN 'TXT' ELSE 'A' END AS qtype_name, {HOSTS}
FROM events""",
    "v_notice": f"""
SELECT event_id, ts, 'C' || event_id AS uid, '10.0.0.' || (user_id % 5) AS id_orig_h,
  '8.8.8.' || (event_id % 3) AS id_resp_h,
  CASE event_type WHEN 'error' THEN 'Custom::DNS_Tunneling'
    WHEN 'signup' THEN 'PacketFilter::Dropped_Packets' ELSE 'Other' END AS note,
  CASE WHEN event_id % 2 = 0 THEN 'Suspicious query=q' || event_id || '.example.com, long'
       ELSE 'High TXT query rate' END AS msg, {HOSTS}
FROM events""",
    "v_http": f"""
SELECT event_id, ts, 'C' || event_id AS uid, '10.0.0.' || (user_id % 5) AS id_orig_h,
  '10.' || (event_id % 30) || '.1.' || (user_id % 200) AS id_resp_h,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(floor(value * 10000) AS int) END
    AS response_body_len,
  CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN NULL ELSE 'Mozilla/5.0' END
    AS user_agent,
  CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 204 WHEN 2 THEN NULL ELSE 200 END
    AS status_code, {HOSTS}
FROM events""",
    "v_ssl": f"""
SELECT event_id, ts, 'C' || event_id AS uid, '10.0.0.' || (user_id % 5) AS id_orig_h,
  '10.' || (event_id % 30) || '.1.' || (user_id % 200) AS id_resp_h, 443 AS id_resp_p,
  CASE WHEN event_id % 3 = 0 THEN 'TLSv12' ELSE 'TLSv13' END AS version,
  event_type || '.example.com' AS server_name, event_id % 2 = 0 AS established, {HOSTS}
FROM events""",
    "v_loss": f"""
SELECT event_id, ts, 'peer' || (event_id % 4) AS peer, CAST(event_id % 50 AS int) AS gaps,
  CAST(event_id % 900 AS int) AS acks,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN CAST(5 AS double)
    WHEN event_id % 31 = 0 THEN CAST(10 AS double) ELSE value / 8 END AS percent_lost, {HOSTS}
FROM events""",
    "v_metrics_raw": """
SELECT event_id, ts,
  CASE event_type
    WHEN 'click' THEN '{"user":"' || (event_id % 100)
      || '","system":"5","iowait":"1","idle":"20","hostname":"host' || (user_id % 7)
      || '","vm_id":"vm' || (user_id % 3) || '"}'
    WHEN 'view' THEN '{"total":"' || CASE WHEN event_id % 37 = 0 THEN 0 ELSE 1000 END
      || '","used":"' || (event_id % 1000) || '","hostname":"host' || (user_id % 7)
      || '","vm_id":"vm' || (user_id % 3) || '"}'
    WHEN 'purchase' THEN '{"device":"sda","rkB_s":"' || (event_id % 500) || '","wkB_s":"'
      || (event_id % 300) || '","hostname":"host' || (user_id % 7)
      || '","vm_id":"vm' || (user_id % 3) || '"}'
    WHEN 'signup' THEN 'broken {json' ELSE NULL END AS raw_json
FROM events""",
    # Metrics of one host and hour, dense enough for CPU and memory to share a window.
    "v_metrics": f"""
SELECT event_id, ts, CAST(event_id % 101 AS double) AS cpu_user,
  CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(event_id % 1000 AS double) END AS mem_used,
  CASE WHEN event_id % 37 = 0 THEN CAST(0 AS double) ELSE CAST(1000 AS double) END AS mem_total,
  {HOSTS}
FROM events""",
    "v_auth_raw": f"""
SELECT event_id, {HOSTS},
  {ISO} || ' host' || (user_id % 7) || ' '
  || CASE event_id % 8
      WHEN 0 THEN 'sshd[' || (1000 + event_id % 9000) || ']: Failed password for root from 203.0.113.' || (user_id % 250) || ' port ' || (40000 + event_id % 20000) || ' ssh2'
      WHEN 1 THEN 'sshd[' || (1000 + event_id % 9000) || ']: Failed password for invalid user u' || user_id || ' from 203.0.113.' || (user_id % 250) || ' port ' || (40000 + event_id % 20000) || ' ssh2'
      WHEN 2 THEN 'sshd[77]: Accepted password for u' || user_id || ' from 10.0.0.9 port 50000 ssh2'
      WHEN 3 THEN 'sshd[78]: Accepted publickey for u' || user_id || ' from 10.0.0.9 port 50001 ssh2'
      WHEN 4 THEN 'sshd[79]: pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=203.0.113.7  user=u' || user_id
      WHEN 5 THEN 'sudo:     u' || user_id || ' : TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND='
        || CASE event_id % 7 WHEN 0 THEN '/sbin/reboot' WHEN 1 THEN '/usr/bin/rm -rf /var'
             WHEN 2 THEN '/sbin/MKFS.ext4 /dev/sdb' WHEN 3 THEN '/bin/dd if=/dev/zero of=/dev/sda'
             WHEN 4 THEN '/usr/sbin/init 0' ELSE '/usr/bin/su' END
      WHEN 6 THEN 'CRON[' || event_id || ']: pam_unix(cron:session): session opened for user root(uid=0) by root(uid=0)'
      ELSE 'systemd[1]: Started Session ' || event_id || ' of User root.' END AS message
FROM events""",
    "v_syslog_raw": f"""
SELECT event_id, {HOSTS}, {ISO} || ' host' || (user_id % 7) || ' '
  || CASE event_id % 9
      WHEN 0 THEN 'systemd[1]: Started Daily job ' || event_id || '.'
      WHEN 1 THEN 'systemd[1]: Starting Cleanup...'
      WHEN 2 THEN 'systemd[1]: Finished Rotate log files.'
      WHEN 3 THEN 'systemd[1]: apt.service: Deactivated successfully.'
      WHEN 4 THEN 'systemd-logind[' || (user_id % 900) || ']: Created slice user-1000.slice.'
      WHEN 5 THEN 'CRON[' || event_id || ']: (root) CMD (run-parts)'
      WHEN 6 THEN 'sddm[811]: Adding new display on vt 7'
      WHEN 7 THEN 'udevd[12]: unset environment variable FOO, error ' || event_id
      ELSE 'rsyslogd: action resumed' END AS message
FROM events""",
    "v_kern_raw": f"""
SELECT event_id, {HOSTS}, {ISO} || ' host' || (user_id % 7) || ' kernel: '
  || CASE event_id % 6
      WHEN 0 THEN '10:11:12.123456 main     Service started, Process ID: ' || event_id
      WHEN 1 THEN '10:11:12.123456 main     Creating worker thread ' || event_id
      WHEN 2 THEN '10:11:12.123456 main     OS Release: 6.8'
      WHEN 3 THEN '10:11:12.123456 dnd      Monitor 0 connected'
      WHEN 4 THEN '10:11:12.123456 shcl     Error VERR_NOT_FOUND code ' || event_id
      ELSE 'plain line ' || event_id END AS message
FROM events""",
    "v_dmesg_raw": """
SELECT event_id, '[' || lpad(CAST(event_id AS string), 6, ' ') || '.'
  || lpad(CAST(event_id * 7 % 1000000 AS string), 6, '0') || '] kernel: '
  || CASE event_id % 6
      WHEN 0 THEN 'Linux version 6.8.0'
      WHEN 1 THEN 'usb 1-1: new device ' || event_id
      WHEN 2 THEN 'ERROR: Cannot allocate ' || event_id
      WHEN 3 THEN 'Initialized driver ' || event_id
      WHEN 4 THEN 'Starting scsi scan'
      ELSE 'random: crng init done' END AS message
FROM events""",
    "v_ufw_raw": f"""
SELECT event_id, {HOSTS}, {ISO} || ' host' || (user_id % 7)
  || ' kernel: [UFW BLOCK] IN=enp0s3 OUT= SRC=203.0.113.' || (user_id % 250)
  || ' DST=10.0.0.' || (event_id % 250) || ' PROTO=TCP DPT=' || (event_id % 1024) AS message
FROM events""",
    "v_tshark_raw": """
SELECT event_id,
  'Jan ' || extract(day FROM ts) || ', ' || extract(year FROM ts) || ' '
  || substr(CAST(ts AS string), 12, 8) || '.' || lpad(CAST(event_id % 1000000 AS string), 6, '0')
  || '000 UTC'
  || chr(9) || '10.0.0.' || (user_id % 5) || chr(9) || '10.' || (event_id % 30) || '.1.2'
  || chr(9) || CASE event_id % 3 WHEN 0 THEN '53,50000' WHEN 1 THEN '123,123' ELSE '' END
  || chr(9) || CASE event_id % 7 WHEN 0 THEN '80,50123' WHEN 1 THEN '443,443' WHEN 2 THEN '50123,22'
      WHEN 3 THEN '21,443' WHEN 4 THEN '3389' WHEN 5 THEN '80' ELSE '' END
  || CASE WHEN event_id % 41 = 0 THEN '' ELSE chr(9) || '6' END AS message
FROM events""",
    "v_geo": """
SELECT CAST(167772160 + n_nationkey * 65536 AS bigint) AS ip_lo,
  CAST(167772160 + n_nationkey * 65536
    + CASE WHEN n_nationkey % 2 = 0 THEN 65535 ELSE 32767 END AS bigint) AS ip_hi,
  CAST(n_nationkey * 3 - 36 AS double) AS latitude,
  CAST(n_nationkey * 5 - 60 AS double) AS longitude, n_name AS city
FROM nation
UNION ALL
SELECT CAST(3405803776 AS bigint) AS ip_lo, CAST(3405803776 + 127 AS bigint) AS ip_hi,
  CAST(1 AS double) AS latitude, CAST(2 AS double) AS longitude, r_name AS city
FROM region WHERE r_regionkey = 0""",
    # Ranges within ranges, equal starts, and both address families.
    "v_nested": """
SELECT ip_lo, ip_hi, CAST(latitude AS double) AS latitude, CAST(longitude AS double) AS longitude, city FROM (VALUES
  ('10.0.0.0', '10.255.255.255', 1.0, 1.0, 'ten'), ('10.3.0.0', '10.9.255.255', 2.0, 2.0, 'three to nine'),
  ('10.5.0.0', '10.5.1.127', 3.0, 3.0, 'five'), ('10.5.1.0', '10.5.1.63', 4.0, 4.0, 'five one'),
  ('10.5.1.0', '10.5.1.31', 5.0, 5.0, 'first of five one'), ('10.8.0.0', '10.12.1.99', 6.0, 6.0, 'over the end'),
  ('2001:db8::', '2001:db8:ffff:ffff:ffff:ffff:ffff:ffff', 7.0, 7.0, 'six'),
  ('2001:db8:0:0:0:0:0:100', '2001:db8::4ff', 8.0, 8.0, 'in six'))
  t(ip_lo, ip_hi, latitude, longitude, city)""",
    "v_both": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2001:0db8:0000:0000:0000:0000:0000:' || (event_id % 9999)
  WHEN 1 THEN '2001:db8::' || (event_id % 2000) WHEN 2 THEN '10.' || (event_id % 14) || '.1.' || (user_id % 200)
  ELSE '10.5.' || (event_id % 3) || '.' || (event_id % 140) END AS ip
FROM events""",
    # Messages of a topic between what does not belong there.
    "v_mixed": """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'broken {json'
  WHEN 4 THEN '{"user":"' || (event_id % 9) || '","hostname":"h"}' WHEN 5 THEN '7'
  ELSE '{"ts":1735689600.5,"uid":"C' || event_id || '","id.orig_h":"10.0.0.1"}' END AS value
FROM events""",
    "v_assets": """
SELECT * FROM (VALUES ('Lubuntu VM','lubuntu','10.0.0.1'), ('Kali VM','kali','10.0.0.2'),
  ('Web VM','web','10.3.1.8')) t(name, short_name, ip_address)""",
    "v_addresses": """
SELECT event_id, CASE event_id % 7
  WHEN 0 THEN '172.' || (event_id % 40) || '.0.1' WHEN 1 THEN '10.0.0.' || (event_id % 400)
  WHEN 2 THEN '192.168.' || (event_id % 300) || '.7' WHEN 3 THEN 'a.b.c.d'
  WHEN 4 THEN '2001:0db8:0000:0000:0000:0000:0000:' || (event_id % 9999)
  WHEN 5 THEN '127.0.0.1' ELSE (event_id % 256) || '.9.9.9' END AS ip
FROM events""",
    "v_tailed": """
SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'noise ' || event_id
  ELSE substr(CAST(ts AS string), 1, 19) || ' '
  || CASE event_id % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARN' ELSE 'error' END
  || ' message ' || event_id || ' of ' || user_id END AS value
FROM events""",
    "v_files": """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'lubuntu' ELSE 'kali' END AS host_group,
  'file:///var/log/' || CASE event_id % 7 WHEN 0 THEN 'syslog' WHEN 1 THEN 'kern.log'
    WHEN 2 THEN 'dmesg' WHEN 3 THEN 'ufw.log' WHEN 4 THEN 'auth.log'
    WHEN 5 THEN 'audit/audit.log' ELSE 'other.txt' END AS file
FROM events""",
    # Six lines per event: a start line, fields (one given twice), loose lines.
    "v_lines": """
SELECT 'f' || (user_id % 3) AS file, event_id * 6 + k AS line_no,
  CASE k WHEN 0 THEN CASE WHEN event_id % 5 = 4 THEN 'free text ' || event_id
                     ELSE 'Attack Type: T' || (event_id % 4) END
    WHEN 1 THEN '  - Incident Count: ' || event_id
    WHEN 2 THEN '  - Source IPs: 10.0.0.' || (event_id % 200)
    WHEN 3 THEN '  - Details: value ' || user_id
    WHEN 4 THEN '  - Incident Count: ' || (event_id + 1)
    ELSE 'tail ' || event_id END AS line
FROM (SELECT event_id, user_id, 0 AS k FROM events UNION ALL
  SELECT event_id, user_id, 1 AS k FROM events UNION ALL
  SELECT event_id, user_id, 2 AS k FROM events UNION ALL
  SELECT event_id, user_id, 3 AS k FROM events UNION ALL
  SELECT event_id, user_id, 4 AS k FROM events UNION ALL
  SELECT event_id, user_id, 5 AS k FROM events) n""",
}

#: Base tables of each view.
BASES = ["events", "nation", "region"]
