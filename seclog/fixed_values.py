"""Fixed values.

Everything here is a value that must be what it is for results to be right:
message schemas, port tables, ordered keyword rules, log patterns, thresholds
and text formats. No logic lives in this file.
"""

# --- Fixed values: message schemas, one per topic -------------------------
# Dotted names are literal field names in the messages.

_CONNECTION_ID = "`id.orig_h` string, `id.orig_p` int, `id.resp_h` string, `id.resp_p` int"
_ORIGIN = "hostname string, vm_id string"

TOPIC_SCHEMAS = {
    "zeek_capture_loss": (
        "ts double, ts_delta double, peer string, gaps int, acks int, "
        f"percent_lost double, {_ORIGIN}"
    ),
    "zeek_conn": (
        f"ts double, uid string, {_CONNECTION_ID}, proto string, service string, "
        "duration double, orig_bytes bigint, resp_bytes bigint, conn_state string, "
        "local_orig boolean, local_resp boolean, missed_bytes bigint, history string, "
        "orig_pkts bigint, orig_ip_bytes bigint, resp_pkts bigint, resp_ip_bytes bigint, "
        f"ip_proto int, {_ORIGIN}"
    ),
    "zeek_dns": (
        f"ts double, uid string, {_CONNECTION_ID}, proto string, trans_id int, rtt double, "
        "query string, qclass int, qclass_name string, qtype int, qtype_name string, "
        "rcode int, rcode_name string, AA boolean, TC boolean, RD boolean, RA boolean, "
        f"Z int, answers array<string>, TTLs array<double>, rejected boolean, {_ORIGIN}"
    ),
    "zeek_http": (
        f"ts double, uid string, {_CONNECTION_ID}, trans_depth int, method string, "
        "host string, uri string, version string, user_agent string, "
        "request_body_len int, response_body_len int, status_code int, status_msg string, "
        "tags array<string>, resp_fuids array<string>, orig_fuids array<string>, "
        f"orig_mime_types array<string>, resp_mime_types array<string>, {_ORIGIN}"
    ),
    "zeek_notice": (
        f"ts double, uid string, {_CONNECTION_ID}, proto string, note string, msg string, "
        "src string, dst string, p int, actions array<string>, email_dest array<string>, "
        f"suppress_for float, {_ORIGIN}"
    ),
    "zeek_ssl": (
        f"ts double, uid string, {_CONNECTION_ID}, version string, cipher string, "
        "curve string, server_name string, resumed boolean, established boolean, "
        f"ssl_history string, {_ORIGIN}"
    ),
}

# Raw log line inside a JSON message.
LOG_MESSAGE_SCHEMA = "message string, hostname string, vm_id string"

# Host metrics: every field arrives as text.
METRIC_FIELDS = {
    "cpu": ["user", "nice", "system", "iowait", "steal", "idle"],
    "memory": ["total", "used", "free", "shared", "buff_cache", "available"],
    "disk": [
        "device", "r_s", "rkB_s", "rrqm_s", "rrqm_pct", "r_await", "rareq_sz",
        "w_s", "wkB_s", "wrqm_s", "wrqm_pct", "w_await", "wareq_sz",
    ],
}

# --- Fixed values: columns each network table keeps, after the time parts --

_ENDPOINTS = ["id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p"]
_GEO = [
    "orig_latitude", "orig_longitude", "orig_city",
    "resp_latitude", "resp_longitude", "resp_city",
]
_FROM = ["hostname", "vm_id"]

TABLE_COLUMNS = {
    "zeek_capture_loss": [
        "ts_delta", "peer", "gaps", "acks", "percent_lost", "loss_severity", *_FROM,
    ],
    "zeek_conn": [
        *_ENDPOINTS, *_GEO, "proto", "service", "duration", "orig_bytes", "resp_bytes",
        "conn_state", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", *_FROM,
    ],
    "zeek_dns": [
        "uid", *_ENDPOINTS, *_GEO, "proto", "trans_id", "rtt", "query", "qclass",
        "qclass_name", "qtype", "qtype_name", "rcode", "rcode_name", "AA", "TC", "RD",
        "RA", "Z", "answers", "TTLs", "rejected", *_FROM,
    ],
    "zeek_http": [
        "uid", *_ENDPOINTS, *_GEO, "trans_depth", "method", "host", "uri", "version",
        "user_agent", "request_body_len", "response_body_len", "status_code",
        "status_msg", "tags", "resp_fuids", "orig_fuids", "orig_mime_types",
        "resp_mime_types", *_FROM,
    ],
    "zeek_notice": [
        "uid", *_ENDPOINTS, *_GEO, "proto", "note", "msg", "src", "dst", "p", "actions",
        "email_dest", "suppress_for", *_FROM,
    ],
    "zeek_ssl": [
        "uid", *_ENDPOINTS, *_GEO, "version", "cipher", "curve", "server_name",
        "resumed", "established", "ssl_history", *_FROM,
    ],
}

TIME_PARTS = ["year", "month", "day", "hour", "minute", "second"]

# Fact columns that are not packed into event_data.
FACT_OWN_COLUMNS = [
    "ts", "timestamp", *TIME_PARTS, *_ENDPOINTS, *_FROM,
    "log_type", "proto", "service", "uid",
]

# --- Fixed values: port names ----------------------------------------------

TCP_SERVICES = {
    "20": "FTP-DATA", "21": "FTP", "22": "SSH", "23": "TELNET", "25": "SMTP",
    "53": "DNS", "80": "HTTP", "110": "POP3", "143": "IMAP", "443": "HTTPS",
    "445": "SMB", "3389": "RDP", "8080": "HTTP-ALT", "8443": "HTTPS-ALT",
}
UDP_SERVICES = {
    "53": "DNS", "67": "DHCP-SERVER", "68": "DHCP-CLIENT", "123": "NTP",
    "161": "SNMP", "162": "SNMP-TRAP", "137": "NETBIOS-NS", "138": "NETBIOS-DGM",
    "514": "SYSLOG",
}
PRIORITY_SERVICES = ["HTTP", "HTTPS", "SSH"]
UNCLASSIFIED_TRAFFIC = "OTHER"

# --- Fixed values: ordered keyword rules, first match wins -------------------
# (class, [any of these substrings])

EVENT_RULES = {
    "syslog": [
        ("service_start", ["Started ", "Starting "]),
        ("service_stop", ["Finished ", "Deactivated successfully"]),
        ("user_activity", ["user-", "User ", "[PAM]"]),
        ("cron_job", ["CRON"]),
        ("display_manager", ["sddm"]),
        ("error", ["error", "unset environment variable"]),
    ],
    "kern": [
        ("service_start", ["started", "Service started"]),
        ("service_init", ["Initializing service", "Creating worker thread"]),
        ("system_info", ["OS Product", "OS Release", "Executable"]),
        ("hardware", ["Monitor", "RRScreenChangeNotify", "output[0] successfully configured"]),
        ("error", ["Error", "VERR_"]),
    ],
    "dmesg": [
        ("system_info", ["Linux version", "Command line", "OS Product"]),
        ("hardware", ["scsi", "usb", "NIC Link", "Detected", "Video Device"]),
        ("error", ["ERROR", "Cannot allocate", "not supported"]),
        ("boot", ["module loaded", "Starting", "Initialized"]),
    ],
    "auth": [
        ("session_open", ["session opened for user"]),
        ("session_close", ["session closed for user"]),
        ("sudo_command", ["COMMAND="]),
        ("su_session", ["pam_unix(su:session)"]),
        ("cron_session", ["pam_unix(cron:session)"]),
        ("logind_event", ["systemd-logind"]),
        ("session_event", ["New session", "Removed session"]),
        ("error", ["Failed to activate", "unable to locate"]),
    ],
    "ufw": [],
}
EVENT_DEFAULTS = {
    "syslog": "system", "kern": "kernel", "dmesg": "kernel", "auth": "auth_misc",
    "ufw": "firewall_block",
}
SEVERITY_RULES = {
    "syslog": [
        ("high", ["error", "unset environment variable"]),
        ("medium", ["Started ", "Finished "]),
    ],
    "kern": [
        ("high", ["Error", "VERR_"]),
        ("medium", ["started", "Service started", "Monitor"]),
    ],
    "dmesg": [
        ("high", ["ERROR", "Cannot allocate", "not supported"]),
        ("medium", ["scsi", "usb", "NIC Link", "Detected"]),
    ],
    "auth": [
        ("high", ["Failed to activate", "unable to locate"]),
        ("medium", ["COMMAND=", "su:session"]),
        ("low", ["session opened", "session closed"]),
    ],
    "ufw": [],
}
SEVERITY_DEFAULTS = {
    "syslog": "low", "kern": "low", "dmesg": "low", "auth": "info", "ufw": "medium",
}

# Name in log_source where it is not the family's own.
LOG_SOURCE_NAMES = {"auth": "system"}

# Attack type named in free text: (type, [any of these, in lower case]).
ATTACK_TEXT_RULES = [
    ("Data_Exfiltration", ["data exfiltration"]),
    ("TCP_DoS", ["denial-of-service", "dos"]),
    ("Unauthorized_Access", ["unauthorized access"]),
    ("DNS_Tunneling", ["dns tunneling"]),
]
ATTACK_TEXT_DEFAULT = "Other"
NO_ATTACK_TEXT = "no anomalies"

# --- Fixed values: patterns ---------------------------------------------------

LOG_TIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)"
TAILED_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) ([A-Z]+) (.+)$"
TAILED_TIME = "yyyy-MM-dd HH:mm:ss"
FRAME_TIME = "MMM d, yyyy HH:mm:ss.SSSSSSSSS z"
NOTICE_QUERY = r"query=([^\s,]+)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
IPV6 = r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
PRIVATE_NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"]

# Login daemon: how an event type is recognised in the message text
# (every listed substring must occur; first match wins).
SSHD_EVENTS = [
    ("sshd_login_success", ["Accepted password"]),
    ("sshd_login_success_pubkey", ["Accepted publickey"]),
    ("sshd_login_fail", ["Failed password"]),
    ("sshd_login_fail", ["maximum authentication attempts exceeded"]),
    ("sshd_login_fail", ["Disconnecting authenticating user", "Too many authentication failures"]),
    ("sshd_login_fail", ["pam_unix(sshd:auth): authentication failure"]),
]
SSHD_OTHER = "sshd_other"
NOT_SSHD = "other"

# (pattern, user group, address group, port group; 0 = not in the message)
SSHD_DETAILS = {
    "sshd_login_success": [
        (r"Accepted password for (\S+) from ([\d\.]+) port (\d+)", 1, 2, 3),
    ],
    "sshd_login_success_pubkey": [
        (r"Accepted publickey for (\S+) from ([\d\.]+) port (\d+)", 1, 2, 3),
    ],
    "sshd_login_fail": [
        (r"Failed password for (?:invalid user )?(\S+) from ([\d\.]+) port (\d+)", 1, 2, 3),
        (r"error: maximum authentication attempts exceeded for (?:invalid user )?(\S+) "
         r"from ([\d\.]+) port (\d+)", 1, 2, 3),
        (r"Disconnecting authenticating user (\S+) ([\d\.]+) port (\d+): "
         r"Too many authentication failures", 1, 2, 3),
        (r"pam_unix\(sshd:auth\): authentication failure;.*rhost=([\d\.]+)\s+user=(\S+)", 2, 1, 0),
    ],
}
SSHD_METHODS = {
    "sshd_login_success": "password",
    "sshd_login_fail": "password",
    "sshd_login_success_pubkey": "publickey",
}

DANGEROUS_COMMANDS = [
    r"rm\s+-rf\s+/",
    r"reboot",
    r"shutdown",
    r"init\s+0",
    r"mkfs\.",
    r"dd\s+.*of=/dev/",
]

# --- Fixed values: thresholds ---------------------------------------------

TUNNELING_NOTE = "Custom::DNS_Tunneling"
DROPPED_PACKETS_NOTE = "PacketFilter::Dropped_Packets"
LARGE_BODY_BYTES = 1_000_000
EXPECTED_STATUS = [200, 204]
EXFILTRATION_BYTES = 1_000_000
EXFILTRATION_SECONDS = 10
DOS_SECONDS = 1
DOS_PACKETS = 1000
DOS_HALF_OPEN = 50
FLOOD_PACKETS = 500
FLOOD_SECONDS = 0.5
HALF_OPEN_STATE = "S0"
EXPECTED_PORTS = [80, 443, 53]
EXPECTED_PORT_TEXTS = ["80", "443", "80,80", "443,443"]
WEB_PORT_TEXTS = ["80", "443"]
CPU_PERCENT = 80
MEMORY_SHARE = 0.9
LOSS_BAND = (5, 10)
TRIAGE_LOSS_PERCENT = 50
TRIAGE_QUERY_LENGTH = 50

SCORE_NOTICES = 3
SCORE_QUERY_LENGTH = 50
SCORE_ENTROPY = 4.0
SCORE_WEIGHTS = {"length": 0.4, "notices": 0.4, "entropy": 0.2}

INCIDENTS_PER_RULE = 100
TRIAGE_ROWS = 10

# --- Fixed values: collected files and topics --------------------------------

# File name ending -> log source; host group + source -> topic.
LOG_FILES = {
    "syslog": "syslog",
    "kern.log": "kern",
    "dmesg": "hardware",
    "ufw.log": "ufw",
    "auth.log": "auth",
    "audit.log": "audit",
}
TOPIC_OF_SOURCE = {
    "lubuntu.syslog": "lubuntu_syslog",
    "lubuntu.kern": "lubuntu_kern",
    "lubuntu.hardware": "lubuntu_hardware",
    "lubuntu.ufw": "lubuntu_firewall",
    "lubuntu.audit": "lubuntu_audit",
    "lubuntu.auth": "lubuntu_auth",
    "kali.syslog": "kali_syslog",
    "kali.kern": "kali_kern",
    "kali.auth": "kali_auth",
    "system.logs": "raw_logs",
}
ARCHIVED_TOPICS = [
    "lubuntu_tshark", "lubuntu_audit", "lubuntu_auth", "lubuntu_firewall",
    "lubuntu_hardware", "lubuntu_kern", "lubuntu_syslog", "lubuntu_ufw",
    "kali_auth", "kali_kern", "kali_syslog", "kali_dpkg",
]
DEFAULT_ASSETS = ["lubuntu", "kali"]

# --- Fixed values: formats of summary text -----------------------------------

RECORD_START = "Attack Type:"
RECORD_FIELD = r"^-\s+(.+?):\s+(.*)$"

# --- Fixed values: line formats of the system logs ---------------------------

SYSLOG_PROCESS = rf"{LOG_TIME}\s+\S+\s+(\S+?)(?:\[\d+\])?:"
SYSLOG_MESSAGE = rf"{LOG_TIME}\s+\S+\s+\S+(?:\[\d+\])?:\s+(.+)"
LOG_HOST = rf"{LOG_TIME}\s+(\S+)"
LOG_PID = r"\[(\d+)\]"
KERN_PID = r"Process ID:\s+(\d+)"
KERN_MESSAGE = r"kernel:\s+\d{2}:\d{2}:\d{2}\.\d+\s+\S+\s+(.+)"
UFW_MESSAGE = r"\[UFW BLOCK\]\s+(.+)"
DMESG_UPTIME = r"\[\s*(\d+\.\d+)\]"
DMESG_MESSAGE = r"kernel:\s+(.+)"
AUTH_HOST = r"^\S+\s+(\S+)"
AUTH_NAMED = r"\s+(\S+(?:\[\d+\])?):\s+"
AUTH_PROCESS = r"^(\S+?)(?:\[\d+\])?$"
AUTH_MESSAGE = r"\s+\S+(?:\[\d+\])?:\s+(.*)"

# --- Fixed values: what incidents say; names in braces are columns -----------

SENTENCES = {
    "DNS_Tunneling": "Suspicious DNS tunneling traffic from {src} to {dst} at {at} with query {query}",
    "Suspicious_HTTP": "Suspicious HTTP traffic from {src} to {dst} at {at}: {why}",
    "Data_Exfiltration": "Potential data exfiltration from {src} to {dst} at {at}: transferred {sent} bytes in {lasted} seconds",
    "TCP_DoS": "TCP DoS attack detected at {at} from {src} targeting {dst}: {packets} packets sent, {half_open} incomplete handshakes",
    "Unauthorized_Access": "Unauthorized access attempt from {src} to {dst} on port {port} at {at}",
    "SYN_Flood": "Potential SYN flood from {src} to {dst} at {at}: {sent} packets",
    "System_Strain": "System strain detected at {at}: CPU {cpu}%, Memory {memory}%",
}
HTTP_LARGE = "large response size ({size} bytes)"
HTTP_NO_AGENT = "missing user agent"
HTTP_STATUS = "unusual status code ({status})"
UNKNOWN_QUERY = "unknown"
