import random
from ipaddress import IPv4Address, IPv6Address
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seclog.functions.net import ipv4_number
from seclog.operators import (
    alerts, assets, detect, features, geo, lookup, metrics, network, packets, records, star,
    syslog, tables,
)
from seclog.plans import tunneling

VM = "lubuntu-vm1"


@pytest.fixture(scope="module")
def labelled(spark):
    """Fifteen name lookups, five of them tunnelling, and six notices.

    Fixed values: the texts below are labelled rows with known features.
    """
    normal = ["www.google.com", "www.example.com", "api.github.com", "www.amazon.com",
              "cloudflare.com", "www.microsoft.com", "www.apple.com", "www.facebook.com",
              "www.twitter.com", "www.linkedin.com"]
    long = ["partition-cname-trouter-abc123xyz789longencodeddata.example.com",
            "encoded-987xyztrouter-cname-partition-longdata123.example.com",
            "trouter-partition-abc789xyzlongencodedstring456.example.com",
            "cname-encoded-123abcxyz789longdata789.example.com",
            "partition-trouter-xyz123abc789encodedlongdata.example.com"]
    messages = ["Suspicious long query detected: partition-cname-trouter-...",
                "High TXT query rate from 10.71.0.35",
                "Encoded query pattern: trouter-partition-abc789...",
                "Potential DNS tunneling: cname-encoded-123abc..."]
    dns = [(datetime(2025, 5, 21, 16, 45 + i // 6, i % 6 * 10), "192.168.1.100", q, VM)
           for i, q in enumerate(normal)]
    dns += [(datetime(2025, 5, 21, 16, 47, i * 10), "10.71.0.35", q, VM) for i, q in enumerate(long)]
    notes = [(datetime(2025, 5, 21, 16, 47, 5 + i * 10), "10.71.0.35", "8.8.8.8",
              "Custom::DNS_Tunneling", m, VM) for i, m in enumerate(messages)]
    notes += [(datetime(2025, 5, 21, 16, 45, 15), "192.168.1.100", "8.8.8.8", "Other",
               "Normal DNS query observed", VM),
              (datetime(2025, 5, 21, 16, 46, 15), "192.168.1.100", "1.1.1.1", "Other",
               "Standard query to cloudflare.com", VM)]
    return (
        spark.createDataFrame(dns, "timestamp timestamp, id_orig_h string, query string, vm_id string"),
        spark.createDataFrame(notes, "timestamp timestamp, id_orig_h string, id_resp_h string, "
                                     "note string, msg string, vm_id string"),
    )


def test_labelled_features(labelled):
    rows = {r.id_orig_h: r for r in features.dns_features(labelled[0]).collect()}
    normal, tunnel = rows["192.168.1.100"], rows["10.71.0.35"]
    assert normal.ts_window_start == datetime(2025, 5, 21, 16, 45)
    assert normal.query_rate == pytest.approx(10 / 300)
    assert (normal.unique_queries, tunnel.unique_queries) == (10, 5)
    assert normal.avg_query_len == pytest.approx(14.8)
    assert normal.query_name_entropy == pytest.approx(3.1437784738)
    assert tunnel.avg_query_len == pytest.approx(57.8)
    assert tunnel.query_name_entropy == pytest.approx(4.4040028666)
    notice = features.notice_features(labelled[1]).collect()
    assert [(r.id_orig_h, r.dns_tunneling_notices, r.avg_notice_msg_len) for r in notice] == [
        ("10.71.0.35", 4, 48.0)]


def test_labelled_score_and_rule(labelled):
    scored = tunneling.tunneling_scores(*labelled).collect()
    assert [(r.id_orig_h, r.score) for r in scored] == [("10.71.0.35", 1.0)]
    assert scored[0].details.startswith("High AVG_QUERY_LEN=57.8, DNS_TUNNELING_NOTICES=4, QUERY_NAME_ENTROPY=4.404")
    found = detect.detect_dns_tunneling(labelled[1]).collect()
    assert len(found) == 4 and all("with query unknown" in r.description for r in found)
    as_of = F.lit("2025-05-21 17:01:00").cast("timestamp")
    assert tunneling.tunneling_scores(*labelled, as_of=as_of).count() == 1
    as_of = F.lit("2025-05-21 17:10:00").cast("timestamp")
    assert tunneling.tunneling_scores(*labelled, as_of=as_of).count() == 0


def test_stored_features(spark, labelled, tmp_path):
    as_of = F.lit("2025-05-21 16:50:00").cast("timestamp")
    tunneling.store_features(*labelled, str(tmp_path), as_of)
    dns, notes = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("dns_features", "notice_features"))
    scored = tunneling.score_stored(dns, notes, "2025-05-21 16:45:00").collect()
    assert [(r.id_orig_h, r.score, r.timestamp is not None) for r in scored] == [("10.71.0.35", 1.0, True)]
    assert tunneling.score_stored(dns, notes, "2025-05-21 16:50:00").count() == 0
    tunneling.store_baseline(dns, str(tmp_path), as_of)
    assert spark.read.parquet(f"{tmp_path}/dns_baseline").count() == 2
    assert tables.preview(dns, 1).count() == 1


def test_features_with_missing_names(spark):
    rows = [(datetime(2025, 1, 1), "h", q, "v") for q in ("aa", "aa", None, "ab", "")]
    df = spark.createDataFrame(rows, "timestamp timestamp, id_orig_h string, query string, vm_id string")
    r = features.dns_features(df).first()
    assert r.unique_queries == 3
    assert r.avg_query_len == pytest.approx((2 + 2 + 2 + 0) / 4)
    assert r.query_name_entropy == pytest.approx(1.0 / 5)
    only_null = features.dns_features(df.where("query IS NULL")).first()
    assert (only_null.unique_queries, only_null.avg_query_len, only_null.query_name_entropy) == (0, None, 0.0)


# --- lookups and geolocation ------------------------------------------------------

def test_left_lookup_ways_agree(spark):
    rng = random.Random(1)
    # One key holds a third of the rows, a third has no key.
    names = ["hot"] * 3000 + [None] * 3000 + [f"k{rng.randint(0, 400)}" for _ in range(3000)]
    facts = spark.createDataFrame(list(enumerate(names)), "i int, k string").repartition(8)
    table = spark.createDataFrame(
        [("hot", 1)] + [(f"k{i}", i) for i in range(0, 400, 2)], "key string, v int")
    small = lookup.left_lookup(facts, table, "k", "key")
    salted = lookup.left_lookup(facts, table, "k", "key", max_broadcast_bytes=0, rows_per_salt=500)
    assert small.columns == salted.columns == ["i", "k", "v"]
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
    assert salted.count() == 9000
    hot = {r["__hot_key"]: r["__salts"] for r in lookup.hot_keys(facts, "k", 500).collect()}
    assert hot == {"hot": 6, None: 6}


def test_salted_lookup_spreads_a_hot_key(spark):
    facts = spark.range(20000).select(F.lit("hot").alias("k"), F.lit(1).alias("same")).repartition(8)
    table = spark.createDataFrame([("hot", 7)], "key string, v int")
    joined = lookup.left_lookup(facts, table, "k", "key", max_broadcast_bytes=0, rows_per_salt=1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20000 and len(sizes) > 1


def theta(ips, ranges):
    number = ipv4_number(F.col("ip"))
    return ips.join(ranges, number.between(F.col("ip_lo"), F.col("ip_hi")), "left").select(
        "ip", "latitude", "longitude", "city")


def test_geo_equals_range_join(spark):
    rng = random.Random(3)
    start, rows = 0, []
    while start < 2**32 - 2**26 and len(rows) < 400:
        lo = start + rng.choice([0, 1, 17, 65536, 70000, 2**24])
        hi = lo + rng.choice([0, 1, 255, 65535, 65536, 200000, 2**22])
        rows.append((lo, hi, float(len(rows)), -float(len(rows)), f"c{len(rows)}"))
        start = hi + 1
    ranges = spark.createDataFrame(rows, "ip_lo long, ip_hi long, latitude double, longitude double, city string")
    edges = [n for lo, hi, *_ in rows for n in (lo - 1, lo, hi, hi + 1) if 0 <= n < 2**32]
    numbers = edges + [rng.randrange(2**32) for _ in range(500)]
    text = [".".join(str(n >> s & 255) for s in (24, 16, 8, 0)) for n in numbers]
    text += ["not an address", "2001:0db8:0:0:0:0:0:1", None, "::1", "1::2::3", ":::", "1.2.3.4.5"]
    ips = spark.createDataFrame([(t,) for t in text], "ip string")
    for few_ranges, few_places in ((10**6, 0), (0, 10**6), (0, 0)):
        got = geo.geo_enrich(
            ips, ranges, {"at": "ip"}, max_broadcast_bytes=few_places, max_range_bytes=few_ranges
        ).select(
            "ip", "at_latitude", "at_longitude", "at_city")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, theta(ips, ranges).collect()), key=str)


def test_overlaps_have_one_meaning_at_every_size(spark):
    """The range that starts last wins, of equal starts the narrower; against brute force."""
    rng = random.Random(9)
    rows = [(lo := rng.randrange(2**17), lo + rng.choice([0, 3, 50, 4000, 70000]), float(n), 0.0, f"c{n}")
            for n in range(150)]
    ranges = spark.createDataFrame(rows, "ip_lo long, ip_hi long, latitude double, longitude double, city string")
    numbers = [rng.randrange(2**17 + 70000) for _ in range(400)]
    ips = spark.createDataFrame([(f"0.{n >> 16}.{n >> 8 & 255}.{n & 255}",) for n in numbers], "ip string")
    want = {}
    for n, r in zip(numbers, ips.collect()):
        held = [x for x in rows if x[0] <= n <= x[1]]
        want[r.ip] = max(held, key=lambda x: (x[0], -x[1], x[2]))[4] if held else None
    table = geo.prepare(ranges)
    for given, few in ((ranges, 10**6), (table, 0)):
        placed = geo.geo_enrich(ips, given, {"a": "ip"}, max_range_bytes=few, max_broadcast_bytes=few)
        assert placed.count() == 400 and {r.ip: r.a_city for r in placed.collect()} == want
    hidden = geo.geo_enrich(spark.createDataFrame([("10.0.0.1",)], "ip string"), spark.createDataFrame(
        [("10.0.0.0", "10.0.0.9", 1.0, 1.0, "a")], "ip_lo string, ip_hi string, latitude double, longitude double, city string"),
        {"a": "ip"}, skip_private=True)
    assert hidden.first().a_city is None


def test_places_of_both_families_against_brute_force(spark):
    """Ranges of any bounds in a small part of either family, wide ones and whole families too."""
    from ipaddress import ip_address

    rng = random.Random(4)
    bases = [int(ip_address("10.1.0.0")), int(ip_address("2001:db8::")), int(ip_address("2001:db8::ffff:0:0"))]
    rows = []
    for n in range(300):
        base, wide = rng.choice(bases), rng.choice([2, 300, 2**15, 2**16])
        lo = base + rng.randrange(2**16)
        hi = min(lo + rng.randrange(wide), base + 2**17)
        rows.append((lo, hi, 6 if base > 2**32 else 4, f"c{n}"))
    rows += [(0, 2**32 - 1, 4, "all four"), (0, 2**128 - 1, 6, "all six"), (bases[0], bases[0] - 1, 4, "ends before")]

    def shown(number, family):
        return str(IPv4Address(number) if family == 4 else IPv6Address(number))

    ranges = spark.createDataFrame(
        [(shown(lo, f), shown(hi, f), 1.0, 2.0, c) for lo, hi, f, c in rows] + [("x", "y", 1.0, 1.0, "none")],
        "ip_lo string, ip_hi string, latitude double, longitude double, city string")
    asked = [(rng.choice(bases) + rng.randrange(2**17)) for _ in range(600)]
    asked += [x for lo, hi, *_ in rows[:300] for x in (lo, hi)]
    asked = [(n, 6 if n > 2**32 else 4) for n in asked]
    ips = spark.createDataFrame([(shown(n, f),) for n, f in asked] + [(None,), ("text",)], "ip string")
    want = {None: None, "text": None}
    for n, f in asked:
        held = [r for r in rows if r[2] == f and r[0] <= n <= r[1]]
        want[shown(n, f)] = max(held, key=lambda r: (r[0], -r[1], r[3]))[3]
    table = geo.prepare(ranges)
    assert len(table.lengths) <= 12
    for few in (10**9, 0):
        placed = geo.geo_enrich(ips, table, {"a": "ip"}, max_range_bytes=few, max_broadcast_bytes=few)
        assert {r.ip: r.a_city for r in placed.collect()} == want and placed.count() == len(asked) + 2


def test_rare_lengths_give_way():
    given = geo.longer_prefixes({("4", 3): 10, ("4", 5): 900_000, ("4", 6): 5_000_000, ("4", 9): 4, ("6", 7): 3})
    assert given == {("4", 3): 5, ("4", 5): 5, ("4", 6): 6, ("4", 9): 9, ("6", 7): 7}
    assert geo.longer_prefixes({}) == {}


def test_a_table_without_ranges_places_nothing(spark):
    none = geo.prepare(spark.createDataFrame(
        [], "ip_lo long, ip_hi long, latitude double, longitude double, city string"))
    ips = spark.createDataFrame([("1.2.3.4",), (None,)], "ip string")
    for few in (10**9, -1):
        placed = geo.geo_enrich(ips, none, {"a": "ip"}, max_range_bytes=few)
        assert placed.columns == ["ip", "a_latitude", "a_longitude", "a_city"]
        assert placed.where("a_city IS NULL").count() == 2


def test_fact_by_join_is_one_plan(spark):
    from seclog.operators import star

    events = spark.range(1).selectExpr(
        "1D AS ts", "concat('u', id) AS uid", "'1.2.3.4' AS id_orig_h", "5 AS id_orig_p", "CAST(NULL AS string) AS id_resp_h",
        "CAST(NULL AS int) AS id_resp_p", "'h' AS hostname", "'v' AS vm_id", "'zeek_conn' AS log_type", "'tcp' AS proto",
        "'dns' AS service", "'q' AS query", "TIMESTAMP '2024-01-01 00:00:00' AS timestamp")
    joined = star.fact_by_join(events)
    assert "LogicalRDD" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 1


def test_address_key(spark):
    from ipaddress import ip_address

    from seclog.functions.net import address_key

    good = ["::", "::1", "1::", "2001:DB8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "fe80::1:2",
            "1.2.3.4", "255.255.255.255"]
    bad = ["", "1:2", "1::2::3", ":::", "g::1", "1:2:3:4:5:6:7:8:9", "1.2.3", "::1.2.3.400", "12345::", None, "1:2:3:4:5:6:7:8::"]
    df = spark.createDataFrame([(a,) for a in good + bad], "a string")
    got = [r.k for r in df.select(address_key(F.col("a")).alias("k")).collect()]

    def key(text):
        a = ip_address(text)
        return f"{int(a) + (0xFFFF << 32 if a.version == 4 else 0):032x}"

    assert got == [key(a) for a in good] + [None] * len(bad)


def test_assets(spark):
    stock = spark.createDataFrame(
        [("Kali", "kali", "10.0.0.2"), ("Web", "web", "10.0.0.3"), ("Zed", "zed", "10.0.0.3"),
         ("No address", "none", None)], "name string, short_name string, ip_address string")
    found = spark.createDataFrame(
        [(1, "10.0.0.3", "10.0.0.2"), (2, "9.9.9.9", "10.0.0.2"), (3, None, None)],
        "i int, src_ip string, dst_ip string")
    for limit in (100, 0):
        got = assets.attribute_asset(found, stock, max_broadcast_bytes=limit).orderBy("i").collect()
        assert [(r.asset_name, r.matched_by) for r in got] == [
            ("Web", "source"), ("Kali", "destination"), ("Kali", "default")]
    none = assets.attribute_asset(found, stock, ["nobody"]).orderBy("i").collect()
    assert (none[2].asset_name, none[2].matched_by) == (None, None)


# --- logs -----------------------------------------------------------------------

def parse_lines(spark, source, lines, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, message string")
    return syslog.parse_system_log(df, source, keep=["i"], **options).orderBy("i").collect()


T = "2025-04-07T12:21:07.533748+01:00 box "


def test_syslog_classes(spark):
    lines = [T + "systemd[1]: Started x.", T + "systemd[1]: Finished y.", T + "logind[5]: user-1",
             T + "CRON[9]: (root) CMD", T + "sddm: greet", T + "app: error 5", T + "app[3]: fine", "bad"]
    rows = parse_lines(spark, "syslog", lines)
    assert [r.event_type for r in rows] == [
        "service_start", "service_stop", "user_activity", "cron_job", "display_manager", "error",
        "system", "system"]
    assert [r.severity for r in rows] == ["medium", "medium", "low", "low", "low", "high", "low", "low"]
    assert (rows[0].hostname, rows[0].process, rows[0].pid, rows[0].message) == (
        "box", "systemd", "1", "Started x.")
    assert rows[0].timestamp == datetime(2025, 4, 7, 11, 21, 7, 533748)
    assert (rows[7].timestamp, rows[7].hostname, rows[7].message) == (None, "", "")
    assert rows[0].log_source == "syslog" and rows[0].processed_at is not None


def test_kern_ufw_dmesg(spark):
    kern = parse_lines(spark, "kern", [
        T + "kernel: 10:00:00.1 main Service started", T + "kernel: 10:00:00.1 main Initializing service",
        T + "kernel: 10:00:00.1 main OS Product: Linux", T + "kernel: 10:00:00.1 d Monitor 1",
        T + "kernel: 10:00:00.1 d VERR_X Process ID:   77", T + "kernel: x"])
    assert [r.event_type for r in kern] == [
        "service_start", "service_init", "system_info", "hardware", "error", "kernel"]
    assert [r.severity for r in kern] == ["medium", "low", "low", "medium", "high", "low"]
    assert (kern[4].pid, kern[0].message, kern[0].process) == ("77", "Service started", "kernel")
    ufw = parse_lines(spark, "ufw", [T + "kernel: [UFW BLOCK] IN=a SRC=1.2.3.4"])[0]
    assert (ufw.event_type, ufw.severity, ufw.message, ufw.pid) == (
        "firewall_block", "medium", "IN=a SRC=1.2.3.4", None)
    lines = ["[    1.500000] kernel: Linux version 6", "[   2.000001] kernel: usb 1", "ERROR here",
             "[ 3.0] kernel: Initialized", "[ 3.0] kernel: other"]
    boot = F.lit("2025-01-01 00:00:00").cast("timestamp")
    dmesg = parse_lines(spark, "dmesg", lines, boot_time=boot)
    assert [r.event_type for r in dmesg] == ["system_info", "hardware", "error", "boot", "kernel"]
    assert dmesg[0].timestamp == datetime(2025, 1, 1, 0, 0, 1, 500000)
    assert dmesg[1].timestamp == datetime(2025, 1, 1, 0, 0, 2, 1)
    assert (dmesg[2].timestamp, dmesg[0].hostname, dmesg[0].message) == (None, "unknown", "Linux version 6")
    assert parse_lines(spark, "dmesg", lines)[0].timestamp is None


def test_auth_classes(spark):
    rows = parse_lines(spark, "auth", [
        T + "sudo: pam_unix(sudo:session): session opened for user root(uid=0) by a(uid=1)",
        T + "su[17]: pam_unix(su:session): session closed for user root",
        T + "sudo:     a : TTY=pts/0 ; COMMAND=/bin/su", T + "su[17]: pam_unix(su:session): odd",
        T + "CRON[17]: pam_unix(cron:session): odd", T + "systemd-logind[8]: Session 1 logged out.",
        T + "x: New session 5", T + "dbus-daemon[8]: [system] Failed to activate service", T + "x: y"])
    assert [r.event_type for r in rows] == [
        "session_open", "session_close", "sudo_command", "su_session", "cron_session",
        "logind_event", "session_event", "error", "auth_misc"]
    assert [r.severity for r in rows] == [
        "low", "medium", "medium", "medium", "info", "info", "info", "high", "info"]
    assert [(r.process, r.pid) for r in rows[:3]] == [("sudo", ""), ("su", "17"), ("sudo", "")]


def test_login_details(spark):
    lines = [
        "sshd[9792]: Failed password for root from 203.0.113.5 port 40022 ssh2",
        "sshd[9792]: Failed password for invalid user bob from 203.0.113.5 port 40023 ssh2",
        "sshd[1]: Accepted password for al from 10.0.0.9 port 5 ssh2",
        "sshd[1]: Accepted publickey for al from 10.0.0.9 port 6 ssh2",
        "sshd[1]: error: maximum authentication attempts exceeded for root from 1.2.3.4 port 7 ssh2 [preauth]",
        "sshd[1]: Disconnecting authenticating user root 1.2.3.4 port 8: Too many authentication failures",
        "sshd[1]: pam_unix(sshd:auth): authentication failure; logname= uid=0 rhost=1.2.3.9  user=eve",
        "sshd[1]: Failed password for nobody without address", "sshd[1]: Server listening",
        "sudo: Failed password for x from 1.1.1.1 port 1",
    ]
    df = spark.createDataFrame(
        [(i, T.replace("+01:00", "-05:00") + x, "box", "vm") for i, x in enumerate(lines)]
        + [(99, "no header", "box", "vm"), (100, None, "box", "vm")],
        "i int, message string, hostname string, vm_id string")
    rows = {r.i: r for r in syslog.parse_auth(df).collect()}
    got = [(rows[i].event_type.replace("sshd_login_", ""), rows[i].sshd_user, rows[i].sshd_src_ip,
            rows[i].sshd_port, rows[i].sshd_auth_method, rows[i].sshd_success) for i in range(10)]
    assert got == [
        ("fail", "root", "203.0.113.5", "40022", "password", False),
        ("fail", "bob", "203.0.113.5", "40023", "password", False),
        ("success", "al", "10.0.0.9", "5", "password", True),
        ("success_pubkey", "al", "10.0.0.9", "6", "publickey", True),
        ("fail", "root", "1.2.3.4", "7", "password", False),
        ("fail", "root", "1.2.3.4", "8", "password", False),
        ("fail", "eve", "1.2.3.9", None, "password", False),
        ("fail", None, None, None, "password", False),
        ("sshd_other", None, None, None, None, None), ("other", None, None, None, None, None)]
    assert (rows[0].process, rows[0].pid, rows[9].pid) == ("sshd", "9792", None)
    assert rows[0].log_timestamp == datetime(2025, 4, 7, 17, 21, 7, 533748)
    assert (rows[99].event_type, rows[99].log_timestamp, rows[100].event_type) == ("other", None, "other")
    assert len(rows) == 12 and syslog.failed_logins(syslog.parse_auth(df)).count() == 6


def test_packets_drop_malformed(spark):
    good = "\t".join(["May  1, 2025 10:00:00.123456789 UTC", "1.1.1.1", "2.2.2.2", "", "443,5000", "6"])
    df = spark.createDataFrame([(good,), ("a\tb",), ("",), (None,), (good + "\tx",)], "message string")
    rows = packets.parse_packets(df).collect()
    assert [(r.ip_src, r.traffic_type, r.day, r.second) for r in rows] == [("1.1.1.1", "HTTPS", 1, 0)]
    table = packets.packet_table(packets.parse_packets(df))
    assert table.columns[:6] == packets.FIELDS and table.columns[-1] == "traffic_type"


def test_metrics_windows(spark):
    def at(s):
        return datetime(2025, 1, 1, 0, 0, s)

    messages = [
        (at(1), '{"user":"5","system":"1","hostname":"user1","vm_id":"v"}'),
        (at(0), '{"user":null,"total":"100","used":"40","hostname":"user1","vm_id":"v"}'),
        (at(2), '{"user":"9","idle":"x","hostname":"user1","vm_id":"v"}'),
        (at(3), '{"device":"sda","rkB_s":"7","hostname":"user1","vm_id":"v"}'),
        (at(4), '{"hostname":"total","vm_id":"v"}'), (at(4), "broken {json"), (at(4), None),
        (at(12), '{"total":"0","used":"1","hostname":"user1","vm_id":"v"}')]
    df = spark.createDataFrame(messages, "timestamp timestamp, value string")
    rows = metrics.metrics_by_window(metrics.parse_metrics(df)).orderBy("timestamp").collect()
    assert len(rows) == 2
    first = rows[0]
    assert (first.cpu_user, first.cpu_system, first.cpu_idle, first.mem_used, first.mem_total,
            first.disk_read_kbs, first.disk_write_kbs) == (5.0, 1.0, None, 40.0, 100.0, 7.0, None)
    assert (rows[1].timestamp, rows[1].mem_total, rows[1].second) == (at(10), 0.0, 10)


# --- messages and star -----------------------------------------------------------

CONN = ('{"ts":1747845900.987654,"uid":"C1","id.orig_h":"10.0.0.1","id.orig_p":4,"id.resp_h":"8.8.8.8",'
        '"id.resp_p":53,"proto":"udp","hostname":"h","vm_id":"v"}')


def test_parse_messages(spark):
    df = spark.createDataFrame([(CONN.encode(),), (b"{broken",), (b'{"ts":"x"}',)], "value binary")
    parsed = network.parse_messages(df, "zeek_conn")
    good = network.good_rows(parsed).collect()
    assert [(r.uid, r.id_orig_h, r.id_resp_p, r.service) for r in good] == [("C1", "10.0.0.1", 53, None)]
    assert sorted(r[0] for r in network.quarantine(parsed).collect()) == ['{"ts":"x"}', "{broken"]
    table = network.event_table(network.good_rows(parsed), "zeek_conn").first()
    assert (table.timestamp, table.second) == (datetime(2025, 5, 21, 16, 45, 0, 987654), 0)
    plan = network.good_rows(parsed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def events(spark):
    rows = [
        ("zeek_conn", 1.5, "C1", "10.0.0.1", 1, "10.0.0.2", 2, "h", "v", "tcp"),
        ("zeek_conn", 1.5, "C1", "10.0.0.1", 1, "10.0.0.2", 2, "h", "v", "tcp"),
        ("zeek_dns", 2.0, "C2", "10.0.0.2", 2, "10.0.0.1", 1, "h", "w", "udp"),
        ("zeek_notice", 2.0, "C3", "10.0.0.2", None, "10.0.0.9", None, "h", None, None),
        ("zeek_capture_loss", 3.0, None, None, None, None, None, None, "v", None),
    ]
    df = spark.createDataFrame(
        rows, "log_type string, ts double, uid string, id_orig_h string, id_orig_p int, id_resp_h string, "
              "id_resp_p int, hostname string, vm_id string, proto string")
    return network.add_event_time(df.withColumn("service", F.lit(None).cast("string"))
                                  .withColumn("note", F.concat(F.lit("n-"), "log_type")))


def test_star(spark):
    rows = events(spark)
    fact = star.fact_events(rows)
    assert fact.columns == star.FACT and fact.count() == 4
    joined = star.fact_by_join(rows)
    assert sorted(map(str, fact.collect())) == sorted(map(str, joined.collect()))
    salted = star.fact_by_join(rows, max_broadcast_bytes=0)
    assert sorted(map(str, fact.collect())) == sorted(map(str, salted.collect()))
    entity = {(r.ip_address, r.port): (r.is_source, r.is_destination)
              for r in star.dim_network_entity(rows).collect()}
    assert entity == {("10.0.0.1", 1): (True, True), ("10.0.0.2", 2): (True, True),
                      ("10.0.0.2", None): (True, False), ("10.0.0.9", None): (False, True)}
    assert star.dim_host(rows).count() == 4 and star.dim_time(rows).count() == 3
    loss = fact.where("log_type = 'zeek_capture_loss'").first()
    assert (loss.host_id, loss.source_network_entity_id) == (None, None) and loss.time_id is not None
    assert fact.where("log_type = 'zeek_dns'").first().event_data == '{"note":"n-zeek_dns"}'


def test_fact_by_join_measures_its_dimensions(spark, monkeypatch):
    """Plans that look large are kept and measured: small dimensions are broadcast and the facts are read once for keys."""
    rows = events(spark)
    want = sorted(map(str, star.fact_events(rows).collect()))
    monkeypatch.setattr(star, "plan_bytes", lambda df: 1 << 50)
    joined = star.fact_by_join(rows)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 4 and "__salt" not in plan
    assert sorted(map(str, joined.collect())) == want
    counted = {(r.kind, r.ip_address, r.hostname, r.vm_id): r.rows for r in star.dimension_keys(rows).collect()}
    assert counted[("source", "10.0.0.1", None, None)] == 2 and counted[("dest", None, None, None)] == 1
    assert counted[("host", None, "h", "v")] == 2


def test_facts_read_their_data_once(spark):
    """The peer is in the rows as a column: no key looks for it in the packed JSON."""
    rows = events(spark).withColumn("peer", F.when(F.col("uid").isNull(), "p1"))
    fact = star.fact_events(rows)
    assert "get_json_object" not in fact._jdf.queryExecution().optimizedPlan().toString()
    numbers = events(spark).withColumn("peer", F.when(F.col("uid").isNull(), 1.5))  # packed as 1.5
    texts = events(spark).withColumn("peer", F.when(F.col("uid").isNull(), "1.5"))
    ids = [sorted(r.event_id for r in star.fact_events(x).collect()) for x in (numbers, texts)]
    assert ids[0] == ids[1] != sorted(r.event_id for r in star.fact_events(events(spark)).collect())


def test_star_keys_are_unique(spark, sf_dir):
    from checks.catalog import QUERIES

    for name, key in (("dim_time", "time_id"), ("dim_host", "host_id"), ("dim_network_entity", "network_entity_id")):
        dim = QUERIES[name](spark, sf_dir)
        assert dim.count() == dim.select(key).distinct().count()


# --- rules ----------------------------------------------------------------------

def test_rule_edges(spark):
    t = datetime(2025, 1, 1, 23, 59, 30)
    http = spark.createDataFrame(
        [(1, t, 1000000, "x", 200), (2, t, 1000001, "x", 200), (3, t, 5, "", 200), (4, t, 5, None, None),
         (5, t, None, "x", 404), (6, t, 5, "x", 0)],
        "i int, timestamp timestamp, response_body_len int, user_agent string, status_code int"
    ).withColumn("id_orig_h", F.col("i").cast("string")).withColumn("id_resp_h", F.lit("d"))
    got = {r.src_ip: r.description.split(": ", 1)[1] for r in detect.detect_suspicious_http(http).collect()}
    assert got == {"2": "large response size (1000001 bytes)", "3": "missing user agent",
                   "5": "unusual status code (404)", "6": ""}
    strain = spark.createDataFrame(
        [(t, 81.0, 1.0, 0.0), (t, 5.0, 91.0, 100.0), (t, 80.0, 90.0, 100.0), (t, None, 95.0, 100.0),
         (t, 99.0, None, 1.0)],
        "timestamp timestamp, cpu_user double, mem_used double, mem_total double")
    got = sorted(r.description.split(": ", 1)[1] for r in detect.detect_system_strain(strain).collect())
    assert got == ["CPU 5.00%, Memory 91.00%", "CPU 81.00%, Memory None%"]


def test_range_crosses_midnight_and_limits(spark):
    rows = [(i, datetime(2025, 1, 1 + i // 24, i % 24), 2025, 1, 1 + i // 24) for i in range(72)]
    df = spark.createDataFrame(rows, "i int, timestamp timestamp, year int, month int, day int")
    got = detect.time_range(df, "2025-01-01 22:00:00", "2025-01-03 01:00:00")
    assert sorted(r.i for r in got.collect()) == list(range(22, 50))
    half_open = detect.time_range(df, "2025-01-01 22:00:00", "2025-01-03 01:00:00", end_open=True)
    assert sorted(r.i for r in half_open.collect()) == list(range(22, 49))
    assert [r.i for r in detect.earliest(df, 3, "timestamp").collect()] == [0, 1, 2]
    assert detect.earliest(df, None, "timestamp").count() == 72


def test_partition_pruning(spark, tmp_path):
    from seclog.sinks.writers import append_table

    rows = [(datetime(2025, 1, 1 + i), 2025, 1, 1 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "timestamp timestamp, year int, month int, day int")
    append_table(df, str(tmp_path / "t"))
    picked = detect.time_range(spark.read.parquet(str(tmp_path / "t")),
                               "2025-01-03 00:00:00", "2025-01-04 12:00:00")
    assert picked.count() == 2
    plan = picked._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "day#" in filters and "year#" in filters
    assert tables.retain_since(df, "2025-01-05 00:00:00").count() == 5


def test_days_of_another_time_zone_are_not_lost(spark):
    """Day columns written west of Greenwich lag behind the UTC day."""
    row = (datetime(2025, 1, 2, 3), 2025, 1, 1)
    df = spark.createDataFrame([row], "timestamp timestamp, year int, month int, day int")
    assert detect.time_range(df, "2025-01-02 00:00:00", "2025-01-02 12:00:00").count() == 1
    new_year = spark.createDataFrame(
        [(datetime(2025, 1, 1, 3), 2024, 12, 31)], "timestamp timestamp, year int, month int, day int")
    assert detect.time_range(new_year, "2025-01-01 00:00:00", "2025-01-01 12:00:00").count() == 1


def test_strings_and_numbers_of_ports_unite(spark):
    t = datetime(2025, 1, 1)
    conn = spark.createDataFrame([(t, "a", "b", 22), (t, "a", "b", 22), (t, "a", "b", 443)],
                                 "timestamp timestamp, id_orig_h string, id_resp_h string, id_resp_p int")
    frames = spark.createDataFrame([(t, "a", "b", "22"), (t, "c", "d", "80,80"), (t, "e", "f", "9,80"),
                                    (t, "g", "h", "")],
                                   "frame_time timestamp, ip_src string, ip_dst string, tcp_port string")
    got = sorted((r.src_ip, r.details) for r in detect.detect_unauthorized(conn, frames).collect())
    assert got == [("a", '{"dst_port":22,"type":"Unauthorized_Access"}'),
                   ("e", '{"dst_port":80,"type":"Unauthorized_Access"}'),
                   ("g", '{"dst_port":null,"type":"Unauthorized_Access"}')]


# --- alerts and records -------------------------------------------------------------

def incidents(spark):
    t = datetime(2025, 5, 22, 10)
    rows = [(t, "System_Strain", "s", None, None, '{"cpu_user":67.74,"mem_percent":100.0,"type":"System_Strain"}')]
    rows += [(t, "Unauthorized_Access", f"u{i}", f"10.0.0.{i % 5}", "d",
              f'{{"dst_port":{[67, 3, 110, 3][i % 4]},"type":"Unauthorized_Access"}}') for i in range(20)]
    return spark.createDataFrame(
        rows, "event_time timestamp, attack_type string, description string, src_ip string, dst_ip string, details string")


def test_rollup_and_lines(spark):
    rollup = alerts.incident_rollup(incidents(spark))
    rows = {r.attack_type: r for r in rollup.collect()}
    assert rows["System_Strain"].details == "Max CPU: 67.74%, Max Memory: 100.00%"
    assert rows["System_Strain"].source_ips == "None" and rows["System_Strain"].source_ip_count == 0
    access = rows["Unauthorized_Access"]
    assert (access.incident_count, access.source_ip_count, access.source_ips) == (
        20, 5, "10.0.0.0, 10.0.0.1, 10.0.0.2, ...")
    assert access.details == "Ports targeted: 3, 67, 110"
    assert access.time_range == "2025-05-22 10 to 2025-05-22 10"
    lines = alerts.rollup_lines(rollup).withColumnRenamed("attack_type", "file")
    back = {r.fields["attack_type"]: r.fields for r in records.assemble_records(lines).collect()}
    assert back["Unauthorized_Access"]["source_ips"] == "10.0.0.0, 10.0.0.1, 10.0.0.2, ..."
    assert back["System_Strain"]["incident_count"] == "1"


def test_messages_and_text(spark):
    import json

    sent = alerts.to_alert_messages(incidents(spark), F.lit("2025-05-22 11:00:00"))
    messages = [json.loads(r.value) for r in sent.collect()]
    strain = next(m for m in messages if m["type"] == "System_Strain")
    assert strain == {"type": "System_Strain", "description": "s", "src_ip": "None", "dst_ip": "None",
                      "details": {"cpu_user": 67.74, "mem_percent": 100.0, "type": "System_Strain"},
                      "timestamp": "2025-05-22 11:00:00"}
    summary = spark.range(1).select(
        alerts.to_summary_message(F.lit("all calm"), F.lit("t")).alias("value"))
    texts = [r.text for r in alerts.incident_text(sent.unionByName(summary)).collect()]
    assert "Summary Report:\nDescription: all calm\nTimestamp: t" in texts
    assert any(t.startswith("Attack Type: System_Strain\nDescription: s\nSource IP: None\n") for t in texts)


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_record_assembly(spark, block):
    lines = ["lost line", "Attack Type: A", "  - Incident Count: 100", "  - Details: Max CPU: 67.74%",
             "Attack Type: B", "free text", "more", "Attack Type: C", "- Details: one", "tail",
             "- Details: two", "- broken"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    rows = records.assemble_records(df, block).collect()
    got = {r.record_no: r.fields for r in rows}
    assert got == {
        1: {"attack_type": "A", "incident_count": "100", "details": "Max CPU: 67.74%"},
        4: {"attack_type": "B", "details": "; free text; more"},
        7: {"attack_type": "C", "details": "two; broken"},
    }


def test_long_record_is_one_row(spark):
    lines = ["Attack Type: A", *[f"l{i}" for i in range(12_000)], "- Count: 1", "- Count: 2", "- Details: x", "y"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    for block in (7, 100_000):
        (row,) = records.assemble_records(df, block).collect()
        assert row.fields == {"attack_type": "A", "count": "2", "details": "x; y"}
    (row,) = records.assemble_records(df.where("line_no < 11000")).collect()
    assert row.fields["details"].count(";") == 10_999


def test_rollup_ranks_before_the_shuffle(spark):
    plan = alerts.incident_rollup(incidents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan[plan.index("WindowGroupLimit"):]


def test_score_join_adds_no_exchange(spark, labelled):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = tunneling.tunneling_scores(*labelled)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3


def test_free_text_types(spark):
    df = spark.createDataFrame([("A DoS wave",), ("No anomalies",)], "description string")
    assert [r.attack_type for r in alerts.type_free_text(df).collect()] == ["TCP_DoS", None]
