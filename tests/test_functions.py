import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seclog import fixed_values as fv
from seclog.functions import keys, net, text, timing


def one(spark, column, **values):
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first().r


def many(spark, kind, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.r for r in df.select("i", make(F.col("x")).alias("r")).orderBy("i").collect()]


def entropy(s):
    if not s or s.isspace():
        return 0.0
    shares = [s.count(c) / len(s) for c in set(s)]
    return -sum(p * math.log2(p) for p in shares)


def test_entropy_fixed_cases(spark):
    cases = [None, "", "   ", "\t\n", "aaaa", "ab", "a b", " ", "\x1c"]
    assert many(spark, "string", cases, text.char_entropy) == pytest.approx(
        [0, 0, 0, 0, 0, 1, entropy("a b"), 0, 0]
    )


def test_entropy_property(spark):
    rng = random.Random(5)
    letters = "abcdefghij.-0123456789éß😀%_'\"\\"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(300)]
    got = many(spark, "string", words, text.char_entropy)
    for word, value in zip(words, got):
        assert value == pytest.approx(entropy(word), abs=1e-12)
        assert -1e-12 <= value <= math.log2(len(word)) + 1e-12 if len(word) > 1 else abs(value) < 1e-12


def test_entropy_of_long_runs(spark):
    cases = ["a" * 300_000, "ab" * 150_000, "a" * 100_000 + "b" * 300_000]
    assert many(spark, "string", cases, text.char_entropy) == pytest.approx(
        [0, 1, 0.25 * 2 + 0.75 * math.log2(4 / 3)])


def sequential_class(tcp, udp):
    """The rule read port by port."""
    found = fv.UNCLASSIFIED_TRAFFIC
    for port in tcp or []:
        name = fv.TCP_SERVICES.get(port)
        if name and (found == fv.UNCLASSIFIED_TRAFFIC or name in fv.PRIORITY_SERVICES):
            found = name
    for port in udp or []:
        name = fv.UDP_SERVICES.get(port)
        if name and found == fv.UNCLASSIFIED_TRAFFIC:
            found = name
    return found


def test_traffic_class(spark):
    rng = random.Random(7)
    ports = [*fv.TCP_SERVICES, *fv.UDP_SERVICES, "9", "x", "", "50000"]
    rows = [(["21", "443"], []), (["443", "80"], []), (["80", "21"], ["53"]),
            (["x", ""], ["9", "53"]), (None, None)]
    rows += [(rng.choices(ports, k=rng.randint(0, 4)), rng.choices(ports, k=rng.randint(0, 4)))
             for _ in range(500)]
    df = spark.createDataFrame(
        [(i, t, u) for i, (t, u) in enumerate(rows)], "i int, t array<string>, u array<string>"
    )
    got = df.select("i", net.traffic_class(F.col("t"), F.col("u")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [sequential_class(t, u) for t, u in rows]
    assert [r.r for r in got[:5]] == ["HTTPS", "HTTP", "HTTP", "DNS", "OTHER"]


def test_loss_severity(spark):
    got = many(spark, "double", [4.99, 5.0, 10.0, 10.01, None], net.loss_severity)
    assert got == ["Low", "Medium", "Medium", "High", "Unknown"]


def test_unusual_port(spark):
    cases = ["50123,22", "80,50123", "443,9", "8080", "", "22.0", "a,b", None, "1,2,3"]
    got = many(spark, "string", cases, net.unusual_port)
    assert got == [22, 80, 443, 8080, None, 22, None, None, 2]


def test_addresses(spark):
    cases = ["1.2.3.4", "256.1.1.1", "a.b.c.d", "1.2.3", "", None, "2001:db8:0:0:0:0:0:1", "::1"]
    assert many(spark, "string", cases, net.is_ipv4) == [True] + [False] * 7
    assert many(spark, "string", cases, net.is_ip) == [True] + [False] * 5 + [True, False]
    private = ["172.31.0.1", "172.32.0.1", "172.15.255.255", "172.16.0.0", "10.9.9.9", "11.0.0.0",
               "192.168.4.4", "192.169.0.0", "127.0.0.1", "8.8.8.8", None, "x"]
    assert many(spark, "string", private, net.is_private) == [
        True, False, False, True, True, False, True, False, True, False, False, False]
    assert one(spark, net.ipv4_number(F.col("a")), a=("string", "255.255.255.255")) == 2**32 - 1


def test_times(spark):
    epoch = one(spark, timing.from_epoch(F.col("t")), t=("double", 1747845900.987654))
    assert epoch == datetime(2025, 5, 21, 16, 45, 0, 987654)
    iso = ["2025-04-07T12:21:07.533748+01:00", "2025-04-07T12:21:07-05:00",
           "2025-04-07T12:21:07Z", "", "nonsense", None]
    got = many(spark, "string", iso, lambda c: timing.from_iso(c).cast("timestamp_ntz"))
    assert got == [datetime(2025, 4, 7, 11, 21, 7, 533748), datetime(2025, 4, 7, 17, 21, 7),
                   datetime(2025, 4, 7, 12, 21, 7), None, None, None]
    frames = ["May  1, 2025 10:00:00.123456789 UTC", "May 21, 2025 10:00:00.000000000 UTC", "x"]
    got = many(spark, "string", frames, lambda c: timing.from_frame_time(c).cast("timestamp_ntz"))
    assert got == [datetime(2025, 5, 1, 10, 0, 0, 123456), datetime(2025, 5, 21, 10), None]
    shown = many(spark, "string", ["2025-05-01 10:00:00", "2025-05-01 10:00:00.12"],
                 lambda c: timing.shown_time(c.cast("timestamp")))
    assert shown == ["2025-05-01 10:00:00", "2025-05-01 10:00:00.120000"]


def test_rules_first_match_wins(spark):
    lines = ["Starting error job", "error CRON", "sddm error", "plain", None]
    got = many(spark, "string", lines,
               lambda c: text.first_class(c, fv.EVENT_RULES["syslog"], "system"))
    assert got == ["service_start", "cron_job", "display_manager", "system", "system"]


def test_captures(spark):
    lines = ["x a=1 b=2 y", "a=1", "none", "", None, "a= b=9", "two\nlines a=1 b=2\nend"]
    got = many(spark, "string", lines, lambda c: text.captures(c, r"a=(\d*) b=(\d)", [2, 1, 0]))
    assert got == [["2", "1", ""], None, None, None, None, ["9", "", ""], ["2", "1", ""]]
    assert many(spark, "string", ["k=v", "k=", "z", None], lambda c: text.capture(c, "k=(.*)")) == [
        "v", None, None, None]


def test_attack_text_and_commands(spark):
    said = ["possible data exfiltration and dos", "a denial-of-service", "dns tunneling seen",
            "unauthorized access", "port scan", "no anomalies found", "", None]
    assert many(spark, "string", said, text.attack_type_in) == [
        "Data_Exfiltration", "TCP_DoS", "DNS_Tunneling", "Unauthorized_Access", "Other",
        None, None, None]
    commands = ["rm  -rf  /", "/sbin/REBOOT", "shutdown -h", "init 0", "mkfs.ext4", "dd if=a of=/dev/sda",
                "ls", "rm -r x"]
    assert many(spark, "string", commands, text.is_dangerous_command) == [True] * 6 + [False] * 2


def test_keys(spark):
    import hashlib

    expected = int(hashlib.sha256(b"v1:av1:7").hexdigest()[:15], 16)
    got = one(spark, keys.surrogate_key(F.col("a"), F.col("b")), a=("string", "a"), b=("int", 7))
    assert got == expected
    assert one(spark, keys.key_if_all(F.col("a"), F.col("b")), a=("string", "a"), b=("int", None)) is None


def test_shown_and_reasons(spark):
    assert one(spark, text.shown(F.col("a")), a=("string", None)) == "None"
    joined = text.reasons((F.lit(True), F.lit("x")), (F.lit(None).cast("boolean"), F.lit("y")),
                          (F.lit(True), F.lit("z")))
    assert one(spark, joined) == "x, z"


def test_keys_tell_missing_parts_apart(spark):
    rows = [("x", None), (None, "x"), (None, None), ("", None), ("a||b", "c"), ("a", "b||c"), ("n", "n"), ("v1:a", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(keys.surrogate_key(F.col("a"), F.col("b"))).distinct().count() == len(rows)


def test_a_line_cannot_forge_a_group(spark):
    from seclog.functions.text import captures

    pattern = r"for (\S+) from (\S+) port (\d+)"
    lines = ["for bob from 1.2.3.4 port 22", "for a\x016.6.6.6\x01b from 203.0.113.7 port 22", "nothing \x01 here", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in df.select(captures(F.col("line"), pattern, [1, 2, 0, 3])).collect()]
    assert got == [["bob", "1.2.3.4", "", "22"], ["a\x016.6.6.6\x01b", "203.0.113.7", "", "22"], None, None]
