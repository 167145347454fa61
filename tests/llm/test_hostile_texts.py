"""Texts that once took time with the square of their length, and keys in unusual dress."""

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from seclog.llm import html_text, line_dedup, near_dup, packing, secrets

PAGES = {
    "center": "<center>" * 125_000, "stray end": "<b>" * 150_000 + "</zz>" * 100_000,
    "under a stop": "<p><button>" + "<center>" * 120_000, "comments": "<!--" * 250_000, "open": "<" * 1_000_000,
    "inline ends": "<div>" * 50_000 + "</b>" * 200_000,
}
TEXTS = {
    "eyJ": "eyJ" * 330_000, "eyJ.": "eyJ." * 250_000, "begin": "-----BEGIN PRIVATE KEY-----\n" * 36_000,
    "begin and end": "-----BEGIN PRIVATE KEY-----\n-----END PRIVATE KEY-----\n" * 18_000, "MIIE": "MIIE" * 250_000,
    "hex": "ab:" * 330_000, "lines": ("A" * 64 + "\n") * 15_000, "dashes": "-" * 1_000_000,
}


def seconds(action, text):
    started = time.process_time()
    action(text)
    return time.process_time() - started


@pytest.mark.parametrize("name", list(PAGES))
def test_pages_in_linear_time(name):
    assert seconds(html_text.main_text, PAGES[name]) < 6


@pytest.mark.parametrize("name", list(TEXTS))
def test_secrets_in_linear_time(name):
    assert seconds(secrets.scan_text, TEXTS[name]) < 4


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + content


RSA = der(0x30, b"".join(der(2, x) for x in [b"\x00", b"\x7f" * 128, b"\x01\x00\x01", b"\x55" * 128, *[b"\x33" * 64] * 5]))
KEY = base64.b64encode(RSA).decode()


def added(text):
    return [(k, text[a:b]) for k, a, b in secrets.scan_text(text)[1] if k in secrets.KINDS[secrets.BASE_KINDS:]]


def test_keys_over_lines_behind_paths_and_with_colons():
    lines = "\n".join(KEY[n:n + 64] for n in range(0, len(KEY), 64))
    assert added(f"see\n{lines}\nend") == [("der_key", lines)]
    assert added("\n".join("  " + x for x in lines.split("\n")))[0][0] == "der_key"
    assert added(f"path/{KEY}") == [("der_key", KEY)] or added(f"path/{KEY}") == [("der_key", KEY.rstrip("="))]
    assert added(f"aa{KEY.rstrip('=')}bb")[0][0] == "der_key"
    colons = ":".join(f"{b:02X}" for b in RSA)
    assert added(f"key {colons}.") == [("der_key", colons)]
    assert added(lines.replace("MII", "MIJ", 1)) == []


def test_encrypted_body_needs_its_header_lines():
    body = base64.b64encode(bytes(range(64))).decode()
    whole = ("-----BEGIN RSA PRIVATE KEY-----\n{}" + body + "\n-----END RSA PRIVATE KEY-----")
    assert added(whole.format("")) == []
    told = whole.format("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n")
    assert added(told) == [("pem_key", told)]
    assert added("-----BEGIN RSA PRIVATE KEY-----\n" + told) == [("pem_key", told)]


def test_tokens_inside_dotted_runs():
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = f"{part(b'{\"alg\":\"HS256\"}')}.{part(b'{\"sub\":\"1\"}')}.{part(b'signature')}"
    for text in (token, f"host.{token}", f"id_{token}", f"a.b.{token}.c"):
        assert ("jwt", token) in added(text), text


def test_packing_keeps_to_its_bound_and_near_the_least(spark):
    """Online with a bound that acts: at most so many bins are open, and few sequences are lost."""
    lengths = [1 + (n * 7919) % 1023 for n in range(4000)]
    bins, fullest = packing.BestFit(1024, 16), []
    for n in lengths:
        bins.place(n)
        fullest.append(sum(map(len, bins.by_room)))
    assert max(fullest) == 16
    pieces = spark.createDataFrame([(n, 0, 0, x, 0) for n, x in enumerate(lengths)], packing.PIECES)
    packed = packing.pack(pieces)
    used = packed.select("sequence_id").distinct().count()
    assert used <= 1.02 * -(-sum(lengths) // 1024)
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sums.where("n <> end OR n > 1024").count() == 0


def test_copies_that_line_dedup_empties_go(spark):
    text = "\n".join(f"line {n} of the copied text" for n in range(5))
    rows = [(1, text), (2, text), (3, text + "\nand one more line"), (4, ""), (5, None), (6, "\n\n")]
    left = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [
        (1, text), (3, "and one more line"), (4, ""), (5, None), (6, "\n\n")]


def test_pairs_meet_in_the_first_band_by_its_key():
    """A sketch that agrees in an earlier band, in which the keys differ, does not hide the pair."""
    import numpy as np

    sketches = np.ones((2, 10), np.uint16)
    keys = np.array([[1, 7], [2, 7]])
    assert near_dup._likely(sketches, keys, 0, 0.5, 1).tolist() == [1]
    assert near_dup._likely(sketches, keys, 0, 0.5, 0).tolist() == []


def test_long_texts_meet_in_blocks_of_bounded_size(spark):
    """A text of many shingles counts for several rows of a block; the classes stay the same."""
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(60_000)]
    rows = [(0, " ".join(base)), (1, " ".join(["changed", *base[1:]])), (2, " ".join([*base[:-1], "changed"])),
            (3, " ".join(base[:300])), (4, " ".join(base[:299])), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = {r.doc_id: r.weight for r in near_dup.features(docs).select("doc_id", "weight").collect()}
    assert weights == {0: 15, 1: 15, 2: 15, 3: 1, 4: 1, 5: None}
    for block_rows in (1024, 20):
        found = near_dup.near_duplicate_classes(docs, block_rows=block_rows).select("doc_id", "class_id").collect()
        assert dict(map(tuple, found)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
