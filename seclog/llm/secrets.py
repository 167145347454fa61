"""Secret scans with structural confirmation.

Fixed patterns find assignments, access keys and long hex runs. Beyond them, base64 and hex candidates
are decoded and reported only if what they hold parses: private keys in DER with consistent nested
lengths, SSH keys as length-prefixed fields, signed tokens whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog.llm.common import add_results

# The base patterns, their least lengths and the order of the kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "jwt")
BASE_KINDS = 3
_ORDER = {kind: n for n, kind in enumerate(KINDS)}

#: Runs that may be hex; a shorter run cannot hold a key.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_ANY_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++")
#: Characters of the shortest header that names an algorithm, {"alg":""} in base64.
LEAST_HEADER = 14
_PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s,:-]*+\Z")
_PEM_HEADER = re.compile(r"^[A-Za-z-]+:.*$", re.M)
_ENCRYPTED_BODY = re.compile(r"^Proc-Type:\s*4,\s*ENCRYPTED\s*$", re.M)
_CIPHER = re.compile(r"^DEK-Info:\s*[A-Z0-9-]+,\s*(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s*$", re.M)
#: Lines of one width that may be a key cut into lines; the last one may be shorter.
_LINE = re.compile(r"(?m)^[\x20\t]{0,16}([A-Za-z0-9+/_-]{4,200}={0,2})[\x20\t]*+\r?$")
LEAST_WIDTH = 32
_COLON_HEX = re.compile(r"[0-9a-fA-F]{2}(?::\s{0,40}[0-9a-fA-F]{2}){23,}+")
#: What the first 24 characters of a key in DER decode to: a sequence, then a version or an algorithm.
_DER_START = re.compile(rb"\x30(?:\x82..|\x81.|[\x20-\x7f])(?:\x02\x01[\x00\x01]|\x30.\x06|\x30\x82..\x06|\x30\x81.\x06)", re.S)
_DER_TEXT = re.compile(r"M(?=[A-P])")

_SSH_MAGIC = b"openssh-key-v1\x00"
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
MAX_DEPTH = 8


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """(tag, content) of the items that fill the bytes exactly, nested where constructed; None if
    a length runs over its container, a form is not the shortest, or nesting is too deep."""
    items, at = [], 0
    if depth > MAX_DEPTH:
        return None
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at:at + n], "big")
            if size < 0x80 or data[at] == 0:
                return None
            at += n
        if at + size > len(data):
            return None
        content: object = data[at:at + size]
        if tag & 0x20:
            content = der_items(data[at:at + size], depth + 1)
            if content is None:
                return None
        items.append((tag, content))
        at += size
    return items


def is_private_der(data: bytes) -> bool:
    """RSA, DSA or EC private keys, plain or in a (possibly encrypted) private-key envelope."""
    items = der_items(data) if data[:1] == b"\x30" else None
    if not items or len(items) != 1 or items[0][0] != SEQUENCE:
        return False
    inner = items[0][1]
    tags = [t for t, _ in inner]
    if tags[:1] == [INTEGER]:
        version = int.from_bytes(inner[0][1], "big") if inner[0][1] else -1
        if tags == [INTEGER] * len(tags) and len(tags) in (6, 9) and version in (0, 1):
            return all(c for _, c in inner)  # DSA, RSA
        if tags[:2] == [INTEGER, OCTETS] and version == 1 and set(tags[2:]) <= {0xA0, 0xA1}:
            return len(inner[1][1]) >= 16  # EC
        if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and version in (0, 1):
            return [t for t, _ in inner[1][1]][:1] == [OID]
    if tags == [SEQUENCE, OCTETS]:
        return [t for t, _ in inner[0][1]][:1] == [OID] and len(inner[1][1]) >= 16
    return False


def is_private_ssh(data: bytes) -> bool:
    """Cipher, key derivation, options, number of keys, a public and a private part that fill it."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at, fields = len(_SSH_MAGIC), []
    for n in range(6):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if n == 3:  # a number, not a field
            if size < 1:
                return False
            continue
        if at + size > len(data):
            return False
        fields.append(data[at:at + size])
        at += size
    return fields[0].isascii() and len(fields[3]) > 4 and len(fields[4]) >= 8


def from_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Three parts; the header is a JSON object that names its algorithm, the claims are JSON."""
    head, claims, signature = text.split(".")
    try:
        header = json.loads(from_base64(head) or b"")
        body = json.loads(from_base64(claims) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not isinstance(body, dict):
        return False
    return header["alg"].lower() == "none" or bool(signature and from_base64(signature))


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der_key" if is_private_der(data) else "ssh_key" if is_private_ssh(data) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lower = text.lower() if text else ""
    if any(w in lower for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]  # a whole run of HEX, long enough
    return found


def armoured_keys(text: str) -> list[tuple[str, int, int]]:
    """Every END mark with the BEGIN mark before it, if both name the same and what lies between is a key."""
    found, begin = [], None
    for m in _PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin and begin[2] == m[2] and _PEM_BODY.match(inner := text[begin.end():m.start()]):
            data = from_base64("".join(_PEM_HEADER.sub("", inner).split()))
            # an encrypted body is told by its two header lines and whole cipher blocks
            hidden = _ENCRYPTED_BODY.search(inner) and _CIPHER.search(inner) and data and len(data) % 8 == 0
            if key_kind(data) or hidden:
                found.append(("pem_key", begin.start(), m.end()))
        begin = None
    return found


def signed_tokens(text: str) -> list[tuple[str, int, int]]:
    """Three neighbouring parts of dotted runs; in the first a header may start at its first or last ``eyJ``."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for n, head in enumerate(parts[:-2]):
            for start in dict.fromkeys([head.find("eyJ"), head.rfind("eyJ")]):
                if 0 <= start <= len(head) - LEAST_HEADER and is_signed_token(".".join([head[start:], parts[n + 1], parts[n + 2]])):
                    found.append(("jwt", at + start, at + len(head) + len(parts[n + 1]) + len(parts[n + 2]) + 2))
                    break
            at += len(head) + 1
    return found


def wrapped_runs(text: str) -> list[tuple[str, int, int]]:
    """Neighbouring lines of one width, with one shorter line at their end, as (joined text, start, end)."""
    found, held = [], []

    def give():
        if len(held) > 1:
            found.append(("".join(h[1] for h in held), held[0].start(1), held[-1].end(1)))
        held.clear()

    for m in _LINE.finditer(text):
        if held and (text[held[-1].end():m.start()] != "\n" or len(m[1]) > len(held[0][1])
                     or len(held[-1][1]) < len(held[0][1])):
            give()
        if held or len(m[1]) >= LEAST_WIDTH:
            held.append(m)
    give()
    return found


def key_inside(run: str) -> tuple[str, int, int] | None:
    """A key in base64 that starts behind other characters or ends before some: its own length says where.

    Only places whose first bytes begin like a key are decoded.
    """
    for m in _DER_TEXT.finditer(run):
        at = m.start()
        head = from_base64(run[at:at + 24]) or b""
        if _DER_START.match(head):
            n = head[1]
            size = n + 2 if n < 0x80 else int.from_bytes(head[2:2 + (n & 3)], "big") + 2 + (n & 3)
            chars = -(-size * 4 // 3)
            data = from_base64(run[at:at + chars])
            if data and len(data) == size and is_private_der(data):
                return "der_key", at, at + chars
    return None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """What decodes and parses as a private key or a signed token. Every part of a text is looked at a fixed
    number of times, so time grows with its length."""
    found = armoured_keys(text) if "-----BEGIN " in text else []
    taken = [(a, b) for _, a, b in found]
    if "eyJ" in text:
        found += signed_tokens(text)

    def add(kind, start, end):
        place = bisect_right(taken, (start, len(text) + 1))
        if not any(a <= start and end <= b for a, b in taken[max(place - 1, 0):place]):
            found.append((kind, start, end))
            insort(taken, (start, end))

    for run, start, end in wrapped_runs(text):
        if kind := key_kind(from_base64(run)):
            add(kind, start, end)
    for m in _CANDIDATE.finditer(text):
        run, kind = m[0], None
        if _ANY_HEX.match(run) and len(run) % 2 == 0:
            kind = key_kind(bytes.fromhex(run))
        kind = kind or key_kind(from_base64(run))
        if kind:
            add(kind, *m.span())
        elif inside := key_inside(run):
            add(inside[0], m.start() + inside[1], m.start() + inside[2])
    if ":" in text:
        for m in _COLON_HEX.finditer(text):
            if kind := key_kind(bytes.fromhex("".join(m[0].replace(":", "").split()))):
                add(kind, *m.span())
    return found


def scan_text(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each ordered by start, then kind."""
    text = text or ""
    base = sorted(base_spans(text), key=lambda s: (s[1], _ORDER[s[0]]))
    more = confirmed_spans(text)
    return base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]])) if more else base


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns), ``base`` and ``spans``: kind, start, end in code points.

    NULL and empty texts have none; repeated rows and NULL ids are documents like others. Spans of
    different kinds may overlap. Whole texts are scanned, however long. No shuffle.
    """
    def make():
        def named(spans):
            return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

        def work(columns):
            for text in columns[0]:
                base, spans = scan_text(text)
                yield named(base), named(spans)

        return work

    return add_results(docs, ["text"], make, f"base {SPANS}, spans {SPANS}", keep)


def joined(spans: str):
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
