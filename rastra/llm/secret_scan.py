"""Secrets in texts: patterns, then structural confirmation.

The base kinds are patterns. The method's own kinds are candidates in base64 or hex which are decoded
and parsed before they count: private keys as DER (nested tags and lengths, the fields of a PKCS#1,
PKCS#8 or SEC1 key), keys in OpenSSH's format (length-prefixed fields) and signed tokens (a JSON
header that names an algorithm, a JSON body, a signature). Texts that merely look random are left alone.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Kinds in their order: the base ones, then the confirmed ones.
KINDS = ("assign", "access", "hex", "token", "pem", "key", "hexkey")
BASE_KINDS = 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([^-]*)-----END \1-----")
#: base64 of a DER sequence starts with M and A to P; of OpenSSH's magic, with its own letters.
KEY = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P][A-Za-z0-9+/]{38,}|b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]{38,})={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{78,}")
OPENSSH = b"openssh-key-v1\0"
#: Object identifiers (fixed values) of RSA and elliptic-curve keys, whose PKCS#8 form has another sequence inside.
SEQUENCE_KEYS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"))


def _decoded(text: str) -> bytes | None:
    """base64 of either alphabet, with or without its padding; None if it isn't."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """The fields (tag, content) that fill ``data`` exactly; None if the lengths don't add up."""
    fields, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 0 < n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return None
        fields.append((tag, data[at : at + size]))
        at += size
    return fields


def is_inner_key(algorithm: tuple[int, bytes], data: bytes) -> bool:
    """Whether the octets inside a PKCS#8 key are what its algorithm asks for, or at least nested fields whose lengths hold."""
    tag, oid = algorithm
    fields = der_fields(data)
    if tag != 0x06 or not fields or len(fields) != 1:
        return False
    if oid in SEQUENCE_KEYS:
        inner = der_fields(fields[0][1]) if fields[0][0] == 0x30 else None
        return bool(inner) and inner[0][0] == 0x02 and (len(inner) >= 6 or inner[1:2] != [] and inner[1][0] == 0x04)
    return fields[0][0] != 0x30 or der_fields(fields[0][1]) is not None


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER sequence with the fields of a private key."""
    outer = der_fields(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = der_fields(outer[0][1]) or []
    tags = [tag for tag, _ in fields]
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:  # encrypted: algorithm, data
        return (der_fields(fields[0][1]) or [(0, b"")])[0][0] == 0x06
    if not tags or tags[0] != 0x02 or fields[0][1] not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [0x30, 0x04]:  # version, algorithm, key
        return is_inner_key((der_fields(fields[1][1]) or [(0, b"")])[0], fields[2][1])
    return tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]) or len(tags) >= 6 and set(tags) == {0x02}


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are OpenSSH's format: cipher, kdf, options, the number of keys, then public and private parts."""
    if not data.startswith(OPENSSH):
        return False
    at, keys = len(OPENSSH), 1
    for field in range(3 + 1 + 1):
        if field == 3:
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 0 < keys <= 16:
                return False
        for _ in range(keys if field == 3 else 1):
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            if at > len(data):
                return False
    return True


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_openssh_key(data))


def is_signed_token(text: str) -> bool:
    """Whether the three parts are a JSON header with an algorithm, a JSON body and a signature (none only for the algorithm none)."""
    head, body, signature = text.split(".")
    try:
        header, claims = (json.loads(_decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    return bool(_decoded(signature)) or header["alg"].lower() == "none"


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every secret in a whole text, in that order; code points, end exclusive."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m.group())] if "eyJ" in text else []
    pems = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = re.sub(r"(?m)^[A-Za-z-]+: .*$", "", m.group(2).replace("\\n", "\n"))
            data = _decoded(re.sub(r"\s+", "", body))
            if is_key(data) or data and "Proc-Type:" in m.group(2):
                pems.append((m.start(), 4, m.end()))
    spans += pems
    begins = [a for a, _, _ in pems]  # in order and apart

    def outside(m: re.Match) -> bool:
        before = bisect.bisect_right(begins, m.start()) - 1
        return before < 0 or m.start() >= pems[before][2]

    spans += [(m.start(), 5, m.end()) for m in KEY.finditer(text) if outside(m) and is_key(_decoded(m.group()))]
    spans += [(m.start(), 6, m.end()) for m in HEX_KEY.finditer(text) if len(m.group()) % 2 == 0 and is_key(bytes.fromhex(m.group()))]
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    parts, done = [], 0
    for a, _, b in spans:
        if a >= done:
            parts += [text[done:a], mark]
        done = max(done, b)
    return "".join(parts) + text[done:]


def scan(text: Column, mark: str = "[SECRET]") -> Column:
    """struct(spans array<struct<kind, start, end>>, redacted string) for a text column.

    Spans are sorted by start, then kind. A null text has no spans and stays null; texts are read whole. Of spans that
    overlap each is listed, and the redacted text has one mark for their union.
    """

    @arrow_udf("struct<spans array<struct<kind string, start int, end int>>, redacted string>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            text = t.as_py()
            spans = secret_spans(text)
            rows.append({"spans": [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans], "redacted": redacted(text, spans, mark) if spans else text})
        return pa.array(rows, pa.struct([("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("redacted", pa.string())]))

    return run(text.cast("string"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """SHA-256 of the list of base spans."""
    return hashlib.sha256(listed([s for s in spans if s[1] < BASE_KINDS]).encode()).hexdigest()


def summary(text: Column) -> Column:
    """struct(n_assign, n_access, n_hex, base_sha256, spans) for a text column: the scan's spans as counts, a digest and a list.

    A null or empty text counts 0 each, with the digest of the empty string.
    """

    @arrow_udf("struct<n_assign long, n_access long, n_hex long, base_sha256 string, spans string>")
    def run(texts: pa.Array) -> pa.Array:
        found = [secret_spans(t.as_py()) for t in texts]
        counts = [pa.array([sum(kind == k for _, kind, _ in s) for s in found], pa.int64()) for k in range(BASE_KINDS)]
        return pa.StructArray.from_arrays([*counts, pa.array([digest(s) for s in found], pa.string()), pa.array([listed(s) for s in found], pa.string())], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run(text.cast("string"))
