"""Secret scans with structural confirmation.

Pattern findings (`assign`, `access`, `hex`) are reported as they match.  Further
candidates - base64 or hex runs, armoured blocks, dotted tokens - are decoded
and parsed, and reported only if their inner structure holds:

* `der_key`: DER whose nested lengths add up to the whole and whose shape is
  that of an RSA, EC or PKCS#8 private key;
* `ssh_key`: the OpenSSH private key layout, every length-prefixed field in place;
* `armoured_key`: a PRIVATE KEY block whose body decodes to either of these, or
  is an encrypted body (PKCS#8 `EncryptedPrivateKeyInfo`); header lines are skipped and
  escaped line ends undone, but the bare ciphertext under a `DEK-Info` line has no structure to confirm;
* `signed_token`: three base64url segments, the first a JSON object naming an
  algorithm, the second a JSON object, the third a signature (empty only for
  algorithm `none`).

Unarmoured candidates are whole runs of their alphabet on one line; an escaped line end ends a run.  A null text
is an empty one; repeated rows each get their own result; other columns are
left alone.  Spans are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.base import map_rows, texts_of

KINDS = ["assign", "access", "hex", "armoured_key", "der_key", "ssh_key", "signed_token"]
BASE_KINDS = 3
PLACEHOLDER = "[SECRET]"

_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_SIGN = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_ESCAPE = r"[nrt]|u000[9aAdD]"  # what follows the backslash of an escaped line end or tab
_ESCAPED = re.compile(rf"\\+(?:{_ESCAPE})")
_RUN64 = re.compile(rf"(?:(?<=\\)(?:{_ESCAPE}))?([A-Za-z0-9+/_-]{{40,}}={{0,2}})")
_RUN16 = re.compile(rf"(?:(?<=\\)(?:{_ESCAPE}))?([0-9A-Fa-f]{{64,}})")
_TOKEN = re.compile(
    rf"(?:(?<=\\)(?:{_ESCAPE})|(?<![A-Za-z0-9_-]))(?=([A-Za-z0-9_-]{{8,}})\.([A-Za-z0-9_-]{{2,}})\.([A-Za-z0-9_-]*))"
)
_SSH_MAGIC = b"openssh-key-v1\0"

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def decode64(run: str) -> bytes | None:
    """The bytes of a base64 or base64url run, padded or not; None if it can't be one."""
    body = run.rstrip("=")
    if len(body) % 4 == 1 or (re.search(r"[+/]", body) and re.search(r"[-_]", body)):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, value) items that fill `data` exactly, in minimal definite lengths; else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
            if size < 0x80 or size.bit_length() <= 8 * (width - 1):
                return None
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_der_key(data: bytes, encrypted: bool = False) -> bool:
    """Whether `data` is one DER sequence shaped like a private key."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [tag for tag, _ in items]
    if encrypted and tags == [_SEQUENCE, _OCTETS]:
        inner = der_items(items[0][1])
        return bool(inner) and inner[0][0] == _OID
    if tags[0] != _INTEGER or len(items[0][1]) != 1:
        return False
    if len(tags) >= 9 and tags[:9] == [_INTEGER] * 9:
        return len(items[1][1]) >= 32 and all(value for _, value in items)
    if len(tags) >= 3 and tags[1:3] == [_SEQUENCE, _OCTETS]:
        inner = der_items(items[1][1])
        return bool(inner) and inner[0][0] == _OID and len(items[2][1]) >= 16
    return len(tags) >= 2 and items[0][1] == b"\x01" and tags[1] == _OCTETS and len(items[1][1]) in (28, 32, 48, 66)


def is_ssh_key(data: bytes) -> bool:
    """Whether `data` is an OpenSSH private key: every length-prefixed field lies where it should."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at, fields = len(_SSH_MAGIC), []

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return data[at - size : at] if at <= len(data) else None

    for _ in range(3):  # cipher, key derivation, its options
        fields.append(field())
    if None in fields or not fields[0] or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys):
        public = field()
        if not public or len(public) < 4 + int.from_bytes(public[:4], "big"):
            return False
    return bool(field()) and at == len(data)


def _json_object(part: str) -> dict | None:
    raw = decode64(part)
    try:
        value = json.loads(raw.decode("utf-8")) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(claims) is None:
        return False
    if not signature:
        return head["alg"].lower() == "none"
    raw = decode64(signature)
    return raw is not None and len(raw) >= 16


def armoured(text: str) -> list[tuple[int, str, int]]:
    """(start, body, end) of the armoured blocks: from a BEGIN line to the first END line of its kind before the next BEGIN."""
    begins = list(_BEGIN.finditer(text))
    blocks = []
    for m, bound in zip(begins, [*(m.start() for m in begins[1:]), len(text)], strict=True):
        last = f"-----END {m[1]}-----"
        at = text.find(last, m.end(), bound)
        if at >= 0:
            blocks.append((m.start(), text[m.end() : at], at + len(last)))
    return blocks


def is_armoured_key(body: str) -> bool:
    """Whether an armoured body, its line ends and slashes escaped or not, holds a private key."""
    lines = re.sub(r"\\+/", "/", _ESCAPED.sub("\n", body)).split("\n")
    raw = decode64("".join("".join(x.split()) for x in lines if ":" not in x))  # without Proc-Type and the like
    return bool(raw) and (is_der_key(raw, encrypted=True) or is_ssh_key(raw))


def findings(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of all secrets of a text, in that order."""
    found = []
    if _SIGN.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(start, 3, end) for start, body, end in armoured(text) if is_armoured_key(body)]
    for m in _RUN64.finditer(text):
        run = m[1]
        if run[0] == "M" and (raw := decode64(run)) and is_der_key(raw):
            found.append((m.start(1), 4, m.end()))
        elif run.startswith("b3BlbnNzaC1rZXktdjE") and (raw := decode64(run)) and is_ssh_key(raw):
            found.append((m.start(1), 5, m.end()))
    for m in _RUN16.finditer(text):
        run = m[1]
        if len(run) % 2 == 0 and run[:2] in ("30", "6f", "6F"):
            raw = bytes.fromhex(run)
            kind = 4 if is_der_key(raw) else 5 if is_ssh_key(raw) else None
            if kind is not None:
                found.append((m.start(1), kind, m.end()))
    if text.count(".") >= 2:
        found += [(m.start(1), 6, m.end(3)) for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """`text` with every finding, overlapping ones together, replaced by a placeholder."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame) -> DataFrame:
    """Per row of `documents`: doc_id, base counts, digest and all spans, and the number of confirmed structures."""

    def step(rows: pa.Table) -> pa.Table:
        all_found = [findings(x) for x in texts_of(rows)]
        kinds = [[kind for _, kind, _ in f] for f in all_found]
        base = [joined([x for x in f if x[1] < BASE_KINDS]) for f in all_found]
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                **{f"n_{KINDS[k]}": pa.array([x.count(k) for x in kinds], pa.int64()) for k in range(BASE_KINDS)},
                "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in base],
                "spans": [joined(f) for f in all_found],
                "n_confirmed": pa.array([sum(k >= BASE_KINDS for k in x) for x in kinds], pa.int64()),
            }
        )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), step, schema)


def redacted(documents: DataFrame) -> DataFrame:
    """`documents` with every secret replaced; n_chars follows where the text changes, null texts stay null."""
    columns = documents.columns

    def step(rows: pa.Table) -> pa.Table:
        texts = rows["text"].to_pylist()
        clean = [x if not x or not (f := findings(x)) else redact(x, f) for x in texts]
        changed = {"text": pa.array(clean, pa.string())}
        if "n_chars" in columns:
            was = rows["n_chars"].to_pylist()
            lengths = [n if a == b else len(b) for n, a, b in zip(was, texts, clean, strict=True)]
            changed["n_chars"] = pa.array(lengths, rows["n_chars"].type)
        return pa.table({c: changed.get(c, rows[c]) for c in columns})

    return map_rows(documents, step, documents.schema)
