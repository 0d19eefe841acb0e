"""Secret scan: three base patterns, and structural confirmation of encoded keys and signed tokens.

Base kinds (leftmost, non-overlapping matches of each; matches that are too short are dropped afterwards):
``assign``, ``access`` and ``hex``. Structural kinds are only reported after their bytes have been decoded
and parsed; text that merely looks encoded is not:

* ``der``: base64 (PEM, bare, wrapped or with escaped line ends) or hex whose bytes are one ASN.1 sequence, all of
  whose nested lengths fit, and which is a key: RSA, DSA or EC integers, or an algorithm by its identifier with
  the key's octets or bits, which are parsed in turn. Signatures, digests and certificates are none;
* ``sshkey``: an OpenSSH key, binary or one-line, whose length-prefixed fields fill it exactly;
* ``jwt``: three base64url parts whose first two are JSON objects and whose header names an algorithm.

Every step is a scan from left to right without recursion, so deeply nested or very long texts do no harm.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
MIN_SECRET = 6
#: Candidates of the structural kinds. Base64 may be broken over lines, as in PEM files.
TOKEN = re.compile(r"[A-Za-z0-9_.-]+")
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{16,}(?:\r?\n)?)*[A-Za-z0-9+/]{16,}={0,2}")
#: Key files by their border lines, as they are, indented, or in a string with escaped line ends.
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{1,60}-----([^-]*)-----END [A-Z0-9 ]{1,60}-----")
GAP = re.compile(r"(?:\s|\\+[nrt])+")
LINES = re.compile(r"[A-Za-z0-9+/]+|(?:\s|\\+[nrt])+")
PEM_PARTS = re.compile(r"((?:\s|\\+[nrt])+)|\\*([A-Za-z0-9+/=]+)|.", re.DOTALL)
#: Where a bare DER sequence in base64 may start; how far it goes is told by its length.
DER_START = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nrt]))M[ICDEFGH][A-Za-z0-9+/]{14,}")
HEX_ANY = re.compile(r"[0-9A-Fa-f]{32,}")
#: No key encoding is shorter than this many bytes.
MIN_BYTES = 32
#: Least bytes of an RSA or DSA modulus (512 bits), most of a public exponent, and sizes of an EC private number.
MODULUS, EXPONENT, EC_NUMBER = 64, 8, range(20, 73)
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")
# the only ways in which a DER sequence and the two OpenSSH encodings start, in base64
BASE64_STARTS = ("MI", "MC", "MD", "ME", "MF", "MG", "MH", "AAAA", "b3BlbnNzaC1rZXkt")

# Object identifiers of key algorithms (encoded): RSA, RSA-PSS, DSA, DH, EC, X25519, X448, Ed25519, Ed448.
RSA_OIDS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
EC_OID = bytes.fromhex("2a8648ce3d0201")
OTHER_OIDS = (bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"), *(bytes.fromhex(f"2b65{n}") for n in ("6e", "6f", "70", "71")))
# How identifiers of password-based encryption begin (PKCS#5, PKCS#12).
ENCRYPTION_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base kinds, ordered by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api_key", "apikey")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_SECRET]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(start, end) of the content of the DER element at ``at``, or None if it doesn't fit."""
    if at + 2 > len(data):
        return None
    n, at = data[at + 1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > len(data):
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if n < 0x80:
            return None
    return (at, at + n) if at + n <= len(data) else None


def der_nests(data: bytes, start: int, end: int) -> bool:
    """Whether elements fill data[start:end] exactly, and so on in every constructed one. ``ends`` holds the ends of the open ones."""
    ends = [end]
    while ends:
        if start == ends[-1]:
            ends.pop()
            continue
        body = der_length(data, start)
        if body is None or body[1] > ends[-1]:
            return False
        if data[start] & 0x20:  # a sequence, set or tagged part
            ends.append(body[1])
            start = body[0]
        else:
            start = body[1]
    return True


def der_parts(data: bytes, start: int, end: int, most: int = 12) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the contents of the elements that fill data[start:end]; None if they don't, or are more than ``most``."""
    parts = []
    while start < end:
        body = der_length(data, start)
        if body is None or body[1] > end or len(parts) == most:
            return None
        parts.append((data[start], *body))
        start = body[1]
    return parts


def _sequence(data: bytes) -> list[tuple[int, int, int]] | None:
    """Parts of the one sequence that fills ``data``, if all that is nested in it fits."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    body = der_length(data, 0)
    if body is None or body[1] != len(data) or not der_nests(data, *body):
        return None
    return der_parts(data, *body)


def _integers(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """RSA (public: modulus and exponent; private: version and eight numbers) or DSA (version and five numbers)."""
    if not parts or any(t != 0x02 or a == b for t, a, b in parts):
        return False
    sizes = [b - a for _, a, b in parts]
    version = sizes[0] == 1 and data[parts[0][1]] <= 1
    if len(parts) == 2:
        return sizes[0] >= MODULUS and sizes[1] <= EXPONENT and data[parts[1][2] - 1] & 1 == 1
    return version and len(parts) in (6, 9) and sizes[1] >= MODULUS


def _ec_private(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Version 1, the number, and perhaps curve and public point."""
    return len(parts) >= 2 and [t for t, _, _ in parts[:2]] == [0x02, 0x04] and data[parts[0][1] : parts[0][2]] == b"\1" and parts[1][2] - parts[1][1] in EC_NUMBER and all(t in (0xA0, 0xA1) for t, _, _ in parts[2:])


def is_der_key(data: bytes) -> bool:
    """One sequence that fills ``data`` and is a private or public key (PKCS#1, SEC1, PKCS#8 plain or encrypted, SubjectPublicKeyInfo)."""
    if len(data) < MIN_BYTES or (parts := _sequence(data)) is None:
        return False
    if _integers(data, parts) or _ec_private(data, parts):
        return True
    tags = [t for t, _, _ in parts]
    versioned = tags[:3] == [0x02, 0x30, 0x04] and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] <= 1
    if not versioned and tags not in ([0x30, 0x04], [0x30, 0x03]):
        return False
    (_, a, b), (kind, x, y) = parts[1:3] if versioned else parts[:2]
    named = der_parts(data, a, b)
    if not named or named[0][0] != 0x06:
        return False
    oid, inner = data[named[0][1] : named[0][2]], data[x:y]
    if kind == 0x03:  # a public key: no unused bits
        if inner[:1] != b"\0":
            return False
        if oid in RSA_OIDS:
            return _integers(inner[1:], _sequence(inner[1:]) or [])
        return oid in OTHER_OIDS or (oid == EC_OID and inner[1:2] in (b"\2", b"\3", b"\4"))
    if not versioned:
        return oid.startswith(ENCRYPTION_OIDS) and len(inner) >= MIN_BYTES
    if oid in RSA_OIDS:
        return _integers(inner, _sequence(inner) or [])
    return oid in OTHER_OIDS or (oid == EC_OID and _ec_private(inner, _sequence(inner) or []))


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a public one whose length-prefixed fields fill it exactly."""
    if data.startswith(b"openssh-key-v1\0"):
        return _ssh_fields(data, 15, 3) is not None
    fields = _ssh_fields(data, 0, None)
    return bool(fields) and len(fields) >= 2 and fields[0].startswith(SSH_NAMES)


def _ssh_fields(data: bytes, at: int, count: int | None) -> list[bytes] | None:
    fields = []
    while at < len(data) and (count is None or len(fields) < count):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields if count is None or len(fields) == count else None


def is_signed_token(parts: list[str]) -> bool:
    """A header that is a JSON object with "alg", and a payload that is a JSON object."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of signed tokens: in a run of base64url parts, a header and a payload (both begin like an object) and a signature."""
    found = []
    for m in TOKEN.finditer(text):
        if ".eyJ" not in m[0]:
            continue
        parts, at, k = m[0].split("."), m.start(), 0
        starts = [at]
        for p in parts[:-1]:
            starts.append(starts[-1] + len(p) + 1)
        while k + 2 < len(parts):
            head = parts[k].find("eyJ")
            if head >= 0 and len(parts[k]) - head >= 11 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) >= 5 and len(parts[k + 2]) >= 16 and is_signed_token([parts[k][head:], parts[k + 1]]):
                found.append(("jwt", starts[k] + head, starts[k + 2] + len(parts[k + 2])))
                k += 2
            k += 1
    return found


def _key_kind(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "sshkey" if len(data) >= MIN_BYTES and is_ssh_key(data) else None


def _decoded(text: str) -> bytes | None:
    try:
        return base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None


def pem_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the bodies of PEM keys, without the gaps around them."""
    found = []
    for m in PEM.finditer(text):
        parts = [(p[2], p.start(2), p.end(2)) for p in PEM_PARTS.finditer(m[1]) if p[1] is None]
        if parts and all(p for p, _, _ in parts) and (data := _decoded("".join(p for p, _, _ in parts))) and (kind := _key_kind(data)):
            found.append((kind, m.start(1) + parts[0][1], m.start(1) + parts[-1][2]))
    return found


def wrapped_der(text: str, at: int) -> int | None:
    """End of the base64 of a DER key that starts at ``at``, over as many lines as its length asks for; None if there is none."""
    head = base64.b64decode(text[at : at + 16])
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4 or head[2 + width] not in (0x02, 0x30):
        return None
    size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    want, pad = -(-size * 4 // 3), -size % 3
    if want > len(text) - at:
        return None
    parts = []
    while want and (m := LINES.match(text, at)):
        at = m.end()
        if not GAP.match(m[0]):
            parts.append(m[0])
            want -= len(m[0])
        if want < 0:
            return None
    if want:
        return None
    for _ in range(pad):
        gap = GAP.match(text, at)
        if text.startswith("=", to := gap.end() if gap else at):
            at = to + 1
    data = _decoded("".join(parts) + "=" * pad)
    return at if data and is_der_key(data) else None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the structural kinds."""
    found = []
    if ".eyJ" in text:
        found += token_spans(text)
    keys = pem_spans(text) if "-----BEGIN " in text else []
    taken = [(a, b) for _, a, b in keys]  # in order, apart from one another

    def inside(a: int, b: int) -> bool:
        at = bisect.bisect_left(taken, (b, 0))
        return at > 0 and taken[at - 1][1] > a

    for m in DER_START.finditer(text):
        if not inside(m.start(), m.end()) and (end := wrapped_der(text, m.start())):
            keys.append(("der", m.start(), end))
            bisect.insort(taken, (m.start(), end))
    if any(s in text for s in BASE64_STARTS):
        for m in BASE64.finditer(text):
            if m[0].startswith(BASE64_STARTS) and not inside(m.start(), m.end()):
                data = _decoded(re.sub(r"\s", "", m[0]))
                if data and (kind := _key_kind(data)):
                    keys.append((kind, m.start(), m.end()))
    found += keys
    for m in HEX_ANY.finditer(text):
        if m[0][:2] in ("30", "00", "6f", "6F") and len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
            found.append((kind, m.start(), m.end()))
    return found


ORDER = (*KINDS, "jwt", "der", "sshkey")


def all_spans(text: str) -> list[tuple[str, int, int]]:
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], ORDER.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [all_spans(t.as_py() or "") for t in batch.column(1)]
        spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        base = [joined([s for s in r if s[0] in KINDS]) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array(base, pa.string())], ["doc_id", "found", "base"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of kind, start, end in code points, end exclusive), base (base spans, joined).

    Whole texts are scanned. Null counts as empty; texts without secrets have an empty array. Repeated rows are
    scanned each on its own, null ids stay null, other columns are not read. An empty table gives an empty
    result. The pass is one map over the rows without a shuffle.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(texts, _scan, "doc_id long, found array<struct<kind: string, start: long, end: long>>, base string")


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark`` (overlapping spans by one mark); null stays null."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for t in batch.column(at):
                text, new, end = t.as_py(), [], 0
                for _, a, b in all_spans(text or ""):
                    if b > end:
                        if a >= end:
                            new += [text[end:a], mark]
                        end = b
                out.append(None if text is None else "".join([*new, text[end:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return arrow_map(docs, clean, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        text.alias("spans"),
        number("jwt").alias("n_jwt"),
        (number("der") + number("sshkey")).alias("n_key"),
    )
