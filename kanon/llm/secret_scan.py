"""Secret scans with structural confirmation (operator 9).

Three base patterns (assignments, access keys, hex runs) are reported as they match. On top of them,
base64 and hex candidates are decoded and reported only if the bytes parse as a key encoding:

* ``jwt``      a signed token whose header decodes to a JSON object with an ``alg`` member and whose
               payload decodes to a JSON object;
* ``der_key``  DER bytes: nested tag-length-value sequences whose lengths fit exactly, starting with a
               small version INTEGER (PKCS#1, PKCS#8, SEC1) or an algorithm SEQUENCE (public key, or a private key under a
               password);
* ``ssh_key``  the length-prefixed strings of an SSH public key or an ``openssh-key-v1`` private key.

The length that the encoding states says where a key ends, in base64 and in hex, so text that follows it does not matter;
its lines may be wrapped, indented or joined by an escaped line break (``\\n``). Every run of token characters is read
once and a body is decoded once per candidate, so the time grows with the text, however long it is.

Defined cases: null text is empty and has no spans; spans are code-point offsets with the end
exclusive; the same place may be reported under several kinds, once each; every row is scanned by
itself, so repeated rows give equal results; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kanon.llm.common import map_arrow, rewrite_texts

# The base patterns of the contract, in its order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run is taken whole, so a minimum inside the pattern drops no other match
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "der_key", "ssh_key")
MIN_SECRET = 6

TOKEN_PARTS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
JWT_HEAD, JWT_MIN_HEAD, JWT_MIN_BODY = "eyJ", 11, 4
# An SSH blob starts with a 4-byte length (AAAA), a DER SEQUENCE with 0x30 (base64 M, hex 30).
BASE64_START = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nrt]))(?:AAAA|b3BlbnNzaC1rZXktdjE|M[A-P])[A-Za-z0-9+/]{28,}")
_BREAK = r"[ \t]*(?:(?:\r?\n|(?:\\+r)?\\+n)(?:[ \t]|\\+t)*)+"
NEXT_LINE = re.compile(_BREAK + r"([A-Za-z0-9+/]+)")
HEX_START = re.compile(r"(?:(?<![0-9A-Fa-f])|(?<=\\[nrt]))30[0-9A-Fa-f]{30,}")
NEXT_HEX_LINE = re.compile(_BREAK + r"([0-9A-Fa-f]+)")
# Strings of a public key by its type, the type included.
SSH_TYPES = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3}
SSH_PRIVATE = b"openssh-key-v1\0"
# Object identifiers of the password-based schemes of PKCS#5 and PKCS#12, without their last numbers.
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _b64(s: str, urlsafe: bool = False) -> bytes | None:
    s = re.sub(r"\s", "", s).rstrip("=")
    try:
        return base64.b64decode(s.translate(_URL) + "=" * (-len(s) % 4) if urlsafe else s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


_URL = str.maketrans("-_", "+/")


def is_jwt(token: str) -> bool:
    """Header and payload are JSON objects and the header names its algorithm."""
    try:
        head, body = (json.loads(_b64(p, True) or b"") for p in token.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _tlv(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at ``at``; None if its length does not fit before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = b[at], b[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        size, at = int.from_bytes(b[at : at + k], "big"), at + k
        if size < 0x80:  # DER wants the short form
            return None
    return (tag, at, at + size) if at + size <= end else None


def _nested(b: bytes, at: int, end: int, depth: int = 0) -> bool:
    """The bytes are DER values one after the other, and those that hold values nest exactly."""
    while at < end:
        v = _tlv(b, at, end)
        if v is None or depth > 16 or v[0] & 0x20 and not _nested(b, v[1], v[2], depth + 1):
            return False
        at = v[2]
    return at == end


def is_der_key(b: bytes) -> bool:
    """One SEQUENCE over all bytes, exactly nested, whose first member is a version number followed by key
    material, or an algorithm SEQUENCE that starts with an OBJECT IDENTIFIER followed by a BIT STRING."""
    top = _tlv(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b) or not _nested(b, top[1], top[2]):
        return False
    first = _tlv(b, top[1], top[2])
    second = first and _tlv(b, first[2], top[2])
    if not first or not second:
        return False
    if first[0] == 0x02:  # version 0..3, then modulus, algorithm or private octets
        return first[2] - first[1] == 1 and b[first[1]] <= 3 and second[0] in (0x02, 0x30, 0x04) and second[2] - second[1] >= 5
    kind = _tlv(b, first[1], first[2]) if first[0] == 0x30 else None
    if kind is None or kind[0] != 0x06:
        return False
    return second[0] == 0x03 or second[0] == 0x04 and second[2] - second[1] >= 16 and b[kind[1] : kind[2]].startswith(PASSWORD_SCHEMES)


class Body:
    """The encoded lines that start at a match, decoded as far as they are asked for, each character once."""

    def __init__(self, text: str, m: re.Match[str], line: re.Pattern[str] = NEXT_LINE, chars: int = 4, size: int = 3) -> None:
        self.text, self.line, self.chars, self.size = text, line, chars, size
        self.data = bytearray()
        self.spans: list[tuple[int, int]] = []
        self.tail = ""
        self._take(*m.span())

    def _take(self, a: int, b: int) -> None:
        self.spans.append((a, b))
        held = self.tail + self.text[a:b]
        whole = len(held) // self.chars * self.chars
        self.data += base64.b64decode(held[:whole]) if self.chars == 4 else bytes.fromhex(held[:whole])
        self.tail = held[whole:]

    def _more(self) -> bool:
        m = self.line.match(self.text, self.spans[-1][1])
        if m is not None:
            self._take(*m.span(1))
        return m is not None

    def bytes(self, a: int, b: int) -> bytes | None:
        """Bytes a..b; None if the lines have fewer."""
        if (b - len(self.data)) * self.chars > (len(self.text) - self.spans[-1][1] + len(self.tail)) * self.size:
            return None
        while len(self.data) < b and self._more():
            pass
        got = bytes(self.data[a:b])
        if len(self.data) < b and self.chars == 4 and len(self.tail) > 1:
            got = (bytes(self.data) + base64.b64decode(self.tail + "=" * (4 - len(self.tail))))[a:b]
        return got if len(got) == b - a else None

    def end(self, n: int) -> int:
        """Place in the text behind the characters of the first n bytes."""
        need = -(-n * self.chars // self.size)
        for a, b in self.spans:
            if need <= b - a:
                return a + need
            need -= b - a
        return self.spans[-1][1]

    def all(self) -> int:
        """Bytes of all lines."""
        while self._more():
            pass
        return len(self.data) + len(self.tail) * 3 // 4


def _strings(body: Body, at: int, most: int) -> tuple[list[bytes], int]:
    """At most ``most`` length-prefixed strings from byte ``at`` of the body, as far as they are whole, and the byte
    after them."""
    parts: list[bytes] = []
    while len(parts) < most:
        head = body.bytes(at, at + 4)
        got = head and body.bytes(at + 4, at + 4 + int.from_bytes(head, "big"))
        if got is None:
            break
        parts.append(got)
        at += 4 + len(got)
    return parts, at


def _der_size(body: Body) -> int | None:
    """Bytes of the DER key that the body starts with."""
    head = body.bytes(0, 6)
    top = head and _tlv(head, 0, 1 << 40)
    got = top and body.bytes(0, top[2])
    return top[2] if got and is_der_key(got) else None


def _ssh_size(body: Body, private: bool) -> int | None:
    """Bytes of an SSH key: strings that start with a known key type, as many as the type has (or two or
    more that end with the body), or the private-key magic followed by cipher and key-derivation names and as many keys as
    it states. A private key that is cut off reaches as far as its lines do."""
    if private:
        if body.bytes(0, len(SSH_PRIVATE)) != SSH_PRIVATE:
            return None
        names, at = _strings(body, len(SSH_PRIVATE), 3)
        if len(names) < 3 or not names[0].isascii() or names[1] not in (b"none", b"bcrypt"):
            return None
        count = body.bytes(at, at + 4)
        n = int.from_bytes(count, "big") if count else 0
        keys, end = _strings(body, at + 4, n + 1) if n else ([], 0)
        return end if n and len(keys) == n + 1 else body.all()
    kind, _ = _strings(body, 0, 1)
    if not kind or kind[0] not in SSH_TYPES:
        return None
    parts, at = _strings(body, 0, SSH_TYPES[kind[0]])
    whole = len(parts) == SSH_TYPES[kind[0]] or len(parts) >= 2 and body.bytes(at, at + 1) is None
    return at if whole else None


def base64_keys(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the keys in base64, their padding included."""
    found = []
    m = BASE64_START.search(text)
    while m is not None:
        at = m.end()
        body = Body(text, m)
        kind, size = ("der_key", _der_size(body)) if m[0][0] == "M" else ("ssh_key", _ssh_size(body, m[0][0] == "b"))
        if size:
            at = body.end(size)
            pad = -size % 3
            while pad and text[at : at + 1] == "=":
                at, pad = at + 1, pad - 1
            found.append((kind, m.start(), at))
        m = BASE64_START.search(text, at)
    return found


def hex_keys(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the DER keys in hex."""
    found = []
    m = HEX_START.search(text)
    while m is not None:
        at = m.end()
        body = Body(text, m, NEXT_HEX_LINE, 2, 1)
        size = _der_size(body)
        if size:
            at = body.end(size)
            found.append(("der_key", m.start(), at))
        m = HEX_START.search(text, at)
    return found


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the signed tokens: three parts with dots between, of which the first holds the start of a JSON
    object."""
    found = []
    for m in TOKEN_PARTS.finditer(text):
        parts, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(parts):
            head = parts[k].find(JWT_HEAD)
            fits = head >= 0 and len(parts[k]) - head >= JWT_MIN_HEAD and len(parts[k + 1]) >= JWT_MIN_BODY
            n = sum(map(len, parts[k : k + 3])) + 2
            if fits and is_jwt(text[at + head : at + n]):
                found.append(("jwt", at + head, at + n))
            at += n + 1 if fits else len(parts[k]) + 1
            k += 3 if fits else 1
    return found


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of ``text``, by start, then kind in the order of :data:`KINDS`."""
    text = text or ""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_SECRET]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if JWT_HEAD in text:
        found += tokens(text)
    found += base64_keys(text)
    if "30" in text:
        found += hex_keys(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = StructType(
    [StructField("doc_id", LongType())]
    + [StructField(c, LongType()) for c in ("n_assign", "n_access", "n_hex")]
    + [StructField("base_sha256", StringType()), StructField("spans", StringType())]
)


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the digest of the base spans, and all spans."""

    def run(rows: list[tuple]) -> list[tuple]:
        out = []
        for i, text in rows:
            spans = scan(text)
            base = [s for s in spans if s[0] in KINDS[:3]]
            n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            out.append((i, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        return out

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every maximal run of overlapping spans replaced by ``mark``."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """All documents, their secrets replaced."""
    return rewrite_texts(docs, lambda text: (True, redact(text)))
