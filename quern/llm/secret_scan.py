"""Secret scans with structural confirmation.

Plain patterns give the base spans. Beyond them, a run of base64 or hex letters counts only if what it decodes to has
the structure of a secret: an encoded private key whose nested lengths add up to the last byte, an OpenSSH private
key block, or a signed token whose header and claims are JSON objects. Whatever does not parse is not reported. Keys are
read over line breaks, written as such or as ``\\n`` and ``\\r\\n``; their own lengths tell where they end, which must be the
end of a line or run. Tokens end with their third segment, whatever follows it.

Kinds: ``assign``, ``access``, ``hex`` (base), then ``jwt``, ``pem``, ``der``, ``ssh``. Defined results: null texts
count as empty; every row keeps one result, whatever its id; positions are code points, ends exclusive; other columns
are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import pieces

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+))")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,-]|\\+[nrt/])*?)-----END \1-----")
#: A line break as it is or escaped, in JSON strings of JSON strings too.
BREAK = r"(?:\r\n?|\n|\\+r\\+n|\\+[nr])"
#: Where a key can begin, and the letters of a line with the break (or the escape of a slash) that leads on.
BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?=M[A-I][A-Za-z0-9+/_-]{2}|b3Bl)")
BASE64_LINE = re.compile(rf"([A-Za-z0-9+/_-]+)(?:[\x20\t]*{BREAK}[\x20\t]*|\\+(?=/))?")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?=30[0-9A-Fa-f]{2})")
HEX_LINE = re.compile(rf"([0-9A-Fa-f]+)(?:[\x20\t]*{BREAK}[\x20\t]*)?")
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
SSH_MAGIC = b"openssh-key-v1\x00"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, int]
First = Callable[[int], bytes | None]


def der_ends(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The (tag, content start, content end) of the DER values that fill ``data[start:end]`` exactly; None if any length is wrong.

    Constructed values must be filled by their own values in turn.
    """
    end = len(data) if end is None else end
    out = []
    while start < end:
        if end - start < 2 or depth > 12:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size, start = int.from_bytes(data[start : start + n], "big"), start + n
            if size < 0x80 or size >> (8 * (n - 1)) == 0:  # not the shortest form
                return None
        if start + size > end or (tag & 0x20 and der_ends(data, start, start + size, depth + 1) is None):
            return None
        out.append((tag, start, start + size))
        start += size
    return out


def is_private_key(data: bytes) -> bool:
    """One DER sequence to the last byte: a small version, then RSA numbers, an EC key, an algorithm and its key, or an encrypted key."""
    top = der_ends(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_ends(data, top[0][1], top[0][2]) or []
    tags = [t for t, _, _ in inner]
    if len(tags) == 2 and tags == [0x30, 0x04]:  # an algorithm, then the encrypted key
        first = der_ends(data, inner[0][1], inner[0][2]) or []
        return bool(first) and first[0][0] == 0x06 and inner[1][2] - inner[1][1] >= 16
    if len(tags) < 3 or tags[0] != 0x02 or inner[0][2] - inner[0][1] != 1 or data[inner[0][1]] > 1:
        return False
    if tags[1] == 0x30 and tags[2] == 0x04:
        return True
    if tags[1] == 0x04 and all(t & 0xE0 == 0xA0 for t in tags[2:]):
        return True
    return len(tags) >= 6 and all(t == 0x02 for t in tags)


def is_ssh_key(data: bytes) -> bool:
    """The block of an OpenSSH private key: length-prefixed strings and keys up to the last byte."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 64 and all(string() for _ in range(keys + 1)) and at == len(data)


def decoded(run: str) -> bytes:
    """The bytes of a base64 run, either alphabet, padded or not; empty if it isn't one."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_token(header: str, claims: str) -> bool:
    """A signed token's header names its algorithm; header and claims are JSON objects."""
    try:
        head, body = (json.loads(decoded(x)) for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the plain patterns, each leftmost and non-overlapping."""
    out: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def der_size(first: First) -> int | None:
    """The size that the first bytes of a private key give; None if no key begins with them."""
    head = first(2)
    if head is None or head[0] != 0x30 or head[1] == 0x80 or head[1] > 0x84:
        return None
    at = 2 + max(0, head[1] - 0x80)
    head = first(at + 2)
    if head is None or head[at] != 0x30 and head[at:] != b"\x02\x01":
        return None
    return at + (head[1] if at == 2 else int.from_bytes(head[2:at], "big"))


def ssh_size(first: First) -> int | None:
    """The size that the lengths inside an OpenSSH private key block give; None if it isn't one."""
    if first(len(SSH_MAGIC)) != SSH_MAGIC:
        return None
    at, strings, counted = len(SSH_MAGIC), 3, False
    while strings or not counted:
        if (head := first(at + 4)) is None:
            return None
        size, at = int.from_bytes(head[at:], "big"), at + 4
        if strings:
            at, strings = at + size, strings - 1
        elif 1 <= size <= 64:
            strings, counted = size + 1, True
        else:
            return None
    return at


def letters(text: str, at: int, line: re.Pattern[str], n: int) -> tuple[str, int] | None:
    """The first ``n`` letters from ``at`` on, joined over line breaks, and the end of the last; None if there are fewer."""
    found, end = [], at
    while n > 0 and n <= len(text) - at and (m := line.match(text, at)):
        found.append(m[1][:n])
        n, end, at = n - len(found[-1]), at + len(found[-1]), m.end()
    return None if n > 0 else ("".join(found), end)


def keys(text: str) -> Iterator[Span]:
    """The private keys in runs of base64 and hex letters, wrapped or not."""
    for begins, line, count, decode, least in (BASE64, BASE64_LINE, lambda n: -(-n * 4 // 3), decoded, 40), (HEX_ANY, HEX_LINE, lambda n: 2 * n, bytes.fromhex, 48):
        last = 0
        for m in begins.finditer(text):
            start = m.start()

            def first(n: int) -> bytes | None:
                found = letters(text, start, line, count(n))  # noqa: B023
                return decode(found[0])[:n] if found else None  # noqa: B023

            if start < last:
                continue
            der = der_size(first)
            size = ssh_size(first) if der is None else der
            if size is None or count(size) < least or not (found := letters(text, start, line, count(size))):
                continue
            run, end = found
            if line.match(text, end) or not (is_private_key if der else is_ssh_key)(decode(run)):
                continue
            if line is BASE64_LINE:
                end += len(re.match("={0,2}", text[end : end + 2])[0])
            yield start, 5 if der else 6, end
            last = end


def confirmed_spans(text: str) -> list[Span]:
    """(start, kind, end) of what decodes to a key or token."""
    out: list[Span] = []
    if "." in text:
        last = 0
        for m in JWT.finditer(text):
            if m.start() >= last and is_token(m[1], m[2]):
                out.append((m.start(), 3, last := m.end(3)))
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = re.sub(r"\\+t|\\+(?=/)", " ", re.sub(BREAK, "\n", m[2]))
            lines = [x for x in body.split("\n") if ":" not in x]
            data = decoded("".join("".join(lines).split()))
            if is_private_key(data) or is_ssh_key(data) or (":" in m[2] and "ENCRYPTED" in m[2] and len(data) >= 32):
                out.append((m.start(), 4, m.end()))
    inside = [(a, b) for a, k, b in out if k == 4]
    out += [x for x in keys(text) if not any(a <= x[0] < b for a, b in inside)]
    return sorted(set(out))


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans, for each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for text in piece.column("text").to_pylist():
                base = base_spans(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(sorted(base + confirmed_spans(text or "")))))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents, all columns, with every span of ``text`` replaced by ``mark``; overlapping spans by one."""
    at = docs.columns.index("text")

    def without(text: str | None) -> str | None:
        if not text or not (spans := base_spans(text) + confirmed_spans(text)):
            return text
        out, last = [], 0
        for start, _, end in sorted(spans):
            if start >= last:
                out += [text[last:start], mark]
            last = max(last, end)
        return "".join([*out, text[last:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield piece.set_column(at, "text", pa.array(map(without, piece.column("text").to_pylist()), pa.string()))

    return docs.mapInArrow(scan, docs.schema)
