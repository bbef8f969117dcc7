"""Secret scan: three textual kinds, and encoded keys and signed tokens that are reported only when they parse.

A candidate for the structural kinds is a run of base64 or hex, or base64 over lines. It is decoded and its inside is read: DER
key encodings whose nested lengths must fill each other exactly, SSH keys of length-prefixed strings, and signed tokens whose
header is a JSON object that names an algorithm. Of an armoured key encrypted as a whole only headers and length can be read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.llm.names import safe_names

# The kinds in their order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "token", "key")
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
# End of the fixed values.

# In lower case, so that the search is a plain one; what follows the keyword decides whether ASSIGN is tried at all.
ASSIGN_HEAD = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")
SIGNED = re.compile(rb"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
ENCODED = re.compile(rb"[A-Za-z0-9+/_-]{40,}+={0,2}")
# A header line that holds the next BEGIN ends the headers, so that no text is read once for every BEGIN before it.
ARMOUR = re.compile(rb"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE))-----\s*+((?:[ \t]*+[A-Za-z0-9-]++:(?:(?!-----BEGIN )[^\r\n])*+\r?\n)*+)([A-Za-z0-9+/=\s]++)-----END \1-----")
ENCRYPTED = re.compile(rb"Proc-Type:[ \t]*4,ENCRYPTED\s+DEK-Info:[ \t]*[A-Z0-9-]+,(?:[0-9A-Fa-f]{16}){1,2}\s")
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(rb"[A-Za-z0-9+/_-]+")
LONG_HEX = re.compile(rb"[0-9A-Fa-f]{48,}")
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_STRINGS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2}  # of a public key; those of curves have three
SSH_STARTS = (b"ssh-", b"ecdsa-sha2-")
SSH_FILE = b"openssh-key-v1\0"
INTEGER, BITS, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def _decoded(run: bytes) -> bytes | None:
    """Base64 in either alphabet, padded or not."""
    run = run.translate(bytes.maketrans(b"-_", b"+/")).rstrip(b"=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that fill ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            length, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + length > len(data):
            return None
        items.append((tag, data[at:at + length]))
        at += length
    return items


def _algorithm(item: tuple[int, bytes]) -> bool:
    inner = der_items(item[1]) if item[0] == SEQUENCE else None
    return bool(inner) and inner[0][0] == OBJECT_ID and 3 <= len(inner[0][1]) <= 32


def _cipher(item: tuple[int, bytes]) -> bool:
    """An algorithm whose parameters are a sequence, as those of all password-based encryption are; those of a digest are not."""
    return _algorithm(item) and [tag for tag, _ in der_items(item[1])] == [OBJECT_ID, SEQUENCE]


def is_der_key(data: bytes) -> bool:
    """RSA, DSA, elliptic-curve or wrapped keys: one sequence whose nested lengths and leading items are those of a key."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [tag for tag, _ in items]
    if tags == [SEQUENCE, OCTETS]:  # encrypted private key behind its cipher
        return len(items[1][1]) >= 16 and _cipher(items[0])
    if tags[0] == SEQUENCE:  # public key behind its algorithm
        return tags == [SEQUENCE, BITS] and _algorithm(items[0])
    if tags[0] != INTEGER or not items[0][1]:
        return False
    if len(tags) >= 9 and set(tags[:9]) == {INTEGER}:  # RSA private key
        return True
    if tags == [INTEGER] * 6:  # DSA private key: version 0, three numbers of the group, both keys
        return items[0][1] == b"\0"
    if tags == [INTEGER, INTEGER]:  # RSA public key: a large odd modulus and a small exponent
        return len(items[0][1]) >= 64 and bool(items[0][1][-1] & 1) and len(items[1][1]) <= 8
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # private key behind its algorithm
        return _algorithm(items[1])
    return tags[:2] == [INTEGER, OCTETS] and items[0][1] == b"\1" and len(items[1][1]) >= 16  # curve private key


def _strings(data: bytes) -> list[bytes] | None:
    """Strings with 4-byte lengths that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        length = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + length > len(data):
            return None
        out.append(data[at + 4:at + 4 + length])
        at += 4 + length
    return out


def is_ssh_key(data: bytes) -> bool:
    """A public SSH key blob, or a private key file's frame: name of cipher, of derivation, options, count and one key."""
    if data.startswith(SSH_FILE):
        rest, fields = data[len(SSH_FILE):], []
        for _ in range(3):
            length = int.from_bytes(rest[:4], "big")
            if 4 + length > len(rest):
                return False
            fields.append(rest[4:4 + length])
            rest = rest[4 + length:]
        held = _strings(rest[4:])
        return fields[0].isascii() and bool(fields[0]) and held is not None and len(held) == 1 + int.from_bytes(rest[:4], "big")
    if data[:3] != b"\0\0\0":
        return False
    parts = _strings(data)
    return bool(parts) and len(parts) >= 2 and parts[0] in SSH_NAMES


def is_key(data: bytes | None) -> bool:
    return data is not None and len(data) >= 24 and (is_der_key(data) or is_ssh_key(data))


def _is_armoured(label: bytes, headers: bytes, body: bytes) -> bool:
    """A key that parses, or a private key that its headers name as encrypted and that fills blocks of 8 bytes."""
    data = _decoded(b"".join(body.split()))
    if label.endswith(b"PRIVATE KEY") and ENCRYPTED.search(headers):
        return data is not None and len(data) >= 24 and len(data) % 8 == 0
    return is_key(data)


def _ssh_length(data: bytes, start: int) -> int | None:
    """Bytes of the SSH key whose base64 starts at ``start``, from the lengths of its strings alone; None where they run out."""
    def number(at: int) -> int:
        group = start + at // 3 * 4
        piece = _decoded(data[group:group + 8]) or b""
        return int.from_bytes(piece[at % 3:at % 3 + 4], "big") if len(piece) >= at % 3 + 4 else len(data)

    head = _decoded(data[start:start + 28]) or b""
    file = head.startswith(SSH_FILE)
    at, left = (len(SSH_FILE), 3) if file else (0, SSH_STRINGS.get(head[4:4 + head[3]], 3))
    while left:
        at, left = at + 4 + number(at), left - 1
        if not left and file:
            file, left, at = False, number(at) + 1, at + 4  # public keys and one private part
        if at > len(data):
            return None
    return at


def _wrapped_keys(block: bytes) -> Iterator[tuple[int, int]]:
    """Spans of the keys in lines of base64. A DER header and the lengths of an SSH key's strings tell where the key ends."""
    lines = [m.span() for m in LINE.finditer(block)]
    ends = list(accumulate(b - a for a, b in lines))  # characters up to the end of each line
    data, at = b"".join(block[a:b] for a, b in lines), 0
    while at < len(lines):
        before = ends[at] - (lines[at][1] - lines[at][0])
        head = _decoded(data[before:before + 28]) or b"" if ends[at] - before >= 40 else b""
        total = None
        if head[:1] == b"\x30":
            width = head[1] & 0x7F if head[1] & 0x80 else 0
            total = 2 + width + (int.from_bytes(head[2:2 + width], "big") if width else head[1]) if width <= 4 else None
        elif head.startswith(SSH_FILE) or (head[:3] == b"\0\0\0" and head[4:4 + head[3]].startswith(SSH_STARTS)):
            total = _ssh_length(data, before)
        upto = len(lines) if total is None else bisect_left(ends, before - (-8 * total // 6))
        found = upto if at < upto < len(ends) and ends[upto] - before == -(-8 * total // 6) and is_key(_decoded(data[before:ends[upto]])) else None
        if found is None:
            at += 1
            continue
        end = lines[found][1]
        yield lines[at][0], end + len(block[end:end + 2]) - len(block[end:end + 2].lstrip(b"="))
        at = found + 1


def is_signed_token(run: bytes) -> bool:
    """Three parts: a JSON header that names an algorithm, a payload and a signature that decode."""
    head, body, signature = run.split(b".")
    try:
        header = json.loads(_decoded(head) or b"")
    except (ValueError, RecursionError):  # brackets nested beyond what JSON readers take
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        return False
    return bool(_decoded(body)) and (header["alg"].lower() == "none" or bool(signature and _decoded(signature)))


def _find(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, rank of the kind, end) in bytes."""
    if ASSIGN_HEAD.search(data.lower()):
        for m in ASSIGN.finditer(data):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                yield m.start(), 0, m.end()
    if b"AKIA" in data:
        for m in ACCESS.finditer(data):
            yield m.start(), 1, m.end()
    for m in HEX.finditer(data):
        yield m.start(), 2, m.end()
    if b"." in data and b"ey" in data:
        for m in SIGNED.finditer(data):
            if is_signed_token(m[0]):
                yield m.start(), 3, m.end()
    keys = []
    if b"-----BEGIN " in data:
        for m in ARMOUR.finditer(data):
            if _is_armoured(m[1], m[2], m[3]):
                keys.append((m.start(), m.end()))
    for m in WRAPPED.finditer(data):
        keys += [(m.start() + a, m.start() + b) for a, b in _wrapped_keys(m[0])]
    for m in ENCODED.finditer(data):
        run = m[0]
        whole = binascii.unhexlify(run) if len(run) % 2 == 0 and LONG_HEX.fullmatch(run) else None
        if is_key(whole) or is_key(_decoded(run)):
            keys.append(m.span())
    last = 0
    for start, end in sorted(keys, key=lambda span: (span[0], -span[1])):  # an armoured or wrapped block counts once
        if start >= last:
            yield start, 4, end
            last = end


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then in the order of KINDS; NULL is empty."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    spans = sorted(_find(data))
    if len(data) != len(text) and spans:
        marks, place, seen = {}, 0, 0
        for at in sorted({x for start, _, end in spans for x in (start, end)}):
            seen += len(data[place:at].decode("utf-8", "surrogatepass"))
            place = at
            marks[at] = seen
        spans = [(marks[start], kind, marks[end]) for start, kind, end in spans]
    return [(KINDS[kind], start, end) for start, kind, end in spans]


def _spans_of(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t)] for t in texts], dtype=object)


def _masked(text: str | None) -> str | None:
    out, done = [], 0
    for kind, start, end in scan_text(text):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def secret_spans(text: Column) -> Column:
    """Column form of ``scan_text``: one array per text, empty where nothing is found."""
    return F.pandas_udf(_spans_of, "array<struct<kind:string,start:bigint,end:bigint>>")(text)


def without_secrets(text: Column) -> Column:
    """Each text with every reported span replaced by ``[kind]``; overlapping spans go as one, NULL stays NULL."""
    return F.pandas_udf(lambda texts: pd.Series([_masked(t) for t in texts], dtype=object), "string")(text)


def scan(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``df`` with the column ``into``: array of (kind, start, end), in code points and by start.

    NULL and empty texts give an empty array; whole texts are read whatever their length; every row stays, repeated rows
    give equal arrays; a column already named ``into`` is replaced. No shuffle.
    """
    return df.withColumn(into, secret_spans(F.col(text)))


def redacted(documents: DataFrame) -> DataFrame:
    """``documents``, every row kept, with the spans found in ``text`` replaced and ``n_chars`` counted anew where text changed.

    NULL and empty texts and all other columns, whatever their names, stay as they are; repeated rows give equal rows.
    """
    given = documents.toDF(*safe_names(documents.columns, ("text", "n_chars")))
    clean = given.withColumn("clean", without_secrets(F.col("text")))
    new = {"text": F.col("clean")}
    if "n_chars" in given.columns:
        kind = given.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("clean") != F.col("text"), F.length("clean").cast(kind)).otherwise(F.col("n_chars"))
    return clean.select(*[new[c].alias(c) if c in new else f"`{c}`" for c in given.columns]).toDF(*documents.columns)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def secret_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token, n_key) of every document."""
    found = scan(documents.select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), count("token"), count("key"))
