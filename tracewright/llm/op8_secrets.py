"""Secret scan with structural confirmation.

Base spans come from three patterns. Beyond them, runs that look like base64 or hexadecimal are decoded, and reported only if what they hold parses as
something secret:
 der    nested tag-length-value elements whose lengths add up to the whole, in the order of a private key (plain, in a PKCS #8 envelope, or encrypted);
 sshkey an OpenSSH private key: magic, cipher, derivation, public and private parts, whose lengths fill it;
 jwt    three base64url parts of which the first is a JSON header that names an algorithm;
 pem    a BEGIN ... PRIVATE KEY block whose body decodes to one of these, or says in its header lines how it is encrypted.
Public keys and certificates parse too, but are no secrets and aren't reported.

Null text: as an empty one. Null doc_id: as any other. Repeated rows: each its own row. Very long texts: whole. Ties: spans of one start are ordered by kind
(base kinds first, as listed), then end. Extra columns, whatever their names: not read; redact keeps them. Empty table: no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_columns, small_batches, with_columns

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})(?!\.?[A-Za-z0-9_-])")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----((?:(?:\s|\\[nr])*[A-Za-z-]+:[^\n\\]*(?:\n|\\[nr]))*)((?:[A-Za-z0-9+/=\s]|\\[nr])*)-----END \1-----")
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED.*DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}", re.S)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")
_BASE64_URL = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}={0,2}(?![A-Za-z0-9_=-])")
#: Lines of a wrapped run: breaks may be escaped, as in JSON.
_BREAK = r"(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\r)?\\n)"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)+={{0,2}}")
_LINE = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]+={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
#: Fixed value: what an OpenSSH private key begins with.
_SSH_MAGIC = b"openssh-key-v1\x00"
#: Nesting that a DER parse follows.
_DEPTH = 6


def is_der(data: bytes, depth: int = 0) -> bool:
    """Whether data is one SEQUENCE (at the top) of elements whose nested lengths fill it exactly, with an INTEGER or SEQUENCE first."""
    if depth == 0 and (len(data) < 16 or data[0] != 0x30):
        return False
    at, first = 0, True
    while at < len(data):
        if at + 2 > len(data):
            return False
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return False
            length = int.from_bytes(data[at : at + n], "big")
            if length < 0x80:
                return False  # not the shortest form
            at += n
        if at + length > len(data) or tag & 0x1F == 0x1F or (depth == 0 and at + length != len(data)):
            return False
        if depth == 1 and first and tag not in (0x02, 0x30):
            return False
        if tag & 0x20 and depth < _DEPTH and not is_der(data[at : at + length], depth + 1):
            return False
        at, first = at + length, False
    return depth != 1 or not first


def elements(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements in the outer sequence of data that is_der() has passed."""
    out, at = [], 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    while at < len(data):
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            length = int.from_bytes(data[at : at + n], "big")
            at += n
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_private(data: bytes) -> bool:
    """Whether a DER sequence is laid out as a private key: a version and then at least five integers, an octet string, or an algorithm and an octet string;
    or, encrypted, an algorithm and an octet string alone."""
    if not is_der(data):
        return False
    found = elements(data)
    tags = [t for t, _ in found]
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:
        return True
    if tags[0] != 0x02 or not found[0][1] or int.from_bytes(found[0][1], "big") > 1:
        return False
    return tags[1:2] == [0x04] or tags[1:3] == [0x30, 0x04] or (len(tags) >= 6 and set(tags[:6]) == {0x02})


def is_ssh(data: bytes) -> bool:
    """Whether data is an OpenSSH private key whose lengths fill it."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def skip(count: int) -> bool:
        nonlocal at
        for _ in range(count):
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not skip(3) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and skip(keys + 1) and at == len(data)


def decoded(run: str, url: bool = False) -> bytes | None:
    core = run.rstrip("=")
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(head: str, body: str, signature: str) -> bool:
    data = decoded(head, url=True)
    if not data or data.lstrip()[:1] != b"{" or decoded(body, url=True) is None or decoded(signature, url=True) is None:
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def structured(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_private(data) else "sshkey" if is_ssh(data) else None


def decoded_any(run: str) -> bytes | None:
    return decoded(run, url="-" in run or "_" in run)


def wrapped_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in lines without BEGIN and END. A first line's DER header gives the length; other keys end with their lines of one width and the next."""
    found = []
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        i = 0
        while i < len(lines):
            s, e = lines[i]
            head = decoded_any(text[s : s + 8]) if e - s >= 16 else None
            ends = []
            if head and head[0] == 0x30:
                n = head[1] & 0x7F if head[1] & 0x80 else 0
                size = 2 + n + int.from_bytes(head[2 : 2 + n], "big") if n else 2 + head[1]
                j, chars = i, 0
                while j < len(lines) and n <= 4 and chars < -(-size * 4 // 3):
                    chars += len(text[slice(*lines[j])].rstrip("="))
                    j += 1
                ends = [j]
            elif head and head[:4] == _SSH_MAGIC[:4]:
                j = i
                while j < len(lines) and lines[j][1] - lines[j][0] == e - s:
                    j += 1
                ends = [min(j + 1, len(lines)), j]
            for j in ends:
                if j > i + 1 and (kind := structured(decoded_any("".join(text[slice(*x)] for x in lines[i:j])))):
                    found.append((s, lines[j - 1][1], kind))
                    i = j - 1
                    break
            i += 1
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, span as kind:start:end), in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, k, e) for s, k, e in sorted(found)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the method, in order."""
    found = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = decoded("".join(m[3].replace("\\n", " ").replace("\\r", " ").split()))
            if structured(body) or (body and len(body) % 8 == 0 and _ENCRYPTED.search(m[2])):
                found.append((m.start(), m.end(), "pem"))
    if text.count(".") > 1:
        found += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    for m in _BASE64.finditer(text):
        if kind := structured(decoded(m[0])):
            found.append((m.start(), m.end(), kind))
    for m in _BASE64_URL.finditer(text):
        if ("-" in m[0] or "_" in m[0]) and (kind := structured(decoded(m[0], url=True))):
            found.append((m.start(), m.end(), kind))
    if "\n" in text or "\\n" in text:
        found += wrapped_spans(text)
    for m in _HEX_ANY.finditer(text):
        if kind := structured(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), kind))
    return sorted(set(found))


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, each (start, end, kind) by start, then kind (base kinds first, as listed)."""
    text = text or ""
    base = [(s, e, BASE_KINDS[k]) for s, k, e in base_spans(text)]
    rank = {k: i for i, k in enumerate(BASE_KINDS)}
    every = sorted([*base, *confirmed_spans(text)], key=lambda x: (x[0], rank.get(x[2], 9), x[2], x[1]))
    return base, every


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact_text(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each maximal covered stretch replaced by [SECRET:kind], kind being that of its first span."""
    if not spans or text is None:
        return text
    out, at = [], 0
    whole: list[list] = []
    for s, e, k in spans:
        if whole and s < whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], e)
        else:
            whole.append([s, e, k])
    for s, e, k in whole:
        out += [text[at:s], f"[SECRET:{k}]"]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (kind:start:end, comma-joined), spans."""

    def make():
        def step(c):
            both = [scan_text(x) for x in c["text"]]
            count = lambda k: [sum(x[2] == k for x in b) for b, _ in both]
            return {"doc_id": c["doc_id"], "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base": [joined(b) for b, _ in both], "spans": [joined(a) for _, a in both]}

        return step

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string", make)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found secret replaced in text, and n_chars, if there is one, to match. Other columns stay."""
    sized = "n_chars" in docs.columns

    def make():
        def step(c):
            done = [redact_text(t, scan_text(t)[1]) for t in c["text"]]
            sizes = [n if a is b or b is None else len(b) for n, a, b in zip(c["n_chars"], c["text"], done, strict=True)] if sized else []
            return {"text": done, "n_chars": sizes}

        return step

    kind = docs.schema["n_chars"].dataType.simpleString() if sized else ""
    return with_columns(docs, ["text", "n_chars"] if sized else ["text"], "text string" + (f", n_chars {kind}" if sized else ""), make)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
