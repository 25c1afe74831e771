"""Hash-chain, fingerprint and canonical-JSON functions, as Column expressions.

The domain tags of the chain are parameters: a ledger written elsewhere is verified by
passing the tags that it was written with.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG_V1, TAG_V2 = "lumenfold.ledger.event.v1", "lumenfold.ledger.event.v2"
TAGS = (TAG_V1, TAG_V2)
CURRENT_VERSION = 2


def _bytes(c: Column) -> Column:
    return c.cast("binary")


def big_endian(n: Column, size: int) -> Column:
    """An integer as `size` big-endian bytes; negative ones in two's complement."""
    return F.unhex(F.substring(F.lpad(F.hex(n.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def previous_bytes(prev_hash: Column) -> Column:
    """Empty or null: 32 zero bytes; 64 hex digits: their bytes; anything else: null."""
    return F.when(F.coalesce(prev_hash, F.lit("")) == "", F.unhex(F.lit("00" * 32))).when(prev_hash.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(prev_hash))


def _measured(c: Column) -> Column:
    return F.concat(big_endian(F.octet_length(c), 8), _bytes(c))


def _head(tag: str, prev_hash: Column, payload: Column, created_at: Column) -> list[Column]:
    return [_bytes(F.lit(tag)), F.unhex(F.lit("00000020")), previous_bytes(prev_hash), _measured(payload), F.unhex(F.lit("00000008")), big_endian(created_at, 8)]


def event_hash_v1(prev_hash: Column, payload: Column, created_at: Column, tag: str = TAG_V1) -> Column:
    """SHA-256 (hex) over the tag and the length-prefixed previous hash, canonical payload and
    time. Null where the payload isn't JSON or the previous hash isn't one."""
    return F.sha2(F.concat(*_head(tag, prev_hash, canonical_payload(payload), created_at)), 256)


def event_body(payload: Column, created_at: Column, session_id: Column, event_type: Column, redacted_text: Column) -> Column:
    """What event_hash_v2() hashes after the previous hash, of an event with a canonical payload."""
    text = F.when(redacted_text.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), _measured(redacted_text)))
    return F.concat(_measured(payload), F.unhex(F.lit("00000008")), big_endian(created_at, 8), _measured(session_id), _measured(event_type), text)


def event_hash_v2(prev_hash: Column, payload: Column, created_at: Column, session_id: Column, event_type: Column, redacted_text: Column, tag: str = TAG_V2) -> Column:
    """As v1, and the session, the type and the redacted text; a null text is told from an empty one."""
    text = F.when(redacted_text.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), _measured(redacted_text)))
    return F.sha2(F.concat(*_head(tag, prev_hash, canonical_payload(payload), created_at), _measured(session_id), _measured(event_type), text), 256)


def event_hash(version: Column, prev_hash: Column, payload: Column, created_at: Column, session_id: Column, event_type: Column, redacted_text: Column, tags: tuple[str, str] = TAGS) -> Column:
    """By chain version; null for a version that isn't known. tags: of version 1 and 2."""
    v1, v2 = event_hash_v1(prev_hash, payload, created_at, tags[0]), event_hash_v2(prev_hash, payload, created_at, session_id, event_type, redacted_text, tags[1])
    return F.when(version == 1, v1).when(version == 2, v2)


def event_digest(tag: str, previous: bytes, payload: str, created_at: int, session_id: str, event_type: str, redacted_text: str | None) -> bytes:
    """event_hash_v2() of one event with a canonical payload, for writers, which go event by event."""

    def measured(text: str) -> bytes:
        b = text.encode()
        return len(b).to_bytes(8, "big") + b

    text = b"\0" if redacted_text is None else b"\1" + measured(redacted_text)
    parts = [tag.encode(), b"\0\0\0\x20", previous, measured(payload), b"\0\0\0\x08", created_at.to_bytes(8, "big", signed=True), measured(session_id), measured(event_type), text]
    return hashlib.sha256(b"".join(parts)).digest()


def fingerprint(text: Column) -> Column:
    """The first 16 bytes of SHA-256, as 32 hex digits."""
    return F.substring(F.sha2(_bytes(text), 256), 1, 32)


def is_fingerprint(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{32}$"), F.lit(False))


def short_hash(text: Column) -> Column:
    """16 hex digits, for display."""
    return F.substring(F.sha2(_bytes(text), 256), 1, 16)


def separated_hash(domain: str, text: Column) -> Column:
    """SHA-256 of text within a domain, so that equal texts of two domains differ."""
    return F.sha2(F.concat(_bytes(F.lit(domain)), F.unhex(F.lit("00")), _bytes(text)), 256)


def canonical_json_native(text: Column) -> Column:
    """Canonical form by Spark's own parser: keys sorted, no blanks. Right for payloads of
    objects, arrays, strings, integers, booleans and nulls; use canonical_json for floats."""
    return F.to_json(F.parse_json(text))


def _number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    mantissa, _, power = repr(x).partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    ds = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + part) - len(ds))
    ds = ds.rstrip("0") or "0"
    k = len(ds)
    if k <= point <= 21:
        return sign + ds + "0" * (point - k)
    if 0 < point <= 21:
        return sign + ds[:point] + "." + ds[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + ds
    e = point - 1
    return sign + ds[0] + ("." + ds[1:] if k > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))


def canonical(value: object) -> str:
    """RFC 8785 form of a parsed JSON value: keys by UTF-16 code units, shortest numbers."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value) if abs(value) <= 1 << 53 else _number(float(value))
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """RFC 8785 canonical JSON; null for text that isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(json.loads(text))
        except ValueError:
            return None

    for s in parts:
        yield s.map(one)


def canonical_payload(text: Column) -> Column:
    """canonical_json() of text, without leaving the JVM for what Spark's own parser writes in
    the same form: plain ASCII without escapes, fractions, exponents or long numbers. Only
    other texts go to Python."""
    plain = text.rlike(r"^[\t\n\r\x20-\x5b\x5d-\x7e]*$") & ~text.rlike(r"[0-9][.eE]|-0|[0-9]{16}")
    own = F.when(plain, F.to_json(F.try_parse_json(text)))
    return F.coalesce(own, canonical_json(F.when(own.isNull(), text)))


def args_hash(args: Column) -> Column:
    """SHA-256 of the canonical arguments."""
    return F.sha2(_bytes(canonical_payload(args)), 256)


def argv_hash(argv: Column) -> Column:
    return F.sha2(_bytes(F.to_json(argv)), 256)


def descriptor_hash(tag: str, server_id: Column, tool_name: Column, description: Column, schema_json: Column, annotations_json: Column) -> Column:
    """Hash of a tool's descriptor: tag, then the length and canonical JSON of its five fields."""
    body = canonical_json(F.to_json(F.struct(
        F.coalesce(annotations_json, F.lit("null")).alias("annotations"), F.coalesce(description, F.lit("")).alias("description"), schema_json.alias("schema"), server_id.alias("server_id"), tool_name.alias("tool_name"),
    )))
    return F.sha2(F.concat(_bytes(F.lit(tag)), big_endian(F.octet_length(body), 4), _bytes(body)), 256)


def tools_hash(positions_and_hashes: Column) -> Column:
    """Hash of a server: SHA-256 over its tools' hashes in listed order.

    positions_and_hashes: array of (position, hash)."""
    return F.sha2(_bytes(F.array_join(F.transform(F.array_sort(positions_and_hashes), lambda x: x["hash"]), "")), 256)


def bit_bucket(n: Column) -> Column:
    """Bits needed for n: 0, 1, 2, 2, 3, ..."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n))).cast("int")
