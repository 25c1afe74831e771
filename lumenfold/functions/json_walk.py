"""Functions over whole JSON values, as vectorised pandas UDFs: they recurse to any depth,
which column expressions can't. Null or malformed JSON gives null."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from .redaction import ALL_RULES, HARD_RULES, KEY_HINT, LABEL_OF, OWN_MARKER, PEM

_COMPILED: dict[str, re.Pattern] = {}


def _re(pattern: str) -> re.Pattern:
    return _COMPILED.setdefault(pattern, re.compile(pattern))


def scrub_string(text: str, found: set[str]) -> str:
    """As redaction.scrub; adds the names of the rules that match."""
    if _re(PEM).search(text):
        found.add("pem_private_key")
        return "[REDACTED pem_private_key]"
    hits = sorted((m.start(), -m.end(), i, name) for i, (name, p) in enumerate(ALL_RULES) for m in _re(p).finditer(text))
    found.update(h[3] for h in hits)
    merged: list[list] = []
    for start, back, _, name in hits:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -back)
        else:
            merged.append([start, -back, name])
    out, at = [], 0
    for start, end, name in merged:
        out += [text[at:start], f"[REDACTED {name}]"]
        at = end
    return "".join([*out, text[at:]])


def hard_secret_in(text: str) -> str | None:
    bare = _re(OWN_MARKER).sub("", text)
    return next((name for name, p in HARD_RULES if _re(p).search(bare)), None)


def strings_of(value: object) -> Iterator[str]:
    """All string leaves, depth first; keys in the order that canonical JSON has them."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from strings_of(x)
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from strings_of(value[k])


def redact_value(value: object, found: set[str]) -> object:
    """Value with strings scrubbed; a non-empty string under a sensitive key goes whole."""
    if isinstance(value, str):
        return scrub_string(value, found)
    if isinstance(value, list):
        return [redact_value(x, found) for x in value]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if isinstance(v, str) and v and _re(KEY_HINT).search(k):
                found.add("env_like_key")
                out[k] = f"[REDACTED len={len(v.encode())} by_key={re.sub('[^A-Za-z0-9_-]', '_', k)}]"
            else:
                out[k] = redact_value(v, found)
        return out
    return value


def _each(s: pd.Series, f: Callable) -> list:
    out = []
    for text in s:
        try:
            out.append(None if text is None else f(json.loads(text)))
        except ValueError:
            out.append(None)
    return out


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("summary", StringType())]))
def redact_json(s: pd.Series) -> pd.DataFrame:
    """Redacted JSON and its line for full-text search: the findings, then all strings."""

    def one(value: object) -> tuple[str, str]:
        found: set[str] = set()
        done = redact_value(value, found)
        strings = " ".join(strings_of(done)).strip()
        return json.dumps(done, ensure_ascii=False, separators=(",", ":"), sort_keys=True), " ".join([*(f"finding:{x}" for x in sorted(found)), strings]).strip()

    rows = [x or (None, None) for x in _each(s, one)]
    return pd.DataFrame(rows, columns=["value", "summary"])


@F.pandas_udf(ArrayType(StringType()))
def string_leaves(s: pd.Series) -> pd.Series:
    """All string leaves of a JSON value."""
    return pd.Series(_each(s, lambda v: list(strings_of(v))))


def long_strings(args: Column, threshold: int = 100) -> Column:
    """String leaves of at least `threshold` UTF-8 bytes."""
    return F.filter(string_leaves(args), lambda x: F.octet_length(x) >= threshold)


@F.pandas_udf(StringType())
def schema_descriptions(s: pd.Series) -> pd.Series:
    """Every string under a key `description`, one a line."""

    def walk(value: object) -> Iterator[str]:
        if isinstance(value, dict):
            for k in sorted(value):
                if k == "description" and isinstance(value[k], str):
                    yield value[k] + "\n"
                yield from walk(value[k])
        elif isinstance(value, list):
            for x in value:
                yield from walk(x)

    return pd.Series(_each(s, lambda v: "".join(walk(v))))


ALIAS = re.compile(r"secret://[A-Za-z0-9._\-/]*")
SCAN_TYPE = StructType([StructField("verdict", StringType()), StructField("rule", StringType()), StructField("shadowed", BooleanType())])


@F.pandas_udf(SCAN_TYPE)
def scan_args(s: pd.Series) -> pd.DataFrame:
    """('raw_secret', rule), ('all_aliased', null) or ('clean', null): aliases of secrets are
    taken out of strings before they are scanned; keys are scanned as they are. shadowed says
    that it's an assignment whose value is nothing but an alias."""

    def one(value: object) -> tuple[str, str | None, bool]:
        aliased = False
        todo = [value]
        while todo:
            v = todo.pop()
            if isinstance(v, str):
                bare = ALIAS.sub("\0", v)
                if rule := hard_secret_in(bare):
                    return "raw_secret", rule, rule == "env_assignment" and bare != v and hard_secret_in(ALIAS.sub("", v)) != rule
                aliased = aliased or hard_secret_in(v) is not None
            elif isinstance(v, list):
                todo += reversed(v)
            elif isinstance(v, dict):
                for k in sorted(v):
                    if rule := hard_secret_in(k):
                        return "raw_secret", rule, False
                todo += [v[k] for k in sorted(v, reverse=True)]
        return ("all_aliased" if aliased else "clean"), None, False

    return pd.DataFrame([x or (None, None, None) for x in _each(s, one)], columns=["verdict", "rule", "shadowed"])


def resolve_aliases(text: Column, aliases: Column) -> Column:
    """Text with each `secret://alias` that the map knows replaced by its value."""
    names = F.array_sort(F.map_keys(aliases), lambda a, b: F.length(b) - F.length(a))  # longest first
    return F.aggregate(names, text, lambda acc, n: F.replace(acc, F.concat(F.lit("secret://"), n), aliases[n]))


def hide_values(text: Column, aliases: Column) -> Column:
    """The reverse: values become their aliases again."""
    names = F.array_sort(F.map_keys(aliases), lambda a, b: F.length(aliases[b]) - F.length(aliases[a]))
    return F.aggregate(names, text, lambda acc, n: F.replace(acc, aliases[n], F.concat(F.lit("secret://"), n)))


def is_alias(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._\-/]{0,127}$"), F.lit(False))


@F.pandas_udf(StringType())
def redact_boundary(s: pd.Series, kept: pd.Series) -> pd.Series:
    """Text scrubbed, but for the placeholders in `kept` (an array), which stay as written."""
    out = []
    for text, keep in zip(s, kept, strict=True):
        if text is None:
            out.append(None)
            continue
        keep = [k for k in (keep if keep is not None else []) if k]
        parts = re.split("(" + "|".join(map(re.escape, sorted(keep, key=len, reverse=True))) + ")", text) if keep else [text]
        out.append("".join(p if i % 2 else scrub_string(p, set()) for i, p in enumerate(parts)))
    return pd.Series(out)


@F.pandas_udf(StringType())
def redact_from_right(s: pd.Series, findings: pd.Series) -> pd.Series:
    """Text with findings (start, end, kind; byte offsets) replaced one by one from the last
    start to the first. Unlike redaction.scan_text, overlapping findings are each replaced
    while their end still lies inside the shrinking text, and skipped otherwise; this is for
    comparing with ledgers that were redacted in that way."""
    out = []
    for text, found in zip(s, findings, strict=True):
        if text is None:
            out.append(None)
            continue
        raw = text.encode()
        for f in sorted(found if found is not None else [], key=lambda f: -f["start"]):
            a, b = f["start"], f["end"]
            between = lambda i: i == len(raw) or raw[i] & 0xC0 != 0x80
            if a <= b <= len(raw) and between(a) and between(b):
                raw = raw[:a] + f"[REDACTED {LABEL_OF.get(f['kind'], f['kind'])}]".encode() + raw[b:]
        out.append(raw.decode())
    return pd.Series(out)
