"""Full-text search over session_id, event_type and redacted_text.

Tokens are runs of letters, digits, private-use characters and `_-.`, lower-cased. Accents
of Latin letters and combining marks don't count. Texts and queries go through the same
steps. Queries know bare terms (all must occur), OR, NOT, "phrases", prefixes (term*),
column:term and parentheses; a bare term of several tokens is a phrase. Results come in the
order of event_id.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("session_id", "event_type", "redacted_text")
#: Latin letters with accents and their bases, from Unicode's own decompositions, and both
#: forms of the small sigma.
_PAIRS = {c: b for c in map(chr, range(0x80, 0x2000)) if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii() and b.isalpha()}
ACCENTED, PLAIN = "".join(_PAIRS), "".join(_PAIRS.values())
MARKS = ("\u0300", "\u036f")


def fold(text: Column) -> Column:
    bare = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), f"[{MARKS[0]}-{MARKS[1]}]+", "")
    return F.translate(F.lower(bare), "ς", "σ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}_.\-]+", " "), " "), lambda t: t != "")


def tokens_of(text: str) -> list[str]:
    """tokens() of a query's term."""
    bare = "".join(_PAIRS.get(c, c) for c in text if not MARKS[0] <= c <= MARKS[1]).lower().replace("ς", "σ")
    return "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" or c in "_.-" else " " for c in bare).split(" ") if bare else []


class _Parser:
    """expr := and (OR and)*;  and := not+;  not := [NOT] atom."""

    def __init__(self, query: str):
        self.items = re.findall(r'"[^"]*"\*?|\(|\)|[\w.\-]+:"[^"]*"\*?|[^\s()"]+', query)
        self.at = 0
        if not self.items:
            raise ValueError("empty query")

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def either(self) -> Column:
        out = self.every()
        while self.peek() == "OR":
            self.at += 1
            out = out | self.every()
        return out

    def every(self) -> Column:
        out = self.atom()
        while self.peek() not in (None, ")", "OR"):
            negate = False
            if self.peek() in ("AND", "NOT"):
                negate = self.peek() == "NOT"
                self.at += 1
            item = self.atom()
            out = out & ~item if negate else out & item
        return out

    def atom(self) -> Column:
        item = self.peek()
        if item in (None, ")", "AND", "OR", "NOT"):
            raise ValueError("a term is missing")
        self.at += 1
        if item == "(":
            out = self.either()
            if self.peek() != ")":
                raise ValueError("unbalanced parenthesis")
            self.at += 1
            return out
        name, colon, rest = item.partition(":")
        if colon and name in FIELDS:
            return self.term(rest, (name,))
        return self.term(item, FIELDS)

    @staticmethod
    def term(text: str, fields: tuple[str, ...]) -> Column:
        prefix = text.endswith("*")
        words = [w for w in tokens_of(text.rstrip("*").strip('"')) if w]
        if not words:
            raise ValueError(f"no token in {text!r}")
        out = F.lit(False)
        for f in fields:
            t = F.col(f"__{f}")
            if len(words) > 1:
                line = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
                out = out | line.contains(" " + " ".join(words) + (" " if not prefix else ""))
            elif prefix:
                out = out | F.exists(t, lambda x: x.startswith(words[0]))
            else:
                out = out | F.array_contains(t, words[0])
        return out


def search(events: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Events that match, in order; the limit is part of the plan."""
    parser = _Parser(query)
    hit = parser.either()
    if parser.peek() is not None:
        raise ValueError("unbalanced parenthesis")
    found = events.withColumns({f"__{f}": tokens(F.col(f)) for f in FIELDS}).filter(hit)
    found = found.select("event_id", "session_id", "event_type", "redacted_text", "created_at").orderBy("event_id")
    return found.limit(limit) if limit else found
