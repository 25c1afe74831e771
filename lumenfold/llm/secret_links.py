"""Secret scans with multipart credential linking (operator 11). Column expressions only.

Base findings are the matches of three patterns, each leftmost and non-overlapping by itself;
they always count. Weak candidates say nothing alone: identifiers (a user or client name),
endpoints (an address) and keys (a long run of mixed characters). They are found by one more
scan that takes the leftmost of all kinds, and are reported only where their complement is
near: a key needs an identifier, an identifier a secret, an endpoint both. Access
identifiers of the base count as identifiers, its assignments and hex runs as secrets, and
weak ones complement each other. Near means: in the same scope, apart from each other, and
at most `REACH` code points between them. A scope is what lies between blank lines.

Nearness is an interval join. Candidates, widened by the reach, and parts are dealt to
places of `PLACE` code points, and joined by text, scope, place and role; a semi-join, so a
candidate counts once however many parts are near it. Long texts are spread by place.

Positions are code points, ends exclusive. Null texts count as empty; an empty text has no
findings. Texts of any length are scanned whole. Rows that repeat a doc_id are told apart by
their texts, repeated rows get the same result each, and so does a null doc_id. Equal starts
are ordered by kind. An empty table gives an empty result. Other columns of the input aren't
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, written

#: The base patterns, and what a match needs besides.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
)
ASSIGN_VALUE = ASSIGN.removesuffix("+") + "{12,}"
#: Runs are maximal, so the least length can stand in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"

#: The weak candidates. Names of schemes are bounded, so that a long run isn't tried from
#: each of its places on.
IDENTIFIER = (
    r"""([Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr](_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])"""
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
)
ENDPOINT = (
    r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|([Hh][Oo][Ss][Tt]([Nn][Aa][Mm][Ee])?|[Ee][Nn][Dd][Pp][Oo][Ii][Nn][Tt]|[Ss][Ee][Rr][Vv][Ee][Rr])"""
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(:[0-9]+)?"""
)
KEY = "[A-Za-z0-9+/_-]{20,}={0,2}"
ANY = "|".join(f"({p})" for p in (ENDPOINT, IDENTIFIER, ASSIGN, ACCESS, HEX, KEY))
BLANK_LINE = r"\n[\x20\t\r]*\n"

KINDS = ("assign", "access", "hex", "identifier", "endpoint", "key")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "endpoint": "endpoint", "key": "secret"}
#: What a weak candidate needs near it, all of it.
NEEDS = {"identifier": ("secret",), "endpoint": ("identifier", "secret"), "key": ("identifier",)}
REACH, PLACE = 200, 400
#: Matches whose places are summed up in a row; their sums are added up after.
RUN = 64
SPAN = "array<struct<start:int,ord:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(gaps: Column, found: Column) -> Column:
    """(start, match) of each match, from the texts between matches and the matches.

    A place is the sum of all lengths before it. Sums go by runs of `RUN` matches and over
    the runs, so that a text with many matches isn't copied once for each.
    """
    n = F.size(found)
    runs = F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int"))
    lengths = F.zip_with(F.slice(gaps, 1, n), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))

    def of(ls: Column) -> Column:
        own = lambda r: F.slice(ls, r * RUN + 1, F.lit(RUN))
        sums = F.transform(runs, lambda r: F.aggregate(own(r), F.lit(0), lambda a, x: a + x["g"] + x["m"]))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        step = lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["g"])).alias("out"))
        within = lambda b: F.flatten(F.transform(runs, lambda r: F.aggregate(own(r), F.struct(F.get(b, r).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])))
        return F.zip_with(_let(before, within), found, lambda s, m: F.struct(s.alias("start"), m.alias("m")))

    return _let(lengths, of)


def spans(text: Column, pattern: str, order: Callable[[Column], Column]) -> Column:
    """(start, ord, end) of the matches of a pattern; order(match) gives the kind's number, or
    null for a match that doesn't count."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = F.transform(_places(F.split(text, pattern, -1), found), lambda x: F.struct(x["start"].alias("start"), order(x["m"]).cast("int").alias("ord"), (x["start"] + F.length(x["m"])).alias("end")))
    return F.when(text.rlike(pattern), F.filter(placed, lambda x: x["ord"].isNotNull())).otherwise(F.array().cast(SPAN))


def _weak_kind(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    number = lambda kind: F.lit(KINDS.index(kind))
    mixed = m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    base = whole(ASSIGN) | whole(ACCESS) | whole(HEX)
    return F.when(whole(ENDPOINT), number("endpoint")).when(whole(IDENTIFIER), number("identifier")).when(~base & mixed, number("key"))


def _in_role(parts: Column, role: str) -> Column:
    return F.exists(parts, lambda p: p["ord"].isin([i for i, k in enumerate(KINDS) if ROLE[k] == role]))


def scanned(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, __id, __h, base, weak, breaks: what each text holds, nothing linked yet.

    Without an identifier and a secret nothing weak can be reported; such texts have none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    number = lambda kind: lambda m: F.lit(KINDS.index(kind))
    value = lambda m: F.when(m.rlike(f"^{ASSIGN_VALUE}$"), KINDS.index("assign"))
    base = F.array_sort(F.concat(spans(text, ASSIGN, value), spans(text, ACCESS, number("access")), spans(text, HEX, number("hex"))))
    nothing = F.array().cast(SPAN)
    first = docs.select("doc_id", *row_key(), "text", base.alias("base"))
    weak = F.when(_in_role(F.col("base"), "identifier") | text.rlike(IDENTIFIER), spans(text, ANY, _weak_kind)).otherwise(nothing)
    second = first.withColumn("weak", weak)
    both = F.concat("base", "weak")
    able = (F.size("weak") > 0) & _in_role(both, "identifier") & _in_role(both, "secret")
    second = second.withColumn("weak", F.when(able, F.col("weak")).otherwise(nothing))
    breaks = F.when(F.size("weak") > 0, spans(text, BLANK_LINE, lambda m: F.lit(-1))).otherwise(nothing)
    return second.select("doc_id", "__id", "__h", "base", "weak", breaks.alias("breaks"))


def _by_number(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, values[k])])[F.col("ord")]


def linked(found: DataFrame) -> DataFrame:
    """The weak candidates that have all their complements near: __id, __h, links."""
    own = ["__id", "__h"]
    rows = found.filter(F.size("weak") > 0).groupBy(*own).agg(F.first(F.struct("base", "weak", "breaks")).alias("x"))  # repeated rows hold the same
    parts = rows.select(*own, F.explode(F.concat("x.base", "x.weak", "x.breaks")).alias("p")).select(*own, "p.*").distinct()
    scope = F.count_if(F.col("ord") == -1).over(Window.partitionBy(*own).orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("scope", scope).filter("ord >= 0")

    places = lambda a, b: F.explode(F.sequence(F.floor(a / PLACE).cast("int"), F.floor(b / PLACE).cast("int"))).alias("place")
    needs = F.create_map(*[x for k, need in NEEDS.items() for x in (F.lit(KINDS.index(k)), F.array(*map(F.lit, need)))])
    asked = parts.withColumn("needs", needs[F.col("ord")]).filter("needs is not null").select(*own, "scope", "start", "ord", "end", F.size("needs").alias("wanted"), F.explode("needs").alias("role"))
    asked = asked.select("*", places(F.greatest(F.col("start") - REACH, F.lit(0)), F.col("end") + REACH))
    there = parts.select(*own, "scope", _by_number(ROLE).alias("role"), F.col("start").alias("__s"), F.col("end").alias("__e"), places(F.col("start"), F.col("end")))
    near = (F.col("__s") <= F.col("end") + REACH) & (F.col("__e") >= F.col("start") - REACH)
    apart = (F.col("__e") <= F.col("start")) | (F.col("__s") >= F.col("end"))
    keys = [*own, "scope", "role", "place"]
    a, b = asked.alias("a"), there.alias("b")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [near & apart], "left_semi")
    whole = met.groupBy(*own, "start", "ord", "end", "wanted").agg(F.count_distinct("role").alias("n")).filter("n = wanted")
    return whole.groupBy(*own).agg(F.collect_list(F.struct("start", "ord", "end")).alias("links"))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, base and spans: arrays of (kind, start, end) in order
    of start and kind; row for row. spans holds base and the linked candidates."""
    found = written(scanned(docs), "scanned")
    plain = found.filter(F.size("weak") == 0).select("doc_id", "base", F.col("base").alias("spans"))
    links = linked(found)
    more = found.filter(F.size("weak") > 0).join(links, ["__id", "__h"], "left")
    more = more.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("links", F.array().cast(SPAN)))).alias("spans"))
    kind = F.array(*map(F.lit, KINDS))
    named = lambda c: F.transform(c, lambda s: F.struct(F.get(kind, s["ord"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return plain.unionByName(more).select("doc_id", named("base").alias("base"), named("spans").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op11."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))
