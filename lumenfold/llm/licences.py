"""Licence scan by Dice coefficient over word bigrams (operator 4), DataFrame functions only.

A text is normalised: A-Z lower-cased, everything but letters and digits taken as a gap. So
line breaks, indents, comment marks and quotes don't count, and a notice is found wherever it
stands in a text, however it is wrapped. The words are looked at in windows; a window is cut
into bigrams, repeats included, and compared with the licence templates. A template of n
bigrams can only reach the wanted coefficient t with windows of n*t/(2-t) to n*(2-t)/t
bigrams, so a window is compared only with templates whose bounds it meets.

For a template of w words, windows have w, 0.8 w and 1.25 w words (`SIZES`), and begin at
every eighth part of their length (at every word if shorter than 16), and at the last place
where they fit; a text that is shorter than a window is one as a whole. A copy that is exact,
or shortened or lengthened evenly, is thus met by a window that is off by a sixteenth of its
length at most. A text has windows of a template's sizes where it holds one of the bigrams of
which a match of that template must hold one (necessary_bigrams). A window counts for the one
template with the highest coefficient; of equals, the one listed first.

Nearly all of these windows are ruled out before they are made, and nothing is lost by it:
texts without any of the words of which a match must hold one (necessary_words) are dropped
as they are read, and of the others only windows around a necessary bigram are compared.

Null, empty and blank texts and texts of one word match nothing; an empty table gives no
rows. Repeated rows match each in scan(), and together in per_document(). Other columns
aren't looked at. Of a long text nothing but its words, bigrams and matches is held.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii
from .licence_texts import TEMPLATES

THRESHOLD = 0.8
SIZES = (1.0, 0.8, 1.25)
STEPS = 8
#: Words shorter than this are looked for as whole words.
SHORT = 4


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> dict[str, int]:
    """Bigrams of a template and how often each is in it, normalised as texts are."""
    words = words_of(text)
    return dict(sorted(Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)).items()))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Bigrams that a window can have to reach the threshold against n bigrams."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def window_sizes(text: str, threshold: float) -> list[int]:
    """Words of the windows that are made for a template."""
    n = len(words_of(text))
    least, most = size_bounds(n - 1, threshold)
    return sorted({min(max(round(n * s), least + 1, 2), most + 1) for s in SIZES})


def necessary_words(bigrams: dict[str, int], threshold: float) -> list[str]:
    """Words of which a window must hold at least one to reach the threshold.

    At least n*t/(2-t) of a template's n bigrams must be shared, so a window that lacks all
    words of a set that touches more than the rest can't reach it. Words are taken that are
    long, as those are rare, and that touch much, so that few are enough.
    """
    n = sum(bigrams.values())
    spare = n - size_bounds(n, threshold)[0]
    touched = lambda chosen: sum(k for g, k in bigrams.items() if not chosen.isdisjoint(g.split()))
    words, chosen = {w for g in bigrams for w in g.split()}, []
    while touched(set(chosen)) <= spare:
        gain = {w: touched({*chosen, w}) - touched(set(chosen)) for w in words}
        chosen.append(max(words, key=lambda w: (gain[w] * len(w) ** 3 if gain[w] else -1, w)))
        words.discard(chosen[-1])
    return chosen


def necessary_bigrams(bigrams: dict[str, int], threshold: float) -> list[str]:
    """Bigrams of which a window must hold at least one: so many that a window without them
    lacks more than it may. The longest are taken, as those are rare."""
    spare = sum(bigrams.values()) - size_bounds(sum(bigrams.values()), threshold)[0]
    chosen, covered = [], 0
    for g in sorted(bigrams, key=lambda g: (-len(g), g)):
        chosen.append(g)
        covered += bigrams[g]
        if covered > spare:
            break
    return chosen


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(lower_ascii(text), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def _grams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _strings(words: list[str]) -> Column:
    """Fixed strings of letters, digits and blanks as an array, by one expression."""
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def _once(c: Column) -> Column:
    """The value of c, made once a row: filters on it can't be pushed below a generator,
    where they would make it again for each time they name it."""
    return F.explode(F.array(c))


def _let(value: Column, body) -> Column:
    """body(value) with the value made once, inside of expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prepared(spark: SparkSession, known: list[tuple[str, str]], threshold: float) -> Column:
    """The templates, as one array of structs: an inline table, aggregated by a scalar subquery."""
    q = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{q(name)}', '{q(text)}')" for i, (name, text) in enumerate(known)) + " AS t(tid, licence, text)")
    grams = rows.select("tid", "licence", _once(_grams(_words(F.col("text")))).alias("g"))
    n = F.size("g")
    low, high = F.ceil(n * threshold / (2 - threshold) - 1e-9).cast("int"), F.floor(n * (2 - threshold) / threshold + 1e-9).cast("int")
    counted = F.transform(F.array_distinct("g"), lambda x: F.struct(x.alias("gram"), F.size(F.filter("g", lambda y: y == x)).alias("k")))
    repeated = F.filter(counted, lambda r: r["k"] > 1)
    made = grams.select("tid", F.struct("tid", "licence", n.alias("n"), low.alias("low"), high.alias("high"), F.array_distinct("g").alias("once"), repeated.alias("repeated")).alias("t"))
    return made.agg(F.transform(F.array_sort(F.collect_list(F.struct("tid", "t"))), lambda x: x["t"]).alias("ts")).scalar()


def _dice(g: Column, t: Column, threshold: float) -> Column:
    """The coefficient; null where even without counting repeats it's out of reach."""
    once, total = F.size(F.array_intersect(g, t["once"])), F.size(g) + t["n"]
    extra = F.aggregate(t["repeated"], F.lit(0), lambda acc, r: acc + r["k"] - 1)
    more = F.aggregate(t["repeated"], F.lit(0), lambda acc, r: acc + F.greatest(F.lit(0), F.least(r["k"] - 1, F.size(F.filter(g, lambda y: y == r["gram"])) - 1)))
    return F.when(2.0 * (once + extra) >= threshold * total, 2.0 * (once + more) / total)


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, licence, at, n_words, dice: for each row, each licence
    that is found in it and each window size that finds it, the window with the highest
    coefficient, the first one of equals: where it begins, in words from 0, and its length."""
    known = [(name, t) for name, texts in (templates or TEMPLATES).items() for t in texts]
    grams = [template_bigrams(t) for _, t in known]
    every = sorted({w for b in grams for w in necessary_words(b, threshold)})
    wide = [w for w in every if len(w) >= SHORT and not any(v != w and v in w and len(v) >= SHORT for v in every)]  # a part of a word stands for it
    brief = [w for w in every if len(w) < SHORT]
    holds = [F.col("low").contains(w) for w in wide] + ([F.col("low").rlike(r"(?<![\p{L}\p{N}])(" + "|".join(brief) + r")(?![\p{L}\p{N}])")] if brief else [])
    low = docs.select("doc_id", "text").filter("text is not null").select("doc_id", _once(lower_ascii(F.col("text"))).alias("low"))
    worded = low.filter(reduce(or_, holds)).select("doc_id", _once(_words(F.col("low"))).alias("w")).filter("size(w) > 1")
    needed = [necessary_bigrams(b, threshold) for b in grams]
    has = F.array_intersect("g", _strings(sorted({g for gs in needed for g in gs})))
    held = worded.select("doc_id", _once(_grams(F.col("w"))).alias("g")).select("doc_id", "g", _once(has).alias("has")).filter("size(has) > 0")
    which = F.array_compact(F.array(*[F.when(F.arrays_overlap("has", _strings(gs)), i) for i, gs in enumerate(needed)]))
    places = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.array_contains("has", F.get("g", i)))
    held = held.select("doc_id", "g", _once(which).alias("tids"), _once(places).alias("places"))
    sizes = F.array(*[F.array(*[F.lit(m) for m in window_sizes(t, threshold)]) for _, t in known])
    wanted = F.array_distinct(F.transform(F.flatten(F.transform("tids", lambda i: F.get(sizes, i))), lambda m: F.least(m, F.size("g") + 1)))
    usable = F.filter("known", lambda t: F.array_contains("tids", t["tid"]))
    each = held.withColumn("known", _prepared(docs.sparkSession, known, threshold)).select("doc_id", "g", "places", _once(usable).alias("ts"), F.explode(wanted).alias("m"))
    fits = F.filter("ts", lambda t: (F.col("m") - 1).between(t["low"], t["high"]))
    each = each.select("doc_id", "g", "places", "m", _once(fits).alias("ts")).filter("size(ts) > 0")
    step, last = F.expr(f"greatest(1, m div {STEPS})").cast("int"), F.size("g") + 1 - F.col("m")
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - F.col("m") + 2) / step) * step).cast("int")
    around = lambda i: F.when(first(i) <= F.least(i, last), F.sequence(first(i), F.least(i, last), step)).otherwise(F.array().cast("array<int>"))
    starts = F.array_distinct(F.concat(F.flatten(F.transform("places", around)), F.array(last)))
    best = lambda g: F.array_max(F.transform("ts", lambda t: F.struct(_dice(g, t, threshold).alias("dice"), (-t["tid"]).alias("first"), t["licence"].alias("licence"))))
    window = lambda s: F.struct(s.alias("at"), _let(F.slice("g", s + 1, F.col("m") - 1), best).alias("b"))
    hits = F.filter(F.transform(starts, window), lambda x: x["b"]["dice"] >= threshold)
    # of each licence only the best window leaves the row
    names = F.array_distinct(F.transform(F.col("hits"), lambda x: x["b"]["licence"]))
    rank = lambda x: F.struct(x["b"]["dice"].alias("dice"), (-x["at"]).alias("at"))
    top = F.transform(names, lambda name: F.struct(name.alias("licence"), F.array_max(F.transform(F.filter("hits", lambda x: x["b"]["licence"] == name), rank)).alias("r")))
    found = each.select("doc_id", "m", _once(hits).alias("hits")).filter("size(hits) > 0").select("doc_id", "m", F.explode(top).alias("x"))
    return found.select("doc_id", "x.licence", (-F.col("x.r.at")).alias("at"), F.col("m").alias("n_words"), F.col("x.r.dice").alias("dice"))


def per_document(matches: DataFrame) -> DataFrame:
    """One row for each document and licence: the best window of all; of equals the first one,
    then the shortest."""
    top = F.max(F.struct("dice", (-F.col("at")).alias("at"), (-F.col("n_words")).alias("n_words"))).alias("m")
    return matches.groupBy("doc_id", "licence").agg(top).select("doc_id", "licence", (-F.col("m.at")).alias("first_word"), (-F.col("m.n_words")).alias("n_words"), F.round("m.dice", 6).alias("best_dice"))
