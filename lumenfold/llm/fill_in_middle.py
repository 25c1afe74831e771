"""Fill-in-the-middle transformation (operator 12).

A text is cut into units by a pattern, at two ranks drawn from a hash of its doc_id, into
prefix, middle and suffix, which are put in another order between sentinels. It takes two
passes of a lazy match iterator: the first counts the units, the second advances to both
ranks and stops there. No list of units or of their places is ever held; beside the text
and its output a worker holds one match at a time.

The pattern must match wherever a unit begins where the last one ended, so that units
follow each other without gaps and cover the text; that the text is covered is checked.

Null texts count as empty; an empty text, and one that holds a sentinel, stays plain (its
sentinels couldn't be told from those put in). A null doc_id is hashed as an empty string.
Draws depend on doc_id alone: rows that repeat a doc_id get the same draws, each for its own
number of units, and repeated rows the same result, row for row. Where both draws fall on
one rank the middle is empty. Texts of any length are taken whole; long ones are sent on
in batches of `BATCH_BYTES`. An empty table gives an empty one. Other columns of the input
are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
BATCH_BYTES = 1 << 23
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Recipe:
    """How texts are cut and put together: the unit's pattern, the seed of the draws, how many
    in a hundred are transformed, how many of these put the suffix first, and the sentinels."""

    unit: str = LINES
    seed: int = 7
    percent: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        """The first four groups of eight hex digits of the hash."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))

    def held(self, text: str) -> bool:
        return any(s in text for s in (self.prefix, self.suffix, self.middle))


def count_units(unit: re.Pattern, text: str) -> int:
    """The first pass. Raises where units leave a gap or don't reach the end."""
    n = at = 0
    for found in unit.finditer(text):
        if found.start() != at:
            break
        n, at = n + 1, found.end()
    if at != len(text):
        raise ValueError(f"units don't cover the text: nothing matches at {at}")
    return n


def cut_at(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: the ends of units number `low` and `high`, low <= high."""
    begin = end = 0
    matches = unit.finditer(text)
    for rank in range(1, high + 1):
        end = next(matches).end()
        if rank == low:
            begin = end
    return begin, end


def rearrange(text: str, doc_id: int | None, recipe: Recipe, unit: re.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix characters, middle characters, output)."""
    n = count_units(unit, text)
    h1, h2, h3, h4 = recipe.draws(doc_id)
    if not text or recipe.held(text) or h3 % 100 >= recipe.percent:
        return n, PLAIN, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_at(unit, text, low, high)
    prefix, middle, suffix = (recipe.prefix, text[:a]), (recipe.middle, text[a:b]), (recipe.suffix, text[b:])
    form = SPM if h4 % 100 < recipe.suffix_first else PSM
    parts = (suffix, prefix, middle) if form == SPM else (prefix, suffix, middle)
    return n, form, a, b - a, "".join(mark + part for mark, part in parts)


def transform(docs: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n, form, prefix_chars, middle_chars, output; row for row."""
    recipe = recipe or Recipe()
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(recipe.unit)
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                start, size, done = at, 0, []
                while at < batch.num_rows and size < BATCH_BYTES:
                    done.append(rearrange(batch.column(1)[at].as_py() or "", batch.column(0)[at].as_py(), recipe, unit))
                    size += len(done[-1][-1])
                    at += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, recipe: Recipe | None = None) -> Column:
    """The text that an output was made of, from the output and its form alone.

    No text that holds a sentinel is transformed, so each occurs once, where it was put.
    """
    r = recipe or Recipe()
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    middle = after(output, r.middle)
    psm = F.concat(after(before(output, r.suffix), r.prefix), middle, after(before(output, r.middle), r.suffix))
    spm = F.concat(after(before(output, r.middle), r.prefix), middle, after(before(output, r.prefix), r.suffix))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digest(made: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """The columns of query op12."""
    back = restored(F.col("output"), F.col("form"), recipe)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
