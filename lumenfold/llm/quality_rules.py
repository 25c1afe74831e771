"""Quality classifier as a sparse rule ensemble (operator 5).

Statistics of whole texts are counted on the executors. On a bounded sample of labelled
rows the driver grows shallow boosted trees over the statistics, takes every path from a
root as a conjunctive rule, and fits a lasso-penalised logistic model over the rules. The
few rules with a weight are compiled into Spark column expressions, which score every row.

At most `SAMPLE` labelled rows are used to fit, those with the least hash of doc_id; that
is the only bound, and it doesn't touch scoring; documents that share a doc_id count once
in the sample. Null texts count as empty; empty texts
have statistics of zero and get a score like any. With no labels, or one kind only, every
score is the share of good labels (one half without labels). Null labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import Words, slices

SAMPLE = 20_000
STATS = ("n_bytes", "n_words", "mean_word", "upper", "symbols", "digits", "blanks", "distinct", "repeats", "n_lines", "line_words", "one_letter", "stops", "commas")
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 24, 3, 32, 0.3, 20
STRICTNESS = 2e-3

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[*b"!#$%&*+/<=>@\\^_`{|}~"]] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS for each text."""
    w, n = Words(texts), len(texts)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    sums = lambda x: np.add.reduceat(np.append(x, 0), begins[:-1]) if n else np.zeros(0)
    size = np.array([len(t) for t in texts], dtype=np.float64)
    words = np.diff(w.first).astype(np.float64)
    # a multi-byte capital of Latin-1: 0xC3 and then 0x80 to 0x9E
    after_c3 = np.concatenate([[False], w.data[:-1] == 0xC3])
    upper = _UPPER[w.data] + (after_c3 & (w.data >= 0x80) & (w.data <= 0x9E))
    length = (w.end - w.start).astype(np.float64)
    owner = w.owner()
    per = lambda x: np.bincount(owner, weights=x, minlength=n)[:n]
    same = np.zeros(len(w))
    if len(w) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((w.hash, owner))
    fresh = np.ones(len(w), bool)
    if len(w) > 1:
        h, o = w.hash[order], owner[order]
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(owner[order], weights=fresh, minlength=n)[:n]
    lines = sums((w.data == 10).astype(np.int64)) + (size > 0)
    a, b = np.maximum(size, 1), np.maximum(words, 1)
    return np.column_stack([
        size, words, per(length) / b, sums(upper) / a, sums(_SYMBOL[w.data]) / a, sums(_DIGIT[w.data]) / a, (size - per(length)) / a, distinct / b, per(same) / b, lines,
        words / np.maximum(lines, 1), per((length == 1).astype(float)) / b, sums((w.data == 46).astype(np.int64)) / b, sums((w.data == 44).astype(np.int64)) / b,
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id and STATS as doubles; row for row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics([t for (t,) in held]) for held in slices((t or b"",) for t in batch.column(1).to_pylist())]
            got = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(got[:, i])) for i in range(len(STATS)))], ["doc_id", *STATS])

    base = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, cut): value > cut where above, else value <= cut."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(and_, [F.col(s) > c if above else F.col(s) <= c for s, above, c in self.parts])

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, STATS.index(s)] > c) == above for s, above, c in self.parts])


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        """The probability of a good text, from the STATS columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, out: set[Rule]) -> np.ndarray:
    """One boosted tree; adds its paths to out and returns its value for each row."""
    value = np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple, depth: int) -> None:
        if path:
            out.add(Rule(tuple(sorted(path))))
        gs, hs = g[rows].sum(), h[rows].sum()
        value[rows] = -gs / (hs + 1.0)
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF:
            return
        best = (1e-6, -1, -1)
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            b = binned[rows, f]
            k = len(cuts[f]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, i)
        _, f, i = best
        if f < 0:
            return
        cut, right = float(cuts[f][i]), binned[rows, f] > i
        split(rows[right], (*path, (STATS[f], True, cut)), depth + 1)
        split(rows[~right], (*path, (STATS[f], False, cut)), depth + 1)

    split(np.arange(len(x)), (), 0)
    return value


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """x: rows of STATS; y: 0 or 1."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return RuleModel((), (), float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    binned = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
    rules: set[Rule] = set()
    # each kind of label weighs as much as the other, so that the rare one is learnt
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    raw = np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        raw += RATE * _grow(x, cuts, binned, weight * (p - y), weight * p * (1 - p), rules)
    ordered = sorted(rules, key=lambda r: (len(r.parts), r.parts))
    z = np.column_stack([r.holds(x) for r in ordered]).astype(np.float64)
    return _lasso(z, y.astype(np.float64), weight, ordered)


def _lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rules: list[Rule]) -> RuleModel:
    """Accelerated proximal gradient steps for the penalised logistic loss."""
    n, w, bias = len(y), np.zeros(z.shape[1]), 0.0
    step = 4.0 / (np.linalg.norm(z.T @ (z * weight[:, None]) / n, 2) + weight.mean() * (1 + z.shape[1] ** 0.5))
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(400):
        r = weight * (1 / (1 + np.exp(-(z @ v + vb))) - y)
        new = v - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * STRICTNESS, 0)
        new_bias, new_t = vb - step * r.mean(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / new_t * (new - w), new_bias + (t - 1) / new_t * (new_bias - bias)
        w, bias, t = new, new_bias, new_t
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), float(bias))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """docs (doc_id, text), labels (doc_id, quality): fit on rows that aren't held out."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # bounded by `sample`: ids and labels first, so that only their texts are counted
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id", "left_semi")
    met = with_statistics(texts).join(F.broadcast(chosen), "doc_id")
    # documents that share a doc_id are one row of the sample: the least in statistics
    found = met.groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("s")).orderBy("doc_id", "quality").select("s.*", "quality").toPandas()
    return fit(found[list(STATS)].to_numpy(np.float64), found["quality"].to_numpy(np.int64))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score, predicted; row for row."""
    scored = with_statistics(docs).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs without the rows that the model rejects; the columns and texts stay as they are."""
    cols = docs.columns
    ship(docs.sparkSession)
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.encode() if t else b"" for t in batch.column(at).to_pylist())
            parts = [statistics([t for (t,) in held]) for held in slices((t,) for t in texts)]
            got = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
            stats = [pa.array(np.ascontiguousarray(got[:, i])) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *stats], [*(f"c{i}" for i in range(len(cols))), *STATS])

    renamed = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)] + [f"{s} double" for s in STATS])
    return renamed.mapInArrow(run, schema).filter(model.score() >= 0.5).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols)))


def digest(scored: DataFrame) -> DataFrame:
    """The columns of query op5."""
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
