"""Evaluation of span detection: matching, scores, confusion, ensembles, percentiles.

A sample's spans are one small group; order-dependent matching runs per sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from ..functions.redaction import LABEL_OF, LABELS

IOU = 0.5


def iou_column(a: Column, b: Column) -> Column:
    """Intersection over union of two byte spans; zero where they don't meet."""
    inter = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    union = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(inter > 0, inter / union).otherwise(0.0)


def iou(a: tuple[int, int], b: tuple[int, int]) -> float:
    inter = min(a[1], b[1]) - max(a[0], b[0])
    return inter / (max(a[1], b[1]) - min(a[0], b[0])) if inter > 0 else 0.0


def match_spans(spans: DataFrame) -> DataFrame:
    """spans (sample_id, role 'truth' or 'pred', pos, label, start, end) -> sample_id, truth,
    pred: a row for each match, missed truth (pred 'none') and false prediction (truth 'none').

    Truths in order take the first free prediction of their label with an IoU of 0.5 at least.
    Samples stream through a task one after another, so only one is held.
    """

    def matched(spans: list[tuple]) -> Iterator[tuple[str, str]]:
        free: dict[str, list[tuple[int, int]]] = {}
        for role, label, start, end in spans:
            if role == "pred":
                free.setdefault(label, []).append((start, end))
        for role, label, start, end in spans:
            if role == "truth":
                own = free.get(label, [])
                i = next((i for i, p in enumerate(own) if iou(p, (start, end)) >= IOU), None)
                if i is not None:
                    own.pop(i)
                yield label, "none" if i is None else label
        yield from (("none", label) for label, own in free.items() for _ in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, spans, kind = None, [], None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.string(), pa.string()))], ["sample_id", "truth", "pred"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for own, *span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spans and own != sample:
                    done += [(sample, *m) for m in matched(spans)]
                    spans = []
                sample = own
                spans.append(tuple(span))
            if done:
                yield out(done)
        if spans:
            yield out([(sample, *m) for m in matched(spans)])

    ordered = spans.select("sample_id", "role", "label", "start", "end", "pos").repartition("sample_id").sortWithinPartitions("sample_id", "pos").drop("pos")
    return ordered.mapInArrow(run, f"sample_id {dict(spans.dtypes)['sample_id']}, truth string, pred string")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def scores(pairs: DataFrame, *by: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1; zero where a denominator is."""
    each = pairs.select(*by, F.explode(F.array_distinct(F.array("truth", "pred"))).alias("label"), "truth", "pred").filter("label <> 'none'")
    n = lambda cond, name: F.count_if(cond).alias(name)
    hit = F.col("truth") == F.col("pred")
    counts = each.groupBy(*by, "label").agg(n(hit, "tp"), n(~hit & (F.col("pred") == F.col("label")), "fp"), n(~hit & (F.col("truth") == F.col("label")), "fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(pairs: DataFrame) -> DataFrame:
    """The matrix of labels and 'none', one column for each prediction."""
    return pairs.groupBy("truth").pivot("pred", [*LABELS, "none"]).count().na.fill(0)


def weighted_misses(misses: DataFrame) -> DataFrame:
    """lang, weight: missed truths by risk tier (high 3, med 2, else 1)."""
    w = F.when(F.col("risk_tier") == "high", 3).when(F.col("risk_tier") == "med", 2).otherwise(1)
    return misses.groupBy("lang").agg(F.count("*").alias("n"), F.sum(w).alias("weight"))


#: Cells that the values of a group are cut into to find its ranks.
CELLS = 128


def nearest_rank(values: DataFrame, column: str, *by: str) -> DataFrame:
    """p50, p95, p99 by nearest rank: the value at floor(q * n), the last at most.

    Exact, by selection: rough percentiles cut a group into cells, counts say which cells hold
    the wanted ranks, and only their values are put in order, equal ones as one. No task gets
    a whole group.
    """
    rows = values.filter(F.col(column).isNotNull()).select(*by, F.col(column).alias("v"))
    cuts = F.percentile_approx("v", [i / CELLS for i in range(1, CELLS)], 100 * CELLS)
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_distinct(cuts).alias("cuts")).select(*[F.col(b).alias(f"__{b}") for b in by], "n", "cuts")
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    placed = rows.join(groups, same) if by else rows.crossJoin(F.broadcast(groups))  # without groups: one row
    placed = placed.select(*by, "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("cell"))
    cells = placed.groupBy(*by, "cell").agg(F.count("*").alias("held"), F.first("n").alias("n"))
    before = F.sum("held").over(Window.partitionBy(*by).orderBy("cell")) - F.col("held")  # CELLS rows a group
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("rank")) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]))
    chosen = cells.withColumn("before", before).select(*by, "cell", "held", "before", wanted.alias("w"))
    chosen = chosen.filter((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("held")))
    chosen = chosen.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("cell").alias("__cell"), F.col("w.name").alias("name"), (F.col("w.rank") - F.col("before")).alias("nth"))
    here = [*same, F.col("cell") == F.col("__cell")]
    few = placed.join(chosen.drop("name", "nth").distinct(), here, "left_semi").groupBy(*by, "cell", "v").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*by, "cell").orderBy("v"))
    found = few.withColumn("upto", upto).join(chosen, here).filter((F.col("nth") < F.col("upto")) & (F.col("nth") >= F.col("upto") - F.col("times")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == p, F.col("v"))).alias(p) for p in ("p50", "p95", "p99")])


def gate(recall: Column, p95_ms: Column) -> Column:
    return (recall >= 0.85) & (p95_ms <= 1500)


def binary_metrics(rows: DataFrame, truth: Column, pred: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall of two booleans."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    got = rows.select(*by, truth.alias("t"), pred.alias("p")).groupBy(*by).agg(n(F.col("t") & F.col("p"), "tp"), n(~F.col("t") & F.col("p"), "fp"), n(F.col("t") & ~F.col("p"), "fn"), n(~F.col("t") & ~F.col("p"), "tn"))
    return got.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def ensemble(findings: DataFrame, confirm: tuple[str, ...] = ()) -> DataFrame:
    """findings (sample_id, pos, engine, kind, start, end) -> sample_id, kind, start, end, engines.

    A finding joins the first cluster of its label that has a span with an IoU of 0.5 at
    least. Labels in `confirm` need two engines. The longest span stands for a cluster, the
    last one of equals.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        clusters: list[tuple[str | None, list]] = []
        for f in group.sort_values("pos", kind="stable").itertuples():
            label = LABEL_OF.get(f.kind)
            home = next((c for name, c in clusters if name == label and any(iou((g.start, g.end), (f.start, f.end)) >= IOU for g in c)), None)
            if home is None:
                clusters.append((label, home := []))
            home.append(f)
        rows = []
        for label, c in clusters:
            engines = sorted({f.engine for f in c})
            if label in confirm and len(engines) < 2:
                continue
            best = max(reversed(c), key=lambda f: f.end - f.start)
            rows.append((best.sample_id, best.kind, best.start, best.end, ",".join(engines)))
        rows.sort(key=lambda r: r[2])
        return pd.DataFrame(rows, columns=["sample_id", "kind", "start", "end", "engines"])

    return findings.groupBy("sample_id").applyInPandas(run, f"sample_id {dict(findings.dtypes)['sample_id']}, kind string, start int, end int, engines string")


# Native labels of token models and the labels that they stand for.
LABEL_SPACES = {
    "privacy": {"account_number": "account_number", "private_address": "address", "private_date": "date", "private_email": "email", "private_person": "person", "private_phone": "phone", "private_url": "url", "secret": "secret"},
    "multilingual": {
        "GIVENNAME": "person", "SURNAME": "person", "TITLE": "person", "EMAIL": "email", "TELEPHONENUM": "phone", "STREET": "address", "BUILDINGNUM": "address", "CITY": "address",
        "ZIPCODE": "address", "DATE": "date", "TIME": "date", "TAXNUM": "account_number",
    },
    "european": {
        "GIVENNAME1": "person", "GIVENNAME2": "person", "LASTNAME1": "person", "LASTNAME2": "person", "LASTNAME3": "person", "TITLE": "person", "EMAIL": "email", "TEL": "phone", "STREET": "address",
        "DATE": "date", "TIME": "date", "BOD": "date", "IDCARD": "account_number", "PASSPORT": "account_number", "DRIVERLICENSE": "account_number", "SOCIALNUMBER": "account_number",
        "CARDISSUER": "account_number", "IP": "url", "PASS": "secret",
    },
}
#: Thresholds by (language, label); over 1 blocks a label in a language.
LANGUAGE_THRESHOLDS = {("it", "account_number"): 1.1, ("de", "person"): 1.1, ("fr", "account_number"): 1.1, ("de", "account_number"): 1.1, ("en", "person"): 1.1, ("zh", "account_number"): 1.1}


def threshold(label: Column, lang: Column, defaults: dict[str, float]) -> Column:
    """The threshold of a label in a language, else its default, else null."""
    pick = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("double")
    return F.coalesce(pick({f"{a}/{b}": t for (a, b), t in LANGUAGE_THRESHOLDS.items()}, F.concat(lang, F.lit("/"), label)), pick(defaults, label))


SPAN_TYPE = ArrayType(StructType([StructField("label", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("confidence", FloatType())]))


def decoder(id2label: list[str], space: str):
    """A pandas UDF (logits array<array<float>>, starts, ends) -> spans: the best label of each
    token, runs of one label joined whatever their position mark, the least confidence of a run."""
    mapping = LABEL_SPACES[space]
    cores = ["" if x == "O" else (x[2:] if x[:2] in ("B-", "I-", "E-", "S-") else x) for x in id2label]

    def one(logits, starts, ends) -> list[dict]:
        if logits is None or not len(logits):
            return []
        z = np.array([np.asarray(r, dtype=np.float32) for r in logits])
        best = z.argmax(axis=1)
        conf = 1.0 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
        out, i = [], 0
        while i < len(best):
            core, j = cores[best[i]], i + 1
            if core:
                while j < len(best) and cores[best[j]] == core:
                    j += 1
                if core in mapping and starts[i] < ends[j - 1]:
                    out.append({"label": mapping[core], "start": int(starts[i]), "end": int(ends[j - 1]), "confidence": float(conf[i:j].min())})
            i = j
        return out

    @F.pandas_udf(SPAN_TYPE)
    def decode(logits: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(logits, starts, ends, strict=True)])

    return decode


def softmax_second(logits: Column) -> Column:
    """Probability of the second of two classes."""
    return 1.0 / (1.0 + F.exp(logits[0] - logits[1]))
