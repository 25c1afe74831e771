"""corpus_pipeline against brute force, stage by stage and as a whole."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumenfold.llm import bpe, quality_rules, simhash
from tests.llm.test_llm_ops import brute_components, brute_contained, sentence

RNG = random.Random(21)
ITEM = sentence(40)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(400):
        bad = i % 7 == 3
        text = " ".join(["BUY!! $$$"] * 60) if bad else "\n".join([sentence(70), "A common line", sentence(30)])
        if i % 50 == 10:
            text += "\n" + ITEM
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(1000, rows[1][1], "en", "s", 1), (1001, rows[2][1] + " end", "en", "s", 1), (1002, None, None, None, None), (1003, "", "en", "s", 0), (1000, rows[1][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, sentence(30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_run(spark, folder):
    path, rows = folder
    public = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality_rules.train(docs, spark.read.parquet(f"{path}/labels.parquet"))

    def good(text):
        x = quality_rules.statistics([(text or "").encode()])
        total = model.bias + sum(w for r, w in zip(model.rules, model.weights, strict=True) if r.holds(x)[0])
        return 1 / (1 + np.exp(-total)) >= 0.5

    left = [r for r in rows if good(r[1])]
    assert {r[0] for r in left} >= {i for i in range(400) if i % 7 != 3} and not {r[0] for r in left} & {i for i in range(400) if i % 7 == 3}
    counts = Counter(k for r in left for k in {x.strip().lower() for x in (r[1] or "").split("\n")})
    left = [(r[0], "\n".join(x for x in (r[1] or "").split("\n") if not ((k := x.strip().lower()) and counts[k] >= 10))) for r in left]
    brute = brute_components([simhash.fingerprint(t.encode(), 4) for _, t in left], 4)
    first = {c: min(r[0] for r, b in zip(left, brute, strict=True) if b == c) for c in set(brute)}
    kept = {r for r, b in zip(left, brute, strict=True) if r[0] == first[b]}  # equal rows count once
    leaks = {i for i, *_ in brute_contained([(i, t) for i, t in kept], [(1, ITEM)])}
    assert leaks
    encoder = bpe.Bpe(open(public.path("byte_bpe_50k.json"), "rb").read())
    wanted = sorted((i, hashlib.sha256(encoder.encode(t)).hexdigest()) for i, t in kept if i not in leaks)
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in got) == wanted
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), path).count() == 0


def test_near_duplicates_are_those_of_operator_3(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminated", "tokens"]
    text = sentence(60)
    bits = lambda t: (simhash.fingerprint(text.encode(), 4) ^ simhash.fingerprint(t.encode(), 4)).bit_count()
    far = next(t for i in range(60) if bits(t := " ".join(["changed" if j == i else w for j, w in enumerate(text.split())])) > 4)
    rows = [(1, text), (2, text), (3, far), (4, sentence(60)), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    brute = brute_components([simhash.fingerprint((t or "").encode(), 4) for _, t in rows], 4)
    assert brute[2] != brute[0]  # a near copy that operator 3 leaves
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()]
    assert sorted(got) == sorted(min(rows[j][0] for j in range(len(rows)) if brute[j] == c) for c in set(brute))
