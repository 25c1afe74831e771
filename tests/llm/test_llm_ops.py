"""The training-data operators against brute force on small documents, with odd rows."""

import functools
import hashlib
import json
import math
import random
import re
import textwrap
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import bpe, common, components, decontaminate, host_reputation, licences, line_dedup, near_copies, permutation_index, quality_rules, revisits, simhash, window_index, words
from lumenfold.llm.words import Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, Row string, n_lines int"
RNG = random.Random(7)
VOCAB = ["alpha", "beta", "Gamma", "δέλτα", "eps.", "zeta", "eta", "théta", "iota", "kappa"]


def sentence(n):
    return " ".join(RNG.choice(VOCAB) + str(RNG.randrange(30)) for _ in range(n))


SHARED = [sentence(60), sentence(55), sentence(80)]


def corpus():
    texts = []
    for i in range(90):
        parts = [sentence(RNG.randrange(5, 90)) for _ in range(RNG.randrange(1, 4))]
        if i % 3 == 0:
            parts.insert(RNG.randrange(len(parts) + 1), SHARED[i % 9 // 3])
        if i % 4 == 0:
            parts.append("  Common LINE \r")
        texts.append("\n".join(parts))
    texts += [texts[0], texts[5], texts[5], texts[3] + " tail", None, "", "   ", "\n\n", "one", "one two", sentence(20_000), "K", "É " * 70]
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}", len(t or ""), "x", "y", 0) for i, t in enumerate(texts)]
    return rows + [(rows[7][0], rows[7][1], *rows[7][2:]), (None, texts[2], "en", None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def same(got, wanted):
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


# ---- line dedup ---------------------------------------------------------------------

def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    hi[:50] = hi[0]  # keys that agree in their first half
    index = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(hi, lo).dump())
    assert sorted(index.slots(hi, lo)) == list(range(5000))


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(docs, least):
    counts = Counter(k for r in ROWS for k in set(line_dedup.line_keys(r[1].encode() if r[1] else None)))
    wanted = []
    for r in ROWS:
        ls = (r[1] or "").encode().split(b"\n")
        kept = [x for x in ls if not ((k := x.strip().lower()) and counts[k] >= least)]
        wanted.append((r[0], len(ls), len(ls) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    same([tuple(r) for r in line_dedup.digest(line_dedup.drop_frequent_lines(docs, least)).collect()], wanted)


def test_line_dedup_hot_shard_and_columns(docs, empty, monkeypatch):
    wanted = [tuple(r) for r in line_dedup.digest(line_dedup.drop_frequent_lines(docs, 10)).collect()]
    monkeypatch.setattr(line_dedup, "TASK_PROBES", 20)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    same([tuple(r) for r in line_dedup.digest(line_dedup.drop_frequent_lines(docs, 10)).collect()], wanted)
    out = line_dedup.without_frequent_lines(docs, 10)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert line_dedup.drop_frequent_lines(empty).count() == 0


# ---- revisits -----------------------------------------------------------------------

CAPTURES = "record_id long, url string, captured_at long, record_type string, status int, etag string, last_modified string, digest string, headers array<struct<key:string,value:string>>, full string"


def capture(i, url, t, full=True, etag=None, lm=None, dg=None, headers=(), status=None):
    return i, url, t, "response" if full else "revisit", status or (200 if full else 304), etag, lm, dg, [tuple(h) for h in headers], "clash"


def test_revisits(spark):
    rows = [
        capture(1, "http://www.A.example/x/?b=2&a=1&utm_source=q#f", 10, etag='"e1"', headers=[("ETag", '"e1"'), ("Content-Type", "text/html"), ("Cache-Control", "a")]),
        capture(2, "https://a.example:443/x?a=1&b=2", 20, etag='"e2"'), capture(3, "http://a.example/x?a=1&b=2", 15, False, etag='W/"e1"', headers=[("cache-control", "b"), ("Content-Type", "z")]),
        capture(4, "http://a.example/x?a=1&b=2", 25, False, etag='"e1"'), capture(5, "http://a.example/x?a=1&b=2", 10, False, etag='"e1"'), capture(6, "http://a.example/x?a=1&b=2", 30, False),
        capture(7, None, 30, False), capture(8, "http://a.example/x?a=1&b=2", None, False), capture(9, "http://b.example/", 5, False), capture(10, "http://a.example/x?a=1&b=2", 22, status=404), capture(11, "http://c.example", 1, lm="m"), capture(12, "http://c.example/", 2, False, lm="m", etag='"q"'),
        capture(13, "http://c.example/", 1, lm="n"), capture(12, "http://c.example/", 2, False, lm="m", etag='"q"'),
    ]
    got = revisits.resolve(spark.createDataFrame(rows, CAPTURES)).collect()
    same([(r.record_id, r.refers_to, r.outcome, r.matched_by) for r in got], [
        (3, 1, "resolved", "etag"), (4, 2, "validator-mismatch", None), (5, None, "no-earlier-response", None), (6, 2, "no-validator", None), (7, None, "no-earlier-response", None), (8, None, "no-earlier-response", None),
        (9, None, "no-earlier-response", None), (12, 13, "validator-mismatch", None), (12, 13, "validator-mismatch", None),
    ])
    assert [tuple(h) for r in got if r.record_id == 3 for h in r.headers] == [("cache-control", "b"), ("content-type", "text/html"), ("etag", '"e1"')]


def test_revisits_of_a_crowded_url(spark):
    rng = random.Random(3)
    rows = [capture(i, "http://hot.example/" if i % 3 else f"http://u{i % 5}.example/", rng.randrange(60), rng.random() < 0.2, etag=f'"{i % 2}"') for i in range(400)]
    df = spark.createDataFrame(rows, CAPTURES)
    key = lambda hot: sorted((r.record_id, r.refers_to, r.outcome) for r in revisits.resolve(df, hot).collect())
    wanted = []
    for r in rows:
        if r[3] == "revisit":
            best = max(((x[2], x[0]) for x in rows if x[1] == r[1] and x[3] == "response" and x[2] < r[2]), default=None)
            wanted.append((r[0], best and best[1], "no-earlier-response" if best is None else "resolved" if best[1] % 2 == r[0] % 2 else "validator-mismatch"))
    assert key(100_000) == key(20) == key(1) == sorted(wanted)
    assert revisits.resolve(df.limit(0)).count() == 0


# ---- simhash ------------------------------------------------------------------------

def brute_components(fps, d):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("width", [4, 5])
def test_fingerprint(width):
    for t in ["", "one", "a b c", sentence(3), sentence(40), "A É b\u00a0c d e f"]:
        w = t.encode().lower().split()
        grams = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(t.encode(), width) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):
            out.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
    return sorted(out)[:n]


@pytest.mark.parametrize("mask", [0, (1 << 64) - (1 << 51), simhash.blocks(6)[2] | simhash.blocks(6)[4]])
def test_gray_index(mask):
    fps = [f for f in clustered(400, 5)]
    group = [f for f in fps if f & mask == fps[7] & mask] if mask else fps
    found = simhash.GrayIndex(np.array(group, dtype=np.uint64), mask, 4).search()
    got = brute = brute_components(group, 4)
    label = list(range(len(group)))
    for i, j in enumerate(found.tolist()):  # the links as components
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    groups = lambda xs: {frozenset(i for i, x in enumerate(xs) if x == y) for y in set(xs)}
    assert groups(label) == groups(got) == groups(brute)


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_links_for_any_number_of_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "n_blocks", lambda n, d: blocks)
    monkeypatch.setattr(simhash, "TILE", 50)
    fps = clustered(300, 9)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.component for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)).collect()}
    brute = brute_components(fps, 4)
    assert {frozenset(s for s in signed if got.get(s, s) == got.get(x, x)) for x in signed} == {frozenset(signed[i] for i, b in enumerate(brute) if b == c) for c in set(brute)}


def test_near_duplicates(docs, empty):
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    fps = [simhash.fingerprint(r[1].encode() if r[1] else None, 4) for r in ROWS]
    brute = brute_components(fps, 4)
    least = {c: min((r[0] for r, b in zip(ROWS, brute, strict=True) if b == c and r[0] is not None), default=None) for c in set(brute)}
    same([tuple(r) for r in got], [(r[0], f"{f:016x}", least[b]) for r, f, b in zip(ROWS, fps, brute, strict=True)])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5), (201, 200)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}
    assert components.components(edges.limit(0)).count() == 0


# ---- licences -----------------------------------------------------------------------

def brute_licences(text):
    known = [(name, Counter({tuple(g.split()): k for g, k in licences.template_bigrams(t).items()}), set(licences.words_of(t))) for name, ts in licences.TEMPLATES.items() for t in ts]
    w = re.findall(r"[a-z0-9\u00c0-\u024f\u0370-\u03ff]+", text.lower())
    best = {}
    pairs = {" ".join(p) for p in zip(w, w[1:], strict=False)}
    sizes = {min(m, len(w)) for ts in licences.TEMPLATES.values() for t in ts for m in licences.window_sizes(t, 0.8) if not pairs.isdisjoint(licences.necessary_bigrams(licences.template_bigrams(t), 0.8))}
    for m in sizes - {0, 1}:
        for at in {*range(0, len(w) - m + 1, max(1, m // 8)), len(w) - m}:
            words, found = set(w[at : at + m]), []
            unit = Counter(zip(w[at : at + m], w[at + 1 : at + m], strict=False))
            for i, (name, b, own) in enumerate(known):
                if not words.isdisjoint(own) and (dice := 2 * (unit & b).total() / (m - 1 + b.total())) >= 0.8:
                    found.append((dice, -i, name))
            if found:
                dice, _, name = max(found)
                best[name] = max(best.get(name, (0,)), (dice, -at, -m))
    return {name: (-at, -m, round(dice, 6)) for name, (dice, at, m) in best.items()}


def commented(text, width, mark):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_licences(spark, empty):
    t = licences.TEMPLATES
    gpl = t["GPL-3.0"][2].split()
    texts = [
        "x\n  Released under the MIT license!\ny", t["Apache-2.0"][1], t["Apache-2.0"][1], "Licensed under the Apache License", "", "all rights reserved", "reserved", "Licensed under CC BY-NC 4.0.", sentence(900) + " all rights reserved",
        sentence(300) + "\n" + commented(t["MIT"][2], 70, " * ") + "\n" + sentence(200), sentence(90) + " " + commented(t["MIT"][1], 70, "# ") + " " + sentence(20), commented(t["BSD-3-Clause"][1], 60, "// ") + sentence(70), commented(t["BSD-2-Clause"][1], 72, "    "),
        sentence(40) + " is " + t["ISC"][0] + sentence(33), " ".join(w for i, w in enumerate(gpl) if i % 17), sentence(11) + " ".join(w + " zz" * (i % 15 == 0) for i, w in enumerate(gpl)), f"{sentence(30)} {t['GPL-2.0'][1]} {sentence(30)} {t['CC-BY-4.0'][1]}",
    ]
    rows = [(i, x) for i, x in enumerate(texts)] + [(100, None), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"licence": F.lit("clash"), "g": F.lit(1), "low": F.lit(1)})
    got = {}
    for r in licences.per_document(licences.scan(df)).collect():
        got.setdefault(r.doc_id, {})[r.licence] = (r.first_word, r.n_words, r.best_dice)
    assert got == {i: b for i, x in enumerate(texts) if (b := brute_licences(x))}
    assert [sorted(got.get(i, {})) for i in range(9)] == [["MIT"], ["Apache-2.0"], ["Apache-2.0"], [], [], ["All-rights-reserved"], [], ["CC-BY-NC-4.0"], ["All-rights-reserved"]]
    assert all(name in got[i] for i, name in [(9, "MIT"), (10, "MIT"), (11, "BSD-3-Clause"), (12, "BSD-2-Clause"), (13, "ISC"), (14, "GPL-3.0"), (15, "GPL-3.0"), (16, "GPL-2.0"), (16, "CC-BY-4.0")])
    scan = licences.scan(df)
    assert licences.scan(empty).count() == 0 and "Python" not in scan._jdf.queryExecution().toString()


def test_size_bounds_and_necessary_words_lose_nothing():
    rng = random.Random(2)
    for texts in licences.TEMPLATES.values():
        for t in texts:
            b = licences.template_bigrams(t)
            words, total = licences.words_of(t), sum(b.values())
            low, high = licences.size_bounds(total, 0.8)
            for _ in range(60):
                unit = [w for w in words if rng.random() > 0.12] + ["zz"] * rng.randrange(3)
                u = licences.template_bigrams(" ".join(unit))
                size = sum(u.values())
                dice = 2 * sum(min(k, u.get(g, 0)) for g, k in b.items()) / max(1, size + total)
                if dice >= 0.8:
                    assert low <= size <= high and any(w in unit for w in licences.necessary_words(b, 0.8)) and any(g in u for g in licences.necessary_bigrams(b, 0.8))


# ---- quality ------------------------------------------------------------------------

def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, sentence(60) if i % 3 else " ".join(["SPAM!!" if i % 2 else "$$$ ###"] * 50), "en") for i in range(600)]
    docs = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "", "en"), (9003, "long " * 50_000, "en")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600) if rng.random() < 0.8] + [(5, None, 0), (777_777, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_rules.train(docs, labels)
    got = {r.doc_id: r for r in quality_rules.digest(quality_rules.score(docs, model)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 600]
    assert len(got) == 603 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got.values()) and 0 < len(model.rules) < 60
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_scores_row_by_row(spark):
    """The compiled columns against the model's own numbers, with statistics counted anew."""
    rng = random.Random(9)
    rows = [(i, sentence(rng.randrange(1, 90)) + "\n" * rng.randrange(4) + "!#" * rng.randrange(20) * (i % 2)) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("!#" not in (rows[i][1] or ""))) for i in range(400)], "doc_id long, quality int")
    model = quality_rules.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_rules.score(docs, model).collect()}
    assert len(model.rules) > 1
    for i, text in rows:
        b = (text or "").encode()
        w = b.split()
        one = dict(zip(quality_rules.STATS, quality_rules.statistics([b])[0], strict=True))
        assert one["n_bytes"] == len(b) and one["n_words"] == len(w) and math.isclose(one["mean_word"], sum(map(len, w)) / max(1, len(w)), abs_tol=1e-9)
        total = model.bias
        for rule, weight in zip(model.rules, model.weights, strict=True):
            if all((one[s] > cut) == above for s, above, cut in rule.parts):
                total += weight
        assert math.isclose(got[i], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_repeated_documents_count_once(spark):
    rows = [(i, sentence(40) if i % 2 else "!! ## " * 40) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    once, thrice = (quality_rules.train(spark.createDataFrame(r, "doc_id long, text string"), labels, 150) for r in (rows, rows * 3))
    assert once == thrice


def test_quality_without_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_rules.train(empty, none)
    assert model.rules == () and quality_rules.score(empty, model).count() == 0
    one = quality_rules.fit(np.zeros((5, len(quality_rules.STATS))), np.ones(5))
    assert one.bias > 0


def test_statistics_match_words():
    texts = [b"", b" ", "Ab É, x x\ny 12".encode(), b"A" * 10]
    got = dict(zip(quality_rules.STATS, quality_rules.statistics(texts).T, strict=True))
    assert got["n_words"].tolist() == [0, 0, 6, 1] and got["repeats"][2] == 1 / 6 and got["distinct"][2] == 5 / 6 and got["upper"][3] == 1 and got["n_lines"].tolist() == [0, 1, 2, 1]
    assert got["upper"][2] == 2 / len(texts[2]) and not np.isnan(quality_rules.statistics(texts)).any()


# ---- host reputation ----------------------------------------------------------------

def test_host_and_path(spark):
    urls = [("http://A.Ex.example/x/y?z#f", "a.ex.example", "/x/y"), ("x://h?p=/q", "h", ""), ("http://h#/a", "h", ""), ("h/a", "", ""), (None, "", ""), ("a://b://c/d", "b:", "//c/d"), ("http://É.example/ü", "É.example", "/ü"), ("://h/", "h", "/")]
    got = host_reputation.with_host_path(spark.createDataFrame([(u,) for u, _, _ in urls], "url string")).collect()
    assert [(r.host, r.path) for r in got] == [(h, p) for _, h, p in urls]


def test_rules_and_shrinkage(spark):
    rule = host_reputation.Rule
    rules = [rule("allow", "org"), rule("block", "x.org", "a/"), rule("allow", "x.org", "a/b")]
    urls = ["http://x.org/", "http://y.x.org/a/1", "http://x.org/a/b", "http://x.org/A/", "http://xx.org/a/", "http://x.org", "http://bad.com/1", "http://good.com/1", None]
    pages = [(i, u, 1) for i, u in enumerate(urls)] + [(100 + i, "http://bad.com/p", 1) for i in range(50)] + [(200 + i, "http://good.com/p", 1) for i in range(50)] + [(300, "http://new.bad.com/", 1), (300, "http://new.bad.com/", 1)]
    labels = [(100 + i, True) for i in range(50)] + [(200 + i, False) for i in range(50)] + [(100, None), (None, True), (101, True)]
    df = host_reputation.judge(spark.createDataFrame(pages, "page_id long, url string, verdict int"), spark.createDataFrame(labels, "page_id long, bad boolean"), rules)
    got = [(r.page_id, r.rule, r.verdict) for r in df.collect()]
    assert len(got) == len(pages)
    by = {i: (r, v) for i, r, v in got}
    assert [by[i] for i in range(9)] == [("org/", "allow"), ("x.org/a/", "block"), ("x.org/a/b", "allow"), ("org/", "allow"), ("org/", "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow")]
    assert by[100][1] == "block" and by[200][1] == "allow"
    share = {r.host: r.share for r in df.select("host", "share").distinct().collect()}
    assert share["good.com"] < share["new.bad.com"] < share["bad.com"]
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert host_reputation.judge(spark.createDataFrame(pages, "page_id long, url string, v int"), none, rules).count() == len(pages)


def test_crowded_hosts_and_no_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{min(i % 9, 3)}.org/{i}", "x", "y") for i in range(300)] + [(5, None, "x", "y"), (None, "http://h1.org/", "x", "y")], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([(i, i % 3 != 0 and i % 9 == 1) for i in range(200)] + [(None, True), (7, None)], "page_id long, bad boolean")
    key = lambda: sorted(map(repr, host_reputation.judge(pages, labels, []).collect()))
    plain = key()
    monkeypatch.setattr(host_reputation, "CROWD", 20)
    assert key() == plain and len(plain) == 302
    assert host_reputation.judge(pages.limit(0), labels, []).count() == 0
    assert len({r.bound for r in host_reputation.judge(pages.filter("page_id < 9"), labels.limit(0), []).collect()}) >= 1


def test_posterior_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.org/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1 and i % 10 != 1) for i in range(400)], "page_id long, bad boolean")
    got = {(r.host, r.verdict) for r in host_reputation.judge(pages, labels, []).collect()}
    assert got == {("bad.org", "block"), ("good.org", "allow")}


def test_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", "", "a.uk"]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(host_reputation.suffix_of(F.col("h")).alias("s"), host_reputation.domain_of(F.col("h")).alias("d")).collect()
    assert [(r.s, r.d) for r in got] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("uk", "co.uk"), ("com", "y.com"), ("com", "com"), ("", ""), ("uk", "a.uk")]


# ---- windows ------------------------------------------------------------------------

def brute_windows(rows, width):
    first = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        for p in range(len(w) - width + 1):
            if r[0] is not None:
                first[tuple(w[p : p + width])] = min(r[0], first.get(tuple(w[p : p + width]), r[0]))
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        keep = [True] * len(w)
        for p in range(len(w) - width + 1):
            if r[0] is not None and first[tuple(w[p : p + width])] < r[0]:
                keep[p : p + width] = [False] * width
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((r[0], len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize(("width", "gram", "batches", "block"), [(50, 20, 1, 1 << 18), (50, 20, 3, 1 << 18), (7, 3, 4, 5), (3, 3, 2, 1)])
def test_windows(docs, monkeypatch, width, gram, batches, block):
    monkeypatch.setattr(window_index, "BLOCK", block)
    got = window_index.digest(window_index.drop_repeated_windows(docs, width, gram, batches)).collect()
    same([tuple(r) for r in got], brute_windows(ROWS, width))


def test_windows_that_meet_at_edges(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        a = rng.randrange(60)
        rows.append((rng.randrange(30), " ".join([f"x{rng.randrange(4)}" for _ in range(rng.randrange(6))] + base[a : a + rng.randrange(5, 30)] + [rng.choice("ab") for _ in range(rng.randrange(12))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 3):
        same([tuple(r) for r in window_index.digest(window_index.drop_repeated_windows(df, 8, 3, batches)).collect()], brute_windows(rows, 8))


def test_windows_without_rows(empty):
    assert window_index.drop_repeated_windows(empty).count() == 0


def test_runs_are_compacted(spark):
    index = window_index.WindowIndex(spark, width=5, gram=2)
    store = None
    for i in range(4):
        batch = spark.createDataFrame([(i * 10, f"a b c d e f{i} g h i j k"), (i * 10 + 1, f"q{i} r s t u v w")], "doc_id long, text string")
        store = batch if store is None else store.unionByName(batch)
        found = {r.id: sorted(map(tuple, r.spans)) for r in index.add(batch, store).collect()}
        assert (found == {}) == (i == 0)
    assert len(index.runs) <= window_index.FAN_IN and index.known().groupBy("a", "g").count().filter("count > 1").count() == 0


def test_index_opens_again(spark, tmp_path):
    path, rng = f"file://{tmp_path}/index", random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([f"x{rng.randrange(9)}" for _ in range(4)] + base[(a := rng.randrange(40)) : a + 15])) for i in range(60)]
    df, found = spark.createDataFrame(rows, "doc_id long, text string"), []
    for i in range(5):  # every batch by an index that is opened anew, with compactions between
        index = window_index.WindowIndex(spark, path, width=8, gram=3, buckets=3)
        found.append(index.add(df.filter(F.expr(f"doc_id div 12 = {i}")), df.filter(F.expr(f"doc_id div 12 <= {i}"))))
        assert 1 <= len(index.runs) <= window_index.FAN_IN
    again = window_index.WindowIndex(spark, path, width=8, gram=3)
    assert again.buckets == 3 and again.known().groupBy("a", "g").count().filter("count > 1").count() == 0
    spans = functools.reduce(lambda a, b: a.unionByName(b), found)
    same([tuple(r) for r in window_index.digest(window_index.cut_spans(df, spans)).collect()], brute_windows(rows, 8))
    with pytest.raises(ValueError):
        window_index.WindowIndex(spark, path, width=9, gram=3)


def test_history_is_merged_in_place(spark):
    index = window_index.WindowIndex(spark, width=5, gram=2, buckets=4)
    batch = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    index.add(batch, batch)
    with common.settings(spark, window_index.MERGE | {"spark.sql.adaptive.enabled": "false"}):
        plan = index.merged(index.groups(batch))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.rindex("SortMergeJoin") :]
    run = scan[scan.rindex("Project") :]
    assert "SelectedBucketsCount: 4 out of 4" in run and "Exchange" not in run and "Sort " not in run


def test_windows_at_the_ends_of_long(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(-(2**63), text), (0, "a " + text), (2**63 - 1, text + " b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in window_index.digest(window_index.drop_repeated_windows(df, batches=3)).collect()], brute_windows(rows, 50))


def test_filter_lets_members_through(spark):
    keys = spark.range(-500, 500).select((F.col("id") * 7919 * 104729).alias("k"))
    bits = common.bit_filter(keys, F.col("k"))
    assert common.flag(keys, F.col("k"), bits, "m").filter("not m").count() == 0
    others = spark.range(1, 2001).select((F.col("id") * 7919 * 104729 + 13).alias("k"))
    assert common.flag(others, F.col("k"), bits, "m").filter("m").count() < 20
    own = common.BitSet(common.filter_pages(bits))
    values = np.array([r.k for r in keys.collect()], dtype=np.int64).view(np.uint64)
    assert own.has(values).all() and own.has(values + np.uint64(13)).sum() < 20
    assert not common.BitSet(common.filter_pages(common.bit_filter(keys.limit(0), F.col("k")))).has(values).any()


def test_words_of_any_length(monkeypatch):
    texts = [b"ab cd " * 50, b"x" * 300 + b" ab", b"", b"  cd\nab " + b"y" * 70]
    whole = words.Words(texts)
    monkeypatch.setattr(words, "CHUNK", 64)
    small = words.Words(texts)
    short = (small.end - small.start) <= 64
    assert (whole.hash[short] == small.hash[short]).all() and (whole.second_hash()[short] == small.second_hash()[short]).all()
    assert len({*small.hash.tolist()}) == len({*whole.hash.tolist()}) == 4 and not (whole.hash == whole.second_hash()).any()


# ---- nearest neighbours -------------------------------------------------------------

def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD_ROWS", 300)
    monkeypatch.setattr(permutation_index, "QUERY_ROWS", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [None] * 24, 1), (2003, [float("nan")] * 24, 1), (2004, [float("inf")] * 24, 1), (2005, [1.0], 1), (2006, [], 1), (None, [1.0] * 24, 1), (2020, [0.0] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = permutation_index.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 1000, 20))
    hit = 0
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -9
        wanted = set(np.lexsort((np.arange(1000), -s))[:20].tolist())
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(math.isclose(f[2], s[f[1]], abs_tol=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len(wanted & {f[1] for f in found})
    assert hit >= 0.9 * 20 * len(by)


@pytest.mark.parametrize("n", [300, 4000])
def test_recall_and_copies(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x[: n // 3] = x[0]  # a third of all rows are copies of one vector
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in permutation_index.nearest(df, df.filter(f"vec_id % {n // 50} = 1")).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -1e9
        wanted = np.lexsort((np.arange(n), -s))[:20]
        hit += len(found & set(wanted.tolist()))
        assert q >= n // 3 or found == set(wanted.tolist())
    assert len(by) == 50 and hit >= 0.9 * 20 * len(by)


def test_recall_beside_a_crowd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x[:1000] = x[0] + 0.3 * x[:1000]  # a third of all rows in one crowd, none alike
    x[1000:1500] = x[1000] + 0.5 * x[1000:1500]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(3000)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in permutation_index.nearest(df, df.filter("vec_id % 30 = 0")).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    near = [len(found & set(np.lexsort((np.arange(3000), np.where(np.arange(3000) == q, 9, -x @ x[q])))[:20].tolist())) for q, found in by.items()]
    assert len(by) == 100 and sum(near) >= 0.9 * 20 * len(by)


def lengths_of(kind, n, rng):
    x = rng.normal(size=(n, 64))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "log-normal":
        x *= (rng.lognormal(size=n) / np.linalg.norm(x, axis=1))[:, None]
    elif kind == "clustered":
        x = (rng.normal(size=(100, 64))[rng.integers(0, 100, n)] + 0.5 * x) * rng.uniform(0.2, 3, n)[:, None]
    return x


@pytest.mark.parametrize("n", [1000, 8000])
@pytest.mark.parametrize("kind", ["unit", "gaussian", "clustered", "log-normal"])
def test_recall_of_unequal_lengths(spark, kind, n):
    x = lengths_of(kind, n, np.random.default_rng(11))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in permutation_index.nearest(df, df.filter(f"vec_id % {n // 50} = 0")).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(found & set(np.lexsort((np.arange(n), np.where(np.arange(n) == q, np.inf, -x @ x[q])))[:20].tolist())) for q, found in by.items())
    assert len(by) == 50 and hit >= 0.9 * 20 * len(by), hit / 20 / len(by)


def test_lengths_of_any_size(spark):
    rows = [(0, [1e-300, 0.0]), (1, [5e-324, 5e-324]), (2, [1e154, 1e150]), (3, [1.0, 1.0]), (4, [1.0, -1.0]), (5, [-1e-8, 2e-8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in permutation_index.nearest(df, df.filter("vec_id = 3")).orderBy("rank").collect()]
    assert got == [2, 5, 0, 1, 4]


def test_cells_in_shards(monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD_ROWS", 10)
    first, parts, n = permutation_index.shards_of(np.array([4, 5, 0, 3, 35, 2, 8, 1]))
    assert first.tolist() == [0, 0, 0, 1, 2, 6, 6, 7] and parts.tolist() == [1, 1, 1, 1, 4, 1, 1, 1] and n == 8


def test_nearest_of_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in permutation_index.nearest(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 1), (20, 2, 2), (20, 3, 0), (20, 4, 0)]
    assert permutation_index.nearest(df.limit(0), df.limit(0)).count() == 0


# ---- tokens -------------------------------------------------------------------------

def test_tokens(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    theirs, ours = tokenizers.Tokenizer.from_file(path), bpe.Bpe(open(path, "rb").read())
    odd = ["a\x1cb  \x85 c", "x<|endoftext|>y <|endoftext|>", "日本語 ½ ²3", "  lead\n\n\n tail  ", "don't WE'LL 's", "\U0001f600\u200d é \u180e z\ufeff", "a" * 3000, " " * 40 + "\t\r\n", "\u3000x\u2028", "", "ſ K ﬁ"]
    for t in odd + [r[1] or "" for r in ROWS[:40]]:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == ids
        assert ours.decode(ours.encode(t)).decode() == theirs.decode(ids, skip_special_tokens=False) == t
    wanted = []
    for r in ROWS:
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        wanted.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same([tuple(r) for r in bpe.digest(bpe.encode_documents(docs, path)).collect()], wanted)
    assert bpe.encode_documents(empty, path).count() == 0


def test_tokenizers_that_are_not_followed():
    import public_tokenizers

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    bpe.check_supported(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"type": "BPE", "ignore_merges": True}}, {"added_tokens": [{"content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError, match="not supported"):
            bpe.check_supported(spec | change)


def test_columns_named_like_row_keys(spark):
    rows = [(i % 7, f"alpha beta {i % 5} gamma delta\nshared line", 5, "a", i) for i in range(21)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row long, __hits string, row long")
    assert line_dedup.without_frequent_lines(df, 3).columns == df.columns
    assert sorted(r.row for r in line_dedup.without_frequent_lines(df, 3).collect()) == list(range(21))
    for keep in (simhash.keep_first, near_copies.keep_first):
        kept = keep(df)
        assert kept.columns == df.columns and {r["__row"] for r in kept.collect()} == {5}


# ---- decontamination ----------------------------------------------------------------

def brute_contained(rows, items):
    def grams(t, k):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = []
    for i, t in items:
        n = len((t or "").split())
        if n:
            want = grams(t, min(n, 5))
            for r in rows:
                shared = len(want & grams(r[1], min(n, 5)))
                if shared >= 0.8 * len(want):
                    out.append((r[0], i, shared, len(want)))
    return out


def test_decontamination(spark, docs, empty):
    longest = max((r[1] or "" for r in ROWS), key=len).split()
    near = longest[5000:5040]
    near[20] = "changed"
    items = [(1, SHARED[0]), (2, SHARED[1].upper().lower()), (3, " ".join(longest[10:60])), (4, " ".join(longest[19_000:19_030])), (5, " ".join(near)), (6, "one two"), (7, "one"), (8, None), (9, ""), (10, sentence(40)), (1, SHARED[0]), (11, SHARED[2].replace(" ", "\n"))]
    worn = longest[7000:7300]
    for i in range(0, 300, 40):
        worn[i] = "changed"
    items += [(12, " ".join(longest[300:500])), (13, " ".join(worn)), (14, sentence(150)), (15, " ".join(longest[:18_000]))]  # by signatures of documents
    table = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, doc_id string")
    levels = {r.level for r in decontaminate.signatures(table, 0.8).select("level").distinct().collect()}
    assert levels == {0, 1, 2, 3, decontaminate.ALL}
    got = decontaminate.contained_items(docs, table).select("doc_id", "item_id", "n_shared", "n_shingles").collect()
    wanted = brute_contained(ROWS, items)
    same([tuple(r) for r in got], wanted)
    assert {4, 5, 12, 13, 15} <= {w[1] for w in wanted} and 14 not in {w[1] for w in wanted}
    kept = decontaminate.clean(docs, table)
    bad = {r for r, *_ in wanted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in ROWS} - bad
    assert decontaminate.contained_items(empty, table).count() == 0 and decontaminate.contained_items(docs, table.limit(0)).count() == 0


def test_signatures():
    rng = np.random.default_rng(1)
    assert {n: decontaminate.partition(n, 0.8)[0] for n in (1, 6, 7, 30, 200, 2000)} == {1: decontaminate.ALL, 6: decontaminate.ALL, 7: 3, 30: 3, 200: 1, 2000: 0}
    every, none = SimpleNamespace(has=lambda x: np.ones(len(x), bool)), SimpleNamespace(has=lambda x: np.zeros(len(x), bool))
    for n in [*range(7, 40), *[60, 95, 96, 150, 400, 1500]]:  # the least that must be shared, in documents as full as their class allows
        for size in {max(64, 1 << (n - 1).bit_length()), 512, 4096}:
            h = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            held = rng.choice(h, decontaminate.needed(len(h), 0.8), replace=False)
            doc = np.concatenate([held, rng.integers(0, 2**63, max(0, size - len(held)), dtype=np.uint64)])
            bits, level, agree = decontaminate.sign(h, 0.8)
            got, from_bits, c = decontaminate.document_hits(doc, none, every)
            have = dict(zip(got.tolist(), from_bits.tolist(), strict=True))
            bins = decontaminate.SMALLEST + c + level
            agreed = [x for x, b in zip(h.tolist(), bits.tolist(), strict=True) if b <= bins and have.get(x, decontaminate.NEVER) <= bins]
            # by the definition: equal minima of the bins of both sides
            least = lambda xs: {int(x) & ((1 << bins) - 1): int(x) for x in sorted(xs.tolist(), reverse=True)}  # noqa: E731, B023
            assert sorted(agreed) == sorted(x for at, x in least(h).items() if least(doc).get(at) == x)
            assert len(agreed) >= agree > 0 and agree >= (0.4 * n if n > 60 else 1)


def test_candidates_of_the_given_benchmark_come_from_signatures(spark):
    sf = "/root/testdata/sf0.01"
    posted = decontaminate.signatures(spark.read.parquet(f"{sf}/benchmark.parquet"), 0.8).cache()
    assert posted.filter(F.col("level") == decontaminate.ALL).count() == 0 and posted.select("item").distinct().count() == 40
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.xxhash64("doc_id").alias("id"), F.xxhash64("text").alias("h_text"), F.col("text").cast("binary").alias("text"))
    found = decontaminate.hits(docs, posted).cache()
    assert found.count() > 0 and found.filter(F.col("bits") == decontaminate.NEVER).count() == 0
    assert decontaminate.candidates(found, posted).count() >= 10


def test_common_phrases_bring_no_pairs_together(spark):
    stock = ["terms and conditions apply to every such offer made here today", "all rights reserved by the owners of this very fine and old site"]
    items = [(i, f"{sentence(12)} {stock[0]} {sentence(12)} {stock[1]}") for i in range(200)]
    rows = [(i, f"{sentence(40)} {stock[0]} {sentence(40)} {stock[1]} {sentence(40)}" + (f" {items[i][1]}" if i < 5 else "")) for i in range(400)]
    docs = spark.createDataFrame([(i, 1, t.encode()) for i, t in rows], "id long, h_text long, text binary")
    table = spark.createDataFrame(items, "item_id long, text string")
    posted = decontaminate.signatures(table, 0.8).cache()
    pairs = decontaminate.candidates(decontaminate.hits(docs, posted).cache(), posted).count()
    assert 5 <= pairs < 0.01 * 200 * 400
    got = decontaminate.contained_items(spark.createDataFrame(rows, "doc_id long, text string"), table).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(5)]


def test_many_items(spark):
    rows = [(i, sentence(30)) for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(r[1] for r in rows[i * 10 : i * 10 + 3])) for i in range(300)], "doc_id long, text string")
    got = decontaminate.contained_items(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert {(i, j) for i in range(300) for j in range(i * 10, i * 10 + 3)} <= {(r.doc_id, r.item_id) for r in got}


# ---- words --------------------------------------------------------------------------

def test_words():
    texts = [b"", b"a  b", b"\x0b", b"a", "é\u00a0x b".encode(), b" a b "]
    w = Words(texts)
    assert np.diff(w.first).tolist() == [len(t.split()) for t in texts]
    flat = [x for t in texts for x in t.split()]
    assert [bytes(w.data[s:e]) for s, e in zip(w.start, w.end, strict=True)] == flat
    assert len(set(w.hash.tolist())) == len(set(flat)) and w.hash[0] == w.hash[2]
