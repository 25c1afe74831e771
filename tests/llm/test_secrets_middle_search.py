"""Secret links, fill-in-the-middle and ranked search against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from lumenfold.llm import fill_in_middle, impact_search, queries, secret_links
from lumenfold.llm.secret_links import ACCESS, ANY, ASSIGN, ASSIGN_VALUE, BLANK_LINE, ENDPOINT, HEX, IDENTIFIER, KINDS, NEEDS, REACH, ROLE

DOCS = "doc_id long, text string, lang string, n long, rank string, form string, spans string, __h string"
EXTRA = ("en", 3, "x", "y", "z", "h")
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- secret links -------------------------------------------------------------------

def brute_spans(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if re.search(f"^{ASSIGN_VALUE}$", m[0])]
    base += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text)] + [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    weak = []
    for m in re.finditer(ANY, text):
        if re.fullmatch(ENDPOINT, m[0]):
            weak.append((m.start(), 4, m.end()))
        elif re.fullmatch(IDENTIFIER, m[0]):
            weak.append((m.start(), 3, m.end()))
        elif not any(re.fullmatch(p, m[0]) for p in (ASSIGN, ACCESS, HEX)) and all(re.search(p, m[0]) for p in ("[0-9]", "[A-Z]", "[a-z]")):
            weak.append((m.start(), 5, m.end()))
    breaks = [m.start() for m in re.finditer(BLANK_LINE, text)]
    scope = lambda at: sum(b <= at for b in breaks)
    parts, links = base + weak, []
    for s, k, e in weak:
        near = {ROLE[KINDS[q]] for a, q, b in parts if scope(a) == scope(s) and a <= e + REACH and b >= s - REACH and (b <= s or a >= e)}
        if near >= set(NEEDS[KINDS[k]]):
            links.append((s, k, e))
    return sorted(base), sorted(base + links)


def brute_secrets(doc_id, text):
    base, every = brute_spans(text)
    line = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in xs)
    return doc_id, *(sum(k == i for _, k, _ in base) for i in range(3)), sha(line(base)), line(every)


KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzABCD1234"
HEXED = "0123456789abcdef" * 2
SECRET_TEXTS = [
    None, "", " ", "plain words only\n\nand more", KEY, f"user = bob {KEY}", f"user = bob\n\n{KEY}", f"user = bob{' ' * 199}{KEY}", f"user = bob{' ' * 201}{KEY}", f"{KEY} https://db.example.org:5432/x",
    f"login: ann\nhttps://db.example.org/x\n{KEY}", f"https://a.example/{HEXED} user=cy", f"é\U0001F600 ACCESS_KEY_ID: zed\r\n \t\r\nhost: q {HEXED} Token='{HEXED}'", "AKIA" + "Z" * 13, "AKIA" + "Z" * 14, "AKIAAKIA" + "Q" * 10 + f" {KEY}",
    "password: token:abcdefghijklmnop", "token=secret=abcdefghijklmn", "API_KEY  ==abcdefghijk", "api-key=abcdefghijklmn", "paſsword=abcdefghijklmn", "toKen=abcdefghijklmn", "apikey = \"short\" ApiKey:'0123456789ab'", f"account=abc {'x1Y' * 4000} user=def",
    "\n\n".join(f"user=u{i} {KEY} server={'s' * (i % 5)}.example token={HEXED}" for i in range(300)), "token=" + "a" * 100_000, " ".join(["0123456789abcdef0"] * 700),
]


def secret_rows():
    rng = random.Random(3)
    pieces = [KEY, HEXED, "user=bob", "client_id: 77ab", "https://h.example/p?q=1", "host = h.example:99", "secret: abcdefghijklmnop", "AKIA" + "B7" * 8, "\n\n", "\n \t\n", "\n", "word " * 10, "ünï" * 9, "." * 90, "Endpoint=abc", "token:x"]
    texts = SECRET_TEXTS + ["".join(rng.choice(pieces) + " " * rng.randrange(60) for _ in range(rng.randrange(2, 30))) for _ in range(60)]
    rows = list(enumerate(texts))
    return rows + [(5, texts[5]), (5, texts[5]), (5, "user = other " + KEY), (None, texts[6]), (None, texts[5])]


def test_secret_links_equal_brute_force(spark):
    rows = secret_rows()
    got = [tuple(r) for r in secret_links.digest(secret_links.scan(frame(spark, rows).repartition(3))).collect()]
    wanted = [brute_secrets(*r) for r in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    linked = [k for w in wanted for k in KINDS[3:] if f"{k}:" in w[-1]]
    assert {*linked} == {*KINDS[3:]} and any(brute_spans(t)[0] == brute_spans(t)[1] and KEY in (t or "") for _, t in rows)


def test_places_of_many_matches_go_over_runs(spark, monkeypatch):
    monkeypatch.setattr(secret_links, "RUN", 3)
    texts = ["é" * (i % 4) + " 0123456789abcdef" * i for i in range(1, 14)]
    got = {r.doc_id: [(s.start, s.end) for s in r.base] for r in secret_links.scan(frame(spark, enumerate(texts))).collect()}
    assert got == {i: [(m.start(), m.end()) for m in re.finditer(HEX, t)] for i, t in enumerate(texts)}


def test_secret_links_of_nothing(spark):
    assert secret_links.digest(secret_links.scan(frame(spark, []))).collect() == []


def test_secret_links_have_no_python(spark):
    plan = secret_links.linked(secret_links.scanned(frame(spark, secret_rows())))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- fill in the middle -------------------------------------------------------------

def brute_middle(doc_id, text, unit=r"[^\n]*\n|[^\n]+", seed=7, percent=100, first=50):
    text = text or ""
    units = re.findall(unit, text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < first:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MIDDLE_TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\r\nß\n\n\U0001F600", "x <P> y", "<S>", "a\n<M>", "<p>\n<s>", "line\n" * 30_000 + "end", "long " * 50_000, " \x0b\x0c\n\x85", "<M", "P>\n<"]


def middle_rows():
    rng = random.Random(5)
    texts = MIDDLE_TEXTS + ["".join(rng.choice(["a", "bc", "\n", "é", " "]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (rows[6][0], "other\ntext\n"), (None, "a\nb\nc")]


def test_fill_in_middle_equals_brute_force(spark):
    rows = middle_rows()
    made = fill_in_middle.transform(frame(spark, rows).repartition(3))
    assert sorted(map(tuple, made.collect()), key=str) == sorted((brute_middle(*r) for r in rows), key=str)
    shas = {(r.doc_id, r.n, r.restored_sha256) for r in fill_in_middle.digest(made).collect()}
    assert shas == {(i, brute_middle(i, t)[1], sha(t or "")) for i, t in rows}
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_with_another_recipe(spark):
    recipe = fill_in_middle.Recipe(unit=r"\s*\S+\s*|\s+", seed=11, percent=60, suffix_first=20)
    rows = middle_rows()
    made = fill_in_middle.transform(frame(spark, rows), recipe).collect()
    assert sorted(map(tuple, made), key=str) == sorted((brute_middle(*r, r"\s*\S+\s*|\s+", 11, 60, 20) for r in rows), key=str)
    assert sum(r.form == "plain" for r in made) > 20


def test_fill_in_middle_refuses_units_with_gaps(spark):
    with pytest.raises(ValueError, match="cover"):
        fill_in_middle.count_units(re.compile("[a-z]+"), "ab cd")
    with pytest.raises(ValueError, match="cover"):
        fill_in_middle.count_units(re.compile("[a-z]+ ?"), "ab cd!")


def test_fill_in_middle_stops_at_the_second_rank():
    class Spy:
        taken = 0

        def finditer(self, text):
            for m in re.finditer(r"[^\n]*\n|[^\n]+", text):
                self.taken += 1
                yield m

    spy = Spy()
    assert fill_in_middle.cut_at(spy, "a\n" * 1000, 3, 5) == (6, 10) and spy.taken == 5


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.digest(fill_in_middle.transform(frame(spark, []))).collect() == []


# ---- ranked search ------------------------------------------------------------------

TERM = re.compile(impact_search.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rank(docs, items, top=20):
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, Counter(w), len(w)) for i, w in words if w]
    count, length = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item_id, text in set(items):
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc_id, tf, n in words:
            m = 75 + 25 * n * count // length
            s = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, q in asked.items() if tf[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def search_rows():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["Éa", "éa", "日本", "x_y", "İ"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i * 3, " ".join(rng.choices(vocab, weights, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(9000, None), (9001, ""), (9002, " -- \n"), (9003, "w1 " * 30_000), (9004, "W1 w2,W3"), (9004, "w1 W2.w3"), (9004, "w1 W2.w3"), (None, "w1 w2 w3 w59"), (12, docs[4][1]), *[(8000 + i, "same w40 w41 text") for i in range(50)]]
    items = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(1, 25)))) for i in range(25)]
    items += [(100, "w1"), (101, "same W40 w40"), (102, "absent"), (103, None), (104, ""), (100, "w1"), (105, "w59 w58 w57 日本 Éa"), (None, "w7")]
    return docs, items


@pytest.mark.parametrize("postings, block", [(1 << 19, 1 << 17), (200, 40), (1, 1)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, postings, block):
    monkeypatch.setattr(impact_search, "SEGMENT_POSTINGS", postings)
    monkeypatch.setattr(impact_search, "BLOCK_TERMS", block)
    docs, items = search_rows()
    if block == 1:
        items = items[20:28]
    found = impact_search.rank(frame(spark, docs).repartition(3), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int"))
    got = [tuple(r) for r in found.collect()]
    wanted = brute_rank(docs, items)
    assert sorted(got, key=str) == wanted and wanted


def test_an_item_id_may_have_two_texts(spark):
    docs = [(i, f"w{i} w{i % 3}") for i in range(30)]
    items = [(1, "w1"), (1, "w2")]
    got = impact_search.rank(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), top=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_rank(docs, items, 4)


def segment_of(docs):
    import pyarrow as pa

    builder = impact_search._Builder()
    words = [(i, impact_search.terms_of(t.encode())) for i, t in docs]
    length = sum(len(w) for _, w in words)
    for i, w in words:
        builder.add(i, w, 75 + 25 * len(w) * len(docs) // length)
    batch = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(builder.row(), impact_search._TYPES, strict=True)], impact_search._NAMES)
    return impact_search.Segment(batch, 0)


def test_groups_are_exact_impacts_in_order():
    docs, _ = search_rows()
    seg = segment_of([(i, t) for i, t in docs if t and impact_search.terms_of(t.encode())])
    for k in seg.number.values():
        vs = seg.impacts[seg.term_groups[k] : seg.term_groups[k + 1]]
        assert (vs[:-1] > vs[1:]).all() and len(vs)


def test_search_stops_before_the_last_group_and_completes_scores():
    rng = random.Random(1)
    docs = [(i, " ".join(["common"] * rng.randrange(1, 4) + ["filler"] * rng.randrange(0, 9) + (["rare"] * rng.randrange(1, 4) if i % 40 == 0 else []))) for i in range(2000)]
    seg = segment_of(docs)
    best = impact_search._Best(5)
    processed = seg.search(["rare", "common"], [3600, 1], best)
    assert 0 < processed < 200  # of 2,050 postings
    weight = {"rare": 3600, "common": 1}
    length = sum(len(t.split()) for _, t in docs)
    score = lambda t: sum(w * (10**9 * t.split().count(k) // (1000 * t.split().count(k) + 12 * (75 + 25 * len(t.split()) * len(docs) // length))) for k, w in weight.items() if k in t)
    assert list(zip(best.ids, best.scores, strict=True)) == [(i, s) for s, i in sorted(((score(t), i) for i, t in docs), key=lambda x: (-x[0], x[1]))[:5]]


def test_ranked_search_over_nothing(spark):
    docs, items = search_rows()
    assert impact_search.rank(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert impact_search.rank(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_registered_queries_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op11_secret_links(spark, SF).collect()), key=str) == sorted((brute_secrets(*d) for d in docs), key=str)
    assert sorted((tuple(r) for r in queries.op13_impact_search(spark, SF).collect()), key=str) == brute_rank(docs, items)
    made = {r.doc_id: r for r in queries.op12_fill_in_middle(spark, SF).collect()}
    assert len(made) == len(docs) and all(made[i].output_sha256 == sha(brute_middle(i, t)[-1]) and made[i].restored_sha256 == sha(t or "") for i, t in docs)
