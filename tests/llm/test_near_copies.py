"""Near copies by Jaccard similarity against brute force."""

import random

import corpus_pipeline
from lumenfold.llm import near_copies, simhash
from tests.llm.test_llm_ops import sentence

RNG = random.Random(8)


def shingled(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_kept(rows, similarity=0.8):
    rows = sorted(set(rows))
    sets, left, kept = [shingled(t) for _, t in rows], set(range(len(rows))), []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            todo += [j for j in left - seen - set(todo) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0]
        kept.append(min(rows[i][0] for i in seen))
        left -= seen
    return sorted(kept)


def changed(text, n):
    w = text.split()
    for i in RNG.sample(range(len(w)), n):
        w[i] = "z" + str(RNG.randrange(10**6))
    return " ".join(w)


def test_stage_against_brute_force(spark, monkeypatch):
    rows, far = [], 0
    for i in range(60):
        text = sentence(120)
        copies = [changed(text, n) for n in (1, 2, 2, 3, 6)]
        rows += [(10 * i + k, t) for k, t in enumerate([text, *copies])]
        far += sum(bin(simhash.fingerprint(text.encode(), 4) ^ simhash.fingerprint(t.encode(), 4)).count("1") > 4 for t in copies[:3])
    assert far  # near copies that four bits of a fingerprint leave
    rows += [(5000, ""), (5001, ""), (5002, "one two"), (5003, "ONE  two"), (5004, "one two three")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for tile in (near_copies.TILE, 3):  # whole clusters, and clusters dealt in chunks
        monkeypatch.setattr(near_copies, "TILE", tile)
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == brute_kept(rows)


def test_link_is_exact():
    base = [sentence(40) for _ in range(12)]
    sets = [near_copies.shingles(changed(RNG.choice(base), RNG.randrange(4)).encode(), 5) for _ in range(150)] + [near_copies.shingles(b"", 5)]
    group = list(range(len(sets)))
    for i, j in near_copies.link(sets, 0.8):
        group = [group[i] if g == group[j] else g for g in group]
    wanted = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(set(a.tolist()) & set(b.tolist()))
            if shared and shared >= 0.8 * (len(a) + len(b) - shared):
                wanted = [wanted[i] if g == wanted[j] else g for g in wanted]
    assert len({*zip(group, wanted, strict=True)}) == len(set(group)) == len(set(wanted))
