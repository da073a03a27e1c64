"""The shingle-set join against brute force: given documents, awkward ones, and planted groups of near copies."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from barwright.llm import jaccard
from tests.llm import brute
from tests.llm.test_native import docs_of, empty, odd  # noqa: F401


def plain_set(text):
    ws = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in brute.words(text)]
    return frozenset(tuple(ws[i:i + 3]) for i in range(len(ws) - 2)) if len(ws) > 2 else frozenset([tuple(ws)] if ws else [])


def plain_join(docs):
    """All pairs of distinct sets, compared."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[plain_set(t)].append(i)
    sets = [s for s in groups if s]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and find(i) != find(j):
                o = len(a & b)
                if 100 * o >= 90 * (len(a) + len(b) - o):
                    root[find(i)] = find(j)
    least = defaultdict(list)
    for i, s in enumerate(sets):
        least[find(i)] += [x for x in groups[s] if x is not None]
    comp = {s: min(least[find(i)], default=None) for i, s in enumerate(sets)}
    return sorted(((x, len(s), comp[s] if s else x) for s, ids in groups.items() for x in ids), key=repr)


def got(df):
    return sorted(((None if pd.isna(r.doc_id) else r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_query(spark, sf, odd, empty):  # noqa: F811
    for d in (sf, odd):
        docs = [(None if pd.isna(i) else int(i), t) for i, t in zip(docs_of(d).doc_id, docs_of(d).text)]
        assert got(jaccard.query(spark, d)) == plain_join(docs)
    assert jaccard.query(spark, empty).count() == 0


def edited(rng, ws, share):
    ws = list(ws)
    for i in rng.sample(range(len(ws)), round(share * len(ws))):
        ws[i] = f"e{rng.randrange(10**6)}"
    return ws


@pytest.mark.parametrize("few", [2, 4, 1000])
def test_planted(spark, monkeypatch, few):
    """Pairs around the threshold at many sizes; chains; a large group of near copies without its source; a passage that half of all rows share."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rng, rows = random.Random(4), []
    word = lambda: f"w{rng.randrange(3000)}"
    for size in (3, 9, 11, 12, 21, 40, 100, 400, 3000):
        for share in (0, 0.004, 0.01, 0.015, 0.017, 0.02, 0.03):
            base = [word() for _ in range(size)]
            rows += [" ".join(base), " ".join(edited(rng, base, share)), " ".join(base[:-1]), " ".join(base[size // 19:])]
    chain = [word() for _ in range(200)]
    for _ in range(12):
        chain = edited(rng, chain, 0.012)
        rows.append(" ".join(chain))
    for size, share in ((150, 0.02), (90, 0.03), (150, 0.012)):
        base = [word() for _ in range(size)]
        rows += [" ".join(edited(rng, base, share)) for _ in range(120)]
    # copies of copies, and edits that several copies share
    for _ in range(3):
        base = [word() for _ in range(160)]
        for _ in range(8):
            middle = edited(rng, base, 0.03)
            rows += [" ".join(middle)] * (rng.random() < 0.5) + [" ".join(edited(rng, middle, rng.choice([0.006, 0.012, 0.02]))) for _ in range(12)]
    passage = " ".join(word() for _ in range(60))
    rows += [f"{' '.join(word() for _ in range(40 + i % 7))} {passage}" for i in range(300)]
    rows += [rows[0].upper(), rows[5], rows[5]]
    docs = list(enumerate(rows))
    rng.shuffle(docs)
    assert got(jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))) == plain_join(docs)


def test_copies_of_one_text_have_few_leads(spark, monkeypatch):
    """Copies with edits of their own share other fragments with each of many others, and are compared to a lead or two, not to one per fragment."""
    rng, found, by_lead = random.Random(6), [], jaccard.by_lead
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    docs = [(i, " ".join(edited(rng, base, 0.04))) for i in range(400)]

    def seen(met, keep):
        few, led = by_lead(met, keep)
        found.append((led.count(), led.select("rep").distinct().count()))
        return few, led
    monkeypatch.setattr(jaccard, "by_lead", seen)
    assert got(jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))) == plain_join(docs)
    (rows, reps), = found
    assert reps > 300 and rows <= 2 * reps, found


def test_fragments_lose_no_pair():
    """Sets at the threshold always share the hash of a fragment, as classes of sizes allow."""
    rng = np.random.default_rng(0)
    for like, a in [(90, n) for n in (*range(1, 60), 97, 333, 1000)] + [(80, n) for n in (*range(1, 40), 97)]:
        classes = jaccard.Classes(like)
        for extra in range(a * (100 - like) // like + 1):
            for gone in range(a * (100 - like) // 100 + 1):
                if 100 * (a - gone) < like * (a + extra) or gone + extra == 0:
                    continue
                t = np.unique(rng.integers(0, 1 << 63, a + extra, dtype=np.uint64) * np.uint64(2))
                x, y = np.sort(rng.permutation(t)[:a]), None
                rest = np.setdiff1d(t, x)
                y = np.sort(np.concatenate([x[rng.permutation(a)[:a - gone]], rest]))
                sx, sy = jaccard.signatures(x, classes), jaccard.signatures(y, classes)
                assert any(set(sx[i]) & set(sy[j]) for i, j in ((0, 0), (0, 1), (1, 0))), (a, extra, gone)
