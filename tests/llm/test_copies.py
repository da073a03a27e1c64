"""SimHash classes, fingerprints and packing against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from barwright.llm import components, minhash, packing, simhash, subwords
from tests.llm import brute
from tests.llm.test_native import docs_of, empty, odd  # noqa: F401


def plain_simhash(text):
    ws = [w.encode().lower().decode() for w in brute.words(text)]
    sh = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(prints):
    """Fingerprint -> representative, by comparing all pairs."""
    p = np.array(sorted(set(prints)), dtype=np.uint64)
    root = list(range(len(p)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p[i + 1:] ^ p[i]) <= 2)[0]:
            a, b = sorted((find(i), find(int(j) + i + 1)))
            root[b] = a
    return {int(v): int(p[find(i)]) for i, v in enumerate(p)}


def check_classes(out, docs):
    prints = [plain_simhash(t) for t in docs.text]
    cls = plain_classes(prints)
    least = defaultdict(lambda: None)
    for i, f in zip(docs.doc_id, prints):
        if not pd.isna(i):
            c = cls[f]
            least[c] = int(i) if least[c] is None else min(least[c], int(i))
    key = lambda d: sorted(((-1 if pd.isna(a) else int(a)), b, (-1 if pd.isna(c) or c is None else int(c))) for a, b, c in d)
    want = [(i, f"{f:016x}", least[cls[f]]) for i, f in zip(docs.doc_id, prints)]
    assert key(zip(out.doc_id, out.fingerprint, out.component_id)) == key(want)


def test_classes(spark, sf, odd, empty):  # noqa: F811
    check_classes(simhash.query(spark, sf).toPandas(), docs_of(sf))
    check_classes(simhash.query(spark, odd).toPandas(), docs_of(odd))
    assert simhash.query(spark, empty).count() == 0


def test_links_of_planted_fingerprints(spark):
    """Chains and stars of near fingerprints, and pairs just beyond two bits."""
    rng = random.Random(3)
    prints = []
    for _ in range(60):
        f = rng.getrandbits(64)
        prints.append(f)
        for d in (1, 2, 3):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            prints.append(g)
        for _ in range(rng.choice([0, 0, 12])):
            f ^= 1 << rng.randrange(64)
            prints.append(f)
    base = rng.getrandbits(64)
    prints += [base ^ (m << 20) for m in range(256)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "doc_id long, simhash long")
    got = {r.doc_id: r.component_id for r in simhash.near_classes(rows).collect()}
    cls = plain_classes(prints)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(cls[p], i)
    assert got == {i: least[cls[p]] for i, p in enumerate(prints)}


def test_components_of_a_path_and_none(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3)], "a long, b long")
    assert {r.component for r in components.components(e).collect()} == {0}
    assert components.components(e.where("a = 500")).count() == 0


def test_dedup_stage(spark, odd):  # noqa: F811
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = simhash.stage(spark, docs, odd)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect())
    assert ids.count(5) == 1 and 6 not in ids and ids.count(1) == 1 and 2 not in ids and -1 in ids


def plain_jaccard(a, b):
    sh = lambda t: {tuple(w[i:i + 5]) for w in [brute.words(t)] for i in range(len(w) - 4)} or ({tuple(brute.words(t))} if brute.words(t) else set())
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check_fingerprints(out, docs):
    docs = docs.assign(text=docs.text.fillna(""), at=docs.doc_id.fillna(-1)).sort_values("at", kind="stable").reset_index(drop=True)
    texts = docs.text.tolist()
    out = out.assign(at=out.doc_id.fillna(-1)).sort_values(["at"], kind="stable").reset_index(drop=True)
    errors = []
    assert len(out) == len(docs)
    for i, t in enumerate(texts):
        nxt, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = out.loc[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - plain_jaccard(t, edited), r.near_next - plain_jaccard(t, nxt)]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06
    by_text = defaultdict(set)
    for t, f in zip(texts, out.fingerprint):
        by_text[t].add(f)
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprints(spark, sf, odd, empty):  # noqa: F811
    check_fingerprints(minhash.query(spark, sf).toPandas(), docs_of(sf))
    check_fingerprints(minhash.query(spark, odd).toPandas(), docs_of(odd))
    assert minhash.query(spark, empty).count() == 0


def test_next_over_sparse_ids(spark):
    ids = sorted({random.Random(5).randrange(10 ** 12) for _ in range(300)} | set(range(700)))
    d = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in minhash.with_next(d, ["text"]).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def check_packing(out, docs):
    tok = Tokenizer.from_file(subwords.VOCABULARY)
    want = []
    for i, t in zip(docs.doc_id, docs.text):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            p = np.array(ids[k:k + 4096], "<u4").tobytes()
            want.append((-1 if pd.isna(i) else int(i), k // 4096, k, len(p) // 4, zlib.crc32(p)))
    got = out.assign(doc_id=out.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, got.values.tolist())) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 4096
        assert g.offset.tolist() == [0] + g.length.cumsum().tolist()[:-1]
    return out.sequence_id.nunique() / -(-out.length.sum() // 4096)


def test_packing(spark, sf, odd, empty):  # noqa: F811
    assert check_packing(packing.query(spark, sf).toPandas(), docs_of(sf)) < 1.05
    check_packing(packing.query(spark, odd).toPandas(), docs_of(odd))
    assert packing.query(spark, empty).count() == 0


def test_tree_merges_in_small_groups(spark):
    rng = random.Random(1)
    fills = [rng.randrange(1, 3000) for _ in range(700)]
    bins = spark.createDataFrame(list(enumerate(fills)), "bin long, fill long")
    moved = packing.merge_tree(bins, group=100).toPandas()
    assert len(moved) == 700
    moved["len"] = [fills[b] for b in moved.bin]
    for _, g in moved.groupby("into"):
        g = g.sort_values("shift")
        assert g["shift"].tolist() == [0] + g.len.cumsum().tolist()[:-1] and g.len.sum() <= 4096
    assert moved.into.nunique() < 1.1 * sum(fills) / 4096 + 8


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_by_word_equal_ids_by_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(WORDS.ids(text.encode()), "<u4").tolist()
    assert ids == WORDS.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["Straße, ÜBER!! don't it's x's. |a| a.b@c.de $$$ 0 10 a0b <|endoftext|>. <|ENDOFTEXT|>, e\u0301a E\u0301A \u0130stanbul \u03a3\u0391\u03a3 \ufb01ne 東京。 тест ñÑ\u00a0nbsp \u2003 wide'S 'Ll",
                                  "tion.%%% a### x~ .' 's, n't 'tis \u00b2 x\u00b2 \u0661 ok"])
def test_ids_of_odd_words(text):
    assert np.frombuffer(WORDS.ids(text.encode()), "<u4").tolist() == WORDS.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="abtheZé'ß.,!#0 1<|>\u0301\u00a0ſK", max_size=40))
@settings(max_examples=1500, deadline=None)
def test_ids_of_made_up_words(text):
    assert np.frombuffer(WORDS.ids(text.encode()), "<u4").tolist() == WORDS.tokenizer.encode(text, add_special_tokens=False).ids


WORDS = subwords.WordIds(remembered=500)
