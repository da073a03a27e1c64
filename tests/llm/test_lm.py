"""Language-model scores: gradients, windows, masked batches, base against plain counts, held-out likelihood."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from barwright.llm import attention, lm
from tests.llm import brute
from tests.llm.test_native import docs_of, empty, odd  # noqa: F401


def model(seed=0):
    rng = np.random.default_rng(seed)
    return attention.initial(rng.integers(1, 100, attention.SYMBOLS), seed=seed), rng


def test_gradients_match_differences():
    p, rng = model()
    p = {k: v.astype(float) for k, v in p.items()}
    x, y = rng.integers(0, attention.SYMBOLS, (2, 3, attention.WINDOW))
    m = (rng.random(x.shape) < 0.7).astype(float)
    _, g = attention.gradients(p, x, y, m)
    for k in p:
        flat = np.argsort(-np.abs(g[k]).ravel())[:3]
        for i in flat:
            old, d = p[k].flat[i], 1e-4
            p[k].flat[i] = old + d
            up = attention.gradients(p, x, y, m)[0]
            p[k].flat[i] = old - d
            down = attention.gradients(p, x, y, m)[0]
            p[k].flat[i] = old
            assert abs((up - down) / (2 * d) - g[k].flat[i]) < 2e-2 * abs(g[k].flat[i]) + 1e-5, k


def test_each_symbol_is_scored_once_and_masked():
    for n in (1, 5, lm.STRIDE - 1, lm.STRIDE, lm.STRIDE + 1, 100):
        s = np.arange(1, n + 1)
        x, y, m = attention.windows(s, 0, lm.STRIDE)
        assert y[m].tolist() == s.tolist()
        assert (x[:, -lm.STRIDE:][m] == s - 1).all()
        assert m.sum() == n
    p, rng = model(1)
    t = attention.tables(p)
    s = rng.integers(0, attention.SYMBOLS, 90)
    x, y, m = attention.windows(s, 3, lm.STRIDE)
    whole = attention.log_probs(t, x, y, lm.STRIDE)
    alone = np.concatenate([attention.log_probs(t, x[i:i + 1], y[i:i + 1], lm.STRIDE) for i in range(len(x))])
    assert np.allclose(whole, alone, atol=1e-4)
    later = x.copy()
    later[:, -1] = (later[:, -1] + 1) % attention.SYMBOLS  # a change of the last symbol reaches only the last prediction
    assert np.allclose(attention.log_probs(t, later, y, lm.STRIDE)[:, :-1], whole[:, :-1], atol=1e-4)


def test_probabilities_sum_to_one():
    p, rng = model(2)
    t = attention.tables(p)
    x = np.repeat(rng.integers(0, attention.SYMBOLS, (1, attention.WINDOW)), attention.SYMBOLS, 0)
    lp = attention.log_probs(t, x, np.arange(attention.SYMBOLS)[:, None], 1)
    assert abs(np.exp(lp.astype(float)).sum() - 1) < 1e-3
    c = np.zeros(lm.IDS, np.int64)
    c[:5000] = np.arange(5000) % 97
    s = lm.Symbols(c)
    rare = s.of == attention.SYMBOLS - 1
    assert abs((10 ** s.inside[rare]).sum() - 1) < 1e-9 and (s.inside[~rare] == 0).all()


def test_small_classes_share_a_product(monkeypatch):
    """Gradients are the same however many classes are padded, and a step makes one product for all small ones."""
    p, rng = model(3)
    x = rng.integers(0, attention.SYMBOLS, (32, attention.WINDOW))
    y = np.minimum(rng.zipf(1.2, x.shape) - 1, attention.SYMBOLS - 1)  # one class has most of the targets, many have few
    m = (rng.random(x.shape) < 0.9).astype(np.float32)
    losses = []
    real = attention._softmax_loss
    monkeypatch.setattr(attention, "_softmax_loss", lambda *a: losses.append(1) or real(*a))
    found = []
    for padded in (0, attention.PADDED, x.size):
        losses.clear()
        monkeypatch.setattr(attention, "PADDED", padded)
        found.append((len(losses), *attention.gradients(p, x, y, m), len(losses)))
    assert found[0][3] > 20 and found[1][3] < 12 and found[2][3] == 2
    for _, loss, g, _ in found[1:]:
        assert abs(loss - found[0][1]) < 1e-4
        assert all(np.allclose(g[k], found[0][2][k], rtol=1e-3, atol=1e-5) for k in g)


def test_large_values_overflow_nothing():
    p, rng = model(4)
    for k in ("emb", "q", "uc", "um"):
        p[k] *= 40
    x, y = rng.integers(0, attention.SYMBOLS, (2, 4, attention.WINDOW))
    loss, g = attention.gradients(p, x, y, np.ones(x.shape, np.float32))
    assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())


def test_a_state_survives_packing():
    p, rng = model(5)
    s = attention.fresh(p)
    x, y = rng.integers(0, attention.SYMBOLS, (2, 4, attention.WINDOW))
    attention.descend(s, x, y, np.ones(x.shape, np.float32), 1e-3)
    t = attention.unpacked(attention.packed(s), p, s["step"])
    for a in (s, t):
        attention.descend(a, x, y, np.ones(x.shape, np.float32), 1e-3)
    assert t["step"] == 2 and all((s[part][k] == t[part][k]).all() for part in attention.PARTS for k in p)
    assert any((p[k] != s["p"][k]).any() for k in p)  # the weights that it began with stay


def check_base(out, docs):
    docs = docs.assign(id=docs.doc_id.map(lambda i: "" if pd.isna(i) else str(int(i))))
    docs["held"] = [zlib.crc32(i.encode()) % 7 == 2 for i in docs.id]
    ws = [[w.encode().lower() for w in brute.words(t)] + [None] for t in docs.text]
    c = Counter(w for w, h in zip(ws, docs.held) if not h for w in w)
    n, v = sum(c.values()), len(c)
    want = sorted((i, h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, h, w in zip(docs.id, docs.held, ws))
    got = sorted(("" if pd.isna(r.doc_id) else str(int(r.doc_id)), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.itertuples())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-6)


@pytest.fixture
def frequent_are_few(monkeypatch):
    """Most words go through the join."""
    monkeypatch.setattr(lm, "FREQUENT", 50)


def test_scores(spark, sf, frequent_are_few):
    out = lm.query(spark, sf).toPandas()
    docs = docs_of(sf)
    check_base(out, docs)
    assert (out.score < 0).all()
    text = docs.set_index("doc_id").text
    by = {}
    for r in out.itertuples():
        by.setdefault(text[r.doc_id], set()).add(round(r.score, 3))
    assert max(max(s) - min(s) for s in by.values()) < 0.01  # equal texts, equal scores
    uniform = -out.n_subwords.sum() * math.log10(attention.SYMBOLS)
    assert out.score.sum() > 0.75 * uniform


def test_scores_of_awkward_tables(spark, odd, empty):  # noqa: F811
    out = lm.query(spark, odd).toPandas()
    check_base(out, docs_of(odd))
    assert out.score.notna().all()
    assert lm.query(spark, empty).count() == 0


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 300, (60, 3))
    s = words[rng.integers(0, 60, 3000)].ravel()  # symbols come in known threes: the last two follow from the first
    x, y, m = attention.windows(s, 0, attention.WINDOW)
    p = attention.initial(np.bincount(s, minlength=attention.SYMBOLS))
    before = attention.gradients(p, x, y, m)[0]
    p, after = attention.train(p, x, y, m.astype(np.float32), epochs=25, batch=32)
    assert after < 0.6 * before


def test_trains_on_every_window_of_every_row(spark):
    texts = [f"w{i} of the text number {i} " * (1 + i % 23) for i in range(4_000)] + ["one text many times over"] * 2_000 + [None, ""]
    docs = lm.folded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = docs.where("NOT held_out")
    ids = lm.id_counts(lm.word_counts(rows), rows.count())
    s = lm.Symbols(ids)
    found = lm.training_windows(rows, 3, s.of, s.end).collect()
    w = np.concatenate([np.frombuffer(r.w, "<u2").reshape(-1, attention.WINDOW + 2) for r in found]).astype(int)
    targets = w[:, 1:-1][np.arange(attention.WINDOW) < w[:, -1:]]
    assert (np.bincount(targets, minlength=attention.SYMBOLS) == s.counts).all()  # nothing is sampled, nothing is twice
    assert {r.unit for r in found} == {0, 1, 2} and {r.round for r in found} == set(range(lm.ROUNDS))
    assert attention.WINDOW >= 32 and attention.WINDOW - lm.STRIDE >= 8


def test_units_learn_together(spark):
    rng = np.random.default_rng(4)
    s = rng.integers(0, 300, (60, 3))[rng.integers(0, 60, 120_000)].ravel()  # the last two of each three follow from the first
    x, y, m = attention.windows(s, 0, attention.WINDOW)
    w = np.column_stack([x, y[:, -1], m.sum(1)]).astype("<u2")
    rows = [(int(i % 3), int(i // 3 % lm.ROUNDS), bytearray(v.tobytes())) for i, v in enumerate(w)]
    p = attention.initial(np.bincount(s, minlength=attention.SYMBOLS))
    before = attention.gradients(p, x[:500], y[:500], m[:500])[0]
    p = lm.trained(spark.createDataFrame(rows, "unit int, round int, w binary").repartition(3, "unit"), p)
    assert attention.gradients(p, x[:500], y[:500], m[:500])[0] < 0.85 * before


def test_a_task_keeps_its_units_apart(spark):
    """Units in one task learn as they would alone, and their states are averaged by windows."""
    rng = np.random.default_rng(6)
    s = rng.integers(0, 300, (60, 3))[rng.integers(0, 60, 16_000)].ravel()
    w = lm.cut(s, 0)
    rows = [(int(i % 3 * (i % 5 > 0)), int(i % lm.ROUNDS), v) for i, v in enumerate(w)]
    p = attention.initial(np.bincount(s, minlength=attention.SYMBOLS))
    found = lm.trained(spark.createDataFrame([(u, r, bytearray(v.tobytes())) for u, r, v in rows], "unit int, round int, w binary").coalesce(1), p)
    state = attention.fresh(p)
    for r in range(lm.ROUNDS):
        total, step = 0.0, 0
        for u in range(3):
            own = np.array([v for a, b, v in rows if (a, b) == (u, r)])
            one = attention.unpacked(attention.packed(state), p, state["step"])
            lm.unit_step(one, own, r)
            total, step = total + attention.packed(one).astype(float) * len(own), max(step, one["step"])
        state = attention.unpacked(total / sum(b == r for _, b, _ in rows), p, step)
    assert all(np.allclose(found[k], state["p"][k], rtol=1e-2, atol=1e-3) for k in p)


def test_texts_become_symbols_once(spark):
    texts = ["The cat sat on the mat, and sat. " * n for n in (1, 9, 40)] + [None, "", " \n", "Ünbekannt zzqx 12345 <| the"]
    docs = lm.folded(spark.createDataFrame(list(enumerate(texts * 4)), "doc_id long, text string"))
    rows = docs.where("NOT held_out")
    s = lm.Symbols(lm.id_counts(lm.word_counts(rows), rows.count()))
    out = lm.encoded(docs, s.of, s.inside)
    assert "text" not in out.columns  # what training and scoring take
    ids, got = lm.WordIds(), out.toArrow().to_batches()
    found = {i: v for b in got for i, v in zip(b.column("doc_id").to_pylist(), zip(b.column("n_tokens").to_pylist(), b.column("n_subwords").to_pylist(), b.column("inside").to_pylist(), lm.symbols_of(b)))}
    for i, t in enumerate(texts * 4):
        b = (t or "").encode().lower()
        want = np.append(np.frombuffer(ids.ids(b), "<u4"), lm.END_ID).astype(int)
        n, sub, inside, symbols = found[i]
        assert (n, sub) == (len(b.split()) + 1, len(want)) and symbols.tolist() == s.of[want].tolist() and abs(inside - s.inside[want].sum()) < 1e-9


def test_cut_windows_are_those_of_the_model():
    for n in (1, 31, 32, 33, 64, 100):
        s = np.arange(1, n + 1)
        x, y, m = attention.windows(s, 0, attention.WINDOW)
        assert (lm.cut(s, 0) == np.column_stack([x, y[:, -1], m.sum(1)])).all()


def test_base_reads_texts_once(spark):
    docs = lm.folded(spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string"))
    counts = spark.createDataFrame([(b"a", 3), (b"b", 1)], "word binary, n long")
    out = lm.base_sums(docs, counts, {b"a": math.log10(4)})
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.b_id: (r.known, round(r.logs, 9)) for r in out.collect()}
    assert got == {1: (3, round(2 * math.log10(4) + math.log10(2), 9)), 2: (1, round(math.log10(2), 9))}


def test_scoring_in_blocks_changes_nothing(monkeypatch):
    p, rng = model(7)
    t = attention.tables(p)
    x = rng.integers(0, attention.SYMBOLS, (30, attention.WINDOW))
    y = np.minimum(rng.zipf(1.2, (30, lm.STRIDE)) - 1, attention.SYMBOLS - 1)
    whole = attention.log_probs(t, x, y, lm.STRIDE)
    monkeypatch.setattr(attention, "BATCH", 7)
    monkeypatch.setattr(attention, "TOGETHER", 5)
    assert np.allclose(attention.log_probs(t, x, y, lm.STRIDE), whole, atol=1e-5)
