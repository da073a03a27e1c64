"""Preference formatting against SQL and a plain version; training order as a permutation and its shards."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from barwright.llm import chat, ordering, queries, subwords
from tests import oracle
from tests.llm.test_native import docs_of, empty, odd  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    n, err = oracle.compare(spark, oracle.duck(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert err is None, err
    assert n > 0


def side(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, prompt string, common long")


def test_preferences(spark):
    r = lambda *x: (*x, "clash", 1)
    chosen = side(spark, [r(1, 1, "assistant", "good é"), r(1, 0, "user", "q"), r(2, 0, "user", None), r(2, 1, None, "x"), r(3, 0, "user", "same"), r(None, 0, "user", "lost"),
                          r(5, 0, "user", "a"), r(5, 0, "user", "a"), r(5, None, "system", "s")])
    rejected = side(spark, [r(1, 0, "user", "q"), r(1, 1, "assistant", "bad"), r(1, 2, "user", "why"), r(1, 3, "assistant", ""), r(2, 0, "user", ""), r(3, 0, "user", "same"), r(4, 0, "assistant", "only here")])
    out = {x.pair_id: x for x in chat.preferences(chosen, rejected).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    one = out[1]
    assert one.prompt == "<|im_start|>user\nq<|im_end|>\n" and one.prompt_turns == 1
    assert one.chosen == "<|im_start|>assistant\ngood é<|im_end|>\n"
    cut = lambda text, mask: [text[slice(*map(int, m.split(":")))] for m in mask.split(",") if m]
    assert cut(one.chosen, one.chosen_mask) == ["good é<|im_end|>"]
    assert cut(one.rejected, one.rejected_mask) == ["bad<|im_end|>", "<|im_end|>"]
    assert out[2].prompt_turns == 1 and out[2].chosen == "<|im_start|>unknown\nx<|im_end|>\n" and out[2].rejected == ""
    assert out[3].chosen == out[3].rejected == "" and out[3].prompt_turns == 1
    assert out[4].prompt == "" and cut(out[4].rejected, out[4].rejected_mask) == ["only here<|im_end|>"]
    assert out[5].chosen.count("a<|im_end|>") == 2 and out[5].chosen.startswith("<|im_start|>system")
    none = side(spark, [])
    assert chat.preferences(none, none).count() == 0


def test_rival_replies_of_awkward_conversations(spark):
    c = spark.createDataFrame([(0, 0, "user", "u"), (0, 1, "assistant", "a0"), (1, 0, "user", "u"), (1, 1, "assistant", "a1"), (2, 0, "assistant", "alone"),
                               (4, 0, "user", None), (None, 0, "assistant", "x"), (6, None, "assistant", "n"), (7, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.text for r in chat.with_rival_reply(c).collect()}
    assert got[(0, 1)] == "a1" and got[(1, 1)] == "a0" and (2, 0) not in got and got[(4, 0)] is None and (6, None) not in got


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    p = ordering.permuted(np.arange(n), n, 7)
    assert sorted(p) == list(range(n))
    assert (p == ordering.permuted(np.arange(n), n, 7)).all()
    if n > 500:
        assert (p != ordering.permuted(np.arange(n), n, 8)).mean() > 0.9
        assert abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.15


def check_order(out, docs, n_shard=ordering.SHARD):
    assert sorted(out.slot) == list(range(len(out)))
    assert (out.slot == out.shard * n_shard + out.record).all() and (out.stride == 1024).all()
    tok, want = Tokenizer.from_file(subwords.VOCABULARY), []
    for i, t in zip(docs.doc_id.fillna(-1), docs.text):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            b = np.array(ids[k:k + 512], "<u2").tobytes()
            want.append((int(i), k // 512, len(b) // 2, zlib.crc32(b.ljust(1024, b"\0"))))
    got = [(int(r.doc_id), r.seq, r.n_ids, r.ids_crc32) for r in out.fillna({"doc_id": -1}).itertuples()]
    assert sorted(got) == sorted(want)


def test_order(spark, sf, odd, empty):  # noqa: F811
    check_order(ordering.query(spark, sf).toPandas(), docs_of(sf))
    check_order(ordering.query(spark, odd).toPandas(), docs_of(odd))
    assert ordering.query(spark, empty).count() == 0


def test_resumed_reads(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ordering.write_order(docs, f"{tmp_path}/o", per_shard=100)
    back = ordering.read_order(spark, f"{tmp_path}/o", 250, 100)
    total = ordering.read_order(spark, f"{tmp_path}/o", 0, 100).count()
    assert sorted(r.slot for r in back.select("slot").collect()) == list(range(250, total))
    one = [r.slot for r in back.where("shard = 3").select("slot").collect()]
    assert one == sorted(one)
