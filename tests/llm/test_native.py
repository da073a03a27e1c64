"""Mixing, sharding and quality rules against plain versions."""

import zlib

import pandas as pd
import pyarrow.parquet as pq
import pytest

from barwright.llm import mixing, quality, sharding
from tests.llm import brute


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return brute.awkward(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return brute.awkward(spark, tmp_path_factory.mktemp("empty"), [])


def docs_of(folder):
    return pd.DataFrame(pq.read_table(f"{folder}/documents.parquet").to_pylist())


def check_mix(out, docs):
    docs = docs.assign(size=[len(brute.words(t)) for t in docs.text])
    sizes = docs.assign(source=docs.source.where(docs.source.notna(), "\U0010ffff")).groupby("source")["size"].sum().to_dict()
    names = sorted(sizes)
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    want = brute.water_fill(sizes, weights)
    assert len(out) == len(docs)
    for _, r in out.iterrows():
        assert r.taken in (0, r["size"], 2 * r["size"])
    by_size = {}
    for s in names:
        by_size.setdefault(sizes[s], set()).add(round(want[s], 3))
    for _, r in out.iterrows():
        assert any(abs(r.target - t) < 0.01 for t in by_size[r.source_size])
    return want, sizes


def test_mix(spark, sf):
    out = mixing.query(spark, sf).toPandas()
    want, sizes = check_mix(out, docs_of(sf))
    assert abs(out.taken.sum() / (1.5 * sum(sizes.values())) - 1) < 0.1
    again = mixing.query(spark, sf).toPandas()
    assert sorted(map(tuple, out.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_mix_awkward(spark, odd, empty):
    check_mix(mixing.query(spark, odd).toPandas(), docs_of(odd))
    assert mixing.query(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.stage(spark, docs, odd)
    assert out.columns == docs.columns and 0 < out.count() <= 2 * docs.count()


def test_mix_takes_what_the_rate_says(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'w w w' AS text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source", "3L AS size")
    t = mixing.source_targets(docs, "size")
    got = mixing.emit(mixing.mix(docs, t)).groupBy("source").count().toPandas().set_index("source")["count"]
    for r in t.collect():
        assert abs(3 * got[r.mix_source] / r.mix_target - 1) < 0.05


def check_shards(out, docs, shards=8):
    assert len(out) == len(docs)
    key = lambda d: sorted((-1 if pd.isna(a) else int(a), int(b), int(c)) for a, b, c in d)
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(docs.doc_id, docs.text)]
    assert key(zip(out.doc_id, out["size"], out.text_crc32)) == key(want)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.reindex(range(shards), fill_value=0).min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_shards(spark, sf, odd, empty):
    check_shards(sharding.query(spark, sf).toPandas(), docs_of(sf))
    check_shards(sharding.query(spark, odd).toPandas(), docs_of(odd))
    assert sharding.query(spark, empty).count() == 0


def test_shuffled_order_is_random_and_writes_back(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = sharding.external_shuffle(docs, least=4)
    place = out.select("doc_id", "shuffle_position").toPandas().sort_values("doc_id").shuffle_position
    assert abs(pd.Series(range(len(place))).corr(place.reset_index(drop=True))) < 0.25
    sharding.write_shards(out, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    assert back.count() == docs.count()


def check_quality(out, docs):
    assert len(out) == len(docs)
    got = sorted(map(tuple, out.assign(doc_id=out.doc_id.fillna(-1).astype(int))[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].values.tolist()))
    want = []
    for i, t in zip(docs.doc_id, docs.text):
        ws, t = brute.words(t), t or ""
        lines = [x for x in t.split("\n") if brute.words(x)]
        rep = brute.repeated_words(ws)
        want.append((-1 if pd.isna(i) else int(i), len(ws), sum(map(len, ws)), sum(t.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), rep,
                     len(ws) < 10 or 100 * rep > 20 * len(ws)))
    assert got == sorted(want)
    assert not (out.kept & out.base_failed).any()


def test_quality(spark, sf, odd, empty):
    out = quality.query(spark, sf).toPandas()
    check_quality(out, docs_of(sf))
    check_quality(quality.query(spark, odd).toPandas(), docs_of(odd))
    assert quality.query(spark, empty).count() == 0
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().merge(out, on="doc_id")
    labels = labels[~labels.base_failed]
    assert (labels.kept == (labels.quality == 1)).mean() > 0.9
    assert labels[labels.quality == 1].kept.mean() > 0.97


def test_clean_documents_all_stay(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12 + cast(id AS int)), i -> concat('word', translate(hex(abs(hash(i, id)) % 9973), '0123456789', 'ghijklmnop')))) AS text")
    out = quality.judge(quality.measures(docs))
    assert out.where("NOT _kept").count() == 0


def test_quality_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = quality.stage(spark, docs, odd)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} >= {0, 9}


def test_one_id_of_a_third_of_all_rows_spreads(spark):
    """Repeated rows of one doc_id, and rows without an id that share a text, meet in no bucket; slots stay gapless."""
    rows = [(7, "copy")] * 2000 + [(None, "lost")] * 2000 + [(i, f"text {i}") for i in range(100, 2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = [r["count"] for r in sharding.scatter(docs, 29, least=64, hot=100).groupBy("shuffle_bucket").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 200
    out = sharding.external_shuffle(docs, least=64, hot=100).toPandas()
    assert sorted(out.shuffle_position) == list(range(6000)) and (out.doc_id == 7).sum() == 2000
    assert out.groupby("shuffle_shard").size().max() - out.groupby("shuffle_shard").size().min() <= 1
