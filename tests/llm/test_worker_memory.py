"""What a Python worker holds while and after it works for the pipeline."""

import gc

import pyarrow as pa

from barwright.llm import packing, subwords
from barwright.llm.common import parts


def most_words(batches):
    """The most words that a WordIds of this worker remembers."""
    list(batches)
    yield pa.record_batch([pa.array([max([0, *(len(x.known) for x in gc.get_objects() if isinstance(x, subwords.WordIds))])])], ["n"])


def test_workers_of_the_pipeline_remember_few_words(spark):
    docs = spark.range(0, 3_000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 99), i -> concat('w', id * 100 + i, 'x'))) AS text")
    out = packing.stage(spark, docs, None)
    assert out.select("doc_id").distinct().count() == 3_000
    left = spark.range(0, 64, 1, 64).mapInArrow(most_words, "n long").collect()
    assert max(r.n for r in left) == packing.STAGE_WORDS == 200_000  # the texts have 300,000


def test_parts_of_batches_are_whole():
    batches = [pa.record_batch([pa.array(range(a, a + n), pa.int64())], ["i"]) for a, n in ((0, 1_700), (1_700, 0), (1_700, 500), (2_200, 1))]
    cut = list(parts(batches))
    assert [i for b in cut for i in b.column("i").to_pylist()] == list(range(2_201)) and max(b.num_rows for b in cut) == 500
