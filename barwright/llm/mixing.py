"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source (partial sums before the shuffle, so a hot source is one row per task), targets give each
source a repetition rate, and every document is emitted floor(rate) times plus once more if a hash of its own falls
below the fraction. Decisions depend on the row alone, so reruns agree.

Nulls: a null source is a source of its own, the last; a null text or size counts 0 words and is emitted like any other.
Repeated rows share one decision. A source without words has target and rate 0. Empty tables give empty results.
Columns of the documents keep their names; those added start with ``mix_``.
"""

from pyspark.sql import Window, functions as F

from barwright.llm.common import lookup, settle, text_of, words

#: Weights by rank of the source, total target against all words, most repetitions of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def source_targets(docs, size, weights=WEIGHTS, share=SHARE, most=MOST):
    """One row per source: mix_source, mix_source_size, mix_target, mix_rate.

    Sources are ranked by code point, null last; the weights repeat along the ranks. A target stops at ``most`` times
    its source's size and the excess is shared among the rest by weight until none is above: with sources in order of
    size per weight, the capped ones come first, and the level of the rest follows from running sums. The windows run
    over one row per source of the recipe.
    """
    s = docs.groupBy(F.col("source").alias("mix_source")).agg(F.coalesce(F.sum(size).cast("long"), F.lit(0).cast("long")).alias("mix_source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    cap = F.lit(most) * F.col("mix_source_size")
    s = s.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_fill", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_fill", F.col("mix_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.lit(share) * F.sum("mix_source_size").over(everything)
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    level = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", F.col("mix_source").isNull(), "mix_source", "_level"))).over(everything)["_level"]
    s = s.withColumn("mix_target", F.when(level.isNull(), F.col("_cap")).otherwise(F.least("_cap", level * F.col("_w"))))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    return s.select("mix_source", "mix_source_size", "mix_target", rate.alias("mix_rate"))


def mix(docs, targets, seed=17, identity=("doc_id", "text")):
    """``docs`` with mix_source_size, mix_target and mix_copies, how often the mix takes the row.

    ``identity`` names the columns whose hash decides the extra copy.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in identity]), 11) / float(1 << 53)
    rate = F.col("mix_rate")
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    out = lookup(docs, targets, F.col("source").eqNullSafe(F.col("mix_source")))
    return out.withColumn("mix_copies", copies.cast("long")).drop("mix_source", "mix_rate")


def emit(mixed):
    """The rows of the mix: each row of ``mixed`` as often as its copies say."""
    many = mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return many.drop("mix_copy", "mix_copies", "mix_source_size", "mix_target")


def measured(docs):
    """doc_id, source, mix_size (words of the text) and the text's hash, without the text."""
    return docs.select("doc_id", "source", F.size(words(text_of())).cast("long").alias("mix_size"), F.xxhash64("text").alias("mix_text"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: the documents as often as the mix takes them, with the columns they came with."""
    sized = docs.select("source", F.size(words(text_of())).cast("long").alias("_size"))
    return emit(mix(docs, settle(source_targets(sized, "_size")))).select(*docs.columns)


def query(spark, sf_dir):
    """Every document with the words that the mix takes from it."""
    sized = settle(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    mixed = mix(sized, settle(source_targets(sized, "mix_size")), identity=("doc_id", "mix_text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
