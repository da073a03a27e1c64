"""One-permutation MinHash fingerprints, with DataFrame functions only.

The five-word shingles of a text are hashed once. The low bits of a hash name one of 128 bins and the rest is its
value; each bin keeps its least value. An empty bin borrows from the first bin that is not empty in a fixed random order
of its own (optimal densification). The low eight bits of the 128 values are packed into 16 longs. Likeness is the share of
equal bins, corrected for the chance 1/256 that low bits agree.

Everything of one text happens inside its row, so neither copies nor frequent words meet in a task.

Nulls: a null text is empty. A text with words but fewer than five is one shingle; one without words has an empty
fingerprint, which is like another empty one and unlike all others. Equal texts have equal fingerprints.
"""

from pyspark.sql import Window, functions as F

from barwright.llm.common import let, lookup, settle, text_of, windows_of, words

WIDTH = 5
BINS = 128
BIN_BITS = 7
VALUE_BITS = 64 - BIN_BITS
#: The largest value stands for an empty bin; a hash that has it by chance counts as absent.
EMPTY = (1 << VALUE_BITS) - 1
LOW = 8
#: Documents are dealt in blocks of so many ids to find each one's successor.
BLOCK = 256
#: Blocks whose heads are broadcast.
HEADS = 100_000


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def shingles(ws):
    return F.when(F.size(ws) >= WIDTH, windows_of(ws, WIDTH)).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))


def _bin(key):
    return F.shiftrightunsigned(key, VALUE_BITS)


def _value(key):
    return key.bitwiseAND(F.lit(EMPTY))


def least_per_bin(hashes):
    """128 keys, bin in the top bits and least value below, in signed order; one marker per bin stands behind all hashes."""
    keys = F.transform(hashes, lambda h: F.shiftleft(h, VALUE_BITS).bitwiseOR(F.shiftrightunsigned(h, BIN_BITS)))
    markers = F.array(*[F.lit(_signed((b << VALUE_BITS) | EMPTY)) for b in range(BINS)])
    return let(F.array_sort(F.concat(keys, markers)), lambda s: F.filter(s, lambda k, i: (i == 0) | (_bin(k) != _bin(F.get(s, i - 1)))))


def densify(least):
    """The values of the bins; empty ones take that of the first full bin in their own order of all bins."""
    def fill(full):
        def borrow(k):
            order = F.transform(full, lambda f: F.xxhash64(_bin(k), _bin(f)).bitwiseAND(F.lit(~(BINS - 1))).bitwiseOR(_bin(f)))
            chosen = F.array_min(order).bitwiseAND(F.lit(BINS - 1))
            return _value(F.get(least, ((chosen + BINS // 2) % BINS).cast("int")))
        return F.transform(least, lambda k: F.when(_value(k) == EMPTY, borrow(k)).otherwise(_value(k)))
    return let(F.filter(least, lambda k: _value(k) != EMPTY), lambda full: F.when(F.size(full) == BINS, F.transform(least, _value)).otherwise(fill(full)))


def pack(values):
    """Low bits of the bins, eight bins to a long."""
    per = 64 // LOW

    def word(g):
        out = F.get(values, g * per).bitwiseAND(F.lit((1 << LOW) - 1))
        for i in range(1, per):
            out = out.bitwiseOR(F.shiftleft(F.get(values, g * per + i).bitwiseAND(F.lit((1 << LOW) - 1)), LOW * i))
        return out
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), word)


def fingerprint(text):
    """Packed fingerprint of a text: 16 longs, none for a text without words."""
    return let(shingles_of(text), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
        let(least_per_bin(h), lambda x: let(densify(x), pack))))


def shingles_of(text):
    return let(words(text), shingles)


def likeness(a, b):
    """Estimate of the Jaccard similarity from two packed fingerprints."""
    x = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))

    def unequal(v):
        v = v.bitwiseOR(F.shiftrightunsigned(v, 4))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        return F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))
    p = 1 - F.aggregate(x, F.lit(0), lambda s, v: s + unequal(v)) / float(BINS)
    chance = 1.0 / (1 << LOW)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (p - chance) / (1 - chance)))


def as_text(fp):
    return F.lower(F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def following_blocks(blocks):
    """``blocks`` (block, distinct) with the block that comes next, the first after the last.

    Blocks are dealt by range and settled with the number of their range, so that windows see one range each and a
    table of one row per range joins them.
    """
    ranged = settle(blocks.repartitionByRange("block").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("block").alias("first"))
    ring = Window.orderBy("part")
    firsts = firsts.select(F.col("part").alias("_part"), F.coalesce(F.lead("first").over(ring), F.min("first").over(Window.partitionBy())).alias("_next"))
    inside = F.lead("block").over(Window.partitionBy("part").orderBy("block"))
    return ranged.withColumn("_in", inside).join(firsts, F.col("part") == F.col("_part")).select("block", F.coalesce("_in", "_next").alias("next_block"))


def with_next(docs, columns, add=lambda d: d):
    """Each row with next_<column> of the row that follows by ascending doc_id, the first after the last.

    ``add`` works out further columns of a row; only rows that need it, all once and the first of each block again, pay for it.
    The heads of the blocks are one row in 256; their table is broadcast up to HEADS rows and joined by doc_id beyond it.

    Rows with a null doc_id come before all others, in order of their text's hash.
    """
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "_tie")
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK).cast("long"), F.lit(-(1 << 62)))
    dealt = docs.withColumn("block", block).withColumn("_tie", F.xxhash64("text"))
    everyone = add(dealt)
    ids = docs.select(block.alias("block"), "doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie"))
    first = settle(ids.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie")).alias("f")))
    follows = following_blocks(first.select("block")).join(first.select(F.col("block").alias("next_block"), "f"), "next_block")
    follows = settle(follows.select(F.col("block").alias("_block"), F.col("f.doc_id").alias("_id"), F.col("f.tie").alias("_t")))
    heads = lookup(dealt, follows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t").isNull() | (F.col("_tie") == F.col("_t"))), "inner", HEADS)
    heads = add(heads)
    # rows that share a doc_id share their place: the least of them by hash is the head
    heads = heads.groupBy("_block").agg(F.min_by(F.struct(*[F.col(c).alias(f"head_{c}") for c in columns]), F.col("_tie")).alias("head"))
    inside = everyone.select("*", *[F.lead(F.struct(c)).over(order).alias(f"_next_{c}") for c in columns])
    out = inside.join(heads, F.col("block") == F.col("_block"), "left")
    for c in columns:
        out = out.withColumn(f"next_{c}", F.when(F.col(f"_next_{c}").isNotNull(), F.col(f"_next_{c}.{c}")).otherwise(F.col(f"head.head_{c}")))
    return out.drop("block", "_tie", "_block", "head", *[f"_next_{c}" for c in columns])


def query(spark, sf_dir):
    """Fingerprints of every text and of its edited text, whose second half is the start of the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_of().alias("text"))
    d = with_next(docs, ["text", "fp"], lambda x: x.withColumn("fp", fingerprint("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next_fp"), edited.alias("edited"))
    d = d.withColumn("edited_fp", fingerprint("edited"))
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"),
                    as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
