"""Similarity join of documents by the Jaccard similarity of their shingle sets, with vertical partitioning.

A :class:`Rule` gives the words of a shingle and the least similarity: three words and 90 % in the query, five words and 80 % in the
near-duplicate stage.

Shingles are 64-bit hashes; their global order is that of the hashes, cut into fragments (ranges). Two sets of a and b shingles with
similarity ``like`` % or more differ in at most (a + b)(100 - like) / (100 + like) shingles, so over one fragment more than that some fragment is equal
in both: documents emit the hash of each fragment's shingles, and only those that share one are candidates. As fragments mix shingles from
all over a text, passages or lines that many documents have in common do not make them candidates. Sizes fall in classes whose bounds grow by
100 / like, so that partners are in the same or the next class; the number of fragments is fixed per pair of neighbouring classes.

Candidates that could still be near by size and by a 1024-bit parity sketch (differing bits are a lower bound of differing
shingles) are counted exactly: over FRAGMENTS fixed fragments of the global order, partial overlaps are counted apart and summed per pair.

Equal sets are one row throughout. Groups of at most FEW that share a fragment meet pair by pair. In larger ones all meet a lead, the member
with the most company or that one's own lead, and the difference of each set to its lead is taken: two members that differ by few shingles are both near the lead,
or their differences share many shingles, which prefixes of the differences (rarest shingle first) find. So thousands of copies with edits of their
own cost their edits rather than all pairs, and no link is lost.

Nulls: a null or blank text has an empty set and links with nothing. Rows with a null doc_id take part; a component of such rows alone has a null id. Repeated
rows share a component. Texts are read whole, however long. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window, functions as F, types as T

from barwright.llm.common import lookup, settle, table
from barwright.llm.components import components

FRAGMENTS, SKETCH, FEW = 16, 1024, 4
#: Tasks at least, and rows in a task, of the tables about those that meet.
TASKS, TASK_ROWS = 8, 500_000
#: Words whose hashes a task remembers.
WORDS = 1 << 18
#: Odd multipliers of the words of a shingle and of a fragment's number and class.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


@dataclass(frozen=True)
class Rule:
    """Words of a shingle (up to five), and the per cent of similarity from which two sets are near."""

    width: int = 3
    like: int = 90


class Known(dict):
    """Hashes of words, the first WORDS of them remembered."""

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = h
        return h


def mix(x):
    """Spreads all bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text, known, width):
    """Sorted distinct shingle hashes of a text (bytes); words are lower-cased A-Z."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    if len(ws) < width:
        return mix((h * ODD[:len(ws)]).cumsum(dtype=np.uint64)[-1:] + np.full(1, len(ws), np.uint64) * ODD[5])
    many = len(ws) - width + 1
    return np.unique(mix(sum((h[i:i + many] * ODD[i] for i in range(1, width)), h[:many] * ODD[0])))


def key_of(s):
    """Digest of a set; equal for equal sets."""
    return blake2b(s.tobytes(), digest_size=16).digest()


class Classes:
    """Size classes of a rule: partners of a class lie in it or its neighbours."""

    def __init__(self, like):
        self.like, self.low = like, [1]

    def of(self, n):
        """(number of the class of size n, fragments of it with the next class, fragments of the class before with it)."""
        while len(self.low) < 3 or self.low[-3] <= n:
            self.low.append(self.low[-1] * 100 // self.like + 1)
        c = int(np.searchsorted(self.low, n, side="right")) - 1
        return c, self.fragments(c), self.fragments(c - 1) if c else 0

    def fragments(self, c):
        return (self.low[c + 1] + self.low[c + 2] - 2) * (100 - self.like) // (100 + self.like) + 1


def signatures(s, classes):
    """Hashes of the fragments of a set: with the next class (tag 0) and with the one before (tag 1); none where only equal sets are near."""
    c, *both = classes.of(len(s))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ ODD[4]), dtype=np.uint64)])
    out = []
    for high, many in enumerate(both):
        if many < 2:
            out.append(np.zeros(0, np.uint64))
            continue
        f = ((s >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)
        cuts = np.searchsorted(f, np.arange(many + 1, dtype=np.uint64))
        out.append(mix(sums[cuts[1:]] - sums[cuts[:-1]] + np.arange(many, dtype=np.uint64) * ODD[3] + np.full(1, c - high, np.uint64) * ODD[4]))
    return out


def sketch(s):
    """Parities of the counts of shingles in SKETCH buckets, as bytes."""
    return np.packbits((np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def binary(items):
    return pa.array(items, pa.binary())


def keyed(rows, width):
    """``rows`` with n_shingles and key in place of _text."""
    def run(batches):
        known = Known()
        for b in batches:
            sets = [shingles(t, known, width) for t in b.column("_text").to_pylist()]
            yield b.drop_columns(["_text"]).append_column("n_shingles", pa.array([len(s) for s in sets], pa.int64())).append_column("key", binary([key_of(s) for s in sets]))
    fields = [*rows.drop("_text").schema.fields, T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType())]
    return rows.select(*[c for c in rows.columns if c != "_text"], "_text").mapInArrow(run, T.StructType(fields))


def sketched(src, rule):
    """key, size, parity sketch and fragment hashes of each document with shingles."""
    def run(batches):
        known, classes = Known(), Classes(rule.like)
        for b in batches:
            sets = [s for s in (shingles(t, known, rule.width) for t in b.column("_text").to_pylist()) if len(s)]
            signs = [signatures(s, classes) for s in sets]
            yield pa.RecordBatch.from_arrays([
                binary([key_of(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), binary([sketch(s) for s in sets]),
                *[binary([x[h].astype("<u8").tobytes() for x in signs]) for h in (0, 1)]], ["key", "n", "parity", "low", "high"])
    return src.select("_text").mapInArrow(run, "key binary, n long, parity binary, low binary, high binary")


def fragments(texts, width):
    """(rep, fragment, part): the shingles of each text by fragment of the global order, empty ones too."""
    def run(batches):
        known = Known()
        for b in batches:
            for rep, text in zip(b.column("rep").to_pylist(), b.column("_text").to_pylist()):
                s = shingles(text, known, width)
                cuts = np.searchsorted(s >> np.uint64(32), np.arange(FRAGMENTS + 1, dtype=np.uint64) * np.uint64((1 << 32) // FRAGMENTS))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(FRAGMENTS, rep)), pa.array(np.arange(FRAGMENTS, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(s.view(np.int64)))],
                                                 ["rep", "fragment", "part"])
    return texts.mapInArrow(run, "rep long, fragment int, part array<long>")


def members(reps):
    """(sig, rep): who shares the hash of a fragment; what only one has is pruned. Settled."""
    def run(batches):
        for b in batches:
            for name in ("low", "high"):
                blobs = b.column(name).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), "<i8")), b.column("rep").take(pa.array(np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs])))], ["sig", "rep"])
    w = Window.partitionBy("sig").orderBy("rep")
    rows = reps.select("rep", "low", "high").mapInArrow(run, "sig long, rep long")
    rows = rows.select("sig", "rep", (F.lag("rep").over(w).isNotNull() | F.lead("rep").over(w).isNotNull()).alias("met")).where("met")
    return settle(rows.select("sig", "rep"))


def parts_of(docs, reps, met, width):
    """(rep, fragment, part) of the sets that meet another, settled: read from one text each."""
    alive = settle(reps.select("key", "rep").join(met.select("rep").distinct(), "rep", "left_semi"))
    found = lookup(keyed(docs.select("_text", F.col("_text").alias("_raw")), width), alive.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "inner", 50_000)
    one = found.groupBy("rep").agg(F.first("_raw").alias("_text"))
    return settle(fragments(one, width))


def beside(pairs, parts, *keep):
    """``pairs`` (a, b, ...) with both parts (pa, pb) of each fragment."""
    left = pairs.join(parts.select(F.col("rep").alias("a"), "fragment", F.col("part").alias("pa")), "a")
    return left.join(parts.select(F.col("rep").alias("b"), "fragment", F.col("part").alias("pb")), ["b", "fragment"]).select("a", "b", *keep, "pa", "pb")


def near(pairs, parts, like):
    """The pairs (a, b, na, nb) whose overlaps, counted per fragment and summed, make ``like`` per cent or more of their union."""
    keys = ("a", "b", "na", "nb")
    over = beside(pairs, parts, "na", "nb").select(*keys, F.size(F.array_intersect("pa", "pb")).alias("o")).groupBy(*keys).agg(F.sum("o").alias("o"))
    return over.where(100 * F.col("o") >= like * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def possible(pairs, sides, like):
    """Distinct pairs (a, b, na, nb) that sizes and sketches allow."""
    side = lambda x: sides.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), *[F.col(f"p{i}").alias(f"{x}{i}") for i in range(SKETCH // 64)])
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, SKETCH // 64)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    fits = (100 * F.least("na", "nb") >= like * F.greatest("na", "nb")) & ((100 + like) * apart <= (100 - like) * (F.col("na") + F.col("nb")))
    return pairs.where(fits).select("a", "b", "na", "nb")


def allowed(total, like):
    """How many shingles two near sets of ``total`` shingles together may differ in."""
    return F.floor(total * (100 - like) / (100 + like) + 1e-9)


def by_lead(met, keep):
    """(small, led): pairs (a, b) of the groups of at most FEW, and (rep, lead, company of the lead) of the larger ones. Both kept.

    All members of a group have one lead in common, which need not be of the group.
    """
    sized = met.join(met.groupBy("sig").agg(F.count(F.lit(1)).alias("m")), "sig")
    company = sized.groupBy("rep").agg(F.sum("m").alias("company"))
    rows = keep(sized.join(company, "rep"))
    few = rows.where(F.col("m") <= FEW).groupBy("sig").agg(F.collect_list("rep").alias("reps"))
    few = few.select("reps", F.explode("reps").alias("a")).select("a", F.explode("reps").alias("b")).where("a < b").distinct()
    many = rows.where(F.col("m") > FEW)
    lead = many.groupBy("sig").agg(F.max(F.struct("company", F.col("rep").alias("lead"))).alias("l")).select("sig", "l.company", "l.lead")
    # groups of copies of one text have many leads: a lead that is itself led gives its groups to the one with the most company
    above = many.select("sig", "rep").join(lead, "sig").groupBy(F.col("rep").alias("_rep")).agg(F.max(F.struct("company", "lead")).alias("top"))
    lead = lead.join(above, F.col("lead") == F.col("_rep")).select("sig", "top.company", "top.lead")
    led = many.select("sig", "rep").join(lead, "sig").where(F.col("rep") != F.col("lead")).select("rep", "lead", "company").distinct()
    return keep(few), keep(led)


def by_difference(led, edges, sides, parts, like, keep):
    """Pairs (a, b) of one lead that may be near though they are not both near the lead, nor both near some other one; None if there are none to look at.

    A member's root is, of the leads that it is near to, the one with the most company, else itself: members of one root are connected.
    """
    near_to = edges.select(F.col("a").alias("rep"), F.col("b").alias("lead")).unionByName(edges.select(F.col("b").alias("rep"), F.col("a").alias("lead")))
    rows = led.join(near_to.distinct().withColumn("home", F.lit(True)), ["rep", "lead"], "left").withColumn("home", F.coalesce("home", F.lit(False)))
    root = rows.where("home").groupBy("rep").agg(F.max(F.struct("company", "lead")).alias("r")).select(F.col("rep").alias("_rep"), F.col("r.lead").alias("_root"))
    rows = rows.join(root, F.col("rep") == F.col("_rep"), "left").select("rep", "lead", "home", F.coalesce("_root", "rep").alias("root"))
    apart = rows.groupBy("lead").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("home").alias("all")).where("lo <> hi AND NOT all").select("lead")
    sizes = sides.select(F.col("rep").alias("_rep"), "n")
    rows = rows.join(apart, "lead").join(sizes, F.col("rep") == F.col("_rep")).drop("_rep")
    rows = keep(rows.join(sizes.select("_rep", F.col("n").alias("nr")), F.col("lead") == F.col("_rep")).drop("_rep"))
    if rows.isEmpty():
        return None
    spans = rows.groupBy("lead").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    parted = keep(beside(rows.select(F.col("rep").alias("a"), F.col("lead").alias("b")), parts).select(
        F.col("a").alias("rep"), F.col("b").alias("lead"), F.explode(F.concat(F.array_except("pa", "pb"), F.array_except("pb", "pa"))).alias("token")))
    common = parted.groupBy("lead", "token").agg(F.count(F.lit(1)).alias("df"))
    sets = parted.join(common, ["lead", "token"]).groupBy("rep", "lead").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    sets = sets.join(rows, ["rep", "lead"]).join(spans, "lead").withColumn("d", F.size("tokens"))
    d, n = F.col("d"), F.col("n")
    # the most that partners can differ by, and the least that they differ from the lead by: those of a member near the lead are not near it
    room = allowed(n + F.least(F.col("most"), F.floor(n * 100 / like + 1e-9)), like)
    away = F.when(F.col("home"), allowed(F.col("nr") + F.greatest(F.col("least"), F.ceil(n * like / 100 - 1e-9)), like) + 1).otherwise(0)
    need = lambda other: F.greatest(F.lit(1), F.ceil((d + other - room) / 2))
    sets = sets.withColumns({"short": d - need(F.greatest(d, away)) + 1, "long": d - need(F.greatest(d - room, F.lit(0), away)) + 1})
    spread = F.explode(F.transform(F.slice("tokens", 1, F.greatest("short", "long", F.lit(0)).cast("int")), lambda x, i: F.struct(x["token"].alias("token"), i.alias("i"))))
    long = keep(sets.select("rep", "lead", "root", "home", "n", "d", "short", "long", spread.alias("x")).select("*", "x.token", "x.i").drop("x"))
    several = long.groupBy("lead", "token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("lead", "token")
    long = long.join(several, ["lead", "token"])
    short = long.where("i < short").select("lead", "token", F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("home").alias("ha"), F.col("n").alias("na"), F.col("d").alias("da"))
    fits = (F.col("root") != F.col("ra")) & ~(F.col("home") & F.col("ha")) & (F.col("da") <= F.col("d")) & (
        100 * F.least("n", "na") >= like * F.greatest("n", "na")) & (F.col("d") - F.col("da") <= allowed(F.col("n") + F.col("na"), like))
    return short.join(long.where("i < long"), ["lead", "token"]).where(fits).select("a", F.col("rep").alias("b"))


def tasks_for(rows):
    """Tasks that suffice for tables of up to so many rows about those that meet."""
    return max(TASKS, rows // TASK_ROWS)


def classes_of(src, rule):
    """(reps, linked): rep and key of every distinct set of the texts in ``_text``, and (node, component) of those that link with another; settled."""
    each = sketched(src, rule).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "parity", "low", "high")])
    reps = settle(each.select(F.monotonically_increasing_id().alias("rep"), "*"))
    met = members(reps)
    # what follows is of the size of ``met`` at most; small tables stay in few tasks and files
    tasks = tasks_for(met.count())
    keep = lambda df: settle(df.coalesce(tasks))
    parts = parts_of(src, reps, met, rule.width)
    longs = [F.conv(F.hex(F.substring("parity", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"p{i}") for i in range(SKETCH // 64)]
    sides = keep(reps.join(met.select("rep").distinct(), "rep", "left_semi").select("rep", "n", *longs))
    small, led = by_lead(met, keep)
    edges = keep(near(possible(small.unionByName(led.select(F.col("rep").alias("a"), F.col("lead").alias("b"))), sides, rule.like), parts, rule.like))
    more = by_difference(led, edges, sides, parts, rule.like, keep)
    if more is not None:
        edges = edges.unionByName(keep(near(possible(more, sides, rule.like), parts, rule.like)))
    linked = components(edges, tasks=tasks)
    return reps.select("rep", "key"), linked


def join(docs, rule=Rule()):
    """``docs`` (doc_id, text) as doc_id, n_shingles, component_id: the least doc_id reachable over links of similar sets."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    rows = settle(keyed(src, rule.width))
    firsts = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    reps, linked = classes_of(src, rule)
    ids = firsts.join(reps, "key").join(linked, F.col("rep") == F.col("node"), "left")
    ids = settle(ids.select("key", "first", F.coalesce("component", "rep").alias("root")))
    ids = ids.join(ids.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("key", "component_id")
    out = rows.join(ids.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir):
    """Set size and component of every document."""
    return join(table(spark, sf_dir, "documents"))
